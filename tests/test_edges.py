"""Edge rows per operator (nulls, boundaries, batch duplicates)."""

import datetime as dt
from decimal import Decimal as Dec

from conftest import rows
from pyspark.sql import functions as F

from innlytics.functions import scalar as E
from innlytics.operators import apply as A
from innlytics.operators import booking as B
from innlytics.operators import changes as CH
from innlytics.operators import quality as Q
from innlytics.sources import catalog as C

D = dt.date


def _add_stay(spark, t, res_id, room, ci, co, status=2):
    res = spark.createDataFrame([(res_id, 1, dt.datetime(2026, 1, 1), status, None)], t.reservasi.schema)
    stay = spark.createDataFrame([(res_id * 100, res_id, room, ci, co, Dec("1.00"))], t.detail_reservasi.schema)
    return t.with_(reservasi=t.reservasi.unionByName(res), detail_reservasi=t.detail_reservasi.unionByName(stay))


def test_b2_null_room_modes(spark, seed):
    t = _add_stay(spark, seed, 50, None, D(2026, 1, 15), D(2026, 1, 16))
    req = spark.createDataFrame([(f"r{k}", k, D(2026, 1, 15), D(2026, 1, 17)) for k in range(1, 5)],
                                "request_id string, tipe_id long, tanggal_checkin date, tanggal_checkout date")
    assert sorted(rows(B.available_rooms(t, req), "tersedia")) == [(0,)] * 4
    got = dict(rows(B.available_rooms(t, req, null_mode="ignore"), "request_id", "tersedia"))
    assert [got[f"r{k}"] for k in range(1, 5)] == [1, 1, 2, 3]


def test_b2_b3_same_day_turnover(spark, seed):
    # room 1 is busy 2026-01-14..16: a stay starting on the 16th is free
    req = spark.createDataFrame([("x", 1, D(2026, 1, 16), D(2026, 1, 17))],
                                "request_id string, kamar_id long, tanggal_checkin date, tanggal_checkout date")
    assert rows(B.booking_conflicts(seed, req), "jumlah_konflik") == [(0,)]
    req2 = req.withColumn("tanggal_checkin", F.lit(D(2026, 1, 15)))
    assert rows(B.booking_conflicts(seed, req2), "jumlah_konflik") == [(1,)]


def test_b3_invalid_request_range(spark, seed):
    # checkout <= checkin: counts stays covering the reversed range, like SQL
    req = spark.createDataFrame([("x", 1, D(2026, 1, 15), D(2026, 1, 15))],
                                "request_id string, kamar_id long, tanggal_checkin date, tanggal_checkout date")
    assert rows(B.booking_conflicts(seed, req), "jumlah_konflik") == [(1,)]


def test_v1_and_b6(spark):
    df = spark.createDataFrame([(1, D(2026, 1, 2), D(2026, 1, 2)), (2, D(2026, 1, 2), None), (3, None, None)],
                               "id long, tanggal_checkin date, tanggal_checkout date")
    out = B.stay_defaults(df, "2026-03-01")
    got = {r["id"]: (r["tanggal_checkin"], r["tanggal_checkout"]) for r in out.collect()}
    assert got[2] == (D(2026, 1, 2), D(2026, 3, 2)) and got[3] == (D(2026, 3, 1), D(2026, 3, 2))
    valid, bad = Q.split(Q.validate_stays(out))
    assert sorted(r["id"] for r in valid.collect()) == [2, 3]
    assert [r["id"] for r in bad.collect()] == [1]


def test_b10_invoice_padding(spark):
    df = spark.createDataFrame([(7,), (1234,)], "reservasi_id long")
    got = sorted(r["nomor_invoice"] for r in B.invoice_numbers(df, "2026-02-10").collect())
    assert got == ["INV-202602-007", "INV-202602-1234"]


def test_e10_rupiah_half_up(spark):
    df = spark.createDataFrame([(Dec("950000"),), (Dec("2.5"),)], "x decimal(20,2)")
    assert sorted(r[0] for r in df.select(E.rupiah("x")).collect()) == ["3", "950.000"]


def test_q1_php_empty(spark):
    df = spark.createDataFrame([(1, "0", 0.0), (2, "0.0", 5.0), (3, "", None)], "id long, s string, x double")
    out = {r["id"]: list(r["reasons"]) for r in Q.required(df, ["s", "x"]).collect()}
    assert out[1] == ["Field 's' wajib diisi", "Field 'x' wajib diisi"] and out[2] == []
    assert len(out[3]) == 2


def test_b7_first_in_order_wins(spark, seed):
    req = spark.createDataFrame(
        [(2, 1, 12, D(2026, 3, 1), D(2026, 3, 3), None), (1, 2, 12, D(2026, 3, 2), D(2026, 3, 4), None),
         (3, 3, 12, D(2026, 3, 4), D(2026, 3, 5), None), (4, 4, 6, D(2026, 1, 15), D(2026, 1, 16), None)],
        "req_seq long, tamu_id long, kamar_id long, tanggal_checkin date, tanggal_checkout date, promo_id long")
    res = A.apply_bookings(seed, req, "2026-02-20")
    assert sorted(r["req_seq"] for r in res.accepted.collect()) == [1, 3]
    rej = {r["req_seq"]: list(r["reasons"]) for r in res.rejected.collect()}
    assert rej[2] == [A.MSG_BOOKED] and rej[4] == [A.MSG_BOOKED]
    acc = {r["req_seq"]: r for r in res.accepted.collect()}
    assert (acc[1]["id_reservasi"], acc[3]["id_reservasi"]) == (11, 12)
    assert acc[1]["harga"] == Dec("850000.00")
    lines = sorted(r["aktivitas"] for r in res.audit.collect())
    assert "Reservasi baru #11 untuk tamu ID 2" in lines and "Buat reservasi #12 untuk tamu ID 3" in lines


def test_b8_checkin_duplicate_and_status(spark, seed):
    req = spark.createDataFrame([(1, 7, None), (2, 10, 3), (3, 10, 2)], "req_seq long, reservasi_id long, pegawai_id long")
    res = A.apply_status_action(seed, req, "checkin", "2026-01-20")
    assert rows(res.accepted, "reservasi_id", "pegawai_id") == [(10, 3)]
    assert sorted(r["req_seq"] for r in res.rejected.collect()) == [1, 3]
    st = dict(rows(res.tables.reservasi, "id_reservasi", "status_reservasi_id"))
    assert st[10] == C.RES_CHECKED_IN
    kamar = dict(rows(res.tables.kamar, "id_kamar", "status_id"))
    assert kamar[11] == C.ROOM_OCCUPIED


def test_b9_payments(spark, seed):
    req = spark.createDataFrame([(1, 9, 1, Dec("0")), (2, 10, 2, Dec("850000")), (3, 1, 1, Dec("5")),
                                 (4, 99, 1, Dec("5")), (5, 10, 1, Dec("1"))],
                                "req_seq long, reservasi_id long, metode_id long, total decimal(20,2)")
    res = A.apply_payments(seed, req, "2026-02-05")
    assert rows(res.accepted, "req_seq", "nomor_invoice") == [(2, "INV-202602-010")]
    assert sorted(r["req_seq"] for r in res.rejected.collect()) == [1, 3, 4, 5]
    assert [r["aktivitas"] for r in res.audit.collect()] == ["Pembayaran reservasi #10 - Rp850.000"]


def test_b11_registrations_sequential(spark, seed):
    req = spark.createDataFrame([
        (1, "new1", "n1@x.com", "pw", "N1", "1"),
        (2, "new2", "N1@x.com", "pw", "N2", "1"),   # email taken by 1 (case-insensitive)
        (3, "new2", "n3@x.com", "pw", "N3", "1"),   # username of 2, but 2 was refused
        (4, "ADMIN1", "z@x.com", "pw", "N4", "1"),  # existing login
        (5, "new5", "dian@email.com", "pw", "N5", "1"),  # guest email without login
        (6, "new6", "n6@x.com", "pw", "N6", "0"),   # telepon '0' is empty
    ], "req_seq long, username string, email string, password string, nama string, telepon string")
    res = A.apply_registrations(seed, req.withColumn("alamat", F.lit(None).cast("string")), "2026-02-01")
    assert sorted(r["req_seq"] for r in res.accepted.collect()) == [1, 3]
    assert sorted(r["req_seq"] for r in res.rejected.collect()) == [2, 4, 5, 6]
    assert "password" not in res.extra["users"].columns
    assert sorted(r["id_user"] for r in res.extra["users"].collect()) == [9, 10]


def test_b12_b13_b14_rooms(spark, seed):
    ins = spark.createDataFrame([(1, "501", 1, None), (2, "101", 1, None), (3, "502", None, None)],
                                "req_seq long, nomor_kamar string, tipe_id long, status_id long")
    r = A.apply_room_inserts(seed, ins)
    assert rows(r.accepted, "id_kamar", "nomor_kamar", "status_id") == [(17, "501", 1)]
    patch = spark.createDataFrame([(1, 8, None, None, 1), (2, 8, "204B", None, None), (3, 3, None, None, None)],
                                  "req_seq long, id_kamar long, nomor_kamar string, tipe_id long, status_id long")
    u = A.apply_room_updates(seed, patch)
    k = {r["id_kamar"]: (r["nomor_kamar"], r["status_id"]) for r in u.tables.kamar.collect()}
    assert k[8] == ("204B", 1) and k[3] == ("103", 2)
    assert [r["req_seq"] for r in u.rejected.collect()] == [3]
    keys = spark.createDataFrame([(1, 5)], "req_seq long, id_kamar long")
    d = A.apply_room_deletes(seed, keys).tables
    assert d.kamar.count() == 15 and d.kamar_fasilitas.where("kamar_id = 5").count() == 0
    assert d.ulasan.where("kamar_id = 5").count() == 0
    assert d.detail_reservasi.where("kamar_id IS NULL").count() == 1
    assert Q.orphans(d.kamar_fasilitas, "kamar_id", d.kamar, "id_kamar").count() == 0


def test_c1_null_guest_quarantined(spark, seed):
    res = spark.createDataFrame([(20, None, dt.datetime(2026, 1, 1), 1, None)], seed.reservasi.schema)
    lines, bad = CH.audit_new_reservations(res)
    assert lines.count() == 0 and bad.count() == 1


def test_c2_null_status_never_fires(spark):
    feed = spark.createDataFrame([(1, dt.datetime(2026, 1, 1, h), h, s) for h, s in [(1, 1), (2, None), (3, 2), (4, 2)]],
                                 C.FEED_SCHEMA)
    assert rows(CH.status_transitions(feed), "old_status", "new_status") == []
    feed2 = spark.createDataFrame([(1, dt.datetime(2026, 1, 1, h), h, s) for h, s in [(1, 1), (2, 2), (5, 3)]],
                                  C.FEED_SCHEMA)
    assert sorted(rows(CH.status_transitions(feed2), "old_status", "new_status")) == [(1, 2), (2, 3)]


def test_c4_overwrites_maintenance(spark, seed):
    # room 8 is in Maintenance; a checked-out stay in it sets it to 1
    t = _add_stay(spark, seed, 60, 8, D(2026, 1, 1), D(2026, 1, 2), status=2)
    tr = spark.createDataFrame([(60, dt.datetime(2026, 1, 2), 1, 2, 3)],
                               "reservasi_id long, ts timestamp_ntz, seq long, old_status long, new_status long")
    kamar = dict(rows(CH.room_status_after(t.kamar, tr, t.detail_reservasi), "id_kamar", "status_id"))
    assert kamar[8] == C.ROOM_FREE


def test_q2_q4_q5(spark, seed):
    assert Q.unique(seed.tamu, ["email"], case_insensitive=True).count() == 0
    assert Q.unique(seed.kamar_fasilitas, ["kamar_id", "fasilitas_id"]).count() == 0
    assert Q.in_range(seed.ulasan, "rating", 1, 5).count() == 0
    assert Q.orphans(seed.detail_reservasi, "kamar_id", seed.kamar, "id_kamar").count() == 0
    assert Q.exists(seed.pembayaran, "reservasi_id", seed.reservasi, "id_reservasi").count() == 8


def test_b7_procedure_mode(spark, seed):
    # no conflict check; a room without type has a NULL price and is refused
    kamar = seed.kamar.unionByName(spark.createDataFrame([(17, "501", None, 1)], seed.kamar.schema))
    t = seed.with_(kamar=kamar)
    req = spark.createDataFrame(
        [(1, 1, 6, D(2026, 1, 15), D(2026, 1, 16), None), (2, 2, 17, D(2026, 3, 1), D(2026, 3, 2), None)],
        "req_seq long, tamu_id long, kamar_id long, tanggal_checkin date, tanggal_checkout date, promo_id long")
    res = A.apply_bookings(t, req, "2026-02-20", check_conflicts=False)
    assert [r["req_seq"] for r in res.accepted.collect()] == [1]
    assert [list(r["reasons"]) for r in res.rejected.collect()] == [[A.MSG_PRICE_NULL]]


def test_s1_s2_write_and_read_tables(spark, seed, tmp_path):
    from innlytics.sources import files
    root = str(tmp_path / "db")
    for name in ("reservasi", "detail_reservasi", "pembayaran", "kamar", "tamu"):
        rej = files.write_table(getattr(seed, name), root, name, mode="overwrite")
        assert rej.count() == 0
    held = {"reservasi", "detail_reservasi", "pembayaran", "kamar", "tamu"}
    back = files.read_tables(spark, root, absent=set(files.catalog.SCHEMAS) - held)
    assert back.detail_reservasi.count() == 12 and back.kamar.count() == 16
    assert back.ulasan.count() == 0 and back.status_reservasi.count() == 4
    # month partitions prune: one folder per check-in month
    assert sorted(p.name for p in (tmp_path / "db" / "detail_reservasi").iterdir() if p.is_dir()) == [
        "bulan=2025-12", "bulan=2026-01"]


def test_b2_null_dates_count_every_free_room(spark, seed):
    req = spark.createDataFrame([("n", 1, None, D(2026, 1, 17))],
                                "request_id string, tipe_id long, tanggal_checkin date, tanggal_checkout date")
    assert rows(B.available_rooms(seed, req), "tersedia") == [(3,)]
