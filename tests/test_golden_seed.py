"""Golden answers on the hand-checked seed (state A) and after the committed
demo reservation (state B)."""

import datetime as dt
from decimal import Decimal as Dec

from conftest import rows
from pyspark.sql import functions as F

from innlytics.operators import booking as B
from innlytics.operators import dashboard as D
from innlytics.operators import derived as X
from innlytics.operators import listings as L
from innlytics.operators import reports as R


def test_r1_occupancy(seed):
    assert rows(R.occupancy_by_month(seed)) == [("2025-12", 1, 16, Dec("6.25")), ("2026-01", 7, 16, Dec("43.75"))]


def test_r2_revenue(seed, seed_b):
    assert rows(R.revenue_by_month(seed)) == [("2025-12", 1, Dec("1200000.00")), ("2026-01", 7, Dec("4675000.00"))]
    assert rows(R.revenue_by_month(seed_b))[-1] == ("2026-02", 1, Dec("850000.00"))
    assert R.revenue_by_month(seed, aliases="script").columns == ["bulan", "jumlah", "total"]


def test_r3_top_guests(seed):
    assert rows(R.top_guests(seed, 5)) == [
        ("Andi Pratama", "andi@email.com", 2, Dec("1490000.00")),
        ("Budi Santoso", "budi@email.com", 2, Dec("1700000.00")),
        ("Citra Dewi", "citra@email.com", 1, Dec("1200000.00")),
        ("Dian Permata", "dian@email.com", 1, Dec("595000.00")),
        ("Eka Putra", "eka@email.com", 1, Dec("350000.00"))]


def test_r4_rating(seed):
    assert rows(R.rating_by_room_type(seed)) == [
        ("Suite", 1, Dec("5.00")), ("Standard", 2, Dec("4.00")), ("Deluxe", 2, Dec("3.50")),
        ("Superior", 1, Dec("3.00"))]


def test_r4_type_without_review_last(spark, seed):
    extra = spark.createDataFrame([(5, "Penthouse", Dec("9.00"), 6)], seed.tipe_kamar.schema)
    out = rows(R.rating_by_room_type(seed.with_(tipe_kamar=seed.tipe_kamar.unionByName(extra))))
    assert out[-1] == ("Penthouse", 0, None)


def test_r5_to_r10(seed, seed_b):
    assert rows(R.promo_usage(seed)) == [("LOYALTY", Dec("10.00"), 2), ("NEWYEAR", Dec("20.00"), 1),
                                         ("WEEKEND", Dec("15.00"), 1)]
    assert rows(R.total_revenue(seed)) == [(Dec("5875000.00"),)]
    assert rows(R.total_revenue(seed_b)) == [(Dec("6725000.00"),)]
    assert abs(rows(R.average_rating(seed))[0][0] - 23 / 6) < 1e-12
    assert rows(R.max_room_price(seed)) == [(Dec("1500000.00"),)]
    assert rows(R.min_room_price(seed)) == [(Dec("350000.00"),)]
    assert rows(R.reservations_by_status(seed)) == [("Baru", 3), ("Check-in", 3), ("Check-out", 3),
                                                    ("Dibatalkan", 1)]
    assert rows(R.reservations_by_status(seed_b))[0] == ("Baru", 4)


def test_sql_api_over_registered_views(spark, seed):
    # the tables are also usable from spark.sql (temporary views)
    seed.register_views(prefix="seed_")
    longest = spark.sql("SELECT max(datediff(tanggal_checkout, tanggal_checkin)) AS nights FROM seed_detail_reservasi")
    stays = rows(seed.detail_reservasi, "tanggal_checkin", "tanggal_checkout")
    assert rows(longest) == [(max((co - ci).days for ci, co in stays),)]


def test_r6_empty_modes(spark, seed):
    empty = seed.with_(pembayaran=seed.pembayaran.limit(0))
    assert rows(R.total_revenue(empty)) == [(Dec("0.00"),)]
    assert rows(R.total_revenue(empty, mode="script")) == [(None,)]


def test_r11_r12_daily(seed):
    out = rows(R.daily_payments(seed, "2026-01-10"), "no", "reservasi_id", "nama_tamu", "total_bayar")
    assert out == [(1, 1, "Andi Pratama", Dec("950000.00"))]
    assert rows(R.daily_payments_total(seed, "2026-01-10"), "grand_total") == [(Dec("950000.00"),)]
    assert rows(R.daily_payments_total(seed, "2030-01-01"), "grand_total") == [(Dec("0.00"),)]


def test_d1_kpis(seed, seed_b):
    assert rows(D.staff_kpis(seed)) == [(16, 4, 11, 10, 6, 10, Dec("5875000.00"))]
    assert rows(D.staff_kpis(seed_b)) == [(16, 4, 11, 11, 7, 10, Dec("6725000.00"))]


def test_d3_month_end_clamp(seed):
    # as_of 2026-08-31 -> window starts 2026-02-28 (month-end clamp)
    assert rows(D.recent_revenue(seed, "2026-08-31")) == []
    assert rows(D.recent_revenue(seed, "2026-06-30")) == [("2026-01", Dec("4675000.00"))]


def test_d4_d5_d6_guest(seed):
    k = {r["user_id"]: r for r in D.guest_kpis(seed).collect()}
    assert (k[6]["total_reservasi"], k[6]["reservasi_aktif"], k[6]["total_pengeluaran"]) == (2, 1, Dec("1490000.00"))
    latest = rows(D.latest_per_guest(seed, 5, user=6), "id_reservasi")
    assert latest == [(2,), (1,), (1,)]
    assert rows(D.guest_profile(seed, user=7), "id_tamu", "nama") == [(2, "Budi Santoso")]


def test_l6_counts(seed, seed_b):
    a = dict(rows(L.guest_list(seed), "id_tamu", "total_booking"))
    assert a == {1: 2, 2: 2, 3: 1, 4: 1, 5: 1, 6: 1, 7: 1, 8: 1, 9: 0, 10: 0}
    assert dict(rows(L.guest_list(seed_b), "id_tamu", "total_booking"))[9] == 1


def test_l4_l5_rooms(seed):
    lst = {r["id_kamar"]: list(r["fasilitas"]) for r in L.room_list(seed).collect()}
    assert lst[1] == ["AC", "TV", "WiFi"] and lst[3] == []
    det = L.room_detail(seed, room_id=9).collect()[0]
    assert [f["id_fasilitas"] for f in det["fasilitas"]] == [1, 2, 3, 6, 8]


def test_l7_history_nested(seed):
    g = L.guest_detail(seed, guest_id=1, flat=False).collect()[0]
    assert g["total_booking"] == 2
    assert [h["id_reservasi"] for h in g["riwayat_reservasi"]] == [2, 1, 1]


def test_b1_totals(seed, seed_b):
    want = [950000, 600000, 850000, 850000, 1500000, 700000, 350000, 600000, 1500000, 850000]
    assert [int(v) for _, v in sorted(rows(B.reservation_totals(seed)))] == want
    assert dict(rows(B.reservation_totals(seed_b)))[11] == Dec("850000.00")


def test_b2_available(spark, seed):
    req = spark.createDataFrame(
        [(f"a{t}", t, dt.date(2026, 1, 15), dt.date(2026, 1, 17)) for t in range(1, 5)]
        + [(f"b{t}", t, dt.date(2026, 1, 16), dt.date(2026, 1, 18)) for t in range(1, 5)],
        "request_id string, tipe_id long, tanggal_checkin date, tanggal_checkout date")
    got = dict(rows(B.available_rooms(seed, req), "request_id", "tersedia"))
    assert [got[f"a{t}"] for t in range(1, 5)] == [1, 1, 2, 3]
    assert [got[f"b{t}"] for t in range(1, 5)] == [3, 1, 2, 3]


def test_b4_none(seed):
    assert B.overlapping_stays(seed).count() == 0


def test_x1_x2_x3(seed, seed_b):
    assert all(r["matches"] for r in X.payment_reconciliation(seed).collect())
    assert X.payment_reconciliation(seed_b).where(F.col("matches")).count() == 9
    assert sorted(r[0] for r in rows(X.room_status_drift(seed), "id_kamar")) == [1, 2, 3, 5, 6, 9, 10, 14]
    assert sorted(r[0] for r in rows(X.checkin_without_status(seed), "id_reservasi")) == [7, 8]
