"""Write batches against a plain sequential replay, and refused inputs."""

import datetime as dt
import os
import random

import pytest
from conftest import rows
from pyspark.sql import types as T

from innlytics import session
from innlytics.operators import apply as A
from innlytics.operators import changes as CH
from innlytics.sources import catalog as C
from innlytics.sources import files
from innlytics.streaming import feeds

DAY = "2026-02-15"


def outcome(result):
    return {r["req_seq"]: list(r["reasons"]) for r in result.rejected.collect()}


def test_b9_a_refused_payment_blocks_nobody(spark, seed):
    free = sorted(set(r[0] for r in rows(seed.reservasi, "id_reservasi")) - set(
        r[0] for r in rows(seed.pembayaran, "reservasi_id")))[0]
    req = spark.createDataFrame([(1, free, 10, 0), (2, free, 2, 850000), (3, free, 2, 1)],
                                "req_seq long, reservasi_id long, metode_id long, total long")
    res = A.apply_payments(seed, req, DAY)
    assert [r["req_seq"] for r in res.accepted.collect()] == [2]
    assert set(outcome(res)) == {1, 3} and outcome(res)[3] == [A.MSG_DUPLICATE]


def test_b8_a_refused_checkin_blocks_nobody(spark, seed):
    free = sorted(set(r[0] for r in rows(seed.reservasi, "id_reservasi")) - set(
        r[0] for r in rows(seed.checkin, "reservasi_id")))[0]
    req = spark.createDataFrame([(1, free, 99), (2, free, 2), (3, free, 2)],
                                "req_seq long, reservasi_id long, pegawai_id long")
    res = A.apply_status_action(seed, req, "checkin", DAY)
    assert [r["pegawai_id"] for r in res.accepted.collect()] == [2]
    assert outcome(res) == {1: [A.MSG_FK.format("pegawai")], 3: [A.MSG_DUPLICATE]}


def test_b8_the_batch_is_judged_in_one_join_and_written_once(spark, seed):
    known, done = (set(r[0] for r in rows(df, c)) for df, c in ((seed.reservasi, "id_reservasi"), (seed.checkin, "reservasi_id")))
    free, taken = min(known - done), min(known & done)
    req = spark.createDataFrame([(1, 777, 2), (2, 777, 99), (3, taken, 2), (4, taken, 99), (5, None, 2), (6, 0, 99), (7, free, 2)],
                                "req_seq long, reservasi_id long, pegawai_id long")
    res = A.apply_status_action(seed, req, "checkin", DAY)
    no_res, no_clerk = A.MSG_FK.format("reservasi"), A.MSG_FK.format("pegawai")
    assert outcome(res) == {1: [no_res], 2: [no_res, no_clerk], 3: [A.MSG_DUPLICATE], 4: [no_clerk, A.MSG_DUPLICATE],
                            5: [A.MSG_ID_REQUIRED], 6: [A.MSG_ID_REQUIRED, no_res, no_clerk]}
    assert rows(res.accepted, "reservasi_id") == [(free,)]
    assert "Join" not in res.rejected._jdf.queryExecution().optimizedPlan().toString()


def test_b12_a_refused_room_blocks_nobody(spark, seed):
    req = spark.createDataFrame([(1, "501", 99, None), (2, "501", 1, None), (3, "501", 1, None)],
                                "req_seq long, nomor_kamar string, tipe_id long, status_id long")
    res = A.apply_room_inserts(seed, req)
    assert [(r["nomor_kamar"], r["tipe_id"]) for r in res.accepted.collect()] == [("501", 1)]
    assert outcome(res) == {1: [A.MSG_FK.format("tipe_kamar")], 3: [A.MSG_DUPLICATE]}


@pytest.mark.parametrize("seed_no", [1, 2, 3])
def test_b13_matches_sequential_replay(spark, seed, seed_no):
    rnd = random.Random(seed_no)
    number = {r[0]: r[1] for r in rows(seed.kamar, "id_kamar", "nomor_kamar")}
    names = sorted(number.values()) + ["204B", "X1", "x1"]
    patches = []
    for i in range(60):
        patches.append((i + 1, rnd.choice([*number, 777]), rnd.choice([None, *names]), None, rnd.choice([None, 1, 2, 3])))
    df = spark.createDataFrame(patches, "req_seq long, id_kamar long, nomor_kamar string, tipe_id long, status_id long")
    res = A.apply_room_updates(seed, df)
    status = {r[0]: r[1] for r in rows(seed.kamar, "id_kamar", "status_id")}
    refused = set()
    for seq, room, no, _, st in patches:
        if no is None and st is None:
            refused.add(seq)
            continue
        if room not in number:
            continue
        if no is not None:
            if any(v.lower() == no.lower() and k != room for k, v in number.items()):
                refused.add(seq)
                continue
            number[room] = no
        if st is not None:
            status[room] = st
    assert set(outcome(res)) == refused
    got = {r[0]: (r[1], r[2]) for r in rows(res.tables.kamar, "id_kamar", "nomor_kamar", "status_id")}
    assert got == {k: (number[k], status[k]) for k in number}


def test_b13_swap_and_keep_inside_a_batch(spark, seed):
    a, b = sorted(rows(seed.kamar, "id_kamar", "nomor_kamar"))[:2]
    df = spark.createDataFrame([(1, a[0], "204B", None, None), (2, a[0], "204b", None, 3), (3, b[0], a[1], None, None),
                                (4, a[0], b[1], None, None)],
                               "req_seq long, id_kamar long, nomor_kamar string, tipe_id long, status_id long")
    res = A.apply_room_updates(seed, df)
    assert outcome(res) == {}
    got = {r[0]: r[1] for r in rows(res.tables.kamar, "id_kamar", "nomor_kamar")}
    assert (got[a[0]], got[b[0]]) == (b[1], a[1])


def _signups(spark, keys):
    return spark.createDataFrame([(i + 1, u, e, "pw", "N", "08", None) for i, (u, e) in enumerate(keys)],
                                 "req_seq long, username string, email string, password string, nama string, "
                                 "telepon string, alamat string")


def test_b11_long_chain_and_key_spaces(spark, seed):
    chain = [(f"u{i // 2}", f"e{(i + 1) // 2}@x") for i in range(30)]
    res = A.apply_registrations(seed, _signups(spark, chain), DAY)
    assert sorted(r["req_seq"] for r in res.accepted.collect()) == list(range(1, 31, 2))
    mail = rows(seed.users, "email")[0][0]
    res = A.apply_registrations(seed, _signups(spark, [(mail, "fresh@x"), ("fresh", mail.upper())]), DAY)
    assert [r["username"] for r in res.accepted.collect()] == [mail]
    assert outcome(res)[2][0] == A.MSG_REGISTERED


@pytest.mark.parametrize("seed_no", [4, 5])
def test_b11_matches_sequential_replay(spark, seed, seed_no):
    rnd = random.Random(seed_no)
    keys = [(f"u{rnd.randint(0, 12)}", f"e{rnd.randint(0, 12)}@x") for _ in range(60)]
    res = A.apply_registrations(seed, _signups(spark, keys), DAY)
    us, es, want = set(), set(), []
    for i, (u, e) in enumerate(keys):
        if u not in us and e not in es:
            us.add(u)
            es.add(e)
            want.append(i + 1)
    assert sorted(r["req_seq"] for r in res.accepted.collect()) == want
    assert len(outcome(res)) == 60 - len(want)


def test_s1_refuses_missing_tables(spark, seed, tmp_path):
    seed.kamar.write.parquet(str(tmp_path / "kamar"))
    with pytest.raises(Exception, match="PATH_NOT_FOUND|does not exist"):
        files.read_tables(spark, str(tmp_path))
    others = set(C.SCHEMAS) - {"kamar"}
    t = files.read_tables(spark, str(tmp_path), absent=others)
    assert t.kamar.count() == seed.kamar.count() and t.pembayaran.count() == 0


def test_s4_only_whole_objects(spark):
    good = ['{"a":5}', ' {"a": 5}\n']
    bad = ['{"a":5} trailing', '{"a":5}]', '{"a":5}}', '{"a":5},{"a":6}', '[{"a":5}]', '{"a":5', "", "x", None, '{"a":5}{"a":5}']
    df = spark.createDataFrame([(b,) for b in good + bad], "body string")
    ok, rest = files.parse_requests(df, T.StructType([T.StructField("a", T.LongType())]), required_cols=["a"])
    assert sorted(r["body"] for r in ok.collect()) == sorted(good) and rest.count() == len(bad)


def test_checkpoint_dir_is_required_on_a_cluster(spark, monkeypatch):
    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Conf:
        def get(self, key, default=None):
            return default

    class Session:
        sparkContext, conf = Context(), Conf()

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        session.checkpoint_dir(Session())


def test_our_settings_do_not_hide_overflow():
    assert "spark.sql.ansi.enabled" not in session.DEFAULT_CONF


def test_c2_late_rows_and_replay(spark, tmp_path):
    at = lambda m: dt.datetime(2026, 1, 1, 0, m)
    first = spark.createDataFrame([(1, at(1), 1, 1), (1, at(5), 2, 2), (2, at(1), 3, 1)], C.FEED_SCHEMA)
    second = spark.createDataFrame([(1, at(3), 4, 3), (1, at(6), 5, 3), (2, at(2), 6, 1), (3, at(1), 7, 4)], C.FEED_SCHEMA)
    empty = spark.createDataFrame([], feeds.SNAPSHOT_SCHEMA)
    moved, last = feeds.transitions_of(first, empty)
    assert sorted(rows(moved, "reservasi_id", "seq", "old_status", "new_status", "late")) == [(1, 2, 1, 2, False)]
    moved, last = feeds.transitions_of(second, last)
    assert sorted(rows(moved, "reservasi_id", "seq", "old_status", "new_status", "late")) == [
        (1, 4, 2, 3, True), (1, 5, 2, 3, False)]
    assert sorted(rows(last, "reservasi_id", "seq", "status_reservasi_id")) == [(1, 5, 3), (2, 6, 1), (3, 7, 4)]
    # a replay of the whole stream into the same folders gives the same tables
    src = str(tmp_path / "feed")
    first.coalesce(1).write.parquet(src)
    second.coalesce(1).write.mode("append").parquet(src)
    out = str(tmp_path / "out")
    for turn in range(2):
        feeds.run_transitions(feeds.read_feed_stream(spark, src), out, str(tmp_path / f"ck{turn}"))
    got = spark.read.parquet(os.path.join(out, "transitions"))
    assert got.count() == 3 and spark.read.parquet(os.path.join(out, "last", "batch=1")).count() == 3


def test_new_ids_number_sparse_orders_once(spark):
    from pyspark.sql import functions as F

    from innlytics.plans.numbering import new_ids
    df = spark.createDataFrame([(i * 1_000_003 % 9_999_991,) for i in range(3000)], "req_seq long")
    out = new_ids(df, "req_seq", {"x": F.lit(10), "y": F.lit(1000)}, ranges=7).orderBy("req_seq").collect()
    assert [r["x"] for r in out] == list(range(11, 3011)) and [r["y"] for r in out] == list(range(1001, 4001))
    plan = new_ids(df, "req_seq", {"x": F.lit(0)})._jdf.queryExecution().executedPlan().toString()
    assert "_rng" in plan


def test_room_updates_match_the_latest_write(spark, seed):
    ts = dt.datetime(2026, 1, 1)
    stays = rows(seed.detail_reservasi, "reservasi_id", "kamar_id")
    tr = spark.createDataFrame([(r, ts, i, 1, 2 + i % 3) for i, (r, _) in enumerate(stays)],
                               "reservasi_id long, ts timestamp_ntz, seq long, old_status long, new_status long")
    latest = {}
    for i, (r, _) in enumerate(stays):
        for r2, room in stays:
            if r2 == r and room is not None:
                latest[room] = max(latest.get(room, (-1, 0)), (i, 2 if 2 + i % 3 == 2 else 1))
    got = {r[0]: r[1] for r in rows(CH.room_status_after(seed.kamar, tr, seed.detail_reservasi), "id_kamar", "status_id")}
    assert all(got[k] == v[1] for k, v in latest.items())
