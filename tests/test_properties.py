"""Pair-free operators against brute force on small random fixtures and on
the sf0.001 stand-ins."""

import datetime as dt
import random
from decimal import Decimal as Dec

import pytest
from conftest import rows
from pyspark.sql import functions as F

from innlytics.operators import apply as A
from innlytics.operators import booking as B
from innlytics.operators import changes as CH
from innlytics.sources import catalog as C
from innlytics.sources import standins
from innlytics.sources.tables import Tables

BASE = dt.date(2026, 1, 1)
SMOKE = "/root/testdata/sf0.001"


def _random_book(spark, seed, n_rooms=6, n_stays=60, null_rooms=0, invalid=0):
    rnd = random.Random(seed)
    kamar = [(k, str(k), 1 + k % 2, rnd.choice([1, 1, 1, 2, 3])) for k in range(1, n_rooms + 1)]
    res, stays = [], []
    for i in range(1, n_stays + 1):
        status = rnd.choice([1, 2, 3, 4])
        res.append((i, 1, dt.datetime(2026, 1, 1), status, None))
        ci = BASE + dt.timedelta(days=rnd.randint(0, 40))
        co = ci + dt.timedelta(days=rnd.randint(1, 6))
        room = rnd.randint(1, n_rooms)
        stays.append((i, i, room, ci, co, Dec("1.00")))
    for j in range(null_rooms):
        stays[j] = (stays[j][0], stays[j][1], None, *stays[j][3:])
    for j in range(invalid):
        s = stays[-1 - j]
        stays[-1 - j] = (s[0], s[1], s[2], s[4], s[3], s[5])
    S = C.SCHEMAS
    return Tables.from_frames(spark, {
        "kamar": spark.createDataFrame(kamar, S["kamar"]),
        "reservasi": spark.createDataFrame(res, S["reservasi"]),
        "detail_reservasi": spark.createDataFrame(stays, S["detail_reservasi"]),
    }), kamar, res, stays


def _active(res, stays):
    st = {r[0]: r[3] for r in res}
    return [s for s in stays if st[s[1]] in (1, 2)]


def _requests(rnd, n, key_max, invalid=True):
    out = []
    for i in range(n):
        ci = BASE + dt.timedelta(days=rnd.randint(-3, 45))
        length = rnd.randint(-2 if invalid else 1, 8)
        if length == 0:
            length = 1
        out.append((f"q{i}", rnd.randint(1, key_max), ci, ci + dt.timedelta(days=length)))
    return out


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_b3_matches_brute_force(spark, seed):
    t, kamar, res, stays = _random_book(spark, seed, invalid=3, null_rooms=2)
    req = _requests(random.Random(seed), 40, 6)
    df = spark.createDataFrame(req, "request_id string, kamar_id long, tanggal_checkin date, tanggal_checkout date")
    got = dict(rows(B.booking_conflicts(t, df), "request_id", "jumlah_konflik"))
    act = _active(res, stays)
    for rid, room, ci, co in req:
        want = sum(1 for s in act if s[2] == room and s[3] < co and s[4] > ci)
        assert got[rid] == want, (rid, room, ci, co)


def test_b2_b3_long_requests(spark):
    # requests over hundreds of nights: one row a night, no day pairs
    t, kamar, res, stays = _random_book(spark, 21, n_rooms=4, n_stays=80)
    req = [(f"q{i}", 1 + i % 2, BASE - dt.timedelta(days=100 + i), BASE + dt.timedelta(days=700 - i)) for i in range(6)]
    df = spark.createDataFrame(req, "request_id string, kamar_id long, tanggal_checkin date, tanggal_checkout date")
    got = dict(rows(B.booking_conflicts(t, df), "request_id", "jumlah_konflik"))
    free = dict(rows(B.available_rooms(t, df.withColumnRenamed("kamar_id", "tipe_id")), "request_id", "tersedia"))
    act = _active(res, stays)
    for rid, key, ci, co in req:
        hit = [s for s in act if s[3] < co and s[4] > ci]
        assert got[rid] == sum(1 for s in hit if s[2] == key)
        busy = {s[2] for s in hit}
        assert free[rid] == sum(1 for k in kamar if k[2] == key and k[3] == 1 and k[0] not in busy)


@pytest.mark.parametrize("seed,null_rooms", [(4, 0), (5, 2), (6, 0)])
def test_b2_matches_not_in(spark, seed, null_rooms):
    t, kamar, res, stays = _random_book(spark, seed, null_rooms=null_rooms, invalid=2)
    req = _requests(random.Random(seed), 40, 2)
    df = spark.createDataFrame(req, "request_id string, tipe_id long, tanggal_checkin date, tanggal_checkout date")
    got = dict(rows(B.available_rooms(t, df), "request_id", "tersedia"))
    act = _active(res, stays)
    for rid, typ, ci, co in req:
        sub = [s[2] for s in act if s[3] < co and s[4] > ci]
        if None in sub:
            want = 0
        else:
            want = sum(1 for k in kamar if k[2] == typ and k[3] == 1 and k[0] not in sub)
        assert got[rid] == want, (rid, typ, ci, co)


def test_b4_matches_self_join_on_standins(spark):
    t = standins.load(spark, SMOKE)
    got = sorted(rows(B.overlapping_stays(t), "reservasi_id", "kamar_id", "tanggal_checkin", "tanggal_checkout",
                      "harga"))
    act = rows(B.active_stays(t), "id_detail", "reservasi_id", "kamar_id", "tanggal_checkin", "tanggal_checkout",
               "harga")
    by_room = {}
    for s in act:
        by_room.setdefault(s[2], []).append(s)
    want = []
    for room, ss in by_room.items():
        for a in ss:
            if any(b[0] != a[0] and b[3] < a[4] and b[4] > a[3] for b in ss):
                want.append(a[1:])
    assert got == sorted(want)


def test_b7_greedy_matches_sequential(spark):
    t, kamar, res, stays = _random_book(spark, 9, n_stays=20)
    rnd = random.Random(9)
    req = []
    for i in range(80):
        ci = BASE + dt.timedelta(days=rnd.randint(50, 70))
        req.append((rnd.randint(1, 1000), 1, rnd.randint(1, 6), ci, ci + dt.timedelta(days=rnd.randint(1, 4)), None))
    seen = set()
    req = [r for r in req if not (r[0] in seen or seen.add(r[0]))]
    df = spark.createDataFrame(req, "req_seq long, tamu_id long, kamar_id long, tanggal_checkin date, "
                                    "tanggal_checkout date, promo_id long")
    t = t.with_(tamu=spark.createDataFrame([(1, "x", "x@x", "1", "a", None)], C.SCHEMAS["tamu"]))
    got = sorted(r["req_seq"] for r in A.apply_bookings(t, df, "2026-01-01").accepted.collect())
    accepted = {}
    want = []
    for seq, _, room, ci, co, _ in sorted(req):
        mine = accepted.setdefault(room, [])
        if all(not (a < co and b > ci) for a, b in mine):
            mine.append((ci, co))
            want.append(seq)
    assert got == sorted(want)


def test_c2_replay_equals_final_status(spark):
    feed = standins.load_feed(spark, SMOKE)
    tr = CH.status_transitions(feed, block_seconds=600)
    # replay: the last transition of each reservation is its final non-null status, unless unchanged since
    last = {r[0]: r[1] for r in rows(tr.groupBy("reservasi_id").agg(
        F.max_by("new_status", "seq").alias("s")))}
    full = sorted(rows(feed), key=lambda r: (r[0], r[1], r[2]))
    final = {}
    for res_id, ts, seq, st in full:
        if st is not None:
            final[res_id] = st
    for res_id, st in last.items():
        assert final[res_id] == st
    # block size does not change the answer
    assert sorted(rows(tr)) == sorted(rows(CH.status_transitions(feed, block_seconds=86400 * 365)))


def test_b7_adds_no_overlap_on_standins(spark):
    # accepted bookings + the existing book: every overlapping active stay
    # was already overlapping before the batch
    from innlytics.sources import requests as RQ
    t = standins.load(spark, SMOKE)
    res = A.apply_bookings(t, RQ.booking_requests(t), "2026-02-15")
    assert res.accepted.count() > 0
    cols = ["reservasi_id", "kamar_id", "tanggal_checkin", "tanggal_checkout"]
    before = set(rows(B.overlapping_stays(t), *cols))
    after = set(rows(B.overlapping_stays(res.tables), *cols))
    assert after == before


def test_b2_invalid_null_room_stays(spark):
    # reversed NULL-room stays (which V1 would refuse) still follow NOT IN
    t, kamar, res, stays = _random_book(spark, 11, n_stays=40, null_rooms=4)
    for j in range(2):
        s = stays[j]
        stays[j] = (s[0], s[1], None, s[4], s[3], s[5])
    t = t.with_(detail_reservasi=spark.createDataFrame(stays, C.SCHEMAS["detail_reservasi"]))
    req = _requests(random.Random(11), 40, 2)
    df = spark.createDataFrame(req, "request_id string, tipe_id long, tanggal_checkin date, tanggal_checkout date")
    got = dict(rows(B.available_rooms(t, df), "request_id", "tersedia"))
    act = _active(res, stays)
    for rid, typ, ci, co in req:
        sub = [s[2] for s in act if s[3] < co and s[4] > ci]
        want = 0 if None in sub else sum(1 for k in kamar if k[2] == typ and k[3] == 1 and k[0] not in sub)
        assert got[rid] == want, (rid, typ, ci, co)
