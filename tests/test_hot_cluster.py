"""Hot overlap clusters thinned out in rounds give the outcome of one-by-one bookings."""

import datetime as dt
import random

import pytest

from innlytics.operators import apply as A

BASE = dt.date(2026, 1, 1)


def one_by_one(rows):
    taken, won = {}, {}
    for seq, room, a, b in sorted(rows):
        held = taken.setdefault(room, [])
        won[seq] = all(c >= b or d <= a for c, d in held)
        if won[seq]:
            held.append((a, b))
    return won


def frame(spark, rows):
    day = lambda n: BASE + dt.timedelta(days=n)
    return spark.createDataFrame([(s, k, day(a), day(b)) for s, k, a, b in rows],
                                 "req_seq long, kamar_id long, tanggal_checkin date, tanggal_checkout date")


@pytest.mark.parametrize("order", ["random", "by day", "backwards"])
def test_rounds_equal_one_by_one(spark, order):
    r = random.Random(3)
    stays = [(1 if i % 3 else 2, a, a + r.choice([1, 2, 3, 14])) for i, a in enumerate(r.randrange(300) for _ in range(600))]
    if order != "random":
        stays.sort(key=lambda x: x[1], reverse=order == "backwards")
    rows = [(7 * i + 1, *x) for i, x in enumerate(stays)]
    got = {x["req_seq"]: x["_won"] for x in A.arbitrate(frame(spark, rows), hot_cluster=5).collect()}
    assert got == one_by_one(rows)


def test_a_hot_room_needs_few_rounds(spark, monkeypatch):
    """Twenty thousand requests of one room in random order are decided without the stream."""
    r = random.Random(8)
    rows = [(i, 1, a, a + r.randint(1, 6)) for i, a in enumerate(r.randrange(1500) for _ in range(20_000))]
    rounds = []
    once = A.IV.earliest_overlap
    monkeypatch.setattr(A.IV, "earliest_overlap", lambda *a, **k: rounds.append(1) or once(*a, **k))
    got = {x["req_seq"]: x["_won"] for x in A.arbitrate(frame(spark, rows), hot_cluster=1000).collect()}
    assert got == one_by_one(rows) and len(rounds) / 2 <= 25


@pytest.mark.parametrize("seed_no", [1, 2, 3])
def test_b13_rounds_equal_one_by_one(spark, seed, seed_no):
    r = random.Random(seed_no)
    stored = {x["id_kamar"]: x["nomor_kamar"] for x in seed.kamar.collect()}
    names = [*stored.values(), "X1", "X2", "x1"]
    rows = [(i + 1, r.choice([*stored, 777]), r.choice(names)) for i in range(120)]
    number, want = dict(stored), {}
    for seq, room, no in rows:
        want[seq] = room not in number or all(v.lower() != no.lower() or k == room for k, v in number.items())
        if want[seq] and room in number:
            number[room] = no
    patches = spark.createDataFrame(rows, "req_seq long, id_kamar long, nomor_kamar string")
    got = {x["req_seq"]: x["_won"] for x in A.arbitrate_numbers(seed.kamar, patches, hot_component=1).collect()}
    assert got == want


def test_b13_a_chain_is_left_to_the_stream(spark, seed):
    """One room patched two hundred times: rounds decide too little, the rest is streamed."""
    rows = [(i + 1, 1 + i % 2, f"N{i % 3}") for i in range(200)]
    number = {x["id_kamar"]: x["nomor_kamar"] for x in seed.kamar.collect()}
    want = {}
    for seq, room, no in rows:
        want[seq] = all(v != no or k == room for k, v in number.items())
        if want[seq]:
            number[room] = no
    patches = spark.createDataFrame(rows, "req_seq long, id_kamar long, nomor_kamar string")
    got = {x["req_seq"]: x["_won"] for x in A.arbitrate_numbers(seed.kamar, patches, hot_component=1).collect()}
    assert got == want
