"""Stream state in buckets: cost, replay, restart and expiry; rooms equal the batch answer."""

import datetime as dt
import os
import random

from conftest import rows

from innlytics.operators import changes as CH
from innlytics.sources import catalog as C
from innlytics.sources import standins
from innlytics.streaming import feeds
from innlytics.streaming.snapshot import Snapshot

SMOKE = "/root/testdata/sf0.001"
SCHEMA = "k long, v long"


def put(snap, batch_id, data):
    """Upsert {key: value} as one micro-batch; the number of buckets written."""
    df = snap.spark.createDataFrame(sorted(data.items()), SCHEMA)
    old = snap.before(batch_id, df)
    return snap.update(batch_id, df, lambda held: old.join(df, "k", "left_anti").unionByName(df))


def folders(path):
    return {(b, f) for b in os.listdir(path) if b.startswith("batch=") for f in os.listdir(os.path.join(path, b))
            if f.startswith("bucket=")}


def test_a_batch_rewrites_only_its_buckets(spark, tmp_path):
    root = str(tmp_path / "state")
    snap = Snapshot(spark, root, SCHEMA, "k", buckets=16)
    state = {k: k for k in range(300)}
    assert put(snap, 0, state) == 16
    assert put(snap, 1, {7: 70}) == 1 and put(snap, 2, {7: 71, 1000: 1}) <= 2
    state |= {7: 71, 1000: 1}
    assert dict(rows(snap.read(2), "k", "v")) == state
    assert dict(rows(snap.read(0), "k", "v")) == {k: k for k in range(300)}
    assert len([f for b, f in folders(root) if b == "batch=1"]) == 1
    assert put(snap, 3, {}) == 0 and dict(rows(snap.read(3), "k", "v")) == state


def test_replays_and_restarts_give_the_same_state(spark, tmp_path):
    r = random.Random(4)
    batches = [{r.randrange(60): r.randrange(1000) for _ in range(r.randint(1, 25))} for _ in range(4)]
    state = {}
    for b in batches:
        state |= b
    whole = Snapshot(spark, str(tmp_path / "a"), SCHEMA, "k", buckets=8)
    for i, b in enumerate(batches):
        put(whole, i, b)
        if i == 2:
            put(whole, i, {})        # a half-finished attempt of another shape, then the replay
            put(whole, i, b)
    again = Snapshot(spark, str(tmp_path / "a"), SCHEMA, "k", buckets=8)  # another process
    assert dict(rows(again.read(3), "k", "v")) == state
    held = len(folders(str(tmp_path / "a")))
    gone = again.expire(3, keep=1)
    assert gone > 0 and len(folders(str(tmp_path / "a"))) == held - gone
    assert dict(rows(again.read(3), "k", "v")) == state
    put(again, 3, batches[3])
    assert dict(rows(again.read(3), "k", "v")) == state


def test_stream_keeps_rooms_and_statuses_across_a_restart(spark, tmp_path):
    t = standins.load(spark, SMOKE)
    feed = standins.load_feed(spark, SMOKE)
    src, out = str(tmp_path / "feed"), str(tmp_path / "out")
    feeds.write_feed(feed, src, 3)
    stream = feeds.read_feed_stream(spark, src)
    feeds.run_transitions(stream, out, str(tmp_path / "ck"), stays=t.detail_reservasi, buckets=8)
    assert feeds.last_batch(spark, out) == 2
    batch = CH.status_transitions(feed)
    want = sorted(rows(CH.room_status_after(t.kamar, batch, t.detail_reservasi), "id_kamar", "status_id"))
    assert sorted(rows(feeds.rooms_after(spark, t.kamar, out, 8), "id_kamar", "status_id")) == want
    # more feed, the same checkpoint: the state goes on
    last = feed.agg({"ts": "max", "seq": "max"}).first()
    later = last["max(ts)"] + dt.timedelta(days=1)
    res = [r[0] for r in feed.select("reservasi_id").distinct().orderBy("reservasi_id").limit(3).collect()]
    more = spark.createDataFrame([(x, later, last["max(seq)"] + i + 1, 2 + i % 2) for i, x in enumerate(res)]
                                 + [(res[0], dt.datetime(1990, 1, 1), last["max(seq)"] + 9, 4)], C.FEED_SCHEMA)
    more.coalesce(1).write.mode("append").parquet(src)
    feeds.run_transitions(stream, out, str(tmp_path / "ck"), stays=t.detail_reservasi, buckets=8)
    assert feeds.last_batch(spark, out) == 3
    whole = feed.unionByName(more.where("ts > '2000-01-01'"))
    want = sorted(rows(CH.room_status_after(t.kamar, CH.status_transitions(whole), t.detail_reservasi), "id_kamar", "status_id"))
    assert sorted(rows(feeds.rooms_after(spark, t.kamar, out, 8), "id_kamar", "status_id")) == want
    late = spark.read.parquet(os.path.join(out, "transitions")).where("late")
    assert rows(late, "reservasi_id", "batch") == [(res[0], 3)]
