"""Bulk loads, deletes along the references, keys in the schema's collation, and reads by month."""

import datetime as dt
import random

import pytest
from conftest import rows
from pyspark.sql import functions as F
from pyspark.sql import types as T

from innlytics.operators import apply as A
from innlytics.operators import dashboard as D
from innlytics.operators import load as LD
from innlytics.operators import quality as Q
from innlytics.operators import reports as R
from innlytics.plans.first_come import first_come
from innlytics.sources import catalog as C
from innlytics.sources import constraints as K
from innlytics.sources import files

DAY = dt.date(2026, 2, 1)


def reasons(loaded, table):
    return {r["req_seq"]: sorted(r["reasons"]) for r in loaded.rejected[table].collect()}


def test_catalogue_covers_the_schema():
    assert set(K.RULES) == set(C.SCHEMAS) and len(K.REFERENCES) == 23
    for table, rules in K.RULES.items():
        names = set(C.SCHEMAS[table].names)
        used = [*rules.not_null, *rules.unique, *[x[0] for x in rules.ranges + rules.lengths], *sum(rules.after, ())]
        assert set(used) <= names and (rules.key is None or rules.key in names)
    for ref in K.REFERENCES:
        assert ref.column in C.SCHEMAS[ref.child].names and K.RULES[ref.parent].key == ref.key
    order = K.parents_first()
    assert all(order.index(r.parent) < order.index(r.child) for r in K.REFERENCES) and len(order) == 21


@pytest.mark.parametrize("seed_no", [1, 2, 3, 4])
def test_first_come_equals_one_by_one(spark, seed_no):
    r = random.Random(seed_no)
    data = [(i * 3, r.choice([None, *range(12)]), r.choice([None, *"abcdefgh"]), r.randrange(30)) for i in range(80)]
    r.shuffle(data)
    got = {x["at"]: x["won"] for x in first_come(spark.createDataFrame(data, "at long, a int, b string, c int"), "at",
                                                 ["a", "b", "c"]).collect()}
    taken, want = [set(), set(), set()], {}
    for at, *keys in sorted(data):
        want[at] = not any(k is not None and k in s for k, s in zip(keys, taken))
        if want[at]:
            for k, s in zip(keys, taken):
                s.add(k)
    assert got == want
    empty = first_come(spark.createDataFrame([], "at long, a int"), "at", ["a"])
    assert empty.count() == 0 and empty.columns == ["at", "won"]


def test_first_come_plan_does_not_grow_with_the_rounds(spark):
    chain = spark.createDataFrame([(i, i // 2, (i + 1) // 2) for i in range(40)], "at long, a int, b int")
    out = first_come(chain, "at", ["a", "b"])
    assert len(out._jdf.queryExecution().optimizedPlan().toString().split("\n")) < 6
    assert [x["at"] for x in out.where("won").orderBy("at").collect()] == list(range(0, 40, 2))


def test_load_tells_every_kind_of_fault(spark, seed):
    batch = spark.createDataFrame([
        (1, None, 1, 4, 5, "fine"), (2, None, 99, 4, 5, "no guest"), (3, None, 1, 99, 5, "no room"), (4, None, 1, 4, 6, "rating"),
        (5, None, 1, 4, 0, "rating"), (6, None, None, None, None, "all NULL"), (7, 3, 1, 4, 1, "stored id"),
        (8, 50, 1, 4, 1, "own id"), (9, 50, 1, 4, 1, "id twice"), (10, None, 99, 98, 9, "three")],
        "req_seq long, id_ulasan long, tamu_id long, kamar_id long, rating int, komentar string")
    done = LD.load_rows(seed, "ulasan", batch)
    fk = LD.MSG_FK.format
    assert reasons(done, "ulasan") == {
        2: [fk("ulasan", "tamu_id")], 3: [fk("ulasan", "kamar_id")], 4: [LD.MSG_CHECK.format("rating")],
        5: [LD.MSG_CHECK.format("rating")], 7: [LD.MSG_DUPLICATE.format("ulasan", "id_ulasan")], 9: [LD.MSG_TWICE],
        10: sorted([fk("ulasan", "tamu_id"), fk("ulasan", "kamar_id"), LD.MSG_CHECK.format("rating")])}
    assert sorted(rows(done.accepted["ulasan"], "req_seq", "id_ulasan")) == [(1, 51), (6, 52), (8, 50)]
    assert done.tables.ulasan.count() == 9 and set(done.tables.ulasan.columns) == set(C.SCHEMAS["ulasan"].names)


def test_load_of_several_tables_parents_first(spark, seed):
    users = spark.createDataFrame([(1, 70, "José", "jose@x.id", 3), (2, 71, "jose", "other@x.id", 3), (3, 72, "maria", "JOSÉ@x.id", 3),
                                   (4, 73, None, "n@x.id", 3), (5, 74, "x" * 51, "l@x.id", 3), (6, 75, "Maria", "m@x.id", 9),
                                   (7, 76, "ADMIN1", "a@x.id", 3), (8, 77, "mária", "m2@x.id", None)],
                                  "req_seq long, id_user long, username string, email string, role_id long")
    guests = spark.createDataFrame([(1, "José", "g1@x.id", 70), (2, "twin", "g2@x.id", 71), (3, "again", "G1@x.id", None),
                                    (4, "one login", "g4@x.id", 70), (5, None, "g5@x.id", None)],
                                   "req_seq long, nama string, email string, user_id long")
    done = LD.load_tables(seed, {"tamu": guests, "users": users})
    dup = LD.MSG_DUPLICATE.format
    assert reasons(done, "users") == {
        2: [LD.MSG_TWICE], 3: [LD.MSG_TWICE], 4: [LD.MSG_NULL.format("username")], 5: [LD.MSG_LONG.format("username")],
        6: [LD.MSG_FK.format("users", "role_id")], 7: [dup("users", "username")]}
    assert reasons(done, "tamu") == {2: [LD.MSG_FK.format("tamu", "user_id")], 3: [LD.MSG_TWICE], 4: [LD.MSG_TWICE],
                                     5: [LD.MSG_NULL.format("nama")]}
    assert sorted(rows(done.accepted["tamu"], "id_tamu", "nama")) == [(11, "José")]
    out = {(r["tabel"], r["req_seq"]): r["accepted"] for r in LD.outcomes(done).collect()}
    assert len(out) == 13 and sum(out.values()) == 3
    for ref in K.REFERENCES:
        assert Q.orphans(getattr(done.tables, ref.child), ref.column, getattr(done.tables, ref.parent), ref.key).count() == 0


def test_stays_turn_and_null_dates_are_refused(spark, seed):
    batch = spark.createDataFrame([(1, 1, 4, DAY, DAY), (2, 1, 4, None, DAY), (3, 1, 4, DAY, dt.date(2026, 2, 3)), (4, 77, None, DAY, DAY)],
                                  "req_seq long, reservasi_id long, kamar_id long, tanggal_checkin date, tanggal_checkout date")
    done = LD.load_rows(seed, "detail_reservasi", batch.withColumn("harga", F.lit(1)))
    assert reasons(done, "detail_reservasi") == {
        1: [Q.MSG_CHECKOUT], 2: [LD.MSG_NULL.format("tanggal_checkin")],
        4: sorted([Q.MSG_CHECKOUT, LD.MSG_FK.format("detail_reservasi", "reservasi_id")])}
    assert done.tables.detail_reservasi.count() == 13


def plain_delete(tables, table, keys):
    """Row by row: remove, cascade and clear, until nothing changes."""
    gone = {(table, k) for k in keys}
    while True:
        more = {(r.child, row[K.RULES[r.child].key]) for r in K.REFERENCES if r.action == K.CASCADE and K.RULES[r.child].key
                for row in tables[r.child] if (r.parent, row[r.column]) in gone} - gone
        if not more:
            break
        gone |= more
    out = {}
    for name, data in tables.items():
        refs = [r for r in K.REFERENCES if r.child == name]
        key, kept = K.RULES[name].key, []
        for row in data:
            row = dict(row)
            if key and (name, row[key]) in gone:
                continue
            if any(r.action == K.CASCADE and (r.parent, row[r.column]) in gone for r in refs):
                continue
            for r in refs:
                if r.action == K.SET_NULL and (r.parent, row[r.column]) in gone:
                    row[r.column] = None
            kept.append(row)
        out[name] = sorted(map(str, kept))
    return out


@pytest.mark.parametrize("table, keys", [
    ("kamar", [3, 5, 99, None]), ("tamu", [1, 2, 6]), ("reservasi", [1, 2, 3, 7]), ("users", [1, 3, 6]), ("promo", [])])
def test_deletes_follow_the_references(spark, seed, table, keys):
    before = {n: [r.asDict() for r in getattr(seed, n).collect()] for n in seed.names()}
    done = LD.delete_rows(seed, table, spark.createDataFrame([(k,) for k in keys], "k long"), "k")
    after = {n: sorted(str(r.asDict()) for r in getattr(done.tables, n).collect()) for n in seed.names()}
    assert after == plain_delete(before, table, keys)
    assert set(done.touched) >= {n for n in after if after[n] != sorted(map(str, before[n]))}
    for ref in K.REFERENCES:
        assert Q.orphans(getattr(done.tables, ref.child), ref.column, getattr(done.tables, ref.parent), ref.key).count() == 0


def test_b14_logs_repeated_and_unknown_rooms(spark, seed):
    keys = spark.createDataFrame([(1, 3), (2, 3), (3, None), (4, 0), (5, 777)], "req_seq long, id_kamar long")
    res = A.apply_room_deletes(seed, keys, as_of="2026-02-15")
    assert sorted(r["req_seq"] for r in res.rejected.collect()) == [3, 4] and res.audit.count() == 3
    assert res.tables.kamar.count() == 15 and res.tables.ulasan.where("kamar_id = 3").count() == 0


def test_keys_know_neither_case_nor_accents(spark, seed):
    names = spark.createDataFrame([("José", 1), ("jose", 2), ("JOSÈ", 3), ("josef", 4), (None, 5), (None, 6)], "nama string, k int")
    assert [tuple(r) for r in Q.unique(names, ["nama"], case_insensitive=True).collect()] == [("jose", 3)]
    rooms = spark.createDataFrame([(1, "Ñ1", 1), (2, "n1", 1), (3, "N2", 1)], "req_seq long, nomor_kamar string, tipe_id long")
    assert sorted(r["nomor_kamar"] for r in A.apply_room_inserts(seed, rooms).accepted.collect()) == ["N2", "Ñ1"]
    patches = spark.createDataFrame([(1, 1, "É9"), (2, 2, "e9"), (3, 1, "X"), (4, 2, "e9")],
                                    "req_seq long, id_kamar long, nomor_kamar string")
    res = A.apply_room_updates(seed, patches)
    assert [r["req_seq"] for r in res.rejected.collect()] == [2]
    assert dict(rows(res.tables.kamar.where("id_kamar < 3"), "id_kamar", "nomor_kamar")) == {1: "X", 2: "e9"}


def test_month_bounds_prune_folders_and_keep_results(spark, seed, tmp_path):
    root = str(tmp_path / "db")
    for name in C.SCHEMAS:
        files.write_table(getattr(seed, name), root, name, mode="overwrite")
    whole = files.read_tables(spark, root)
    first = dt.date(2026, 1, 11)
    part = files.read_tables(spark, root, bounds={"pembayaran": (first, first), "detail_reservasi": (None, first)})
    plan = R.daily_payments(part, first)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(bulan" in plan and "(bulan" in plan
    assert rows(R.daily_payments(part, first)) == rows(R.daily_payments(whole, first))
    assert part.detail_reservasi.count() == whole.detail_reservasi.where(F.col("tanggal_checkin") <= F.lit(first)).count()
    assert part.detail_reservasi.columns == C.SCHEMAS["detail_reservasi"].names
    six = files.read_tables(spark, root, bounds={"pembayaran": (dt.date(2025, 7, 20), None)})
    assert rows(D.recent_revenue(six, "2026-01-20")) == rows(D.recent_revenue(whole, "2026-01-20"))


def test_load_into_adds_accepted_rows_by_month(spark, seed, tmp_path):
    root = str(tmp_path / "db")
    for name in C.SCHEMAS:
        files.write_table(getattr(seed, name), root, name, mode="overwrite")
    t = files.read_tables(spark, root)
    stays = spark.createDataFrame([(1, 1, 4, DAY, dt.date(2026, 2, 3), 5), (2, 77, 4, DAY, dt.date(2026, 2, 3), 5)],
                                  "req_seq long, reservasi_id long, kamar_id long, tanggal_checkin date, tanggal_checkout date, harga int")
    done = files.load_into(t, root, {"detail_reservasi": stays})
    assert done.rejected["detail_reservasi"].count() == 1
    assert files.read_tables(spark, root).detail_reservasi.count() == 13
    assert (tmp_path / "db" / "detail_reservasi" / "bulan=2026-02").is_dir()


def test_request_bodies_of_wrong_types_and_repeated_keys(spark):
    schema = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.StringType()), T.StructField("d", T.DateType()),
                           T.StructField("m", T.DecimalType(10, 2)), T.StructField("l", T.ArrayType(T.LongType()))])
    bodies = ['{"a":1,"b":"x","d":"2026-01-02","m":1.25,"l":[1,2]}', '{"a":"7"}', '{"a":1,"a":2}', '{"a":1.5}', '{"a":"x"}',
              '{"a":1,"d":"soon"}', '{"a":1,"m":"much"}', '{"a":1,"b":null}', '{"a":1,"l":"no"}', '{"a":true}', '{"a":1}],[{"a":2}',
              '{"a":1},{"a":1}']
    df = spark.createDataFrame([(i, b) for i, b in enumerate(bodies)], "i int, body string")
    ok, bad = files.parse_requests(df, schema, required_cols=["a"])
    assert {r["i"]: r["a"] for r in ok.collect()} == {0: 1, 1: 7, 2: 2, 7: 1}
    assert rows(ok.where("i = 0"), "b", "d", "l") == [("x", dt.date(2026, 1, 2), [1, 2])]
    wrong = {r["i"]: r["reasons"] for r in bad.collect()}
    assert files.MSG_TYPE.format("d") in wrong[5] and files.MSG_TYPE.format("m") in wrong[6] and set(wrong) == {3, 4, 5, 6, 8, 9, 10, 11}


def test_a_body_is_parsed_once_however_often_its_fields_are_read(spark):
    schema = T._parse_datatype_string("a int, b string, d date")
    for df in files.parse_requests(spark.createDataFrame([(1, "{}")], "i int, body string"), schema, required_cols=["a"]):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("parseJson") == 1 and plan.count("$['d']") <= 2


SMOKE = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["b2_available_rooms", "b7_outcomes"])
def test_batch_and_stays_are_read_once_and_then_from_their_cuts(spark, name):
    import __spark_entry__ as entry
    assert not [f for f in entry.queries()[name](spark, SMOKE).inputFiles() if "lineitem" in f]


def test_stays_without_ids_compete_for_nothing_and_get_ids_in_order(spark, seed, monkeypatch):
    monkeypatch.setattr(LD, "first_come", None)
    res, room = rows(seed.reservasi, "id_reservasi")[0][0], rows(seed.kamar, "id_kamar")[0][0]
    batch = spark.createDataFrame([(i * i, None if i % 5 == 0 else res, room, DAY, DAY + dt.timedelta(1), 1) for i in range(40)],
                                  "req_seq long, reservasi_id long, kamar_id long, tanggal_checkin date, tanggal_checkout date, harga int")
    batch = batch.withColumn("reservasi_id", F.coalesce("reservasi_id", F.lit(-1)))
    done = LD.load_rows(seed, "detail_reservasi", batch)
    top = max(r[0] for r in rows(seed.detail_reservasi, "id_detail"))
    assert sorted(rows(done.accepted["detail_reservasi"], "req_seq", "id_detail")) == [
        (i * i, top + n) for n, i in enumerate([i for i in range(40) if i % 5], 1)]
    assert set(reasons(done, "detail_reservasi")) == {i * i for i in range(0, 40, 5)}


def test_new_ids_number_in_the_deal_itself(spark):
    from innlytics.plans.numbering import new_ids
    df = spark.range(1000).select((F.col("id") * F.col("id")).alias("k"))
    out = new_ids(df, "k", {"no": F.lit(7)}, ranges=9)
    assert sorted(rows(out, "k", "no")) == [(i * i, 8 + i) for i in range(1000)]
    assert "row_number" not in out._jdf.queryExecution().optimizedPlan().toString()
