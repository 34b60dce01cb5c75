"""Bulk loads checked against the catalogue of constraints, and deletes that
follow the references (B14 for any table).

``load_rows`` judges a batch of one table against the stored tables and the
batch itself: NOT NULL (Q3), text lengths, CHECK ranges (Q4), the stay rule (V1),
references (Q5) and unique keys (Q2) of the stored rows in one pass each, then
unique keys inside the batch in the batch's order, where only rows without
another fault take a key. A refused row keeps its reasons and blocks nobody.
``load_tables`` loads several tables, parents first, so that rows can refer to
rows of the same load. ``delete_rows`` removes rows and, table by table from the
parents down, the rows that CASCADE reaches at any depth, and clears the columns
of SET NULL.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from innlytics.functions import scalar as E
from innlytics.operators import quality as Q
from innlytics.plans.checkpoint import cut
from innlytics.plans.first_come import first_come
from innlytics.plans.numbering import new_ids
from innlytics.sources import catalog as C
from innlytics.sources import constraints as K
from innlytics.sources.tables import Tables

# Fixed rejection texts (the database's own wording).
MSG_NULL = "Column '{}' cannot be null"
MSG_LONG = "Data too long for column '{}'"
MSG_CHECK = "Check constraint '{}' is violated"
MSG_FK = "Foreign key constraint fails ({}.{})"
MSG_DUPLICATE = "Duplicate entry for key '{}.{}'"
MSG_TWICE = "Duplicate entry in the batch"

SEQ = "req_seq"


@dataclass
class Loaded:
    accepted: dict[str, DataFrame]
    rejected: dict[str, DataFrame]
    tables: Tables


def unique_value(table: str, column: str) -> F.Column:
    """A unique column as the schema compares it: texts without regard to case
    and accents."""
    dtype = C.SCHEMAS[table][column].dataType
    return E.text_key(column) if isinstance(dtype, T.StringType) else F.col(column)


def faults(t: Tables, table: str, batch: DataFrame) -> DataFrame:
    """The batch with ``reasons``: all faults but those of unique keys inside it."""
    rules = K.RULES[table]
    r = batch
    for f in C.SCHEMAS[table].fields:
        if f.name not in r.columns:
            r = r.withColumn(f.name, F.lit(None).cast(f.dataType))
    row_rules = [(F.col(c).isNull(), MSG_NULL.format(c)) for c in rules.not_null]
    row_rules += [(F.length(c) > n, MSG_LONG.format(c)) for c, n in rules.lengths]
    row_rules += [(~F.col(c).between(lo, hi), MSG_CHECK.format(c)) for c, lo, hi in rules.ranges]
    row_rules += [(F.col(later) <= F.col(earlier), Q.MSG_CHECKOUT) for later, earlier in rules.after]
    r = Q.with_reasons(r, row_rules)
    for ref in K.parents_of(table):
        r = Q.flag_missing_parent(r, ref.column, getattr(t, ref.parent), ref.key, MSG_FK.format(table, ref.column),
                                  lookup=ref.parent in K.LOOKUPS)
    for c in ([rules.key] if rules.key else []) + list(rules.unique):
        value = unique_value(table, c)
        asked = r.select(value.alias("_ask")).where(F.col("_ask").isNotNull()).distinct()
        stored = (getattr(t, table).select(value.alias("_have")).join(asked, F.col("_have") == F.col("_ask"), "left_semi")
                  .distinct().withColumn("_hit", F.lit(True)))
        r = Q.with_reasons(r.withColumn("_value", value).join(stored, F.col("_value") == F.col("_have"), "left"),
                           [(F.col("_hit").isNotNull(), MSG_DUPLICATE.format(table, c))]).drop("_value", "_have", "_hit")
    return r


def load_rows(t: Tables, table: str, batch: DataFrame) -> Loaded:
    """Load a batch (``req_seq``, all different, and columns of the table; absent
    ones are NULL). A NULL primary key gets the next ids, after all stored and
    loaded ones, in batch order."""
    rules = K.RULES[table]
    r = cut(faults(t, table, batch), "load")
    keys = ([rules.key] if rules.key else []) + list(rules.unique)
    # Rows without any unique value compete for nothing.
    held = [unique_value(table, c).alias(f"_u{i}") for i, c in enumerate(keys)]
    some = F.lit(False)
    for c in keys:
        some = some | F.col(c).isNotNull()
    good = r.where((F.size("reasons") == 0) & some).select(SEQ, *held)
    if keys and not good.isEmpty():
        r = r.join(first_come(good, SEQ, [f"_u{i}" for i in range(len(keys))]), SEQ, "left")
        r = cut(Q.with_reasons(r, [(F.col("won") == F.lit(False), MSG_TWICE)]).drop("won"), "load")
    ok, rejected = Q.split(r)
    new = ok.select(SEQ, *[F.col(f.name).cast(f.dataType) for f in C.SCHEMAS[table].fields])
    if rules.key:
        # whole rows are dealt out for their ids: no ids to join back
        given = new.select(rules.key).unionByName(getattr(t, table).select(rules.key))
        top = cut(given.agg(F.coalesce(F.max(rules.key), F.lit(0)).cast("bigint").alias("_top")), "top").scalar()
        numbered = new_ids(new.where(F.col(rules.key).isNull()).drop(rules.key), SEQ, {rules.key: top})
        new = numbered.select(*new.columns).unionByName(new.where(F.col(rules.key).isNotNull()))
    tables = t.with_(**{table: getattr(t, table).unionByName(new.drop(SEQ))})
    return Loaded({table: new}, {table: rejected}, tables)


def load_tables(t: Tables, batches: dict[str, DataFrame]) -> Loaded:
    """Load batches of several tables, parents first."""
    done = Loaded({}, {}, t)
    for table in K.parents_first():
        if table in batches:
            step = load_rows(done.tables, table, batches[table])
            done = Loaded(done.accepted | step.accepted, done.rejected | step.rejected, step.tables)
    return done


def outcomes(done: Loaded) -> DataFrame:
    """(tabel, req_seq, accepted, reasons) of every row of a load."""
    out = None
    for table, rejected in done.rejected.items():
        part = done.accepted[table].select(F.lit(table).alias("tabel"), SEQ, F.lit(True).alias("accepted"),
                                           F.lit("").alias("reasons")).unionByName(
            rejected.select(F.lit(table).alias("tabel"), SEQ, F.lit(False).alias("accepted"),
                            F.array_join(F.array_sort("reasons"), "|").alias("reasons")))
        out = part if out is None else out.unionByName(part)
    return out


@dataclass
class Deleted:
    tables: Tables
    gone: dict[str, DataFrame] = field(default_factory=dict)    # keys removed, by table
    touched: list[str] = field(default_factory=list)            # tables that lost rows or values


def delete_rows(t: Tables, table: str, keys: DataFrame, key_col: str) -> Deleted:
    """Delete the rows of ``table`` whose primary key is in ``keys``, with what
    the references do to the tables below it. NULL and unknown keys delete
    nothing. A table is rewritten once: its removed rows are those of any
    CASCADE reference to a removed parent, and their own keys go on downwards."""
    def removed(df: DataFrame, col: str) -> DataFrame:
        return df.select(F.col(col).alias("_gone")).where(F.col("_gone").isNotNull()).distinct()

    root = K.RULES[table].key
    asked = removed(keys, key_col)
    gone = {table: cut(removed(getattr(t, table).join(asked, F.col(root) == F.col("_gone"), "left_semi"), root), "gone")}
    changes = {table: getattr(t, table).join(gone[table], F.col(root) == F.col("_gone"), "left_anti")}
    for child in K.parents_first():
        refs = [r for r in K.parents_of(child) if r.parent in gone]
        if child == table or not refs:
            continue
        df = getattr(t, child)
        lost = F.lit(False)
        for i, ref in enumerate(refs):
            hit = gone[ref.parent].select(F.col("_gone").alias(f"_g{i}"))
            df = df.join(hit, F.col(ref.column) == F.col(f"_g{i}"), "left")
            if ref.action == K.CASCADE:
                lost = lost | F.col(f"_g{i}").isNotNull()
        kept = df.where(~lost)
        for i, ref in enumerate(refs):
            if ref.action == K.SET_NULL:
                kept = kept.withColumn(ref.column, F.when(F.col(f"_g{i}").isNull(), F.col(ref.column)))
        changes[child] = kept.select(*getattr(t, child).columns)
        own = K.RULES[child].key
        if own and K.children_of(child) and any(r.action == K.CASCADE for r in refs):
            gone[child] = cut(removed(df.where(lost), own), "gone")
    return Deleted(t.with_(**changes), gone, list(changes))
