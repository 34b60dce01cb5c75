"""Integrity checks (Q1-Q6) and stay validation (V1) as data-quality jobs.

Row-level rules are boolean expressions evaluated in one projection; set
rules (uniqueness, foreign keys) are one aggregation or one anti join each.
Rejections always keep the row and carry the reason(s).
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from innlytics.functions import scalar as E
from innlytics.plans import joins

# Fixed messages (the API's own wording).
MSG_REQUIRED = "Field '{}' wajib diisi"
MSG_CHECKOUT = "Tanggal checkout harus lebih besar dari tanggal checkin"


def with_reasons(df: DataFrame, rules: Iterable[tuple[Column, str | Column]], out: str = "reasons") -> DataFrame:
    """Append ``out``: array of the reasons whose condition is true (NULL
    conditions count as not violated)."""
    parts = [F.when(F.coalesce(cond, F.lit(False)), F.lit(msg) if isinstance(msg, str) else msg)
             for cond, msg in rules]
    arr = F.filter(F.array(*parts), lambda x: x.isNotNull()) if parts else F.array().cast("array<string>")
    if out in df.columns:
        return df.withColumn(out, F.concat(F.col(out), arr))
    return df.withColumn(out, arr)


def split(df: DataFrame, out: str = "reasons") -> tuple[DataFrame, DataFrame]:
    """(valid rows without ``out``, rejected rows with ``out``)."""
    ok = F.size(F.col(out)) == 0
    return df.where(ok).drop(out), df.where(~ok)


def required_rules(df: DataFrame, cols: Sequence[str]) -> list[tuple[Column, str]]:
    """Q1: PHP ``!isset || empty``: NULL, '', '0', 0 are missing."""
    types = {f.name: f.dataType for f in df.schema.fields}
    return [(E.php_empty(c, types[c]), MSG_REQUIRED.format(c)) for c in cols]


def required(df: DataFrame, cols: Sequence[str], out: str = "reasons") -> DataFrame:
    return with_reasons(df, required_rules(df, cols), out)


def unique(df: DataFrame, cols: Sequence[str], case_insensitive: bool = False) -> DataFrame:
    """Q2: key values occurring more than once (rows with a NULL key part are
    exempt). Text keys compare without case and accents when asked (MySQL's
    default collation); the smallest of the lower-cased spellings stands for all."""
    nn = df.where(F.lit(True) if not cols else F.expr(" AND ".join(f"`{c}` IS NOT NULL" for c in cols)))
    if not case_insensitive:
        return nn.groupBy(*cols).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)
    keys = [E.text_key(c).alias(f"_k{i}") for i, c in enumerate(cols)]
    return (nn.groupBy(*keys).agg(*[F.min(F.lower(c)).alias(c) for c in cols], F.count(F.lit(1)).alias("n"))
            .where(F.col("n") > 1).select(*cols, "n"))


def not_null(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Q3: rows where a NOT NULL column is NULL."""
    cond = F.lit(False)
    for c in cols:
        cond = cond | F.col(c).isNull()
    return df.where(cond)


def in_range(df: DataFrame, col: str, lo, hi) -> DataFrame:
    """Q4: CHECK (col BETWEEN lo AND hi) violations; NULL passes."""
    return df.where(F.col(col).isNotNull() & ~F.col(col).between(lo, hi))


def orphans(child: DataFrame, fk: str, parent: DataFrame, pk: str, lookup: bool = False) -> DataFrame:
    """Q5: child rows whose non-NULL foreign key has no parent. ``lookup``
    marks a fixed lookup table as parent (broadcast after a size check)."""
    keys = parent.select(F.col(pk).alias("_pk"))
    if lookup and joins.fits(parent):
        keys = F.broadcast(keys)
    return child.where(F.col(fk).isNotNull()).join(keys, F.col(fk) == F.col("_pk"), "left_anti")


def exists(requests: DataFrame, fk: str, parent: DataFrame, pk: str) -> DataFrame:
    """Q6: requests whose key exists in the parent table."""
    keys = parent.select(F.col(pk).alias("_pk"))
    return requests.join(keys, F.col(fk) == F.col("_pk"), "left_semi")


def flag_missing_parent(df: DataFrame, fk: str, parent: DataFrame, pk: str, reason: str,
                        out: str = "reasons", nullable: bool = True, lookup: bool = False) -> DataFrame:
    """Add ``reason`` to rows whose ``fk`` has no parent (NULL passes when
    ``nullable``), as the FK constraint would refuse the insert.

    ``lookup=True`` marks the parent as a fixed lookup table: its keys are
    broadcast (size-checked), so the check stays a map-side probe even when
    the foreign key is a constant default that leaves no equi-join key.
    Otherwise the parent is first reduced to the keys the batch asks for
    (semi join: a small batch is the build side and the parent is only
    scanned), so a small batch never shuffles a large parent."""
    keys = parent.select(F.col(pk).alias("_fkp"))
    if not lookup:
        asked = df.select(F.col(fk).alias("_ask")).where(F.col("_ask").isNotNull()).distinct()
        keys = keys.join(asked, F.col("_fkp") == F.col("_ask"), "left_semi")
    keys = keys.distinct().withColumn("_hit", F.lit(True))
    if lookup and joins.fits(parent):
        keys = F.broadcast(keys)
    j = df.join(keys, F.col(fk) == F.col("_fkp"), "left")
    bad = F.col("_hit").isNull() & (F.col(fk).isNotNull() if nullable else F.lit(True))
    return with_reasons(j, [(bad, reason)], out).drop("_fkp", "_hit")


def validate_stays(stays: DataFrame, ci: str = "tanggal_checkin", co: str = "tanggal_checkout",
                   out: str = "reasons") -> DataFrame:
    """V1: checkout must be after checkin (the insert trigger's rule)."""
    return with_reasons(stays, [(F.col(co) <= F.col(ci), MSG_CHECKOUT)], out)
