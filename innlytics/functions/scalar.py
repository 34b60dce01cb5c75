"""Scalar expressions of the domain (all JVM-side built-ins, codegen-friendly)."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

MONEY_SUM = T.DecimalType(20, 2)


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def month_key(c) -> Column:
    """DATE_FORMAT(x, '%Y-%m')."""
    return F.date_format(col(c), "yyyy-MM")


def day_range(ts, day) -> Column:
    """DATE(ts) = day written as a half-open range so it reaches the scan."""
    day = F.lit(day) if isinstance(day, (str, dt.date)) else col(day)
    start = day.cast("date").cast("timestamp_ntz")
    end = F.date_add(day.cast("date"), 1).cast("timestamp_ntz")
    return (col(ts) >= start) & (col(ts) < end)


def months_back(as_of, months: int) -> Column:
    """DATE_SUB(as_of, INTERVAL n MONTH) at midnight (month-end clamped)."""
    return F.add_months(F.lit(as_of).cast("date"), -months).cast("timestamp_ntz")


def pct_2dp(num, den) -> Column:
    """ROUND(num / den * 100, 2) in exact decimal arithmetic, HALF_UP."""
    ratio = col(num).cast("decimal(20,0)") * F.lit(100) / col(den).cast("decimal(20,0)")
    return F.round(ratio, 2).cast("decimal(10,2)")


def avg_2dp(total, count) -> Column:
    """ROUND(AVG(int), 2) from a pre-aggregated sum and count, exact decimal."""
    return F.round(col(total).cast("decimal(30,0)") / col(count).cast("decimal(20,0)"), 2).cast("decimal(10,2)")


def ifnull0(c) -> Column:
    """IFNULL(x, 0)."""
    return F.coalesce(col(c), F.lit(0))


def money_sum(c) -> Column:
    return F.sum(col(c)).cast(MONEY_SUM)


def padded_id(c, width: int = 3) -> Column:
    """PHP str_pad(id, width, '0', LEFT): pads, never truncates."""
    s = col(c).cast("string")
    return F.lpad(s, F.greatest(F.lit(width), F.length(s)), "0")


def invoice_number(reservation_id, as_of) -> Column:
    """B10: 'INV-' + yyyyMM(as_of) + '-' + id padded to 3."""
    when = F.lit(as_of) if isinstance(as_of, (str, dt.date, dt.datetime)) else col(as_of)
    return F.concat(F.lit("INV-"), F.date_format(when, "yyyyMM"), F.lit("-"), padded_id(reservation_id))


def rupiah(c) -> Column:
    """PHP number_format(x, 0, ',', '.'): round half up first, then group."""
    return F.translate(F.format_number(F.round(col(c).cast("decimal(20,2)"), 0), 0), ",", ".")


def php_empty(c, dtype: T.DataType) -> Column:
    """PHP ``!isset($x) || empty($x)`` for a decoded JSON value:
    NULL, '', '0', 0, 0.0 and false are empty; the string '0.0' is not."""
    c = col(c)
    if isinstance(dtype, T.StringType):
        return c.isNull() | (c == "") | (c == "0")
    if isinstance(dtype, T.BooleanType):
        return c.isNull() | ~c
    if isinstance(dtype, T.NumericType):
        return c.isNull() | (c == 0)
    if isinstance(dtype, (T.ArrayType, T.MapType)):
        return c.isNull() | (F.size(c) == 0)
    return c.isNull()


def text_key(c) -> Column:
    """A text as the schema's keys compare it: MySQL's default collation knows
    neither case nor accents. Equality, grouping and joins of the result do so."""
    return F.collate(col(c), "UNICODE_CI_AI")


def concat_all(*parts) -> Column:
    """MySQL CONCAT, NULL if any argument is NULL (same as Spark concat)."""
    return F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts])
