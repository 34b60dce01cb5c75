"""Sources and sinks S1-S4.

S1 read the domain tables with explicit schemas (parquet; JDBC is the same
   reader with ``format('jdbc')`` and a ``dbtable`` per table), on request only
   the months of a fact table that date bounds can reach;
S2 bulk-load rows after the integrity checks (parquet, fact tables partitioned
   by month for partition pruning on date filters);
S3 JSON documents out (``to_json`` of a struct per row, or ``write.json``), with
   NULL fields written out;
S4 JSON request bodies in (a body that is not one whole JSON object, also one
   with text after it, gives NULL fields, which the required-field check then
   quarantines, as the original treats an undecodable body as an empty one).
"""

from __future__ import annotations

from collections.abc import Collection

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from innlytics.operators import load as LD
from innlytics.operators import quality as Q
from innlytics.sources import catalog
from innlytics.sources.tables import Tables


def read_tables(spark: SparkSession, root: str, fmt: str = "parquet", options: dict | None = None,
                absent: Collection[str] = (), bounds: dict[str, tuple] | None = None) -> Tables:
    """One folder per table under ``root``. A table that cannot be read is
    an error; only the names in ``absent`` are not read and get the fixed
    lookup rows or an empty table. ``bounds`` names (first day, last day), either
    of them None, for fact tables written by month: only rows of these days by
    the table's main date are read, from the folders of their months alone."""
    frames = {}
    for name, schema in catalog.SCHEMAS.items():
        if name not in absent:
            path = f"{root.rstrip('/')}/{name}"
            reader = spark.read.format(fmt).options(**(options or {}))
            if name in (bounds or {}):
                df = reader.schema(T.StructType([*schema.fields, T.StructField(MONTH, T.StringType())])).load(path)
                frames[name] = _between(df, MONTH_PARTITION[name], *bounds[name]).select(*schema.names)
            else:
                frames[name] = reader.schema(schema).load(path).select(*schema.names)
    return Tables.from_frames(spark, frames)


def _between(df: DataFrame, day: str, first, last) -> DataFrame:
    """Rows of the days first to last: by the date, and by the month derived from
    each bound, which prunes folders."""
    if first is not None:
        at = F.lit(first).cast("date")
        df = df.where(F.col(MONTH) >= F.date_format(at, MONTH_FORMAT)).where(F.col(day) >= at.cast(df.schema[day].dataType))
    if last is not None:
        at = F.lit(last).cast("date")
        df = df.where(F.col(MONTH) <= F.date_format(at, MONTH_FORMAT)).where(
            F.col(day) < F.date_add(at, 1).cast(df.schema[day].dataType))
    return df


# The key each fact table is read by in parallel over JDBC.
JDBC_PARTITION = {"reservasi": "id_reservasi", "detail_reservasi": "id_detail", "pembayaran": "id_pembayaran",
                  "invoice": "id_invoice", "checkin": "id_checkin", "checkout": "id_checkout",
                  "ulasan": "id_ulasan", "audit_log": "id_log", "tamu": "id_tamu", "users": "id_user"}


def read_jdbc(spark: SparkSession, url: str, properties: dict, tables: list[str] | None = None,
              parts: int = 64) -> Tables:
    """S1 over JDBC (not exercised in tests: needs a database). Growing tables
    are read in ``parts`` ranges of their key (bounds from one min/max query)."""
    frames = {}
    for name in tables or list(catalog.SCHEMAS):
        key = JDBC_PARTITION.get(name)
        split = {}
        if key:
            ends = spark.read.jdbc(url, f"(SELECT MIN({key}) AS lo, MAX({key}) AS hi FROM {name}) AS ends",
                                   properties=properties).first()
            if ends["lo"] is not None:
                split = {"column": key, "lowerBound": ends["lo"], "upperBound": ends["hi"] + 1, "numPartitions": parts}
        df = spark.read.jdbc(url, name, properties=properties, **split)
        frames[name] = df.select(*[F.col(f.name).cast(f.dataType) for f in catalog.SCHEMAS[name].fields])
    return Tables.from_frames(spark, frames)


MONTH_PARTITION = {
    "detail_reservasi": "tanggal_checkin",
    "pembayaran": "tanggal_bayar",
    "reservasi": "tanggal_pesan",
}


#: The partition column of fact tables: the month of their main date.
MONTH, MONTH_FORMAT = "bulan", "yyyy-MM"


def write_table(df: DataFrame, root: str, name: str, mode: str = "append",
                required_cols: list[str] | None = None) -> DataFrame:
    """Write ``df`` as table ``name`` after the checks; returns the
    rejected rows (not written). Fact tables are partitioned by month of
    their main date so date filters prune files."""
    checked = Q.required(df, required_cols) if required_cols else df.withColumn("reasons", F.array().cast("array<string>"))
    ok, rejected = Q.split(checked)
    writer = ok
    part = MONTH_PARTITION.get(name)
    if part:
        writer = ok.withColumn(MONTH, F.date_format(part, MONTH_FORMAT))
        writer.write.mode(mode).partitionBy(MONTH).parquet(f"{root.rstrip('/')}/{name}")
    else:
        writer.write.mode(mode).parquet(f"{root.rstrip('/')}/{name}")
    return rejected


def load_into(t: Tables, root: str, batches: dict[str, DataFrame]) -> LD.Loaded:
    """S2 into a folder of tables: the batches are judged against the stored
    tables ``t`` and each other (``load.load_tables``), and the accepted rows are
    added to the folders under ``root``, by month for fact tables."""
    done = LD.load_tables(t, batches)
    for name, rows in done.accepted.items():
        write_table(rows.drop(LD.SEQ), root, name)
    return done


def to_documents(df: DataFrame, out: str = "json") -> DataFrame:
    """S3: one JSON document per row (nested arrays/structs and NULL fields kept)."""
    return df.select(F.to_json(F.struct(*[F.col(c) for c in df.columns]), {"ignoreNullFields": "false"}).alias(out))


def write_documents(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """S3 sink: newline-delimited JSON files."""
    df.write.mode(mode).option("ignoreNullFields", "false").json(path)


def _once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """``df`` with the column ``name``, computed once a row however many later columns
    and filters read it: they are inlined into a projection, not into a generator."""
    return df.select("*", F.explode_outer(F.array(value)).alias(name))


# Reason of a field whose value is not of the column's type (the database's wording).
MSG_TYPE = "Incorrect value for column '{}'"


def parse_requests(bodies: DataFrame, schema: T.StructType, body_col: str = "body",
                   required_cols: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """Decode request bodies; (valid, quarantined-with-reasons). A field of
    another type than the schema's is a fault, unless it is absent or null.

    A body is parsed once, to VARIANT. The parser stops after the first value, so
    the body stands in an array before its own SHA-256: if that is the second
    element, the body was one whole value."""
    body = F.col(body_col)
    mark = F.sha2(body, 256)
    parsed = _once(bodies, "_all", F.try_parse_json(F.concat(F.lit("["), body, F.lit(',"'), mark, F.lit('"]'))))
    first = F.try_variant_get("_all", "$[0]", "variant")
    whole = (F.try_variant_get("_all", "$[1]", "string") == mark) & F.schema_of_variant(first).startswith("OBJECT")
    parsed = _once(parsed, "_doc", F.when(whole, first)).drop("_all")
    read = []
    for i, f in enumerate(schema.fields):
        path = f"$['{f.name}']"
        text = F.try_variant_get("_doc", path, "string")
        if isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType)):
            value = F.try_variant_get("_doc", path, f.dataType.simpleString())
        else:
            value = text.try_cast(f.dataType)
        read += [value.alias(f"v{i}"), text.isNotNull().alias(f"t{i}")]
    parsed = _once(parsed, "_read", F.struct(*read)).drop("_doc")
    flat = [F.col(f"_read.v{i}").alias(f.name) for i, f in enumerate(schema.fields)]
    wrong = [(F.col(f"_read.t{i}") & F.col(f"_read.v{i}").isNull(), MSG_TYPE.format(f.name)) for i, f in enumerate(schema.fields)]
    faults = F.filter(F.array(*[F.when(c, F.lit(m)) for c, m in wrong]), lambda x: x.isNotNull())
    judged = parsed.select(*bodies.columns, *flat, faults.alias("reasons"))
    return Q.split(Q.required(judged, required_cols or []))
