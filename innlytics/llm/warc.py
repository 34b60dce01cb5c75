"""WARC files written by Spark and read back by boundary-chain verification.

Writing: one record per page. Of equal payloads of at least ``MIN_REVISIT``
bytes the page with the largest id is a response and the others are revisit
records that name it; smaller payloads are all responses. Spark's text writer
makes the files (header, payload, blank lines), at most ``RECORDS_PER_FILE``
records to a file, under the shared folder.

Reading: the magic that begins a record may also stand inside a payload, so
finding it proves nothing. Tasks emit every candidate record with the offset
at which its successor would begin; pointer jumping from offset 0 of each
file (each round doubles the length of the pointers, by joins on file and
offset) keeps the candidates that are reachable, and only those are records.

Defined edge results: NULL html counts as empty, NULL urls become empty, line
breaks in urls become spaces; a NULL page_id stays NULL; repeated rows give a
record each (rows with the largest id are all responses); an empty table
gives no files and no records; other columns are ignored.
"""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from innlytics.llm.common import cut, drop, new_path

MAGIC = b"WARC/1.0\r\n"
MIN_REVISIT = 1000
#: Payload bytes of the smallest class of records, and how many of these make a file (256 MB at most); a larger
#: record is a file of its own.
RECORD_BYTES, RECORDS_PER_FILE = 1 << 17, 2048
BROADCAST_ROWS = 20_000
ARROW_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def _bounded(df: DataFrame, max_rows: int) -> DataFrame:
    """A broadcast hint when the frame is small (counted), else a plain join."""
    return F.broadcast(df) if df.limit(max_rows + 1).count() <= max_rows else df


def write_warc(pages: DataFrame, path: str | None = None) -> str:
    """Write the pages; returns the folder with the files."""
    spark = pages.sparkSession
    path = path or new_path(spark, "warc")
    html = F.coalesce(F.col("html"), F.lit(""))
    raw = html.cast("binary")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.coalesce("url", F.lit("")).alias("url"),
                        html.alias("html"), F.sha1(raw).alias("digest"),
                        F.octet_length(raw).cast("long").alias("size"))
    # one row for each payload that occurs again; map-side combined
    again = cut(rows.where(F.col("size") >= MIN_REVISIT).groupBy("digest").agg(
        F.max("page_id").alias("first_id"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n"), "payloads")
    rows = rows.join(_bounded(again, BROADCAST_ROWS), "digest", "left")
    revisit = (F.col("size") >= MIN_REVISIT) & F.col("first_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first_id"))
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))
    urn = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(F.col(c).cast("string"), F.lit("null")), F.lit(">"))
    head = F.concat(
        F.lit(MAGIC.decode()), line("WARC-Type", F.when(revisit, F.lit("revisit")).otherwise(F.lit("response"))),
        line("WARC-Record-ID", urn("page_id")), line("WARC-Date", F.lit("1970-01-01T00:00:00Z")),
        line("WARC-Target-URI", F.regexp_replace("url", r"[\r\n]+", " ")),
        F.when(revisit, line("WARC-Refers-To", urn("first_id"))).otherwise(F.lit("")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
        line("X-Payload-Length", F.col("size").cast("string")), line("Content-Type", F.lit("text/html")),
        line("Content-Length", F.when(revisit, F.lit("0")).otherwise(F.col("size").cast("string"))), F.lit("\r\n"))
    record = F.concat(head, F.when(revisit, F.lit("")).otherwise(F.col("html")))
    # records of about one size share files: each class doubles the size and halves the records of a file
    kind = F.greatest(F.lit(0), F.ceil(F.log2(F.octet_length("html") / RECORD_BYTES))).cast("int")
    rows = rows.withColumn("kind", F.coalesce(kind, F.lit(0)))
    for (k,) in sorted(rows.select("kind").distinct().collect()):  # at most 32 for records below 2 GB
        (rows.where(F.col("kind") == k).select(record.alias("value")).write.option("lineSep", "\r\n\r\n")
         .option("maxRecordsPerFile", max(1, RECORDS_PER_FILE >> k)).text(f"{path}/size={k}"))
    return path


def _page(value: str | None) -> int | None:
    inner = (value or "").removeprefix("<urn:page:").removesuffix(">")
    return int(inner) if inner.lstrip("-").isdigit() else None


def parse_record(data: bytes, at: int) -> dict | None:
    """The record that begins at ``at``, if what stands there is one."""
    end = data.find(b"\r\n\r\n", at)
    if end < 0:
        return None
    head = {}
    for x in data[at + len(MAGIC):end].split(b"\r\n"):
        name, sep, value = x.partition(b": ")
        if not sep:
            return None
        head[name] = value.decode("utf-8", "replace")
    size = head.get(b"Content-Length", "")
    if not size.isdigit():
        return None
    begin = end + 4
    after = begin + int(size)
    if data[after:after + 4] != b"\r\n\r\n":
        return None
    payload = data[begin:after]
    kind = head.get(b"WARC-Type")
    stated = head.get(b"WARC-Payload-Digest", "").removeprefix("sha1:")
    full = head.get(b"X-Payload-Length", "")
    if kind == "revisit":  # the payload is in the record it refers to
        digest, n = stated, int(full) if full.isdigit() else None
    else:
        digest, n = hashlib.sha1(payload).hexdigest(), len(payload)
    return {"begin": at, "next": after + 4, "record_type": kind, "page_id": _page(head.get(b"WARC-Record-ID")),
            "refers_to": _page(head.get(b"WARC-Refers-To")), "url": head.get(b"WARC-Target-URI"),
            "payload_bytes": n, "payload_digest": digest, "intact": not stated or stated == digest, "payload": payload}


CANDIDATE = {"begin": "long", "next": "long", "record_type": "string", "page_id": "long", "refers_to": "long",
             "url": "string", "payload_bytes": "long", "payload_digest": "string", "intact": "boolean"}
SCHEMA = "file string, " + ", ".join(f"{k} {v}" for k, v in CANDIDATE.items())


def candidates(spark: SparkSession, path: str, payloads: bool = False) -> DataFrame:
    """Every place that looks like a record, with the offset of its successor."""
    def step(batches):
        for pdf in batches:
            for file, data in zip(pdf["path"], pdf["content"]):
                rows, at = [], data.find(MAGIC)
                while at >= 0:
                    row = parse_record(data, at)
                    if row:
                        if not payloads:
                            del row["payload"]
                        rows.append({"file": file, **row})
                    at = data.find(MAGIC, at + 1)
                    if len(rows) == 512:
                        yield _frame(rows, payloads)
                        rows = []
                if rows:
                    yield _frame(rows, payloads)

    files = spark.read.format("binaryFile").load(path).where("length > 0").select("path", "content")
    return files.mapInPandas(step, SCHEMA + (", payload binary" if payloads else ""))


def _frame(rows: list, payloads: bool) -> pd.DataFrame:
    out = pd.DataFrame(rows, columns=["file", *CANDIDATE, *["payload"] * payloads])
    for c in ("page_id", "refers_to", "payload_bytes"):
        out[c] = out[c].astype("Int64")
    return out


def reachable(links: DataFrame) -> DataFrame:
    """(file, begin) on the chain from offset 0, by pointer jumping over
    (file, begin, next). The rounds end when nothing new is reached."""
    jump = cut(links.select("file", "begin", "next"), "jump")
    seen = cut(jump.where("begin = 0").select("file", "begin").distinct(), "chain")
    n = seen.count()
    while True:
        ahead = (seen.join(jump, ["file", "begin"]).select("file", F.col("next").alias("begin"))
                 .join(links.select("file", "begin"), ["file", "begin"], "left_semi"))
        new = cut(seen.union(ahead).distinct(), "chain")
        more = new.count()
        drop(seen)
        seen = new
        if more == n:
            drop(jump)
            return seen
        n = more
        far = jump.select("file", F.col("begin").alias("next"), F.col("next").alias("far"))
        old, jump = jump, cut(jump.join(far, ["file", "next"]).select("file", "begin", F.col("far").alias("next")), "jump")
        drop(old)


def read_warc(spark: SparkSession, path: str, payloads: bool = False) -> DataFrame:
    """The records of the files in ``path``; with ``payloads`` also the bytes."""
    rows = spark.conf.get(ARROW_ROWS)
    spark.conf.set(ARROW_ROWS, "1")  # a whole file to a batch
    try:
        found = cut(candidates(spark, path, payloads), "candidates")
    finally:
        spark.conf.set(ARROW_ROWS, rows)
    return found.join(reachable(found), ["file", "begin"], "left_semi")


def archive_pages(pages: DataFrame) -> DataFrame:
    """Write the pages and read them back: page_id, payload_bytes,
    payload_digest, record_type, refers_to."""
    spark = pages.sparkSession
    if pages.isEmpty():
        return spark.createDataFrame([], SCHEMA).select(
            "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    return read_warc(spark, write_warc(pages)).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
