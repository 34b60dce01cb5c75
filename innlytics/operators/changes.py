"""Change-driven bookkeeping (the database triggers) as DataFrame operators.

Each function is pure (DataFrames in, DataFrames out) and is used both in
batch and inside ``streaming.feeds`` micro-batches.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from innlytics.functions import scalar as E
from innlytics.sources import catalog as C

# Fixed texts of the audit lines (the reference's wording).
TXT_NEW_RESERVATION = ("Reservasi baru #", " untuk tamu ID ")
TXT_CHECKED_OUT = ("Reservasi #", " berhasil check-out")
TXT_TRANSITION = ("Reservasi #", " berubah status: ", " -> ")
TXT_API = {
    "booking": ("Buat reservasi #", " untuk tamu ID "),
    "checkin": ("Check-in reservasi #",),
    "checkout": ("Check-out reservasi #",),
    "payment": ("Pembayaran reservasi #", " - Rp"),
    "room_add": ("Tambah kamar ",),
    "room_edit": ("Update kamar ID ",),
    "room_delete": ("Hapus kamar ID ",),
    "login": ("Login ", " sebagai "),
}

AUDIT_COLS = ["aktivitas", "user_id", "ip_address", "tanggal", "source"]


def audit_new_reservations(new_res: DataFrame, when=None) -> tuple[DataFrame, DataFrame]:
    """One trigger line per inserted reservation. CONCAT with a NULL guest
    is NULL and aktivitas is NOT NULL, so such rows are quarantined.
    Returns (audit lines, quarantined reservations)."""
    text = E.concat_all(TXT_NEW_RESERVATION[0], F.col("id_reservasi").cast("string"),
                        TXT_NEW_RESERVATION[1], F.col("tamu_id").cast("string"))
    ts = F.col("tanggal_pesan") if when is None else F.lit(when).cast("timestamp_ntz")
    lines = new_res.select(text.alias("aktivitas"), F.lit(C.TRIGGER_USER_ID).cast("bigint").alias("user_id"),
                           F.lit(C.TRIGGER_IP).alias("ip_address"), ts.alias("tanggal"),
                           F.lit("trigger").alias("source"))
    return lines.where(F.col("aktivitas").isNotNull()), new_res.where(text.isNull())


def status_transitions(feed: DataFrame, initial: DataFrame | None = None, key: str = "reservasi_id",
                       status: str = "status_reservasi_id", block_seconds: int = 3600) -> DataFrame:
    """(key, ts, seq, old, new) for every feed row whose status differs
    from the previous status of the same key (NULL on either side never
    fires). ``initial`` (key, status) is the status before the feed.

    The previous row is found per (key, time block) with ``lag`` and, for the
    first row of a block, from a per-block summary carried over with a
    window across blocks; a key with a huge history is thus processed as
    many parallel block partitions, and the cross-block window only sees
    one summary row per block."""
    blk = F.floor(F.unix_seconds(F.col("ts").cast("timestamp")) / F.lit(block_seconds))
    w = Window.partitionBy(key, "_blk").orderBy("ts", "seq")
    x = (feed.select(key, "ts", "seq", status).withColumn("_blk", blk)
         .withColumn("_old", F.lag(status).over(w))
         .withColumn("_first", F.row_number().over(w) == 1))
    summ = x.groupBy(key, "_blk").agg(F.max_by(F.col(status), F.struct("ts", "seq")).alias("_last"))
    wb = Window.partitionBy(key).orderBy("_blk")
    summ = (summ.withColumn("_carry", F.lag("_last").over(wb))
            .withColumn("_first_blk", F.row_number().over(wb) == 1).drop("_last"))
    j = x.join(summ, [key, "_blk"], "inner")
    if initial is not None:
        j = j.join(initial.select(key, F.col(status).alias("_init")), key, "left")
        carry = F.when(F.col("_first_blk"), F.col("_init")).otherwise(F.col("_carry"))
    else:
        carry = F.when(F.col("_first_blk"), F.lit(None)).otherwise(F.col("_carry"))
    old = F.when(F.col("_first"), carry).otherwise(F.col("_old"))
    return (j.select(key, "ts", "seq", old.cast("bigint").alias("old_status"),
                     F.col(status).alias("new_status"))
            .where(F.col("new_status") != F.col("old_status")))


def transitions_between(before: DataFrame, after: DataFrame, key: str = "id_reservasi",
                        status: str = "status_reservasi_id") -> DataFrame:
    """C2 on two snapshots: rows whose status changed (NULLs never fire)."""
    b = before.select(key, F.col(status).alias("old_status"))
    a = after.select(key, F.col(status).alias("new_status"))
    return b.join(a, key, "inner").where(F.col("new_status") != F.col("old_status"))


def audit_transitions(transitions: DataFrame, key: str = "reservasi_id") -> DataFrame:
    """C3: 'Reservasi #id berubah status: a -> b' (trigger user, fixed ip)."""
    text = E.concat_all(TXT_TRANSITION[0], F.col(key).cast("string"), TXT_TRANSITION[1],
                        F.col("old_status").cast("string"), TXT_TRANSITION[2], F.col("new_status").cast("string"))
    ts = F.col("ts") if "ts" in transitions.columns else F.lit(None).cast("timestamp_ntz")
    return transitions.select(text.alias("aktivitas"), F.lit(C.TRIGGER_USER_ID).cast("bigint").alias("user_id"),
                              F.lit(C.TRIGGER_IP).alias("ip_address"), ts.alias("tanggal"),
                              F.lit("trigger").alias("source"))


def room_updates(transitions: DataFrame, stays: DataFrame, key: str = "reservasi_id") -> DataFrame:
    """The room writes of C4 that can matter: (kamar_id, ts, seq, room_status)
    of each reservation's latest effective transition, per stay line: to
    Check-in -> Terisi, to Check-out/Dibatalkan -> Tersedia, to Baru ->
    nothing. A reservation's earlier writes are overwritten in all its rooms,
    so only the latest is joined with the stays (partial ``max_by`` first)."""
    row = F.struct("ts", "seq", "new_status")
    last = (transitions.where(F.col("new_status").isin(C.RES_CHECKED_IN, C.RES_CHECKED_OUT, C.RES_CANCELLED))
            .groupBy(key).agg(F.max_by(row, F.struct("ts", "seq")).alias("_t")).select(key, "_t.*"))
    eff = (last.where(F.col("new_status").isin(C.RES_CHECKED_IN, C.RES_CHECKED_OUT, C.RES_CANCELLED))
           .select(F.col(key).alias("_res"), "ts", "seq",
                   F.when(F.col("new_status") == C.RES_CHECKED_IN, F.lit(C.ROOM_OCCUPIED))
                   .otherwise(F.lit(C.ROOM_FREE)).cast("bigint").alias("room_status")))
    rooms = stays.where(F.col("kamar_id").isNotNull()).select(F.col("reservasi_id").alias("_res"), "kamar_id")
    return eff.join(rooms, "_res", "inner").drop("_res")


def room_status_after(kamar: DataFrame, transitions: DataFrame, stays: DataFrame) -> DataFrame:
    """C4: room table after the transitions; per room the latest write (by
    (ts, seq)) wins, found with a partial-aggregating ``max_by`` (no sort
    of a room's whole history). Maintenance is overwritten, as the trigger
    does."""
    latest = (room_updates(transitions, stays).groupBy("kamar_id")
              .agg(F.max_by("room_status", F.struct("ts", "seq")).alias("_new")))
    return (kamar.join(latest, F.col("id_kamar") == F.col("kamar_id"), "left")
            .withColumn("status_id", F.coalesce("_new", "status_id")).drop("kamar_id", "_new"))


def checkout_results(checkouts: DataFrame) -> DataFrame:
    """E7's third site: the checkout procedure's reply for each reservation (NULL
    for a NULL id, as CONCAT)."""
    return checkouts.select(E.concat_all(TXT_CHECKED_OUT[0], F.col("reservasi_id").cast("string"), TXT_CHECKED_OUT[1])
                            .alias("hasil"))


def _php_str(c) -> F.Column:
    """PHP string concatenation turns NULL into ''."""
    return F.coalesce(F.col(c).cast("string") if isinstance(c, str) else c.cast("string"), F.lit(""))


def audit_actions(kind: str, rows: DataFrame, user_id=None, ip: str = C.API_IP, when=None) -> DataFrame:
    """The API's own log line for a batch of accepted actions.

    kind: booking (id_reservasi, tamu_id), checkin/checkout (reservasi_id),
    payment (reservasi_id, total), room_add (nomor_kamar), room_edit /
    room_delete (id_kamar), login (username, role)."""
    t = TXT_API[kind]
    if kind == "booking":
        text = F.concat(F.lit(t[0]), _php_str("id_reservasi"), F.lit(t[1]), _php_str("tamu_id"))
    elif kind in ("checkin", "checkout"):
        text = F.concat(F.lit(t[0]), _php_str("reservasi_id"))
    elif kind == "payment":
        text = F.concat(F.lit(t[0]), _php_str("reservasi_id"), F.lit(t[1]), E.rupiah("total"))
    elif kind == "room_add":
        text = F.concat(F.lit(t[0]), _php_str("nomor_kamar"))
    elif kind in ("room_edit", "room_delete"):
        text = F.concat(F.lit(t[0]), _php_str("id_kamar"))
    elif kind == "login":
        text = F.concat(F.lit(t[0]), _php_str("username"), F.lit(t[1]), _php_str("role"))
    else:
        raise ValueError(kind)
    uid = F.col("actor_id") if user_id is None and "actor_id" in rows.columns else F.lit(user_id)
    ts = F.lit(when).cast("timestamp_ntz") if when is not None else F.lit(None).cast("timestamp_ntz")
    return rows.select(text.alias("aktivitas"), uid.cast("bigint").alias("user_id"), F.lit(ip).alias("ip_address"),
                       ts.alias("tanggal"), F.lit("api").alias("source"))
