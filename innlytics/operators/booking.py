"""Booking and availability rules B1-B6, B10 (read side).

Overlap questions are answered without pairing stays with stays or requests
with stays (see ``plans.intervals``): per-room daily summaries, calendar-
bounded windows, and prefix counts. All intervals are half-open
[checkin, checkout): same-day turnover is free.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from innlytics.functions import scalar as E
from innlytics.plans import intervals as IV
from innlytics.plans.checkpoint import cut
from innlytics.sources import catalog as C
from innlytics.sources.tables import Tables

CI, CO = "tanggal_checkin", "tanggal_checkout"


def reservation_totals(t: Tables, reservation_id=None) -> DataFrame:
    """B1: SUM(harga) of the reservation's stay lines, 0 when it has none
    (price as captured, not multiplied by nights, no discount)."""
    res = t.reservasi.select("id_reservasi")
    lines = t.detail_reservasi
    if reservation_id is not None:
        res = res.where(F.col("id_reservasi") == F.lit(reservation_id))
        lines = lines.where(F.col("reservasi_id") == F.lit(reservation_id))
    sums = lines.groupBy("reservasi_id").agg(F.sum("harga").alias("_s"))
    return (res.join(sums, F.col("id_reservasi") == F.col("reservasi_id"), "left")
            .select("id_reservasi", E.ifnull0("_s").cast(E.MONEY_SUM).alias("total")))


def active_stays(t: Tables) -> DataFrame:
    """Stay lines whose reservation is Baru or Check-in (they block a room)."""
    active = t.reservasi.where(F.col("status_reservasi_id").isin(*C.ACTIVE_RESERVATION)).select("id_reservasi")
    return t.detail_reservasi.join(active, F.col("reservasi_id") == F.col("id_reservasi"), "left_semi")


def overlapping_stays(t: Tables) -> DataFrame:
    """Every active stay that overlaps another active stay of the same
    room. Stays must satisfy V1 (checkout > checkin), as the insert trigger
    guarantees; rows breaking it are left to V1."""
    stays = active_stays(t).where(F.col("kamar_id").isNotNull() & (F.col(CO) > F.col(CI)))
    return IV.overlap_flags(stays, "kamar_id", CI, CO).where("overlaps").drop("overlaps")


def _valid(df: DataFrame) -> DataFrame:
    return df.where(F.col(CO) > F.col(CI))


def booking_conflicts(t: Tables, requests: DataFrame, request_id: str = "request_id",
                      requests_valid: bool = False) -> DataFrame:
    """Per request (request_id, kamar_id, checkin, checkout), the number
    of active stays of that room with ``ci < q.co AND co > q.ci``, by cumulative
    counts alone (``intervals.overlap_count``), turned dates included.
    ``requests_valid=True``: the caller already applied V1."""
    stays = active_stays(t).where(F.col("kamar_id").isNotNull()).select("kamar_id", CI, CO)
    requests = cut(requests, "asked")  # read by every count
    asked = requests.select(request_id, "kamar_id", CI, CO)
    total = IV.overlap_count(stays, asked, ["kamar_id"], request_id, CI, CO, out="_n", requests_valid=requests_valid)
    return (requests.join(total, request_id, "left")
            .withColumn("jumlah_konflik", F.coalesce("_n", F.lit(0)).cast("bigint")).drop("_n"))


def available_rooms(t: Tables, requests: DataFrame, request_id: str = "request_id",
                    null_mode: str = "mysql") -> DataFrame:
    """B2: per request (request_id, tipe_id, checkin, checkout), rooms of the
    type with status Tersedia and no active stay overlapping the range.

    A room is free iff one of its free gaps (complement of its merged busy
    blocks) contains the range, and gaps of a room are disjoint, so

        free = #(gap_start <= ci) - #(gap_end < co) + #(ci < gap_start, gap_end < co)

    The first two are cumulative counts per type; the last, the gaps strictly
    inside the request, is counted by dyadic blocks of days
    (``intervals.count_inside``), so that no request costs a row a night.
    ``null_mode='mysql'`` reproduces ``NOT IN`` over a nullable column: an
    overlapping active stay without a room makes the count 0; ``'ignore'``
    is the plain anti join."""
    rooms = t.kamar.where(F.col("status_id") == C.ROOM_FREE).where(F.col("tipe_id").isNotNull()) \
        .select("id_kamar", "tipe_id")
    act = cut(active_stays(t).select("kamar_id", CI, CO), "active")  # the only reading of all stays
    room_stays = _valid(act.where(F.col("kamar_id").isNotNull())).join(
        rooms.select(F.col("id_kamar").alias("kamar_id")), "kamar_id", "left_semi")
    blocks = IV.busy_blocks(room_stays, "kamar_id", CI, CO)
    gaps = IV.free_gaps(blocks, rooms.select(F.col("id_kamar").alias("kamar_id"), "tipe_id"), "kamar_id")
    # One aggregation of the gaps per (type, start, end), written once, feeds both
    # the prefix counts and the exact inner-gap lookup (one shuffle of the gaps).
    gap_counts = cut(gaps.groupBy("tipe_id", "gap_start", "gap_end").agg(F.count(F.lit(1)).alias("_g")), "gaps")
    requests = cut(requests, "asked")  # read by every count
    req = requests.select(request_id, "tipe_id", CI, CO)
    good = _valid(req)
    # kind 0: gap starts <= ci (i.e. < ci + 1); kind 1: gap ends < co
    ev = gap_counts.select("tipe_id", "_g", F.explode(F.array(
        F.struct(F.col("gap_start").alias("_ed"), F.lit(0).alias("_kind")),
        F.struct(F.col("gap_end").alias("_ed"), F.lit(1).alias("_kind")))).alias("_e")).select(
        "tipe_id", "_e._ed", "_e._kind", F.col("_g").alias("_one"))
    pts = good.select(request_id, "tipe_id", F.explode(F.array(
        F.struct(F.date_add(CI, 1).alias("_px"), F.lit(0).alias("_kind")),
        F.struct(F.col(CO).alias("_px"), F.lit(1).alias("_kind")))).alias("_q")).select(
        request_id, "tipe_id", "_q._px", "_q._kind")
    pq = (IV.count_before(ev, pts, ["tipe_id", "_kind"], "_ed", "_one", [request_id], "_px", out="_c")
          .select(request_id, F.when(F.col("_kind") == 0, F.col("_c")).otherwise(-F.col("_c")).alias("_c")))
    inside = IV.count_inside(gap_counts, good, ["tipe_id"], "gap_start", "gap_end", "_g", request_id, CI, CO, out="_c")
    free_valid = pq.unionByName(inside).groupBy(request_id).agg(F.sum("_c").alias("_free"))
    # Invalid ranges (checkout <= checkin): busy rooms are those with a stay
    # covering night q.checkin and starting before q.checkout; counted exactly.
    bad = req.where(~(F.col(CO) > F.col(CI)))
    bad_type_rooms = (rooms.join(bad.select("tipe_id").distinct(), "tipe_id", "left_semi")
                      .select(F.col("id_kamar").alias("kamar_id")))
    n = (IV.nights(room_stays.join(bad_type_rooms, "kamar_id", "left_semi"), CI, CO)
         .join(rooms.select(F.col("id_kamar").alias("kamar_id"), F.col("tipe_id").alias("_rt")), "kamar_id")
         .groupBy("_rt", "night", "kamar_id").agg(F.min(CI).alias("_sci")))
    busy_bad = (bad.join(n, (F.col("_rt") == F.col("tipe_id")) & (n["night"] == bad[CI]), "inner")
                .where(F.col("_sci") < F.col(CO)).select(request_id, "kamar_id").distinct()
                .groupBy(request_id).agg(F.count(F.lit(1)).alias("_busy")))
    per_type = rooms.groupBy(F.col("tipe_id").alias("_tt")).agg(F.count(F.lit(1)).alias("_rooms"))
    free_bad = (bad.join(per_type, F.col("tipe_id") == F.col("_tt"), "inner").join(busy_bad, request_id, "left")
                .select(request_id, (F.col("_rooms") - F.coalesce("_busy", F.lit(0))).alias("_free")))
    # A NULL date makes the overlap predicate NULL: the subquery is empty and
    # every eligible room of the type counts.
    free_null = (req.where(F.col(CI).isNull() | F.col(CO).isNull())
                 .join(per_type, F.col("tipe_id") == F.col("_tt"), "inner")
                 .select(request_id, F.col("_rooms").alias("_free")))
    free = free_valid.unionByName(free_bad).unionByName(free_null)
    out = requests.join(free, request_id, "left").withColumn(
        "tersedia", F.coalesce("_free", F.lit(0)).cast("bigint")).drop("_free")
    if null_mode == "mysql":
        out = _zero_on_null_room(act, out, requests)
    return out


def _zero_on_null_room(active: DataFrame, out: DataFrame, requests: DataFrame) -> DataFrame:
    """Requests hit by an overlapping active stay whose room is NULL get 0. A
    range is asked once, however many requests share it; the days of the stays
    without a room, and of the ranges, are bounded by the calendar."""
    null_stays = active.where(F.col("kamar_id").isNull()).select(CI, CO)
    ranges = requests.select(CI, CO).where(F.col(CI).isNotNull() & F.col(CO).isNotNull()).distinct()
    ranges = ranges.withColumn("_range", F.struct(CI, CO))
    hits = IV.overlap_count(null_stays, ranges, [], "_range", CI, CO, out="_h").where(F.col("_h") > 0)
    hits = hits.select(F.col(f"_range.{CI}").alias("_hci"), F.col(f"_range.{CO}").alias("_hco"), F.lit(True).alias("_null_hit"))
    return (out.join(hits, (F.col(CI) == F.col("_hci")) & (F.col(CO) == F.col("_hco")), "left")
            .withColumn("tersedia", F.when(F.col("_null_hit"), F.lit(0).cast("bigint")).otherwise(F.col("tersedia")))
            .drop("_hci", "_hco", "_null_hit"))


def room_price(t: Tables, room_id=None, mode: str = "api") -> DataFrame:
    """The room type's price; the API answers 0 for a room without type,
    the SQL procedure NULL."""
    k = t.kamar.select("id_kamar", "tipe_id")
    if room_id is not None:
        k = k.where(F.col("id_kamar") == F.lit(room_id))
    price = F.col("harga") if mode != "api" else E.ifnull0("harga").cast(C.MONEY)
    return (k.join(t.tipe_kamar.select("id_tipe", "harga"), F.col("tipe_id") == F.col("id_tipe"), "left")
            .select("id_kamar", price.alias("harga")))


def stay_defaults(requests: DataFrame, as_of: str | dt.date) -> DataFrame:
    """Checkin defaults to as_of; checkout to as_of + 1 even when a
    checkin was given (V1 may then reject it)."""
    day = F.lit(as_of).cast("date")
    return (requests.withColumn(CI, F.coalesce(F.col(CI).cast("date"), day))
            .withColumn(CO, F.coalesce(F.col(CO).cast("date"), F.date_add(day, 1))))


def invoice_numbers(reservation_ids: DataFrame, as_of, col: str = "reservasi_id") -> DataFrame:
    """B10: 'INV-' + yyyyMM(as_of) + '-' + id left-padded to 3 (never cut)."""
    return reservation_ids.withColumn("nomor_invoice", E.invoice_number(F.col(col), as_of))
