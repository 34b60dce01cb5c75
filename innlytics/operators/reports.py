"""Reports R1-R12.

Pattern throughout: aggregate the fact table on its own key first (partial +
final hash aggregation, map-side combined), then join the much smaller
aggregate to dimensions. Fixed lookups are broadcast by hint, everything else
is left to the planner/AQE (see ``plans.joins``).
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from innlytics.functions import scalar as E
from innlytics.plans.numbering import numbered
from innlytics.sources import catalog as C
from innlytics.sources.tables import Tables


def _status_in(t: Tables, ids) -> DataFrame:
    return t.reservasi.where(F.col("status_reservasi_id").isin(*ids)).select("id_reservasi")


def occupancy_by_month(t: Tables) -> DataFrame:
    """Rooms with a checked-in/out stay per check-in month over all rooms."""
    stays = (t.detail_reservasi.select("reservasi_id", "kamar_id", "tanggal_checkin")
             .join(_status_in(t, C.OCCUPANCY_RESERVATION),
                   F.col("reservasi_id") == F.col("id_reservasi"), "left_semi"))
    by_month = stays.groupBy(E.month_key("tanggal_checkin").alias("bulan")).agg(
        F.countDistinct("kamar_id").alias("kamar_terisi"))
    # uncorrelated scalar subquery: evaluated once, its value inlined
    total = t.kamar.agg(F.count(F.lit(1))).scalar()
    return (by_month.withColumn("total_kamar", total)
            .select("bulan", "kamar_terisi", "total_kamar",
                    E.pct_2dp("kamar_terisi", "total_kamar").alias("persentase"))
            .orderBy("bulan"))


def revenue_by_month(t: Tables, aliases: str = "api") -> DataFrame:
    """R2: payments per month. ``aliases='script'`` gives (jumlah, total)."""
    n, s = ("jumlah_transaksi", "total_pendapatan") if aliases == "api" else ("jumlah", "total")
    return (t.pembayaran.groupBy(E.month_key("tanggal_bayar").alias("bulan"))
            .agg(F.count("id_pembayaran").alias(n), E.money_sum("total").alias(s))
            .orderBy("bulan"))


def top_guests(t: Tables, n: int = 5) -> DataFrame:
    """Most active guests; ties on count broken by guest id (ascending).
    The ``n`` guests are found from the reservations alone (guests must
    exist); only their payments are summed and only their names looked up."""
    best = (t.reservasi.groupBy("tamu_id").agg(F.count("id_reservasi").alias("jumlah_booking"))
            .join(t.tamu.select("id_tamu"), F.col("tamu_id") == F.col("id_tamu"), "left_semi")
            .orderBy(F.desc("jumlah_booking"), F.asc("tamu_id")).limit(n))
    few = F.broadcast(best)  # n rows
    theirs = t.reservasi.select("id_reservasi", F.col("tamu_id").alias("_payer")).join(
        few.select("tamu_id"), F.col("_payer") == F.col("tamu_id"), "left_semi")
    spent = (t.pembayaran.select("reservasi_id", "total").join(theirs, F.col("reservasi_id") == F.col("id_reservasi"))
             .groupBy("_payer").agg(F.sum("total").cast(E.MONEY_SUM).alias("_spent")))
    return (t.tamu.select("id_tamu", "nama", "email").join(few, F.col("id_tamu") == F.col("tamu_id"))
            .join(spent, F.col("id_tamu") == F.col("_payer"), "left")
            .select("id_tamu", "nama", "email", "jumlah_booking",
                    E.ifnull0("_spent").cast(E.MONEY_SUM).alias("total_pengeluaran"))
            .orderBy(F.desc("jumlah_booking"), F.asc("id_tamu")).drop("id_tamu"))


def rating_by_room_type(t: Tables, aliases: str = "api") -> DataFrame:
    """Reviews per room type, types without review kept (0, NULL) and last."""
    avg_name = "rata_rata_rating" if aliases == "api" else "rata_rata"
    per_room = t.ulasan.groupBy("kamar_id").agg(
        F.count("id_ulasan").alias("_n"), F.sum("rating").alias("_s"), F.count("rating").alias("_c"))
    per_type = (t.kamar.select("id_kamar", "tipe_id")
                .join(per_room, F.col("id_kamar") == F.col("kamar_id"), "left")
                .groupBy("tipe_id").agg(F.sum("_n").alias("_n"), F.sum("_s").alias("_s"),
                                        F.sum("_c").alias("_c")))
    return (t.tipe_kamar.select("id_tipe", "nama_tipe")
            .join(per_type, F.col("id_tipe") == F.col("tipe_id"), "left")
            .select("nama_tipe",
                    F.coalesce(F.col("_n"), F.lit(0)).alias("jumlah_ulasan"),
                    F.when(F.col("_c") > 0, E.avg_2dp("_s", "_c")).alias(avg_name), "id_tipe")
            .orderBy(F.desc_nulls_last(avg_name), F.asc("id_tipe"))
            .drop("id_tipe"))


def promo_usage(t: Tables) -> DataFrame:
    """Reservations per promo code, unused codes kept at 0."""
    used = t.reservasi.where(F.col("promo_id").isNotNull()).groupBy("promo_id").agg(
        F.count("id_reservasi").alias("_n"))
    return (t.promo.join(used, F.col("id_promo") == F.col("promo_id"), "left")
            .select("kode", "diskon", F.coalesce("_n", F.lit(0)).alias("jumlah_penggunaan"), "id_promo")
            .orderBy(F.desc("jumlah_penggunaan"), F.asc("id_promo"))
            .drop("id_promo"))


def total_revenue(t: Tables, mode: str = "dashboard") -> DataFrame:
    """SUM(total); the dashboard shows 0 on an empty table, the script NULL."""
    s = E.money_sum("total")
    return t.pembayaran.agg((E.ifnull0(s).cast(E.MONEY_SUM) if mode == "dashboard" else s)
                            .alias("total_pendapatan"))


def average_rating(t: Tables) -> DataFrame:
    """R7."""
    return t.ulasan.agg(F.avg("rating").alias("rata_rata_rating"))


def max_room_price(t: Tables) -> DataFrame:
    """R8."""
    return t.tipe_kamar.agg(F.max("harga").alias("harga_termahal"))


def min_room_price(t: Tables) -> DataFrame:
    """R9."""
    return t.tipe_kamar.agg(F.min("harga").alias("harga_termurah"))


def reservations_by_status(t: Tables) -> DataFrame:
    """Every status with its reservation count (0 kept)."""
    per = t.reservasi.where(F.col("status_reservasi_id").isNotNull()).groupBy("status_reservasi_id").agg(
        F.count("id_reservasi").alias("_n"))
    return (t.status_reservasi.join(per, F.col("id_status_reservasi") == F.col("status_reservasi_id"), "left")
            .select("status", F.coalesce("_n", F.lit(0)).alias("jumlah"), "id_status_reservasi")
            .orderBy("id_status_reservasi").drop("id_status_reservasi"))


def _payments_with_guest(t: Tables) -> DataFrame:
    return (t.pembayaran.select("id_pembayaran", "reservasi_id", "total", "tanggal_bayar")
            .join(t.reservasi.select("id_reservasi", "tamu_id"),
                  F.col("reservasi_id") == F.col("id_reservasi"), "inner")
            .join(t.tamu.select("id_tamu", F.col("nama").alias("nama_tamu")),
                  F.col("tamu_id") == F.col("id_tamu"), "inner"))


def daily_payments(t: Tables, day: str | dt.date | None = None) -> DataFrame:
    """The day's payments numbered by payment id (the cursor's rows).

    Without ``day`` every day is reported in one job; numbering per day is done
    in blocks of payment ids so a busy day is not sorted in a single task."""
    rows = _payments_with_guest(t)
    if day is not None:
        rows = rows.where(E.day_range("tanggal_bayar", day))
    rows = rows.withColumn("tanggal", F.col("tanggal_bayar").cast("date"))
    out = numbered(rows, ["tanggal"], ["id_pembayaran"], F.floor(F.col("id_pembayaran") / 65536))
    return out.select("tanggal", "no", "reservasi_id", "nama_tamu",
                      F.col("total").alias("total_bayar"))


def daily_payments_total(t: Tables, day: str | dt.date | None = None) -> DataFrame:
    """Grand total of the day's cursor rows (0 when none)."""
    if day is not None:
        rows = _payments_with_guest(t).where(E.day_range("tanggal_bayar", day))
        return rows.agg(E.ifnull0(E.money_sum("total")).cast(E.MONEY_SUM).alias("grand_total")) \
            .select(F.lit(day).cast("date").alias("tanggal"), "grand_total")
    # All days: a day whose payments have no guest still appears, with 0.
    guest_res = (t.reservasi.select("id_reservasi", "tamu_id")
                 .join(t.tamu.select("id_tamu"), F.col("tamu_id") == F.col("id_tamu"), "left_semi"))
    flagged = (t.pembayaran.select("reservasi_id", "total", "tanggal_bayar")
               .join(guest_res.withColumn("_ok", F.lit(True)),
                     F.col("reservasi_id") == F.col("id_reservasi"), "left"))
    return (flagged.groupBy(F.col("tanggal_bayar").cast("date").alias("tanggal"))
            .agg(E.ifnull0(F.sum(F.when(F.col("_ok"), F.col("total")))).cast(E.MONEY_SUM).alias("grand_total")))
