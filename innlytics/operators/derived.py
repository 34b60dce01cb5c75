"""Derived checks X1-X3: implied by the data, in no code path of the
original system; kept separate and labelled as such."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from innlytics.functions import scalar as E
from innlytics.operators import booking as B
from innlytics.sources import catalog as C
from innlytics.sources.tables import Tables


def payment_reconciliation(t: Tables) -> DataFrame:
    """X1 (derived): paid total vs stay sum x (1 - promo discount / 100)."""
    due = (B.reservation_totals(t)
           .join(t.reservasi.select(F.col("id_reservasi").alias("_r"), "promo_id"),
                 F.col("id_reservasi") == F.col("_r"), "inner")
           .join(t.promo.select("id_promo", "diskon"), F.col("promo_id") == F.col("id_promo"), "left")
           .select("id_reservasi", "total",
                   F.round(F.col("total") * (F.lit(100) - E.ifnull0("diskon")) / F.lit(100), 2)
                   .cast(E.MONEY_SUM).alias("expected")))
    return (t.pembayaran.select("id_pembayaran", "reservasi_id", F.col("total").alias("paid"))
            .join(due.drop("total"), F.col("reservasi_id") == F.col("id_reservasi"), "left")
            .select("id_pembayaran", "reservasi_id", "paid", "expected",
                    F.coalesce(F.col("paid") == F.col("expected"), F.lit(False)).alias("matches")))


def room_status_drift(t: Tables) -> DataFrame:
    """X2 (derived): rooms whose stored status differs from what the status
    trigger implies from the latest reservation (by booking time, id) in
    Check-in / Check-out / Dibatalkan touching the room."""
    res = t.reservasi.where(F.col("status_reservasi_id").isin(
        C.RES_CHECKED_IN, C.RES_CHECKED_OUT, C.RES_CANCELLED)).select(
        "id_reservasi", "tanggal_pesan",
        F.when(F.col("status_reservasi_id") == C.RES_CHECKED_IN, F.lit(C.ROOM_OCCUPIED))
        .otherwise(F.lit(C.ROOM_FREE)).cast("bigint").alias("_implied"))
    implied = (t.detail_reservasi.where(F.col("kamar_id").isNotNull()).select("reservasi_id", "kamar_id")
               .join(res, F.col("reservasi_id") == F.col("id_reservasi"), "inner")
               .groupBy("kamar_id").agg(F.max_by("_implied", F.struct("tanggal_pesan", "id_reservasi"))
                                        .alias("implied_status")))
    return (t.kamar.join(implied, F.col("id_kamar") == F.col("kamar_id"), "inner")
            .where(~F.col("status_id").eqNullSafe(F.col("implied_status")))
            .select("id_kamar", "nomor_kamar", "status_id", "implied_status"))


def checkin_without_status(t: Tables) -> DataFrame:
    """X3 (derived): reservations with a check-in row still in status Baru."""
    return (t.reservasi.where(F.col("status_reservasi_id") == C.RES_NEW)
            .join(t.checkin.select(F.col("reservasi_id").alias("_c")), F.col("id_reservasi") == F.col("_c"),
                  "left_semi")
            .select("id_reservasi", "tamu_id", "tanggal_pesan"))
