"""Dashboards D1-D6.

The staff dashboard's nine separate queries become one aggregation pass per
table, combined as uncorrelated scalar subqueries (no joins at all).
Per-guest dashboards compute every guest in one job; ``user`` narrows to one
login's guest row when given.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from innlytics.functions import scalar as E
from innlytics.plans import joins
from innlytics.plans.numbering import top_k
from innlytics.sources import catalog as C
from innlytics.sources.tables import Tables

ACTIVE_STATUS_NAMES = ("Baru", "Check-in")


def _active_status_ids(t: Tables) -> DataFrame:
    ids = (t.status_reservasi.where(F.col("status").isin(*ACTIVE_STATUS_NAMES))
           .select(F.col("id_status_reservasi").alias("_active_id")))
    return F.broadcast(ids) if joins.fits(t.status_reservasi) else ids


def _with_active_flag(t: Tables) -> DataFrame:
    """reservasi + ``_active`` (status named Baru / Check-in), via a broadcast
    of the 4-row status lookup."""
    return (t.reservasi.join(_active_status_ids(t),
                             F.col("status_reservasi_id") == F.col("_active_id"), "left")
            .withColumn("_active", F.col("_active_id").isNotNull()).drop("_active_id"))


def staff_kpis(t: Tables) -> DataFrame:
    """One row of staff KPIs."""
    rooms = t.kamar.agg(F.count(F.lit(1)).alias("total_kamar"),
                        F.count_if(F.col("status_id") == C.ROOM_OCCUPIED).alias("kamar_terisi"),
                        F.count_if(F.col("status_id") == C.ROOM_FREE).alias("kamar_tersedia"))
    # The other tables' one-pass aggregates as uncorrelated scalar subqueries
    # (Spark merges those over the same table into one pass).
    res = _with_active_flag(t)
    return rooms.select(
        "total_kamar", "kamar_terisi", "kamar_tersedia",
        res.agg(F.count(F.lit(1))).scalar().alias("total_reservasi"),
        res.agg(F.count_if("_active")).scalar().alias("reservasi_aktif"),
        t.tamu.agg(F.count(F.lit(1))).scalar().alias("total_tamu"),
        t.pembayaran.agg(E.ifnull0(E.money_sum("total")).cast(E.MONEY_SUM)).scalar().alias("total_pendapatan"))


def latest_reservations(t: Tables, n: int = 5) -> DataFrame:
    """Newest n reservations (ties on time broken by id, newest first). The
    guest must exist (semi join); names are attached to the n rows alone."""
    newest = (t.reservasi.select("id_reservasi", "tamu_id", "status_reservasi_id", "tanggal_pesan")
              .join(t.tamu.select("id_tamu"), F.col("tamu_id") == F.col("id_tamu"), "left_semi")
              .join(joins.lookup(t.status_reservasi), F.col("status_reservasi_id") == F.col("id_status_reservasi"))
              .orderBy(F.desc("tanggal_pesan"), F.desc("id_reservasi")).limit(n))
    return (t.tamu.select("id_tamu", F.col("nama").alias("tamu"))
            .join(F.broadcast(newest), F.col("tamu_id") == F.col("id_tamu"))  # n rows
            .select("id_reservasi", "tamu", "status", "tanggal_pesan")
            .orderBy(F.desc("tanggal_pesan"), F.desc("id_reservasi")))


def recent_revenue(t: Tables, as_of: str | dt.date, months: int = 6) -> DataFrame:
    """D3: monthly revenue from ``as_of`` minus ``months`` (midnight, month-end
    clamped) with no upper bound. The bound is a literal, so it is pushed to
    the payment scan."""
    return (t.pembayaran.where(F.col("tanggal_bayar") >= E.months_back(as_of, months))
            .groupBy(E.month_key("tanggal_bayar").alias("bulan"))
            .agg(E.money_sum("total").alias("total"))
            .orderBy("bulan"))


def _guests(t: Tables, user) -> DataFrame:
    g = t.tamu
    return g.where(F.col("user_id") == F.lit(user)) if user is not None else g.where(F.col("user_id").isNotNull())


def guest_kpis(t: Tables, user=None) -> DataFrame:
    """Per login (guest with a user id): reservations, active ones, spend."""
    per_res = _with_active_flag(t).groupBy("tamu_id").agg(
        F.count(F.lit(1)).alias("total_reservasi"), F.count_if("_active").alias("reservasi_aktif"))
    spend = (t.pembayaran.select("reservasi_id", "total")
             .join(t.reservasi.select("id_reservasi", "tamu_id"),
                   F.col("reservasi_id") == F.col("id_reservasi"), "inner")
             .groupBy(F.col("tamu_id").alias("_sp_tamu")).agg(F.sum("total").alias("_spent")))
    return (_guests(t, user).select("user_id", "id_tamu")
            .join(per_res, F.col("id_tamu") == F.col("tamu_id"), "left")
            .join(spend, F.col("id_tamu") == F.col("_sp_tamu"), "left")
            .select("user_id", "id_tamu",
                    F.coalesce("total_reservasi", F.lit(0)).alias("total_reservasi"),
                    F.coalesce("reservasi_aktif", F.lit(0)).alias("reservasi_aktif"),
                    E.ifnull0("_spent").cast(E.MONEY_SUM).alias("total_pengeluaran")))


def latest_per_guest(t: Tables, n: int = 5, user=None) -> DataFrame:
    """Per login, its newest ``n`` stay lines (not reservations), newest
    reservation first; ties inside a reservation by the stay's own columns.
    Spark limits each guest's rows to ``n`` before the shuffle (window group
    limit), so a busy guest sends ``n`` rows a partition."""
    heads = (t.reservasi.select("id_reservasi", "tamu_id", "status_reservasi_id", "tanggal_pesan")
             .join(_guests(t, user).select("id_tamu", "user_id"), F.col("tamu_id") == F.col("id_tamu"), "inner")
             .join(joins.lookup(t.status_reservasi),
                   F.col("status_reservasi_id") == F.col("id_status_reservasi"), "inner"))
    lines = heads.join(t.detail_reservasi.select("reservasi_id", "kamar_id", "tanggal_checkin",
                                                 "tanggal_checkout", "harga"),
                       F.col("id_reservasi") == F.col("reservasi_id"), "inner")
    order = [F.desc("tanggal_pesan"), F.desc("id_reservasi"), F.asc("tanggal_checkin"),
             F.asc("tanggal_checkout"), F.asc("harga"), F.asc_nulls_first("kamar_id")]
    best = top_k(lines, ["user_id"], order, n)
    return best.select("user_id", "id_reservasi", "status", "tanggal_pesan", "tanggal_checkin",
                       "tanggal_checkout", "harga")


def guest_profile(t: Tables, user=None) -> DataFrame:
    """id_tamu, nama, email of the login's guest row."""
    return _guests(t, user).select("user_id", "id_tamu", "nama", "email")

