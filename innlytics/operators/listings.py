"""Listings L1-L11, including the nested room and guest documents.

The per-room facility lookup (one query per room in the original) is one
join plus a grouped ``collect_list``; nested history is a grouped array of
structs. Ordered listings end with a global ``orderBy`` (range-partitioned
distributed sort), which is the listing's feature; pass ``ordered=False``
when the consumer does not need order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from innlytics.plans import joins
from innlytics.sources.tables import Tables

BOOKING_COLS = ["id_reservasi", "tamu", "status", "tanggal_pesan", "tanggal_checkin",
                "tanggal_checkout", "harga"]


def _bookings(t: Tables) -> DataFrame:
    """reservasi JOIN tamu JOIN status JOIN stay lines (all inner)."""
    return (t.reservasi.select("id_reservasi", "tamu_id", "status_reservasi_id", "tanggal_pesan")
            .join(joins.lookup(t.status_reservasi),
                  F.col("status_reservasi_id") == F.col("id_status_reservasi"), "inner")
            .join(t.tamu.select("id_tamu", F.col("nama").alias("tamu"), "email", "telepon", "user_id"),
                  F.col("tamu_id") == F.col("id_tamu"), "inner")
            .join(t.detail_reservasi.select("reservasi_id", "kamar_id", "tanggal_checkin",
                                            "tanggal_checkout", "harga"),
                  F.col("id_reservasi") == F.col("reservasi_id"), "inner"))


def _maybe_order(df: DataFrame, ordered: bool, *cols) -> DataFrame:
    return df.orderBy(*cols) if ordered else df


def booking_list(t: Tables, user=None, ordered: bool = True) -> DataFrame:
    """L1 (all) / L3 (``user`` = login id): bookings newest first."""
    b = _bookings(t)
    if user is not None:
        b = b.where(F.col("user_id") == F.lit(user))
    cols = BOOKING_COLS if user is not None else ["user_id", *BOOKING_COLS]
    return _maybe_order(b.select(*cols), ordered, F.desc("tanggal_pesan"), F.desc("id_reservasi"))


def booking_detail(t: Tables, reservation_id=None) -> DataFrame:
    """L2: booking with contact, room, type and (optional) payment + method."""
    # Payment (0..1 per reservation) is attached to the reservation heads
    # *before* the stay lines, so the heads, payments and stays all meet on
    # the reservation key and the wide stay rows are shuffled once for it.
    heads = (t.reservasi.select("id_reservasi", "tamu_id", "status_reservasi_id", "tanggal_pesan")
             .join(joins.lookup(t.status_reservasi),
                   F.col("status_reservasi_id") == F.col("id_status_reservasi"), "inner")
             .join(t.tamu.select("id_tamu", F.col("nama").alias("tamu"), "email", "telepon"),
                   F.col("tamu_id") == F.col("id_tamu"), "inner"))
    pay = (t.pembayaran.select(F.col("reservasi_id").alias("_p_res"), F.col("total").alias("total_bayar"),
                               "tanggal_bayar", "metode_id")
           .join(joins.lookup(t.metode_pembayaran), F.col("metode_id") == F.col("id_metode"), "left"))
    lines = t.detail_reservasi.select("reservasi_id", "kamar_id", "tanggal_checkin", "tanggal_checkout", "harga")
    if reservation_id is not None:
        heads = heads.where(F.col("id_reservasi") == F.lit(reservation_id))
        lines = lines.where(F.col("reservasi_id") == F.lit(reservation_id))
    b = (heads.join(pay, F.col("id_reservasi") == F.col("_p_res"), "left")
         .join(lines, F.col("id_reservasi") == F.col("reservasi_id"), "inner"))
    return (b.join(t.kamar.select("id_kamar", "nomor_kamar", "tipe_id"),
                   F.col("kamar_id") == F.col("id_kamar"), "inner")
            .join(t.tipe_kamar.select("id_tipe", "nama_tipe"), F.col("tipe_id") == F.col("id_tipe"), "inner")
            .select("id_reservasi", "tamu", "email", "telepon", "status", "tanggal_pesan",
                    "tanggal_checkin", "tanggal_checkout", "harga", "nomor_kamar", "nama_tipe",
                    "total_bayar", "tanggal_bayar", "nama_metode"))


def _rooms(t: Tables) -> DataFrame:
    return (t.kamar.join(t.tipe_kamar, F.col("tipe_id") == F.col("id_tipe"), "inner")
            .join(joins.lookup(t.status_kamar), F.col("status_id") == F.col("id_status"), "inner"))


def _facilities(t: Tables) -> DataFrame:
    return t.kamar_fasilitas.join(t.fasilitas, F.col("fasilitas_id") == F.col("id_fasilitas"), "inner")


def room_list(t: Tables, ordered: bool = True) -> DataFrame:
    """L4: rooms with type, price, status and the sorted array of facility
    names ([] when none). The array per room is bounded by the facility
    dimension, not by the fact data."""
    names = (_facilities(t).groupBy(F.col("kamar_id").alias("_f_room"))
             .agg(F.array_sort(F.collect_list("nama_fasilitas")).alias("_names")))
    out = (_rooms(t).join(names, F.col("id_kamar") == F.col("_f_room"), "left")
           .select("id_kamar", "nomor_kamar", "nama_tipe", "harga", F.col("status").alias("status_kamar"),
                   F.coalesce(F.col("_names"), F.array().cast("array<string>")).alias("fasilitas")))
    return _maybe_order(out, ordered, "nomor_kamar")


def room_detail(t: Tables, room_id=None, flat: bool = False) -> DataFrame:
    """Room + capacity + array of (id_fasilitas, nama_fasilitas) by id.
    ``flat=True`` returns one row per facility (NULLs for none)."""
    rooms = _rooms(t)
    fac = _facilities(t)
    if room_id is not None:
        rooms = rooms.where(F.col("id_kamar") == F.lit(room_id))
        fac = fac.where(F.col("kamar_id") == F.lit(room_id))
    head = rooms.select("id_kamar", "nomor_kamar", "nama_tipe", "harga", "kapasitas",
                        F.col("status").alias("status_kamar"))
    if flat:
        return (head.join(fac.select(F.col("kamar_id").alias("_f_room"), "id_fasilitas", "nama_fasilitas"),
                          F.col("id_kamar") == F.col("_f_room"), "left").drop("_f_room"))
    nested = (fac.groupBy(F.col("kamar_id").alias("_f_room"))
              .agg(F.array_sort(F.collect_list(F.struct("id_fasilitas", "nama_fasilitas"))).alias("_f")))
    return (head.join(nested, F.col("id_kamar") == F.col("_f_room"), "left")
            .select(*head.columns, F.coalesce("_f", F.array().cast(
                "array<struct<id_fasilitas:bigint,nama_fasilitas:string>>")).alias("fasilitas")))


def _booking_counts(t: Tables) -> DataFrame:
    return t.reservasi.groupBy(F.col("tamu_id").alias("_c_tamu")).agg(
        F.count("id_reservasi").alias("total_booking"))


def guest_list(t: Tables, ordered: bool = True) -> DataFrame:
    """Every guest with the number of bookings (0 kept), most first."""
    out = (t.tamu.select("id_tamu", "nama", "email", "telepon")
           .join(_booking_counts(t), F.col("id_tamu") == F.col("_c_tamu"), "left")
           .select("id_tamu", "nama", "email", "telepon",
                   F.coalesce("total_booking", F.lit(0)).alias("total_booking")))
    return _maybe_order(out, ordered, F.desc("total_booking"), F.asc("id_tamu"))


def guest_detail(t: Tables, guest_id=None, flat: bool = True) -> DataFrame:
    """Guest + total_booking + booking history (newest first).

    The default gives one row per history line (NULL history for guests
    without bookings), as a history grows with the data; ``flat=False`` groups
    the same rows into one array per guest."""
    g = t.tamu
    if guest_id is not None:
        g = g.where(F.col("id_tamu") == F.lit(guest_id))
    head = (g.join(_booking_counts(t), F.col("id_tamu") == F.col("_c_tamu"), "left")
            .select("id_tamu", "nama", "email", "telepon", "alamat", "user_id",
                    F.coalesce("total_booking", F.lit(0)).alias("total_booking")))
    hist = (t.reservasi.select("id_reservasi", F.col("tamu_id").alias("_h_tamu"), "status_reservasi_id",
                               "tanggal_pesan")
            .join(joins.lookup(t.status_reservasi),
                  F.col("status_reservasi_id") == F.col("id_status_reservasi"), "inner")
            .join(t.detail_reservasi.select("reservasi_id", "tanggal_checkin", "tanggal_checkout"),
                  F.col("id_reservasi") == F.col("reservasi_id"), "inner")
            .select("_h_tamu", "id_reservasi", "status", "tanggal_pesan", "tanggal_checkin",
                    "tanggal_checkout"))
    if guest_id is not None:
        hist = hist.where(F.col("_h_tamu") == F.lit(guest_id))
    if flat:
        return head.join(hist, F.col("id_tamu") == F.col("_h_tamu"), "left").drop("_h_tamu")
    # Sort key first in the struct: newest booking first = descending sort.
    nested = (hist.groupBy("_h_tamu").agg(F.sort_array(F.collect_list(F.struct(
        "tanggal_pesan", "id_reservasi", "status", "tanggal_checkin", "tanggal_checkout")), asc=False)
        .alias("_h")))
    return (head.join(nested, F.col("id_tamu") == F.col("_h_tamu"), "left")
            .select(*head.columns, F.transform(F.coalesce("_h", F.array()), lambda x: F.struct(
                x["id_reservasi"].alias("id_reservasi"), x["status"].alias("status"),
                x["tanggal_pesan"].alias("tanggal_pesan"), x["tanggal_checkin"].alias("tanggal_checkin"),
                x["tanggal_checkout"].alias("tanggal_checkout"))).alias("riwayat_reservasi")))


def own_guest_detail(t: Tables, user, flat: bool = True) -> DataFrame:
    """L7 for a guest caller: the login's own row whatever id is asked for,
    without ``user_id``."""
    own = t.tamu.where(F.col("user_id") == F.lit(user))
    return guest_detail(t.with_(tamu=own), flat=flat).drop("user_id")


def own_guest(t: Tables, user=None) -> DataFrame:
    """The login's own guest row."""
    g = t.tamu.where(F.col("user_id") == F.lit(user)) if user is not None else \
        t.tamu.where(F.col("user_id").isNotNull())
    return g.select("user_id", "id_tamu", "nama", "email", "telepon")


def _payments(t: Tables) -> DataFrame:
    return (t.pembayaran.join(joins.lookup(t.metode_pembayaran), F.col("metode_id") == F.col("id_metode"),
                              "inner")
            .join(t.invoice.select(F.col("reservasi_id").alias("_i_res"), "nomor_invoice"),
                  F.col("reservasi_id") == F.col("_i_res"), "left"))


PAYMENT_COLS = ["id_pembayaran", "reservasi_id", "total", "tanggal_bayar", "nama_metode", "nomor_invoice"]


def payment_list(t: Tables, user=None, ordered: bool = True) -> DataFrame:
    """L9 (all) / L11 (``user``: payments of the login's reservations)."""
    p = _payments(t)
    if user is None:
        out = p.select(*PAYMENT_COLS)
    else:
        own = (t.reservasi.select("id_reservasi", "tamu_id")
               .join(t.tamu.where(F.col("user_id") == F.lit(user)).select("id_tamu"),
                     F.col("tamu_id") == F.col("id_tamu"), "left_semi"))
        out = p.join(own, F.col("reservasi_id") == F.col("id_reservasi"), "left_semi").select(*PAYMENT_COLS)
    return _maybe_order(out, ordered, F.desc("tanggal_bayar"), F.desc("id_pembayaran"))


def payments_by_user(t: Tables) -> DataFrame:
    """L11 for every login in one job: payment rows tagged with the owner."""
    owners = (t.reservasi.select("id_reservasi", "tamu_id")
              .join(t.tamu.where(F.col("user_id").isNotNull()).select("id_tamu", "user_id"),
                    F.col("tamu_id") == F.col("id_tamu"), "inner"))
    return (_payments(t).join(owners, F.col("reservasi_id") == F.col("id_reservasi"), "inner")
            .select("user_id", *PAYMENT_COLS))


def payment_detail(t: Tables, payment_id=None) -> DataFrame:
    """One payment (all payments when no id is given)."""
    p = _payments(t)
    if payment_id is not None:
        p = p.where(F.col("id_pembayaran") == F.lit(payment_id))
    return p.select(*PAYMENT_COLS)
