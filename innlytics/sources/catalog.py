"""Fixed lookup tables of the hotel domain and the schemas of every table.

The lookup tables are tiny by construction (a handful of statuses, methods,
roles); they are the only frames the library ever broadcasts by hint.
"""

from __future__ import annotations

import datetime as dt
from decimal import Decimal

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

# ---------------------------------------------------------------------------
# These must equal the domain's own lookup rows (ids are the
# listed order, starting at 1).
# ---------------------------------------------------------------------------
ROLE_NAMES = ["admin", "resepsionis", "tamu"]
JOB_TITLES = ["Manajer Hotel", "Resepsionis", "Housekeeping", "Staff Keuangan"]
ROOM_STATUS_NAMES = ["Tersedia", "Terisi", "Maintenance"]
RESERVATION_STATUS_NAMES = ["Baru", "Check-in", "Check-out", "Dibatalkan"]
PAYMENT_METHOD_NAMES = ["Tunai", "Transfer Bank", "Kartu Kredit"]
PROMOS = [
    ("NEWYEAR", Decimal("20.00"), dt.date(2025, 12, 20), dt.date(2026, 1, 5)),
    ("WEEKEND", Decimal("15.00"), dt.date(2026, 1, 1), dt.date(2026, 12, 31)),
    ("LOYALTY", Decimal("10.00"), dt.date(2026, 1, 1), dt.date(2026, 12, 31)),
]
# Staff ids 1-6 with their job and login; no rule reads names or addresses.
STAFF = [(f"Pegawai {i}", "-", "-", job, user) for i, (job, user) in
         enumerate([(1, 1), (2, 3), (2, 4), (2, 5), (3, None), (4, 2)], start=1)]
# Status ids used by the business rules.
RES_NEW, RES_CHECKED_IN, RES_CHECKED_OUT, RES_CANCELLED = 1, 2, 3, 4
ROOM_FREE, ROOM_OCCUPIED, ROOM_MAINTENANCE = 1, 2, 3
ACTIVE_RESERVATION = (RES_NEW, RES_CHECKED_IN)        # blocks a room
OCCUPANCY_RESERVATION = (RES_CHECKED_IN, RES_CHECKED_OUT)  # counted as occupied
TRIGGER_USER_ID = 1
TRIGGER_IP = "10.0.0.1"
API_IP = "127.0.0.1"
# ---------------------------------------------------------------------------

L, I, S, D, TS = T.LongType(), T.IntegerType(), T.StringType(), T.DateType(), T.TimestampNTZType()
MONEY = T.DecimalType(10, 2)
PERCENT = T.DecimalType(5, 2)


def _schema(*fields) -> T.StructType:
    return T.StructType([T.StructField(n, t, True) for n, t in fields])


# Domain schemas. Keys are BIGINT: at 100 TB the fact tables exceed 2^31 rows.
SCHEMAS: dict[str, T.StructType] = {
    "roles": _schema(("id_role", L), ("nama_role", S)),
    "users": _schema(("id_user", L), ("username", S), ("email", S), ("role_id", L)),
    "jabatan": _schema(("id_jabatan", L), ("nama_jabatan", S)),
    "pegawai": _schema(("id_pegawai", L), ("nama", S), ("alamat", S), ("telepon", S),
                       ("jabatan_id", L), ("user_id", L)),
    "tamu": _schema(("id_tamu", L), ("nama", S), ("email", S), ("telepon", S), ("alamat", S),
                    ("user_id", L)),
    "tipe_kamar": _schema(("id_tipe", L), ("nama_tipe", S), ("harga", MONEY), ("kapasitas", I)),
    "status_kamar": _schema(("id_status", L), ("status", S)),
    "kamar": _schema(("id_kamar", L), ("nomor_kamar", S), ("tipe_id", L), ("status_id", L)),
    "fasilitas": _schema(("id_fasilitas", L), ("nama_fasilitas", S)),
    "kamar_fasilitas": _schema(("kamar_id", L), ("fasilitas_id", L)),
    "status_reservasi": _schema(("id_status_reservasi", L), ("status", S)),
    "promo": _schema(("id_promo", L), ("kode", S), ("diskon", PERCENT), ("tanggal_mulai", D),
                     ("tanggal_selesai", D)),
    "reservasi": _schema(("id_reservasi", L), ("tamu_id", L), ("tanggal_pesan", TS),
                         ("status_reservasi_id", L), ("promo_id", L)),
    "detail_reservasi": _schema(("id_detail", L), ("reservasi_id", L), ("kamar_id", L),
                                ("tanggal_checkin", D), ("tanggal_checkout", D), ("harga", MONEY)),
    "metode_pembayaran": _schema(("id_metode", L), ("nama_metode", S)),
    "pembayaran": _schema(("id_pembayaran", L), ("reservasi_id", L), ("metode_id", L),
                          ("total", MONEY), ("tanggal_bayar", TS)),
    "invoice": _schema(("id_invoice", L), ("reservasi_id", L), ("nomor_invoice", S),
                       ("tanggal_terbit", TS)),
    "checkin": _schema(("id_checkin", L), ("reservasi_id", L), ("pegawai_id", L), ("waktu_checkin", TS)),
    "checkout": _schema(("id_checkout", L), ("reservasi_id", L), ("pegawai_id", L),
                        ("waktu_checkout", TS)),
    "ulasan": _schema(("id_ulasan", L), ("tamu_id", L), ("kamar_id", L), ("rating", I),
                      ("komentar", S), ("tanggal", D)),
    "audit_log": _schema(("id_log", L), ("aktivitas", S), ("user_id", L), ("tanggal", TS),
                         ("ip_address", S)),
}

# Change feed of reservation statuses (the input of the trigger operators).
FEED_SCHEMA = _schema(("reservasi_id", L), ("ts", TS), ("seq", L), ("status_reservasi_id", L))


def _named(spark: SparkSession, table: str, names: list[str]) -> DataFrame:
    return spark.createDataFrame([(i + 1, n) for i, n in enumerate(names)], SCHEMAS[table])


_LOOKUP_CACHE: dict[int, dict[str, DataFrame]] = {}


def lookup_tables(spark: SparkSession) -> dict[str, DataFrame]:
    """The fixed small tables, as DataFrames (one local relation each); built
    once per session (they are constants, and building local relations costs
    a driver round trip each)."""
    from innlytics.session import session_key
    key = session_key(spark)
    if key not in _LOOKUP_CACHE:
        _LOOKUP_CACHE[key] = _build_lookup_tables(spark)
    return dict(_LOOKUP_CACHE[key])


def _build_lookup_tables(spark: SparkSession) -> dict[str, DataFrame]:
    return {
        "roles": _named(spark, "roles", ROLE_NAMES),
        "jabatan": _named(spark, "jabatan", JOB_TITLES),
        "status_kamar": _named(spark, "status_kamar", ROOM_STATUS_NAMES),
        "status_reservasi": _named(spark, "status_reservasi", RESERVATION_STATUS_NAMES),
        "metode_pembayaran": _named(spark, "metode_pembayaran", PAYMENT_METHOD_NAMES),
        "promo": spark.createDataFrame([(i + 1, *p) for i, p in enumerate(PROMOS)], SCHEMAS["promo"]),
        "pegawai": spark.createDataFrame([(i + 1, *p) for i, p in enumerate(STAFF)], SCHEMAS["pegawai"]),
    }


def empty(spark: SparkSession, table: str) -> DataFrame:
    return spark.createDataFrame([], SCHEMAS[table])
