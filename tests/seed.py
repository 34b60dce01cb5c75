"""Hand-checked seed fixture (state A) and the committed demo row (state B).

Values are the domain's published seed rows; the timestamps the seed leaves
to load time are pinned: booking time = first check-in - 5 days at 10:00,
payment time = first check-in at 12:00 (UTC).
"""

from __future__ import annotations

import datetime as dt
from decimal import Decimal as Dec

from pyspark.sql import SparkSession

from innlytics.sources import catalog as C
from innlytics.sources.tables import Tables

d = dt.date.fromisoformat

# ---------------------------------------------------------------------------
# The seed rows, in their published order (ids = position, 1..n).
# Staff e-mail domains are replaced by a neutral one (no rule reads them).
# ---------------------------------------------------------------------------
GUESTS = [
    ("Andi Pratama", "andi@email.com", "085111111111", "Jl. Sudirman No.10", 6),
    ("Budi Santoso", "budi@email.com", "085111111112", "Jl. Thamrin No.20", 7),
    ("Citra Dewi", "citra@email.com", "085111111113", "Jl. Gatot Subroto No.30", 8),
    ("Dian Permata", "dian@email.com", "085111111114", "Jl. Asia Afrika No.15", None),
    ("Eka Putra", "eka@email.com", "085111111115", "Jl. Diponegoro No.25", None),
    ("Fitria Ningsih", "fitria@email.com", "085111111116", "Jl. Ahmad Yani No.35", None),
    ("Gilang Ramadhan", "gilang@email.com", "085111111117", "Jl. Siliwangi No.8", None),
    ("Hana Safitri", "hana@email.com", "085111111118", "Jl. Pahlawan No.12", None),
    ("Irfan Hakim", "irfan@email.com", "085111111119", "Jl. Veteran No.18", None),
    ("Joko Widianto", "joko@email.com", "085111111120", "Jl. Merdeka No.5", None),
]
USERS = [("admin1", "admin1@staff.example", 1), ("admin2", "admin2@staff.example", 1),
         ("resepsionis1", "resepsionis1@staff.example", 2), ("resepsionis2", "resepsionis2@staff.example", 2),
         ("resepsionis3", "resepsionis3@staff.example", 2), ("andi_tamu", "andi@email.com", 3),
         ("budi_tamu", "budi@email.com", 3), ("citra_tamu", "citra@email.com", 3)]
ROOM_TYPES = [("Standard", Dec("350000.00"), 2), ("Deluxe", Dec("600000.00"), 2),
              ("Superior", Dec("850000.00"), 3), ("Suite", Dec("1500000.00"), 4)]
ROOMS = [("101", 1, 1), ("102", 1, 1), ("103", 1, 2), ("104", 1, 1),
         ("201", 2, 2), ("202", 2, 1), ("203", 2, 1), ("204", 2, 3),
         ("301", 3, 1), ("302", 3, 2), ("303", 3, 1), ("304", 3, 1),
         ("401", 4, 1), ("402", 4, 2), ("403", 4, 1), ("404", 4, 1)]
FACILITIES = ["AC", "TV", "WiFi", "Kulkas", "Bathtub", "Breakfast", "Mini Bar", "Balkon"]
ROOM_FACILITIES = [(1, 1), (1, 2), (1, 3), (2, 1), (2, 2), (2, 3), (5, 1), (5, 2), (5, 3), (5, 4), (5, 5),
                   (6, 1), (6, 2), (6, 3), (6, 4), (9, 1), (9, 2), (9, 3), (9, 6), (9, 8)]
RESERVATIONS = [(1, 3, None), (1, 2, 3), (2, 3, None), (2, 2, None), (3, 3, 1), (4, 2, 2), (5, 1, None),
                (6, 1, 3), (7, 4, None), (8, 1, None)]
STAYS = [(1, 3, "2026-01-10", "2026-01-12", "350000.00"), (1, 5, "2026-01-10", "2026-01-12", "600000.00"),
         (2, 6, "2026-01-15", "2026-01-17", "600000.00"), (3, 10, "2026-01-11", "2026-01-13", "850000.00"),
         (4, 9, "2026-01-16", "2026-01-18", "850000.00"), (5, 14, "2025-12-25", "2025-12-28", "1500000.00"),
         (6, 1, "2026-01-14", "2026-01-16", "350000.00"), (6, 2, "2026-01-14", "2026-01-16", "350000.00"),
         (7, 4, "2026-01-20", "2026-01-22", "350000.00"), (8, 7, "2026-01-18", "2026-01-20", "600000.00"),
         (9, 13, "2026-01-05", "2026-01-07", "1500000.00"), (10, 11, "2026-01-22", "2026-01-24", "850000.00")]
PAYMENTS = [(1, 2, "950000.00"), (2, 3, "540000.00"), (3, 1, "850000.00"), (4, 2, "850000.00"),
            (5, 3, "1200000.00"), (6, 2, "595000.00"), (7, 1, "350000.00"), (8, 3, "540000.00")]
INVOICES = [(1, "INV-202601-001"), (2, "INV-202601-002"), (3, "INV-202601-003"), (4, "INV-202601-004"),
            (5, "INV-202512-001"), (6, "INV-202601-005"), (7, "INV-202601-006"), (8, "INV-202601-007")]
CHECKINS = [(1, 2), (2, 3), (3, 4), (4, 2), (5, 3), (6, 4), (7, 2), (8, 3)]
CHECKOUTS = [(1, 2), (3, 4), (5, 3)]
REVIEWS = [(1, 3, 4, "Kamar nyaman, AC dingin", "2026-01-12"), (1, 5, 5, "Deluxe worth it!", "2026-01-12"),
           (2, 10, 3, "Superior biasa aja", "2026-01-13"), (3, 14, 5, "Suite mewah banget!", "2025-12-28"),
           (4, 1, 4, "Standard sesuai harga", "2026-01-16"), (6, 7, 2, "Kamar berisik, kurang ok", "2026-01-20")]


def _first_checkin(stays, res_id):
    return min(d(s[2]) for s in stays if s[0] == res_id)


def _at(day: dt.date, hour: int) -> dt.datetime:
    return dt.datetime.combine(day, dt.time(hour))


def frames(spark: SparkSession, state: str = "A") -> Tables:
    S = C.SCHEMAS
    reservations = list(RESERVATIONS)
    stays = list(STAYS)
    payments = list(PAYMENTS)
    invoices = list(INVOICES)
    if state == "B":
        reservations.append((9, 1, None))
        stays.append((11, 12, "2026-02-01", "2026-02-03", "850000.00"))
        payments.append((11, 1, "850000.00"))
        invoices.append((11, "INV-202602-001"))
    res_rows = [(i + 1, g, _at(_first_checkin(stays, i + 1) - dt.timedelta(days=5), 10), st, pr)
                for i, (g, st, pr) in enumerate(reservations)]
    pay_rows = [(i + 1, r, m, Dec(tot), _at(_first_checkin(stays, r), 12)) for i, (r, m, tot) in enumerate(payments)]
    t = {
        "tamu": spark.createDataFrame([(i + 1, *g) for i, g in enumerate(GUESTS)], S["tamu"]),
        "users": spark.createDataFrame([(i + 1, *u) for i, u in enumerate(USERS)], S["users"]),
        "tipe_kamar": spark.createDataFrame([(i + 1, *x) for i, x in enumerate(ROOM_TYPES)], S["tipe_kamar"]),
        "kamar": spark.createDataFrame([(i + 1, *x) for i, x in enumerate(ROOMS)], S["kamar"]),
        "fasilitas": spark.createDataFrame([(i + 1, n) for i, n in enumerate(FACILITIES)], S["fasilitas"]),
        "kamar_fasilitas": spark.createDataFrame(ROOM_FACILITIES, S["kamar_fasilitas"]),
        "reservasi": spark.createDataFrame(res_rows, S["reservasi"]),
        "detail_reservasi": spark.createDataFrame(
            [(i + 1, r, k, d(ci), d(co), Dec(h)) for i, (r, k, ci, co, h) in enumerate(stays)],
            S["detail_reservasi"]),
        "pembayaran": spark.createDataFrame(pay_rows, S["pembayaran"]),
        "invoice": spark.createDataFrame(
            [(i + 1, r, n, _at(_first_checkin(stays, r), 12)) for i, (r, n) in enumerate(invoices)], S["invoice"]),
        "checkin": spark.createDataFrame(
            [(i + 1, r, p, _at(_first_checkin(stays, r), 14)) for i, (r, p) in enumerate(CHECKINS)], S["checkin"]),
        "checkout": spark.createDataFrame(
            [(i + 1, r, p, _at(_first_checkin(stays, r), 14)) for i, (r, p) in enumerate(CHECKOUTS)], S["checkout"]),
        "ulasan": spark.createDataFrame(
            [(i + 1, g, k, r, c, d(day)) for i, (g, k, r, c, day) in enumerate(REVIEWS)], S["ulasan"]),
    }
    return Tables.from_frames(spark, t)
