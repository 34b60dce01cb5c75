"""The schema's constraints as data: one ``Rules`` per table and the list of
references. The validator of bulk loads, the deletes and the orphan report
read them from here."""

from __future__ import annotations

from dataclasses import dataclass

from innlytics.sources import catalog


@dataclass(frozen=True)
class Reference:
    """``child.column`` holds a ``parent.key`` or NULL; ``action`` is what a
    delete of the parent row does to the child row."""
    child: str
    column: str
    parent: str
    key: str
    action: str


@dataclass(frozen=True)
class Rules:
    key: str | None = None                              # primary key; NULL asks for a new one
    not_null: tuple[str, ...] = ()
    unique: tuple[str, ...] = ()                        # besides the primary key; NULL is exempt
    ranges: tuple[tuple[str, int, int], ...] = ()       # CHECK (column BETWEEN lo AND hi); NULL passes
    lengths: tuple[tuple[str, int], ...] = ()           # most characters of a text
    after: tuple[tuple[str, str], ...] = ()             # (later, earlier): the insert trigger's rule


CASCADE, SET_NULL = "cascade", "set_null"

# ---------------------------------------------------------------------------
# The constraints of the schema.
# ---------------------------------------------------------------------------
REFERENCES = [
    Reference("users", "role_id", "roles", "id_role", SET_NULL),
    Reference("pegawai", "jabatan_id", "jabatan", "id_jabatan", SET_NULL),
    Reference("pegawai", "user_id", "users", "id_user", SET_NULL),
    Reference("tamu", "user_id", "users", "id_user", SET_NULL),
    Reference("kamar", "tipe_id", "tipe_kamar", "id_tipe", SET_NULL),
    Reference("kamar", "status_id", "status_kamar", "id_status", SET_NULL),
    Reference("kamar_fasilitas", "kamar_id", "kamar", "id_kamar", CASCADE),
    Reference("kamar_fasilitas", "fasilitas_id", "fasilitas", "id_fasilitas", CASCADE),
    Reference("reservasi", "tamu_id", "tamu", "id_tamu", SET_NULL),
    Reference("reservasi", "status_reservasi_id", "status_reservasi", "id_status_reservasi", SET_NULL),
    Reference("reservasi", "promo_id", "promo", "id_promo", SET_NULL),
    Reference("detail_reservasi", "reservasi_id", "reservasi", "id_reservasi", CASCADE),
    Reference("detail_reservasi", "kamar_id", "kamar", "id_kamar", SET_NULL),
    Reference("pembayaran", "reservasi_id", "reservasi", "id_reservasi", CASCADE),
    Reference("pembayaran", "metode_id", "metode_pembayaran", "id_metode", SET_NULL),
    Reference("invoice", "reservasi_id", "reservasi", "id_reservasi", CASCADE),
    Reference("checkin", "reservasi_id", "reservasi", "id_reservasi", CASCADE),
    Reference("checkin", "pegawai_id", "pegawai", "id_pegawai", SET_NULL),
    Reference("checkout", "reservasi_id", "reservasi", "id_reservasi", CASCADE),
    Reference("checkout", "pegawai_id", "pegawai", "id_pegawai", SET_NULL),
    Reference("ulasan", "tamu_id", "tamu", "id_tamu", CASCADE),
    Reference("ulasan", "kamar_id", "kamar", "id_kamar", CASCADE),
    Reference("audit_log", "user_id", "users", "id_user", SET_NULL),
]
RULES = {
    "roles": Rules("id_role", ("nama_role",), lengths=(("nama_role", 50),)),
    "users": Rules("id_user", ("username", "email"), ("username", "email"), lengths=(("username", 50), ("email", 100))),
    "jabatan": Rules("id_jabatan", ("nama_jabatan",), lengths=(("nama_jabatan", 100),)),
    "pegawai": Rules("id_pegawai", ("nama",), ("user_id",), lengths=(("nama", 150), ("telepon", 15))),
    "tamu": Rules("id_tamu", ("nama", "email"), ("email", "user_id"),
                  lengths=(("nama", 150), ("email", 100), ("telepon", 15))),
    "tipe_kamar": Rules("id_tipe", ("nama_tipe", "harga", "kapasitas"), lengths=(("nama_tipe", 50),)),
    "status_kamar": Rules("id_status", ("status",), lengths=(("status", 50),)),
    "kamar": Rules("id_kamar", ("nomor_kamar",), ("nomor_kamar",), lengths=(("nomor_kamar", 10),)),
    "fasilitas": Rules("id_fasilitas", ("nama_fasilitas",), lengths=(("nama_fasilitas", 100),)),
    "kamar_fasilitas": Rules(),
    "status_reservasi": Rules("id_status_reservasi", ("status",), lengths=(("status", 50),)),
    "promo": Rules("id_promo", ("kode", "diskon"), ("kode",), lengths=(("kode", 20),)),
    "reservasi": Rules("id_reservasi"),
    "detail_reservasi": Rules("id_detail", ("tanggal_checkin", "tanggal_checkout", "harga"),
                              after=(("tanggal_checkout", "tanggal_checkin"),)),
    "metode_pembayaran": Rules("id_metode", ("nama_metode",), lengths=(("nama_metode", 50),)),
    "pembayaran": Rules("id_pembayaran", ("total",), ("reservasi_id",)),
    "invoice": Rules("id_invoice", ("nomor_invoice",), ("reservasi_id", "nomor_invoice"), lengths=(("nomor_invoice", 50),)),
    "checkin": Rules("id_checkin", (), ("reservasi_id",)),
    "checkout": Rules("id_checkout", (), ("reservasi_id",)),
    "ulasan": Rules("id_ulasan", ranges=(("rating", 1, 5),)),
    "audit_log": Rules("id_log", ("aktivitas",), lengths=(("aktivitas", 255), ("ip_address", 45))),
}
#: Tables of a handful of fixed rows.
LOOKUPS = ("roles", "jabatan", "status_kamar", "status_reservasi", "promo", "metode_pembayaran")
# ---------------------------------------------------------------------------


def parents_of(table: str) -> list[Reference]:
    return [r for r in REFERENCES if r.child == table]


def children_of(table: str) -> list[Reference]:
    return [r for r in REFERENCES if r.parent == table]


def parents_first() -> list[str]:
    """All tables, each after those it refers to."""
    order: list[str] = []
    left = list(catalog.SCHEMAS)
    while left:
        ready = [x for x in left if all(r.parent in order for r in parents_of(x))]
        if not ready:
            raise ValueError(f"references form a circle: {left}")
        order += ready
        left = [x for x in left if x not in ready]
    return order
