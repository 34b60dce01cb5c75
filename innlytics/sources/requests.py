"""Request batches derived from the tables themselves (for the registered
queries and the bench): every batch grows with the data it is derived from.

* availability / conflict probes: the date ranges of cancelled stays,
  re-asked for their room type (B2) or room (B3)
* booking requests (B7): every cancelled stay line re-booked by its guest
* check-in requests (B8): every new (Baru) reservation; check-out: every
  checked-in one; payments (B9): every checked-out reservation. Each comes
  twice, a share of them refused first and valid then
* registrations (B11): one per 'signup' event, with taken, repeated and
  chained keys
* bulk loads (S2): one row per stored login, guest, review and stay, with
  faults of every kind
* room inserts/updates/deletes (B12-B14): from the room table, with refused
  requests before valid ones and numbers freed and taken inside the batch
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from innlytics.sources import catalog as C
from innlytics.sources.tables import Tables

CI, CO = "tanggal_checkin", "tanggal_checkout"


def _cancelled_stays(t: Tables) -> DataFrame:
    cancelled = t.reservasi.where(F.col("status_reservasi_id") == C.RES_CANCELLED).select(
        "id_reservasi", "tamu_id", "promo_id", "tanggal_pesan")
    return t.detail_reservasi.join(cancelled, F.col("reservasi_id") == F.col("id_reservasi"), "inner")


def range_key(*cols) -> F.Column:
    return F.concat_ws("|", *[F.col(c).cast("string") for c in cols])


def availability_probes(t: Tables) -> DataFrame:
    """B2 requests: distinct (type, checkin, checkout) of cancelled stays."""
    s = _cancelled_stays(t).join(t.kamar.select("id_kamar", "tipe_id"),
                                 F.col("kamar_id") == F.col("id_kamar"), "inner")
    return (s.select("tipe_id", CI, CO).where(F.col("tipe_id").isNotNull()).distinct()
            .withColumn("request_id", range_key("tipe_id", CI, CO)))


def conflict_probes(t: Tables) -> DataFrame:
    """B3 requests: distinct (room, checkin, checkout) of cancelled stays."""
    return (_cancelled_stays(t).select("kamar_id", CI, CO).distinct()
            .withColumn("request_id", range_key("kamar_id", CI, CO)))


def default_probes(t: Tables) -> DataFrame:
    """B6 requests, one per reservation: checkin given unless cancelled,
    checkout given unless new."""
    day = F.col("tanggal_pesan").cast("date")
    st = F.col("status_reservasi_id")
    return t.reservasi.select(
        "id_reservasi",
        F.when(st != C.RES_CANCELLED, day).alias(CI),
        F.when(st != C.RES_NEW, F.date_add(day, 2)).alias(CO))


def booking_requests(t: Tables) -> DataFrame:
    """B7 requests in request order ``req_seq`` (stay id order)."""
    s = _cancelled_stays(t)
    return s.select(F.col("id_detail").alias("req_seq"), "tamu_id", "kamar_id", CI, CO, "promo_id")


def checkin_requests(t: Tables, kind: str = "checkin") -> DataFrame:
    """Each reservation in the state before asks twice. Every fifth is first
    refused (unknown employee 99) and then valid; the others come twice, and
    the second is a duplicate."""
    status = C.RES_NEW if kind == "checkin" else C.RES_CHECKED_IN
    base = t.reservasi.where(F.col("status_reservasi_id") == status).select("id_reservasi", "tamu_id")
    both = base.withColumn("_turn", F.explode(F.array(F.lit(0), F.lit(1))))
    clerk = F.when(F.col("id_reservasi") % 7 != 0, F.col("tamu_id") % 6 + 1)
    return both.select((F.col("id_reservasi") * 2 + F.col("_turn")).alias("req_seq"),
                       F.col("id_reservasi").alias("reservasi_id"),
                       F.when((F.col("id_reservasi") % 5 == 0) & (F.col("_turn") == 0), F.lit(99)).otherwise(clerk)
                       .cast("bigint").alias("pegawai_id"))


def payment_requests(t: Tables) -> DataFrame:
    """B9 requests: checked-out reservations, method by id, amount = stay sum.
    Each comes twice: every third first with amount 0 (refused), then valid."""
    done = t.reservasi.where(F.col("status_reservasi_id") == C.RES_CHECKED_OUT).select("id_reservasi")
    sums = t.detail_reservasi.groupBy("reservasi_id").agg(F.sum("harga").alias("_s"))
    both = (done.join(sums, F.col("id_reservasi") == F.col("reservasi_id"), "left")
            .withColumn("_turn", F.explode(F.array(F.lit(0), F.lit(1)))))
    due = F.when((F.col("id_reservasi") % 3 == 0) & (F.col("_turn") == 0), F.lit(0)).otherwise(F.coalesce("_s", F.lit(0)))
    return both.select((F.col("id_reservasi") * 2 + F.col("_turn")).alias("req_seq"),
                       F.col("id_reservasi").alias("reservasi_id"),
                       (F.col("id_reservasi") % 4).alias("metode_id"), due.cast("decimal(20,2)").alias("total"))


def room_insert_requests(t: Tables) -> DataFrame:
    """Two inserts per room. Maintenance rooms ask for a new number (suffix
    'A'), even ids first with an unknown type (refused); the others repeat an
    existing number (refused)."""
    both = t.kamar.withColumn("_turn", F.explode(F.array(F.lit(0), F.lit(1))))
    return both.select(
        (F.col("id_kamar") * 2 + F.col("_turn")).alias("req_seq"),
        F.when(F.col("status_id") == C.ROOM_MAINTENANCE, F.concat(F.col("nomor_kamar"), F.lit("A")))
        .otherwise(F.col("nomor_kamar")).alias("nomor_kamar"),
        F.when((F.col("id_kamar") % 2 == 0) & (F.col("_turn") == 0), F.lit(-1).cast("bigint")).otherwise(
            F.col("tipe_id")).alias("tipe_id"),
        F.lit(None).cast("bigint").alias("status_id"))


def room_update_patches(t: Tables) -> DataFrame:
    """Four patches per room, in room order, by id modulo 3. Rooms of class
    0 free their number ('X<id>'); class 1 and 2 take the number of the room
    before them (freed just then); then all ask for a number that another room
    of their three holds, together with a status (refused), and repeat their
    own number with a status; maintenance rooms go back to Tersedia, the others
    send an empty patch (refused)."""
    four = t.kamar.select("id_kamar", "status_id").withColumn("_turn", F.explode(F.sequence(F.lit(0), F.lit(3))))
    k, turn, cls = F.col("id_kamar"), F.col("_turn"), F.col("id_kamar") % 3
    own = F.when(cls == 0, F.concat(F.lit("X"), k.cast("string"))).otherwise((k - 1).cast("string"))
    other = F.when(cls == 2, F.concat(F.lit("X"), (k - 2).cast("string"))).otherwise((k + 1).cast("string"))
    number = F.when((turn == 0) | (turn == 2), own).when(turn == 1, other)
    status = (F.when(turn == 1, F.lit(C.ROOM_MAINTENANCE)).when(turn == 2, F.lit(C.ROOM_OCCUPIED))
              .when((turn == 3) & (F.col("status_id") == C.ROOM_MAINTENANCE), F.lit(C.ROOM_FREE)))
    return four.select((k * 4 + turn).cast("bigint").alias("req_seq"), "id_kamar", number.alias("nomor_kamar"),
                       F.lit(None).cast("bigint").alias("tipe_id"), status.cast("bigint").alias("status_id"))


def room_delete_keys(t: Tables) -> DataFrame:
    """Delete every maintenance room."""
    return t.kamar.where(F.col("status_id") == C.ROOM_MAINTENANCE).select(
        F.col("id_kamar").alias("req_seq"), "id_kamar")


def room_delete_requests(t: Tables) -> DataFrame:
    """B14 with refused and repeated requests: every maintenance room is named
    twice, other rooms of even id without an id (NULL, or 0 by threes), the rest by
    ids that do not exist."""
    k = F.col("id_kamar")
    asked = (F.when(F.col("status_id") == C.ROOM_MAINTENANCE, k).when(k % 6 == 0, F.lit(0)).when(k % 2 == 0, F.lit(None))
             .otherwise(-k))
    return t.kamar.withColumn("_turn", F.explode(F.array(F.lit(0), F.lit(1)))).select(
        (k * 2 + F.col("_turn")).alias("req_seq"), asked.cast("bigint").alias("id_kamar"))


#: New logins of a bulk load get ids from here on.
LOAD_BASE = 1_000_000_000


def load_batches(t: Tables) -> dict[str, DataFrame]:
    """Rows to load into four tables, one per stored row, with faults of every
    kind. Logins: stored ids, no or too long names, unknown roles, stored emails
    in capitals, names and emails that several rows share (in other case and with
    accents). Guests of these logins: missing names, too long phone numbers, shared
    emails, logins that were refused. Reviews: ratings out of range, unknown rooms,
    stored ids. Stays: missing and turned dates, unknown rooms and reservations."""
    i = F.col("id_user")
    name = F.concat(F.element_at(F.array(F.lit("muat"), F.lit("MUAT"), F.lit("Muát")), (i % 3 + 1).cast("int")),
                    F.floor(i / 4).cast("string"))
    users = t.users.select(
        i.alias("req_seq"), F.when(i % 6 == 0, i).otherwise(i + LOAD_BASE).alias("id_user"),
        F.when(i % 13 == 0, F.lit(None)).when(i % 17 == 0, F.repeat(F.lit("x"), 51)).otherwise(name).alias("username"),
        F.when(i % 19 == 0, F.upper("email")).otherwise(
            F.concat(F.lit("muat"), F.floor(i / 3).cast("string"), F.lit("@example.com"))).alias("email"),
        F.when(i % 5 == 0, i % 4 + 1).otherwise(F.lit(3)).cast("bigint").alias("role_id"))
    g = F.col("id_tamu")
    guests = t.tamu.select(
        g.alias("req_seq"), F.when(g % 7 != 0, F.concat(F.lit("Muat "), g.cast("string"))).alias("nama"),
        F.concat(F.lit("tamu-muat"), F.floor(g / 2).cast("string"), F.lit("@example.com")).alias("email"),
        F.when(g % 23 == 0, F.repeat(F.lit("0"), 16)).alias("telepon"),
        F.when(g % 2 == 0, g + LOAD_BASE).alias("user_id"))
    u = F.col("id_ulasan")
    reviews = t.ulasan.select(
        u.alias("req_seq"), F.when(u % 10 == 0, u).alias("id_ulasan"), "tamu_id",
        F.when(u % 11 == 0, F.lit(-1)).otherwise(F.col("kamar_id")).cast("bigint").alias("kamar_id"),
        (F.col("rating") * 2 - 3).alias("rating"), "tanggal")
    r, k = F.col("reservasi_id"), F.col("kamar_id")
    turned = r % 31 == 0
    stays = t.detail_reservasi.select(
        F.col("id_detail").alias("req_seq"), F.when(k % 41 == 0, F.lit(-1)).otherwise(r).cast("bigint").alias("reservasi_id"),
        F.when(k % 37 != 0, F.when(k % 43 == 0, -k).otherwise(k)).alias("kamar_id"),
        F.when(r % 29 != 0, F.when(turned, F.col(CO)).otherwise(F.col(CI))).alias(CI),
        F.when(turned, F.col(CI)).otherwise(F.col(CO)).alias(CO), "harga")
    return {"users": users, "tamu": guests, "ulasan": reviews, "detail_reservasi": stays}


def request_bodies(t: Tables) -> DataFrame:
    """One booking request body per reservation, by id modulo 12: whole (0-3,
    with spaces or a number written as text), with text after it, in an array, two
    in a row, cut short, a word for the room, no room, null for the room, NULL."""
    i = F.col("id_reservasi")
    s = lambda c: c.cast("string")
    base = F.concat(F.lit('{"tamu_id":'), s(F.col("tamu_id")), F.lit(',"kamar_id":'), s(i % 200 + 1))
    whole = F.concat(base, F.lit(',"tanggal_checkin":"'), F.date_format("tanggal_pesan", "yyyy-MM-dd"), F.lit('"}'))
    guest = F.concat(F.lit('{"tamu_id":'), s(F.col("tamu_id")))
    kinds = [whole, F.concat(F.lit(" "), whole, F.lit(" ")), F.concat(guest, F.lit(',"kamar_id":"7"}')),
             F.concat(base, F.lit(',"catatan":{"a":[1,"}"]}}')), F.concat(whole, F.lit(" x")),
             F.concat(F.lit("["), whole, F.lit("]")), F.concat(whole, whole), base, F.concat(guest, F.lit(',"kamar_id":"tujuh"}')),
             F.concat(guest, F.lit("}")), F.concat(guest, F.lit(',"kamar_id":null}')), F.lit(None).cast("string")]
    body = F.lit(None).cast("string")
    for n, kind in enumerate(kinds):  # only the body of a row's own kind is built
        body = F.when(i % 12 == n, kind).otherwise(body)
    return t.reservasi.select(i.alias("req_seq"), body.alias("body"))


def registration_requests(events: DataFrame) -> DataFrame:
    """B11 requests: one per signup event, keys derived from growing ids. Every
    fifth user asks for an existing login; the others for a new name that their
    later events repeat; four neighbouring events share an email, so that
    refused and accepted requests chain."""
    s = events.where(F.col("event_type") == "signup")
    taken = F.col("user_id") % 5 == 0
    name = F.concat(F.when(taken, F.lit("Tamu")).otherwise(F.lit("baru")), F.col("user_id").cast("string"))
    mail = F.concat(F.lit("guest"), F.floor(F.col("event_id") / 4).cast("string"), F.lit("@example.com"))
    return s.select(F.col("event_id").alias("req_seq"), name.alias("username"), mail.alias("email"),
                    F.lit("secret").alias("password"),
                    F.concat(F.lit("Guest "), F.col("user_id").cast("string")).alias("nama"),
                    F.concat(F.lit("08"), F.col("user_id").cast("string")).alias("telepon"),
                    F.lit(None).cast("string").alias("alamat"))
