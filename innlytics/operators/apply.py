"""Batch application of write requests.

Each ``apply_*`` takes the current ``Tables`` and a request batch and returns
an ``Applied``: the new rows, the rejected requests with their reasons, the
audit lines and the updated tables. All checks are set operations over the
whole batch (anti/semi joins, grouped first-wins); the only Python is the
per-room greedy arbitration of B7 (``mapInPandas`` over partitions sorted by
(room, overlap cluster, request order)), so unrelated requests never wait on
each other and no group is materialised.
"""

from __future__ import annotations

import datetime as dt
import uuid
from bisect import bisect_right
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from innlytics.functions import scalar as E
from innlytics.operators import booking as B
from innlytics.operators import changes as CH
from innlytics.operators import load as LD
from innlytics.operators import quality as Q
from innlytics.plans import intervals as IV
from innlytics.plans.checkpoint import cut, drop
from innlytics.plans.components import components
from innlytics.plans.first_come import first_come
from innlytics.plans.numbering import new_ids
from innlytics.session import checkpoint_dir
from innlytics.sources import catalog as C
from innlytics.sources.tables import Tables

CI, CO = "tanggal_checkin", "tanggal_checkout"

# Fixed rejection texts (the API's wording where it has one).
MSG_BOOKED = "Kamar sudah dibooking di tanggal tersebut"
MSG_NOT_FOUND_RES = "Reservasi tidak ditemukan"
MSG_REGISTERED = "Username atau email sudah terdaftar"
MSG_NOTHING_TO_UPDATE = "Tidak ada data yang diupdate"
MSG_ID_REQUIRED = "ID diperlukan"
MSG_DUPLICATE = "Duplicate entry"          # UNIQUE constraint at commit
MSG_FK = "Foreign key constraint fails ({})"
MSG_PRICE_NULL = "Column 'harga' cannot be null"


@dataclass
class Applied:
    accepted: DataFrame
    rejected: DataFrame
    audit: DataFrame
    tables: Tables
    extra: dict = field(default_factory=dict)


def _ts(as_of) -> F.Column:
    return F.lit(as_of).cast("timestamp_ntz")


def _max_id(df: DataFrame, col: str) -> F.Column:
    """Current max id as an uncorrelated scalar subquery (0 on an empty table)."""
    return df.agg(F.coalesce(F.max(col), F.lit(0)).cast("bigint")).scalar()


def _assign_ids(df: DataFrame, bases: dict[str, DataFrame], order: str = "req_seq") -> DataFrame:
    """AUTO_INCREMENT for a batch: for each id column, max(existing id) of its
    table + rank in request order. The batch is ranked once for all ids."""
    return new_ids(df, order, {col: _max_id(base, col) for col, base in bases.items()})


def _first_wins(df: DataFrame, keys: list, reason: str, order: str = "req_seq") -> DataFrame:
    """Add ``reason`` to every request that is not the first (by ``order``) of
    the requests not refused so far that share ``keys``: a refused request
    stores nothing, so it blocks nobody. Rows with a NULL key part are exempt."""
    kcols = [F.col(k) if isinstance(k, str) else k for k in keys]
    names = [f"_k{i}" for i in range(len(kcols))]
    tagged = df.select("*", *[c.alias(n) for c, n in zip(kcols, names)])
    firsts = tagged.where(F.size("reasons") == 0).groupBy(*names).agg(F.min(order).alias("_first"))
    j = tagged.join(firsts, names, "left")
    nn = F.lit(True)
    for n in names:
        nn = nn & F.col(n).isNotNull()
    return Q.with_reasons(j, [(nn & (F.col(order) > F.col("_first")), reason)]).drop("_first", *names)


def _key_flags(df: DataFrame, key: str, sources: list[tuple[DataFrame, str, str]]) -> DataFrame:
    """Attach one boolean per source: does ``key`` occur in that source's
    column? All sources are unioned and aggregated once per key (partial
    aggregation), then joined to ``df`` once."""
    tags = [tag for _, _, tag in sources]
    parts = [src.select(F.col(col).alias("_fk"), *[F.lit(t == tag).alias(t) for t in tags])
             for src, col, tag in sources]
    keys = parts[0]
    for p in parts[1:]:
        keys = keys.unionByName(p)
    asked = df.select(F.col(key).alias("_ask")).where(F.col("_ask").isNotNull()).distinct()
    facts = keys.join(asked, F.col("_fk") == F.col("_ask"), "left_semi").groupBy("_fk").agg(*[F.max(t).alias(t) for t in tags])
    j = df.join(facts, F.col(key) == F.col("_fk"), "left").drop("_fk")
    for t_ in tags:
        j = j.withColumn(t_, F.coalesce(F.col(t_), F.lit(False)))
    return j


def _key_facts(df: DataFrame, key: str, sources: list[tuple[DataFrame, str, str]], fine: F.Column) -> DataFrame:
    """``_key_flags`` together with ``_first``, the smallest req_seq of a key's requests
    that are ``fine`` (NULL for a key in none of the sources). The batch is grouped once, which also gives
    the keys that it asks for, so the rows meet all facts of their key in one join."""
    tags = [tag for _, _, tag in sources]
    parts = [src.select(F.col(col).alias("_fk"), *[F.lit(t == tag).alias(t) for t in tags]) for src, col, tag in sources]
    keys = parts[0]
    for p in parts[1:]:
        keys = keys.unionByName(p)
    own = df.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("_ask")).agg(
        F.min(F.when(fine, F.col("req_seq"))).alias("_first"))
    facts = keys.join(own, F.col("_fk") == F.col("_ask")).groupBy("_ask").agg(
        *[F.max(t).alias(t) for t in tags], F.max("_first").alias("_first"))
    j = df.join(facts, F.col(key) == F.col("_ask"), "left").drop("_ask")
    for t_ in tags:
        j = j.withColumn(t_, F.coalesce(F.col(t_), F.lit(False)))
    return j


def _flag_existing(df: DataFrame, key, existing: DataFrame, ekey, reason: str) -> DataFrame:
    k = F.col(key) if isinstance(key, str) else key
    ek = F.col(ekey) if isinstance(ekey, str) else ekey
    asked = df.select(k.alias("_ask")).where(F.col("_ask").isNotNull()).distinct()
    keys = (existing.select(ek.alias("_ek")).join(asked, F.col("_ek") == F.col("_ask"), "left_semi").distinct()
            .withColumn("_eh", F.lit(True)))
    j = df.withColumn("_dk", k).join(keys, F.col("_dk") == F.col("_ek"), "left")
    return Q.with_reasons(j, [(F.col("_eh").isNotNull(), reason)]).drop("_dk", "_ek", "_eh")


# ---------------------------------------------------------------------------
# B7 bookings
# ---------------------------------------------------------------------------
def _greedy_stream(batches):
    """First come, first served per (room, cluster), over a partition sorted
    by (room, cluster, req_seq). Only the accepted stays of the current
    cluster are held (disjoint, sorted by start: one bisect per request), so
    a cluster of any size streams through without being materialised."""
    key = None
    starts: list[int] = []
    ends: list[int] = []
    for pdf in batches:
        won = []
        for room, blk, ci, co in zip(pdf["kamar_id"].tolist(), pdf["_blk"].tolist(),
                                     pdf["_ci"].tolist(), pdf["_co"].tolist()):
            if (room, blk) != key:
                key, starts, ends = (room, blk), [], []
            i = bisect_right(starts, ci)
            ok = not (i > 0 and ends[i - 1] > ci) and not (i < len(starts) and starts[i] < co)
            if ok:
                starts.insert(i, ci)
                ends.insert(i, co)
            won.append(ok)
        yield pd.DataFrame({"req_seq": pdf["req_seq"].to_numpy(), "_won": won})


#: Overlap clusters of more requests than this are first thinned out in rounds.
HOT_CLUSTER = 50_000
#: A round that decides less than this share of its requests is the last.
LEAST_SHARE = 0.1


def _clusters(days: DataFrame) -> DataFrame:
    """(kamar_id, _blk, req_seq, _ci, _co, _size) of requests with day numbers."""
    dated = days.select("req_seq", "kamar_id", "_ci", "_co", F.date_from_unix_date("_ci").alias(CI),
                        F.date_from_unix_date("_co").alias(CO))
    clustered = (IV.block_of(dated, "kamar_id", CI, CO, merge_touching=False)
                 .select("kamar_id", F.unix_date("block_start").alias("_blk"), "req_seq", "_ci", "_co"))
    return cut(clustered.withColumn("_size", F.count(F.lit(1)).over(Window.partitionBy("kamar_id", "_blk"))), "clusters")


def _thin_out(hot: DataFrame, path: str) -> DataFrame:
    """Decide requests of hot clusters in rounds, spread over all tasks: those that
    come before all pending requests that they overlap are accepted, and the pending
    ones that overlap an accepted one are refused. Decisions are added to the table at
    ``path``; what is left when rounds decide little is returned."""
    pending = cut(hot.select("req_seq", "kamar_id", "_ci", "_co"), "pending")
    n = pending.count()
    while n:
        first = IV.earliest_overlap(pending, pending, "kamar_id", "_ci", "_co", "req_seq", out="_first")
        marked = cut(pending.join(first, "req_seq").withColumn("_won", F.col("_first") == F.col("req_seq")).drop("_first"), "pending")
        rest = marked.where(~F.col("_won")).drop("_won")
        hit = IV.earliest_overlap(marked.where("_won").drop("_won"), rest, "kamar_id", "_ci", "_co", "req_seq", out="_hit")
        rest = cut(rest.join(hit, "req_seq", "left"), "pending")
        (marked.where("_won").select("req_seq", "_won")
         .unionByName(rest.where("_hit IS NOT NULL").select("req_seq", F.lit(False).alias("_won")))
         .write.mode("append").parquet(path))
        drop(pending)
        drop(marked)
        pending = rest.where("_hit IS NULL").drop("_hit")
        before, n = n, pending.count()
        if before - n < LEAST_SHARE * before:
            break
    return pending


def arbitrate(requests: DataFrame, hot_cluster: int = HOT_CLUSTER) -> DataFrame:
    """In-batch conflicts: per room, requests in request order; a request is
    accepted iff it overlaps no earlier accepted request of that room.

    Requests that can never interact (other room, or another overlap cluster
    of the same room) are hashed to different partitions; each partition is
    sorted by (room, cluster, req_seq) by Spark (external sort, spills) and
    streamed through ``mapInPandas``. A request alone in its cluster wins
    without Python. Clusters of more than ``hot_cluster`` requests are thinned out
    in rounds before, which cuts them into small ones unless request order follows
    the calendar all along; the outcome is the same. Returns (req_seq, _won)."""
    spark = requests.sparkSession
    days = requests.select("req_seq", "kamar_id", F.unix_date(CI).alias("_ci"), F.unix_date(CO).alias("_co"))
    sized = _clusters(days)
    hot, done = sized.where(F.col("_size") > hot_cluster), None
    if not hot.isEmpty():
        path = f"{checkpoint_dir(spark).rstrip('/')}/tables/decided-{uuid.uuid4().hex}"
        left = _thin_out(hot, path)
        done = spark.read.parquet(path)
        sized = sized.where(F.col("_size") <= hot_cluster).unionByName(_clusters(left))
    alone = sized.where("_size = 1").select("req_seq", F.lit(True).alias("_won"))
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    out = (sized.where("_size > 1").drop("_size").repartition(n, "kamar_id", "_blk")
           .sortWithinPartitions("kamar_id", "_blk", "req_seq")
           .mapInPandas(_greedy_stream, schema="req_seq long, _won boolean").unionByName(alone))
    return out if done is None else out.unionByName(done)


def apply_bookings(t: Tables, requests: DataFrame, as_of: str | dt.date, actor_id: int = 1,
                   check_conflicts: bool = True, checkpoint: bool = True) -> Applied:
    """B7. requests: req_seq, tamu_id, kamar_id, [tanggal_checkin],
    [tanggal_checkout], [promo_id]; ``req_seq`` is the batch's arrival order
    and must be unique (it decides who wins a room and keeps task retries
    deterministic). ``check_conflicts=False`` is the SQL procedure's
    behaviour (no conflict check, NULL price).

    With ``checkpoint`` (default) the batch, the checked batch and the id-stamped
    rows are written to the shared checkpoint folder: later steps read them back
    instead of re-running the whole check lineage once per consumer, and a
    lost executor does not send the job back to the start."""
    r = B.stay_defaults(requests, as_of)
    if "promo_id" not in r.columns:
        r = r.withColumn("promo_id", F.lit(None).cast("bigint"))
    if checkpoint:
        r = cut(r, "requests")  # every check reads it
    r = Q.required(r, ["tamu_id", "kamar_id"])
    r = Q.with_reasons(r, [(F.col(CO) <= F.col(CI), Q.MSG_CHECKOUT)])
    r = Q.flag_missing_parent(r, "tamu_id", t.tamu, "id_tamu", MSG_FK.format("tamu"))
    r = Q.flag_missing_parent(r, "kamar_id", t.kamar, "id_kamar", MSG_FK.format("kamar"))
    r = Q.flag_missing_parent(r, "promo_id", t.promo, "id_promo", MSG_FK.format("promo"), lookup=True)
    if check_conflicts:
        if checkpoint:
            r = cut(r, "checked")
        probe = r.where(F.size("reasons") == 0).select(F.col("req_seq").alias("request_id"), "kamar_id", CI, CO)
        # probe rows passed V1 above, so the invalid-request branch is skipped
        hits = B.booking_conflicts(t, probe, requests_valid=True).where(F.col("jumlah_konflik") > 0).select(
            F.col("request_id").alias("_hit_seq"), F.lit(True).alias("_hit"))
        r = r.join(hits, F.col("req_seq") == F.col("_hit_seq"), "left")
        r = Q.with_reasons(r, [(F.col("_hit").isNotNull(), MSG_BOOKED)]).drop("_hit_seq", "_hit")
        if checkpoint:
            r = cut(r)
        won = arbitrate(r.where(F.size("reasons") == 0))
        r = r.join(won, "req_seq", "left")
        r = Q.with_reasons(r, [(F.col("_won") == F.lit(False), MSG_BOOKED)]).drop("_won")
    # Price: the API falls back to 0 for a room without type; the SQL
    # procedure reads NULL and the NOT NULL column refuses the stay line.
    price_mode = "api" if check_conflicts else "sql"
    r = r.join(B.room_price(t, mode=price_mode).select(F.col("id_kamar").alias("_pk"), "harga"),
               F.col("kamar_id") == F.col("_pk"), "left").drop("_pk")
    r = Q.with_reasons(r, [(F.col("harga").isNull() & (F.size("reasons") == 0), MSG_PRICE_NULL)])
    priced, rejected = Q.split(r)
    with_ids = _assign_ids(priced, {"id_reservasi": t.reservasi, "id_detail": t.detail_reservasi})
    new_res = with_ids.select("id_reservasi", "tamu_id", _ts(as_of).alias("tanggal_pesan"),
                              F.lit(C.RES_NEW).cast("bigint").alias("status_reservasi_id"), "promo_id")
    new_stays = with_ids.select("id_detail", F.col("id_reservasi").alias("reservasi_id"), "kamar_id", CI, CO,
                                F.col("harga").cast(C.MONEY).alias("harga"))
    trig, _ = CH.audit_new_reservations(new_res, when=as_of)
    api = CH.audit_actions("booking", with_ids, user_id=actor_id, when=as_of)
    tables = t.with_(reservasi=t.reservasi.unionByName(new_res),
                     detail_reservasi=t.detail_reservasi.unionByName(new_stays))
    return Applied(with_ids.select("req_seq", "id_reservasi", "id_detail", "tamu_id", "kamar_id", CI, CO, "harga"),
                   rejected, trig.unionByName(api), tables,
                   {"reservasi": new_res, "detail_reservasi": new_stays})


# ---------------------------------------------------------------------------
# B8 check-in / check-out
# ---------------------------------------------------------------------------
def apply_status_action(t: Tables, requests: DataFrame, kind: str, as_of, actor_id: int = 1) -> Applied:
    """B8. requests: req_seq, reservasi_id, [pegawai_id] (default 1). The
    status is set without looking at the previous one; a second check-in of
    the same reservation breaks UNIQUE(reservasi_id) and is rejected."""
    table = t.checkin if kind == "checkin" else t.checkout
    id_col, time_col = ("id_checkin", "waktu_checkin") if kind == "checkin" else ("id_checkout", "waktu_checkout")
    new_status = C.RES_CHECKED_IN if kind == "checkin" else C.RES_CHECKED_OUT
    r = requests
    if "pegawai_id" not in r.columns:
        r = r.withColumn("pegawai_id", F.lit(None).cast("bigint"))
    r = r.withColumn("pegawai_id", F.coalesce(F.col("pegawai_id"), F.lit(1).cast("bigint")))
    r = Q.with_reasons(r, [(E.php_empty("reservasi_id", requests.schema["reservasi_id"].dataType),
                            MSG_ID_REQUIRED)])
    r = Q.flag_missing_parent(r, "pegawai_id", t.pegawai, "id_pegawai", MSG_FK.format("pegawai"), out="_clerk", lookup=True)
    # One grouping and one join answer all questions of a reservation (exists, done
    # before, which request is first); the judged batch is written once for the steps
    # that read it.
    r = _key_facts(r, "reservasi_id", [(t.reservasi, "id_reservasi", "_is_res"), (table, "reservasi_id", "_done")],
                   (F.size("reasons") == 0) & (F.size("_clerk") == 0))
    r = Q.with_reasons(r, [(F.col("reservasi_id").isNotNull() & ~F.col("_is_res"), MSG_FK.format("reservasi"))])
    r = r.withColumn("reasons", F.concat("reasons", "_clerk"))
    later = F.col("_is_res") & ~F.col("_done") & (F.col("req_seq") > F.col("_first"))
    r = Q.with_reasons(r, [(F.col("_done"), MSG_DUPLICATE), (later, MSG_DUPLICATE)])
    r = cut(r.drop("_is_res", "_done", "_first", "_clerk"), "judged")
    ok, rejected = Q.split(r)
    rows = _assign_ids(ok, {id_col: table})
    new_rows = rows.select(id_col, "reservasi_id", "pegawai_id", _ts(as_of).alias(time_col))
    changed = ok.select(F.col("reservasi_id").alias("_chg"), F.lit(new_status).cast("bigint").alias("_new"))
    res = (t.reservasi.join(changed, F.col("id_reservasi") == F.col("_chg"), "left")
           .withColumn("status_reservasi_id", F.coalesce("_new", "status_reservasi_id")).drop("_chg", "_new"))
    # Transitions from the batch's own rows (not a before/after diff of the
    # whole table): the UPDATE fires only where the status really changes.
    transitions = (ok.select("reservasi_id")
                   .join(t.reservasi.select(F.col("id_reservasi").alias("reservasi_id"),
                                            F.col("status_reservasi_id").alias("old_status")),
                         "reservasi_id", "inner")
                   .withColumn("new_status", F.lit(new_status).cast("bigint"))
                   .where(F.col("new_status") != F.col("old_status")))
    trig = CH.audit_transitions(transitions.withColumn("ts", _ts(as_of)))
    api = CH.audit_actions(kind, ok, user_id=actor_id, when=as_of)
    kamar = CH.room_status_after(t.kamar, transitions.withColumn("ts", _ts(as_of))
                                 .withColumn("seq", F.col("reservasi_id")), t.detail_reservasi)
    tables = t.with_(reservasi=res, kamar=kamar,
                     **{kind: table.unionByName(new_rows)})
    return Applied(new_rows, rejected, trig.unionByName(api), tables, {"transitions": transitions})


# ---------------------------------------------------------------------------
# B9 payments
# ---------------------------------------------------------------------------
def apply_payments(t: Tables, requests: DataFrame, as_of, actor_id: int = 1) -> Applied:
    """B9. requests: req_seq, reservasi_id, metode_id, total. Unknown
    reservation and a second payment are refused; the amount is not
    compared with the reservation total (see X1)."""
    r = Q.required(requests, ["reservasi_id", "metode_id", "total"])
    # One join answers all three reservation-keyed questions (exists, already
    # paid, already invoiced) instead of one join per question.
    r = _key_flags(r, "reservasi_id", [(t.reservasi, "id_reservasi", "_is_res"),
                                       (t.pembayaran, "reservasi_id", "_paid"),
                                       (t.invoice, "reservasi_id", "_invoiced")])
    r = Q.with_reasons(r, [(F.col("reservasi_id").isNotNull() & ~F.col("_is_res"), MSG_NOT_FOUND_RES)])
    r = Q.flag_missing_parent(r, "metode_id", t.metode_pembayaran, "id_metode", MSG_FK.format("metode"), lookup=True)
    r = Q.with_reasons(r, [(F.col("_paid"), MSG_DUPLICATE), (F.col("_invoiced"), MSG_DUPLICATE)])
    r = r.drop("_is_res", "_paid", "_invoiced")
    r = r.withColumn("nomor_invoice", E.invoice_number(F.col("reservasi_id"), as_of))
    r = _flag_existing(r, "nomor_invoice", t.invoice, "nomor_invoice", MSG_DUPLICATE)
    r = _first_wins(r, ["reservasi_id"], MSG_DUPLICATE)
    ok, rejected = Q.split(r)
    rows = _assign_ids(ok, {"id_pembayaran": t.pembayaran, "id_invoice": t.invoice})
    pay = rows.select("id_pembayaran", "reservasi_id", "metode_id", F.col("total").cast(C.MONEY).alias("total"),
                      _ts(as_of).alias("tanggal_bayar"))
    inv = rows.select("id_invoice", "reservasi_id", "nomor_invoice", _ts(as_of).alias("tanggal_terbit"))
    api = CH.audit_actions("payment", rows, user_id=actor_id, when=as_of)
    tables = t.with_(pembayaran=t.pembayaran.unionByName(pay), invoice=t.invoice.unionByName(inv))
    return Applied(rows.select("req_seq", "id_pembayaran", "reservasi_id", "total", "nomor_invoice"),
                   rejected, api, tables, {"pembayaran": pay, "invoice": inv})


# ---------------------------------------------------------------------------
# B11 registrations
# ---------------------------------------------------------------------------
def apply_registrations(t: Tables, requests: DataFrame, as_of=None) -> Applied:
    """B11. requests: req_seq, username, email, password, nama, telepon,
    [alamat]. A request is refused when its username is a stored username or
    its email a stored email (case-insensitive, each against its own column),
    including those of earlier *accepted* requests of the batch; a guest row
    with that email also refuses it (UNIQUE at commit). The password is never
    stored.

    In-batch order is resolved by ``first_come`` on both keys, in rounds over the
    pending requests alone."""
    r = Q.required(requests, ["username", "email", "password", "nama", "telepon"]).drop("password")
    r = r.withColumn("_u", E.text_key("username")).withColumn("_e", E.text_key("email"))
    r = _flag_existing(r, "_u", t.users, E.text_key("username"), MSG_REGISTERED)
    r = _flag_existing(r, "_e", t.users, E.text_key("email"), MSG_REGISTERED)
    r = _flag_existing(r, "_e", t.tamu, E.text_key("email"), MSG_DUPLICATE)
    r = cut(r)
    won = first_come(r.where(F.size("reasons") == 0), "req_seq", ["_u", "_e"])
    r = Q.with_reasons(r.join(won, "req_seq", "left"), [(F.col("won") == F.lit(False), MSG_REGISTERED)]).drop("won")
    acc, rejected = Q.split(r)
    # SELECT id_role FROM roles WHERE nama_role = 'tamu' (first match)
    role = t.roles.where(F.col("nama_role") == "tamu").agg(F.min("id_role")).scalar()
    with_tid = _assign_ids(acc, {"id_user": t.users, "id_tamu": t.tamu}).withColumn("role_id", role.cast("bigint"))
    new_users = with_tid.select("id_user", "username", "email", "role_id")
    new_guests = with_tid.select("id_tamu", "nama", "email", "telepon",
                                 F.coalesce("alamat", F.lit("")).alias("alamat"), F.col("id_user").alias("user_id"))
    login = CH.audit_actions("login", with_tid.withColumn("role", F.lit("tamu")).withColumn("actor_id", F.col("id_user")),
                             when=as_of)
    tables = t.with_(users=t.users.unionByName(new_users), tamu=t.tamu.unionByName(new_guests))
    return Applied(with_tid.select("req_seq", "id_user", "id_tamu", "username", "email"),
                   rejected.drop("_u", "_e"), login, tables, {"users": new_users, "tamu": new_guests})


# ---------------------------------------------------------------------------
# B12-B14 rooms
# ---------------------------------------------------------------------------
def apply_room_inserts(t: Tables, requests: DataFrame, actor_id: int = 1, as_of=None) -> Applied:
    """B12. requests: req_seq, nomor_kamar, tipe_id, [status_id] (default 1)."""
    r = requests if "status_id" in requests.columns else requests.withColumn("status_id", F.lit(None).cast("bigint"))
    r = Q.required(r, ["nomor_kamar", "tipe_id"])
    r = r.withColumn("status_id", F.coalesce("status_id", F.lit(C.ROOM_FREE).cast("bigint")))
    r = Q.flag_missing_parent(r, "tipe_id", t.tipe_kamar, "id_tipe", MSG_FK.format("tipe_kamar"))
    r = Q.flag_missing_parent(r, "status_id", t.status_kamar, "id_status", MSG_FK.format("status_kamar"), lookup=True)
    r = _flag_existing(r, E.text_key("nomor_kamar"), t.kamar, E.text_key("nomor_kamar"), MSG_DUPLICATE)
    r = _first_wins(r, [E.text_key("nomor_kamar")], MSG_DUPLICATE)
    ok, rejected = Q.split(r)
    rows = _assign_ids(ok, {"id_kamar": t.kamar})
    new_rooms = rows.select("id_kamar", "nomor_kamar", "tipe_id", "status_id")
    api = CH.audit_actions("room_add", rows, user_id=actor_id, when=as_of)
    return Applied(new_rooms, rejected, api, t.with_(kamar=t.kamar.unionByName(new_rooms)))


def _number_stream(batches):
    """Room numbers in request order, over a partition sorted by (component,
    req_seq): first the stored numbers (req_seq -1), then the patches. Only the
    numbers of the current component are held."""
    comp, owner, number = None, {}, {}
    for pdf in batches:
        seqs, won = [], []
        for c, seq, room, no in zip(pdf["comp"].tolist(), pdf["req_seq"].tolist(), pdf["room"].tolist(),
                                    pdf["no"].tolist()):
            if c != comp:
                comp, owner, number = c, {}, {}
            if seq == -1:
                number[room] = no
                if no is not None:
                    owner[no] = room
                continue
            # an unknown room changes nothing, so it breaks no constraint
            ok = room not in number or owner.get(no, room) == room
            if ok and room in number:
                owner.pop(number[room], None)
                owner[no], number[room] = room, no
            seqs.append(seq)
            won.append(ok)
        yield pd.DataFrame({"req_seq": pd.Series(seqs, dtype="int64"), "_won": pd.Series(won, dtype=bool)})


#: Components of more rows (patches and stored numbers) than this are first settled in rounds.
HOT_COMPONENT = 50_000


def _with_components(rows: DataFrame) -> DataFrame:
    """The rows (req_seq, room, no) with comp, their component of the graph of rooms
    and numbers."""
    node = F.xxhash64(F.lit("room"), "room")
    graph = rows.where(F.col("no").isNotNull()).select(node.alias("a"), F.xxhash64(F.lit("no"), "no").alias("b"))
    comps = components(graph).withColumnRenamed("root", "comp")
    return rows.withColumn("node", node).join(comps, "node", "left").select(
        "req_seq", "room", "no", F.coalesce("comp", "node").alias("comp"))


def _settle(rows: DataFrame, path: str) -> DataFrame:
    """Decide patches of hot components in rounds, spread over all tasks. A patch is
    decided when no pending one before it is of its room, of its number, or of the room
    that holds its number; the numbers held then decide it, and all patches of a round
    are independent. Decisions are added to the table at ``path``; what is left when
    rounds decide little is returned, with the numbers held then."""
    state = cut(rows.where("req_seq = -1").select("room", "no"), "state")
    asks = rows.where("req_seq >= 0").select("req_seq", "room", "no")
    known = state.select("room").distinct()
    # an unknown room changes nothing, so it breaks no constraint
    asks.join(known, "room", "left_anti").select("req_seq", F.lit(True).alias("_won")).write.mode("append").parquet(path)
    pending = cut(asks.join(known, "room", "left_semi"), "pending")
    n = pending.count()
    while n:
        of_room = pending.groupBy("room").agg(F.min("req_seq").alias("_r"))
        of_no = pending.groupBy("no").agg(F.min("req_seq").alias("_n"))
        holder = state.where("no IS NOT NULL").groupBy("no").agg(F.min("room").alias("_held"))
        before_held = of_room.select(F.col("room").alias("_held"), F.col("_r").alias("_h"))
        free = F.col("_held").isNull() | (F.col("_held") == F.col("room"))
        ready = ((F.col("_r") == F.col("req_seq")) & (F.col("_n") == F.col("req_seq"))
                 & (free | F.col("_h").isNull() | (F.col("_h") > F.col("req_seq"))))
        marked = cut(pending.join(of_room, "room").join(of_no, "no").join(holder, "no", "left").join(before_held, "_held", "left")
                     .select("req_seq", "room", "no", free.alias("_won"), ready.alias("_ready")), "pending")
        marked.where("_ready").select("req_seq", "_won").write.mode("append").parquet(path)
        taken = marked.where("_ready AND _won").select("room", F.col("no").alias("_new"))
        old, state = state, cut(state.join(taken, "room", "left").select("room", F.coalesce("_new", "no").alias("no")), "state")
        drop(old)
        pending = marked.where("NOT _ready").select("req_seq", "room", "no")
        before, n = n, pending.count()
        if before - n < LEAST_SHARE * before:
            break
    return state.select(F.lit(-1).cast("bigint").alias("req_seq"), "room", "no").unionByName(pending)


def arbitrate_numbers(kamar: DataFrame, patches: DataFrame, hot_component: int = HOT_COMPONENT) -> DataFrame:
    """(req_seq, _won): may a patch set its room number, given the numbers that
    the patches before it took and freed?

    Patches matter to each other only through a room or a number they share,
    so they are split into connected components of the room-number graph;
    each is streamed in request order, different ones in parallel. Components of more
    than ``hot_component`` rows are settled in rounds before, which leaves small ones
    unless their patches all wait for each other; the outcome is the same."""
    spark = kamar.sparkSession
    asks = patches.select("req_seq", F.col("id_kamar").alias("room"), F.col("nomor_kamar").alias("no"))
    touched = asks.select("room").distinct()
    wanted = asks.select(E.text_key("no").alias("_w")).distinct()
    book = kamar.select(F.col("id_kamar").alias("room"), F.col("nomor_kamar").alias("no"))
    held = cut(book.join(touched, "room", "left_semi").union(
        book.join(wanted, E.text_key("no") == F.col("_w"), "left_semi")).distinct(), "numbers")
    rows = held.select(F.lit(-1).cast("bigint").alias("req_seq"), "room", "no").unionByName(asks)
    # numbers that are equal without case and accents get one spelling
    spelt = rows.where(F.col("no").isNotNull()).groupBy(E.text_key("no").alias("_k")).agg(F.min("no").alias("_no"))
    rows = cut(rows.join(spelt, E.text_key("no") == F.col("_k"), "left").select("req_seq", "room", F.col("_no").alias("no")),
               "numbers")
    tagged, done = cut(_with_components(rows), "numbers"), None
    sizes = tagged.groupBy("comp").agg(F.count(F.lit(1)).alias("_size"))
    hot = cut(sizes.where(F.col("_size") > hot_component).select("comp"), "hot")
    if not hot.isEmpty():
        path = f"{checkpoint_dir(spark).rstrip('/')}/tables/decided-{uuid.uuid4().hex}"
        left = _settle(tagged.join(hot, "comp", "left_semi"), path)
        done = spark.read.parquet(path)
        tagged = tagged.join(hot, "comp", "left_anti").unionByName(_with_components(left))
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    out = (tagged.select("comp", "req_seq", "room", "no").repartition(n, "comp")
           .sortWithinPartitions("comp", "req_seq").mapInPandas(_number_stream, "req_seq long, _won boolean"))
    return out if done is None else out.unionByName(done)


def apply_room_updates(t: Tables, patches: DataFrame, actor_id: int = 1, as_of=None) -> Applied:
    """B13. patches: req_seq, id_kamar, [nomor_kamar], [tipe_id], [status_id];
    only supplied (non-NULL) fields change, later patches win per field. A
    number is judged in request order (a room may keep its own, and a number
    freed by an earlier patch is free); a refused patch changes no field. A
    patch of an unknown room changes nothing but is still logged."""
    fields_ = [c for c in ("nomor_kamar", "tipe_id", "status_id") if c in patches.columns]
    r = Q.with_reasons(patches, [(F.col("id_kamar").isNull() | (F.col("id_kamar") == 0), MSG_ID_REQUIRED)])
    none_set = F.lit(True)
    for c in fields_:
        none_set = none_set & F.col(c).isNull()
    r = Q.with_reasons(r, [(none_set, MSG_NOTHING_TO_UPDATE)])
    if "tipe_id" in fields_:
        r = Q.flag_missing_parent(r, "tipe_id", t.tipe_kamar, "id_tipe", MSG_FK.format("tipe_kamar"))
    if "status_id" in fields_:
        r = Q.flag_missing_parent(r, "status_id", t.status_kamar, "id_status", MSG_FK.format("status_kamar"), lookup=True)
    if "nomor_kamar" in fields_:
        r = cut(r, "patches")
        won = arbitrate_numbers(t.kamar, r.where((F.size("reasons") == 0) & F.col("nomor_kamar").isNotNull()))
        r = Q.with_reasons(r.join(won, "req_seq", "left"), [(F.col("_won") == F.lit(False), MSG_DUPLICATE)]).drop("_won")
    ok, rejected = Q.split(r)
    latest = ok.groupBy(F.col("id_kamar").alias("_pk")).agg(*[
        F.max_by(F.col(c), F.when(F.col(c).isNotNull(), F.col("req_seq"))).alias(f"_p_{c}") for c in fields_])
    kamar = t.kamar.join(latest, F.col("id_kamar") == F.col("_pk"), "left")
    for c in fields_:
        kamar = kamar.withColumn(c, F.coalesce(F.col(f"_p_{c}"), F.col(c)))
    kamar = kamar.select(*t.kamar.columns)
    api = CH.audit_actions("room_edit", ok, user_id=actor_id, when=as_of)
    return Applied(ok, rejected, api, t.with_(kamar=kamar))


def apply_room_deletes(t: Tables, keys: DataFrame, actor_id: int = 1, as_of=None) -> Applied:
    """B14. keys: req_seq, id_kamar. The room's facilities and reviews go and its
    stays lose their room, as the references say. A room that is unknown, or
    deleted by an earlier request, changes nothing but is still logged."""
    r = Q.with_reasons(keys, [(F.col("id_kamar").isNull() | (F.col("id_kamar") == 0), MSG_ID_REQUIRED)])
    ok, rejected = Q.split(r)
    done = LD.delete_rows(t, "kamar", ok, "id_kamar")
    api = CH.audit_actions("room_delete", ok, user_id=actor_id, when=as_of)
    return Applied(ok, rejected, api, done.tables, {"gone": done.gone})
