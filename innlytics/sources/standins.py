"""Map the driver's TPC-H-style parquet tables onto the hotel domain.

Everything here is a lazy DataFrame definition over the whole input tables;
nothing is collected. Columns are pruned and filters pushed to the parquet
scans by Catalyst, because the mappings are plain projections.

Stand-in rules (fixed; the DuckDB oracle in ``__spark_entry__`` mirrors them):

* tamu  <- customer: id=c_custkey, nama=c_name, email='tamu<id>@example.com',
  telepon='08'+10-digit id, alamat='Nation <c_nationkey>', user_id=c_custkey
* users <- customer: id=c_custkey, username='tamu<id>', same email, role 3
* reservasi <- orders: id=o_orderkey, tamu=o_custkey, pesan=o_orderdate,
  status 4 if priority '5-LOW' else O->1, P->2, F->3; promo=nullif(key%4,0)
* detail_reservasi <- lineitem: reservasi=l_orderkey, kamar=l_partkey,
  checkin=date(l_shipdate), checkout=checkin+1+(int(l_quantity)%5),
  harga=l_extendedprice as decimal(10,2); id = l_orderkey*1000 + line rank
* kamar <- part: id=p_partkey, nomor=str(p_partkey), tipe=rank of p_type,
  status p_size%10: 0 -> 3, 1..3 -> 2, else 1
* tipe_kamar <- part grouped by p_type: price=max(p_retailprice),
  kapasitas=1+len(p_type)%4
* pembayaran <- orders with key%5<>0: method key%3+1, total=o_totalprice
* invoice <- those payments with key%7<>0, number INV-yyyyMM(o_orderdate)-id
* checkin <- reservations in status 2/3, plus status 1 with key%11=0;
  checkout <- status 3; pegawai = key%6+1, time = o_orderdate
* ulasan <- events 'purchase': id=event_id, tamu=user_id,
  kamar=event_id%200+1, rating=1+k%5 (props {"k": n}), tanggal=date(ts)
* fasilitas <- supplier; kamar_fasilitas <- distinct (l_partkey, l_suppkey)
* status feed <- events except 'view': reservasi=user_id, order (ts,
  event_id), signup->1, click->2, purchase->3, error->4
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from innlytics.functions import scalar
from innlytics.sources import catalog
from innlytics.sources.tables import Tables

# Read schemas of the driver tables (only the columns the mapping needs).
RAW_SCHEMAS = {
    "customer": "c_custkey BIGINT, c_name STRING, c_nationkey INT",
    "orders": ("o_orderkey BIGINT, o_custkey BIGINT, o_orderstatus STRING, o_totalprice DOUBLE, "
               "o_orderdate TIMESTAMP_NTZ, o_orderpriority STRING"),
    "lineitem": ("l_orderkey BIGINT, l_partkey BIGINT, l_suppkey BIGINT, l_linenumber INT, "
                 "l_quantity DOUBLE, l_extendedprice DOUBLE, l_shipdate TIMESTAMP_NTZ"),
    "part": "p_partkey BIGINT, p_name STRING, p_type STRING, p_size INT, p_retailprice DOUBLE",
    "supplier": "s_suppkey BIGINT, s_name STRING",
    "events": "event_id BIGINT, ts TIMESTAMP_NTZ, user_id BIGINT, event_type STRING, props STRING",
}


def read_raw(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.schema(RAW_SCHEMAS[name]).parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _reservation_status(orders: DataFrame) -> F.Column:
    return (F.when(F.col("o_orderpriority") == "5-LOW", F.lit(4))
            .when(F.col("o_orderstatus") == "O", F.lit(1))
            .when(F.col("o_orderstatus") == "P", F.lit(2))
            .when(F.col("o_orderstatus") == "F", F.lit(3))
            .cast("bigint"))


def guests(customer: DataFrame) -> DataFrame:
    return customer.select(
        F.col("c_custkey").alias("id_tamu"),
        F.col("c_name").alias("nama"),
        F.concat(F.lit("tamu"), F.col("c_custkey").cast("string"), F.lit("@example.com")).alias("email"),
        F.concat(F.lit("08"), F.lpad(F.col("c_custkey").cast("string"), 10, "0")).alias("telepon"),
        F.concat(F.lit("Nation "), F.col("c_nationkey").cast("string")).alias("alamat"),
        F.col("c_custkey").alias("user_id"),
    )


def users(customer: DataFrame) -> DataFrame:
    return customer.select(
        F.col("c_custkey").alias("id_user"),
        F.concat(F.lit("tamu"), F.col("c_custkey").cast("string")).alias("username"),
        F.concat(F.lit("tamu"), F.col("c_custkey").cast("string"), F.lit("@example.com")).alias("email"),
        F.lit(3).cast("bigint").alias("role_id"),
    )


def reservations(orders: DataFrame) -> DataFrame:
    key = F.col("o_orderkey")
    return orders.select(
        key.alias("id_reservasi"),
        F.col("o_custkey").alias("tamu_id"),
        F.col("o_orderdate").alias("tanggal_pesan"),
        _reservation_status(orders).alias("status_reservasi_id"),
        F.when(key % 4 != 0, key % 4).alias("promo_id"),
    )


def stays(lineitem: DataFrame) -> DataFrame:
    """Stay lines. ``id_detail`` needs a rank inside the reservation because
    (l_orderkey, l_linenumber) repeats; the window is partitioned by the
    reservation key (the same key the reservation join shuffles on) and is
    pruned by Catalyst from every query that does not read ``id_detail``."""
    checkin = F.col("l_shipdate").cast("date")
    line_rank = F.row_number().over(
        Window.partitionBy("l_orderkey").orderBy(
            "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_quantity", "l_extendedprice"))
    return lineitem.select(
        (F.col("l_orderkey") * 1000 + line_rank).alias("id_detail"),
        F.col("l_orderkey").alias("reservasi_id"),
        F.col("l_partkey").alias("kamar_id"),
        checkin.alias("tanggal_checkin"),
        F.date_add(checkin, (F.col("l_quantity").cast("int") % 5 + 1).cast("int")).alias("tanggal_checkout"),
        F.col("l_extendedprice").cast(catalog.MONEY).alias("harga"),
    )


def room_types(part: DataFrame) -> DataFrame:
    """One row per distinct p_type. The id is a dense rank over the distinct
    type names: a window without partition, but over the *type* dimension
    (a handful of rows), never over the fact data."""
    agg = part.groupBy("p_type").agg(F.max("p_retailprice").alias("max_price"))
    return agg.select(
        F.dense_rank().over(Window.orderBy("p_type")).cast("bigint").alias("id_tipe"),
        F.col("p_type").alias("nama_tipe"),
        F.col("max_price").cast(catalog.MONEY).alias("harga"),
        (F.length("p_type") % 4 + 1).cast("int").alias("kapasitas"),
    )


def rooms(part: DataFrame, types: DataFrame) -> DataFrame:
    size_mod = F.col("p_size") % 10
    status = (F.when(size_mod == 0, F.lit(3)).when(size_mod.isin(1, 2, 3), F.lit(2))
              .otherwise(F.lit(1)).cast("bigint"))
    return (part.join(types.select("id_tipe", F.col("nama_tipe").alias("p_type")), "p_type", "left")
            .select(F.col("p_partkey").alias("id_kamar"),
                    F.col("p_partkey").cast("string").alias("nomor_kamar"),
                    F.col("id_tipe").alias("tipe_id"),
                    status.alias("status_id")))


def payments(orders: DataFrame) -> DataFrame:
    key = F.col("o_orderkey")
    return orders.where(key % 5 != 0).select(
        key.alias("id_pembayaran"), key.alias("reservasi_id"),
        (key % 3 + 1).alias("metode_id"),
        F.col("o_totalprice").cast(catalog.MONEY).alias("total"),
        F.col("o_orderdate").alias("tanggal_bayar"),
    )


def invoices(orders: DataFrame) -> DataFrame:
    key = F.col("o_orderkey")
    return orders.where((key % 5 != 0) & (key % 7 != 0)).select(
        key.alias("id_invoice"), key.alias("reservasi_id"),
        scalar.invoice_number(key, F.col("o_orderdate")).alias("nomor_invoice"),
        F.col("o_orderdate").alias("tanggal_terbit"),
    )


def checkins(orders: DataFrame) -> DataFrame:
    key, st = F.col("o_orderkey"), _reservation_status(orders)
    return orders.where(st.isin(2, 3) | ((st == 1) & (key % 11 == 0))).select(
        key.alias("id_checkin"), key.alias("reservasi_id"), (key % 6 + 1).alias("pegawai_id"),
        F.col("o_orderdate").alias("waktu_checkin"))


def checkouts(orders: DataFrame) -> DataFrame:
    key, st = F.col("o_orderkey"), _reservation_status(orders)
    return orders.where(st == 3).select(
        key.alias("id_checkout"), key.alias("reservasi_id"), (key % 6 + 1).alias("pegawai_id"),
        F.col("o_orderdate").alias("waktu_checkout"))


def reviews(events: DataFrame) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("bigint")
    return events.where(F.col("event_type") == "purchase").select(
        F.col("event_id").alias("id_ulasan"), F.col("user_id").alias("tamu_id"),
        (F.col("event_id") % 200 + 1).alias("kamar_id"),
        (k % 5 + 1).cast("int").alias("rating"),
        F.concat(F.lit("ulasan #"), F.col("event_id").cast("string")).alias("komentar"),
        F.col("ts").cast("date").alias("tanggal"),
    )


def status_feed(events: DataFrame) -> DataFrame:
    """Reservation status change feed (input of the trigger operators)."""
    code = (F.when(F.col("event_type") == "signup", F.lit(1)).when(F.col("event_type") == "click", F.lit(2))
            .when(F.col("event_type") == "purchase", F.lit(3)).when(F.col("event_type") == "error", F.lit(4)))
    return events.where(F.col("event_type") != "view").select(
        F.col("user_id").alias("reservasi_id"), F.col("ts"), F.col("event_id").alias("seq"),
        code.cast("bigint").alias("status_reservasi_id"))


def load(spark: SparkSession, sf_dir: str) -> Tables:
    """All domain tables over the stand-ins in ``sf_dir`` (lazy)."""
    raw = {n: read_raw(spark, sf_dir, n) for n in RAW_SCHEMAS}
    types = room_types(raw["part"])
    frames = {
        "tamu": guests(raw["customer"]),
        "users": users(raw["customer"]),
        "reservasi": reservations(raw["orders"]),
        "detail_reservasi": stays(raw["lineitem"]),
        "tipe_kamar": types,
        "kamar": rooms(raw["part"], types),
        "pembayaran": payments(raw["orders"]),
        "invoice": invoices(raw["orders"]),
        "checkin": checkins(raw["orders"]),
        "checkout": checkouts(raw["orders"]),
        "ulasan": reviews(raw["events"]),
        "fasilitas": raw["supplier"].select(F.col("s_suppkey").alias("id_fasilitas"),
                                            F.col("s_name").alias("nama_fasilitas")),
        "kamar_fasilitas": raw["lineitem"].select(F.col("l_partkey").alias("kamar_id"),
                                                  F.col("l_suppkey").alias("fasilitas_id")).distinct(),
    }
    return Tables.from_frames(spark, frames)


def load_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return status_feed(read_raw(spark, sf_dir, "events"))

