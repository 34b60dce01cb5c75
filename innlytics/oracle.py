"""DuckDB oracle SQL for the registered queries.

``PRELUDE`` restates the stand-in mapping of ``sources.standins`` as CTEs over
the driver's raw views, so each oracle is ``PRELUDE + <plain SQL>`` in the
domain's own vocabulary. Output normalisation (shared with the Spark side in
``__spark_entry__``): money/decimal -> DOUBLE, DATE/TIMESTAMP -> VARCHAR,
string arrays -> '|'-joined VARCHAR, integer sums -> BIGINT.

Two rounding helpers avoid DuckDB's DOUBLE decimal division:
ROUND(a*100/b, 2) HALF_UP == ((a*20000 + b) // (2*b)) / 100 for a, b >= 0.
"""

PRELUDE = """
WITH
tamu AS (
  SELECT c_custkey AS id_tamu, c_name AS nama,
         'tamu' || CAST(c_custkey AS VARCHAR) || '@example.com' AS email,
         '08' || lpad(CAST(c_custkey AS VARCHAR), 10, '0') AS telepon,
         'Nation ' || CAST(c_nationkey AS VARCHAR) AS alamat,
         c_custkey AS user_id
  FROM customer),
users AS (
  SELECT c_custkey AS id_user, 'tamu' || CAST(c_custkey AS VARCHAR) AS username,
         'tamu' || CAST(c_custkey AS VARCHAR) || '@example.com' AS email, CAST(3 AS BIGINT) AS role_id
  FROM customer),
reservasi AS (
  SELECT o_orderkey AS id_reservasi, o_custkey AS tamu_id, o_orderdate AS tanggal_pesan,
         CAST(CASE WHEN o_orderpriority = '5-LOW' THEN 4 WHEN o_orderstatus = 'O' THEN 1
                   WHEN o_orderstatus = 'P' THEN 2 WHEN o_orderstatus = 'F' THEN 3 END AS BIGINT)
           AS status_reservasi_id,
         CASE WHEN o_orderkey % 4 <> 0 THEN o_orderkey % 4 END AS promo_id,
         o_totalprice, o_orderpriority
  FROM orders),
detail_reservasi AS (
  SELECT l_orderkey AS reservasi_id, l_partkey AS kamar_id,
         CAST(l_shipdate AS DATE) AS tanggal_checkin,
         CAST(l_shipdate AS DATE) + CAST(CAST(TRUNC(l_quantity) AS BIGINT) % 5 + 1 AS INTEGER)
           AS tanggal_checkout,
         CAST(l_extendedprice AS DECIMAL(10,2)) AS harga,
         l_linenumber, l_suppkey
  FROM lineitem),
tipe_kamar AS (
  SELECT CAST(dense_rank() OVER (ORDER BY p_type) AS BIGINT) AS id_tipe, p_type AS nama_tipe,
         CAST(max(p_retailprice) AS DECIMAL(10,2)) AS harga,
         CAST(length(p_type) % 4 + 1 AS INTEGER) AS kapasitas
  FROM part GROUP BY p_type),
kamar AS (
  SELECT p_partkey AS id_kamar, CAST(p_partkey AS VARCHAR) AS nomor_kamar, tk.id_tipe AS tipe_id,
         CAST(CASE WHEN p_size % 10 = 0 THEN 3 WHEN p_size % 10 IN (1, 2, 3) THEN 2 ELSE 1 END AS BIGINT)
           AS status_id
  FROM part LEFT JOIN tipe_kamar tk ON part.p_type = tk.nama_tipe),
pembayaran AS (
  SELECT o_orderkey AS id_pembayaran, o_orderkey AS reservasi_id, o_orderkey % 3 + 1 AS metode_id,
         CAST(o_totalprice AS DECIMAL(10,2)) AS total, o_orderdate AS tanggal_bayar
  FROM orders WHERE o_orderkey % 5 <> 0),
invoice AS (
  SELECT o_orderkey AS id_invoice, o_orderkey AS reservasi_id,
         'INV-' || strftime(o_orderdate, '%Y%m') || '-' ||
           lpad(CAST(o_orderkey AS VARCHAR),
                CAST(greatest(3, length(CAST(o_orderkey AS VARCHAR))) AS INTEGER), '0')
           AS nomor_invoice,
         o_orderdate AS tanggal_terbit
  FROM orders WHERE o_orderkey % 5 <> 0 AND o_orderkey % 7 <> 0),
checkin AS (
  SELECT id_reservasi AS id_checkin, id_reservasi AS reservasi_id, id_reservasi % 6 + 1 AS pegawai_id,
         tanggal_pesan AS waktu_checkin
  FROM reservasi
  WHERE status_reservasi_id IN (2, 3) OR (status_reservasi_id = 1 AND id_reservasi % 11 = 0)),
checkout AS (
  SELECT id_reservasi AS id_checkout, id_reservasi AS reservasi_id, id_reservasi % 6 + 1 AS pegawai_id,
         tanggal_pesan AS waktu_checkout
  FROM reservasi WHERE status_reservasi_id = 3),
ulasan AS (
  SELECT event_id AS id_ulasan, user_id AS tamu_id, event_id % 200 + 1 AS kamar_id,
         CAST(CAST(json_extract_string(props, '$.k') AS BIGINT) % 5 + 1 AS INTEGER) AS rating,
         'ulasan #' || CAST(event_id AS VARCHAR) AS komentar, CAST(ts AS DATE) AS tanggal
  FROM events WHERE event_type = 'purchase'),
fasilitas AS (SELECT s_suppkey AS id_fasilitas, s_name AS nama_fasilitas FROM supplier),
kamar_fasilitas AS (SELECT DISTINCT l_partkey AS kamar_id, l_suppkey AS fasilitas_id FROM lineitem),
status_feed AS (
  SELECT user_id AS reservasi_id, ts, event_id AS seq,
         CAST(CASE event_type WHEN 'signup' THEN 1 WHEN 'click' THEN 2 WHEN 'purchase' THEN 3
                              WHEN 'error' THEN 4 END AS BIGINT) AS status_reservasi_id
  FROM events WHERE event_type <> 'view'),
status_reservasi AS (
  SELECT * FROM (VALUES (CAST(1 AS BIGINT), 'Baru'), (2, 'Check-in'), (3, 'Check-out'), (4, 'Dibatalkan'))
    AS v(id_status_reservasi, status)),
status_kamar AS (
  SELECT * FROM (VALUES (CAST(1 AS BIGINT), 'Tersedia'), (2, 'Terisi'), (3, 'Maintenance'))
    AS v(id_status, status)),
metode_pembayaran AS (
  SELECT * FROM (VALUES (CAST(1 AS BIGINT), 'Tunai'), (2, 'Transfer Bank'), (3, 'Kartu Kredit'))
    AS v(id_metode, nama_metode)),
promo AS (
  SELECT * FROM (VALUES
    (CAST(1 AS BIGINT), 'NEWYEAR', CAST(20.00 AS DECIMAL(5,2)), DATE '2025-12-20', DATE '2026-01-05'),
    (2, 'WEEKEND', CAST(15.00 AS DECIMAL(5,2)), DATE '2026-01-01', DATE '2026-12-31'),
    (3, 'LOYALTY', CAST(10.00 AS DECIMAL(5,2)), DATE '2026-01-01', DATE '2026-12-31'))
    AS v(id_promo, kode, diskon, tanggal_mulai, tanggal_selesai)),
pegawai AS (
  SELECT * FROM (VALUES (CAST(1 AS BIGINT), CAST(1 AS BIGINT), CAST(1 AS BIGINT)), (2, 2, 3), (3, 2, 4), (4, 2, 5),
                        (5, 3, NULL), (6, 4, 2)) AS v(id_pegawai, jabatan_id, user_id))
"""


def q(body: str) -> str:
    return PRELUDE + body
