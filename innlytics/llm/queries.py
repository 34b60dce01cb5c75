"""Registered queries of the training-data operators and their DuckDB oracles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from innlytics import session
from innlytics.llm import (classifier, conversation_trie, exact_dedup, mixing, ngram_join, packing, pieces, quality_rules,
                           sharding, suffix_dedup, url_filter, variants, warc)
from innlytics.llm.common import read


def _file(name: str) -> str:
    import public_tokenizers
    return public_tokenizers.path(name)


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(read(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "p_good")


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(read(spark, sf_dir, "documents"))


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classifier.classify(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op4_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.near_duplicates(read(spark, sf_dir, "documents"))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read(spark, sf_dir, "documents"), _file("word_bpe_49k.json")).drop("ids")


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.repeats(read(spark, sf_dir, "documents")).drop("spans")


def op7_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge_urls(read(spark, sf_dir, "pages"))


def op8_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.round_trip(read(spark, sf_dir, "documents"), _file("piece_bpe_32k.model"))


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_pages(read(spark, sf_dir, "pages"))


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(read(spark, sf_dir, "documents"))


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants.group_variants(read(spark, sf_dir, "documents"))


def op12_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_trie.conversation_trie(read(spark, sf_dir, "conversations"))


def op13_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_documents(read(spark, sf_dir, "documents")).drop("source")


def _tuned(fn: Callable) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        session.tune(spark)
        return fn(spark, sf_dir)
    run.__name__ = fn.__name__
    return run


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: _tuned(f) for f in (
        op1_quality_rules, op2_exact_dedup, op3_quality_classifier, op4_ngram_jaccard_join, op5_packing, op6_suffix_dedup,
        op7_url_filters, op8_sentencepiece,
        op9_warc, op10_sharding, op11_spelling_variants, op12_conversation_trie, op13_source_mix)}

# CRC-32 (reversed polynomial, as in zlib) of a list of bytes, one bit at a time.
_CRC32 = """xor(list_reduce({0}, lambda crc, byte: list_reduce([0, 1, 2, 3, 4, 5, 6, 7], lambda c, bit:
    CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, xor(crc, byte)), 4294967295), 4294967295)"""

ORACLES: dict[str, str] = {
    "op2_exact_dedup": """
        WITH d AS (SELECT doc_id, sha256(coalesce(text, '')) AS h FROM documents),
             g AS (SELECT h, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY h)
        SELECT d.doc_id, g.keep_id, g.group_size, d.doc_id = g.keep_id AS kept, d.h AS text_sha256
        FROM d JOIN g USING (h)""",
    "op4_ngram_jaccard_join": r"""
        WITH RECURSIVE
         d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                 '[^\x20\x09-\x0D]+') AS w FROM documents),
         s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS g
               FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
         n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
         both_ AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
         links AS (SELECT a, b FROM both_ JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
         edges AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
         reach AS (SELECT doc_id AS a, doc_id AS r FROM documents UNION SELECT edges.b, reach.r FROM reach JOIN edges ON edges.a = reach.a WHERE reach.r < edges.b)
        SELECT doc_id, coalesce(n.n, 0) AS n_shingles, c.r AS component_id
        FROM documents LEFT JOIN n USING (doc_id) JOIN (SELECT a AS doc_id, min(r) AS r FROM reach GROUP BY a) c USING (doc_id)""",
    "op6_suffix_dedup": r"""
        WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x, strlen(coalesce(text, '')) AS n FROM documents),
         s AS (SELECT doc_id, i, md5(substr(x, 2 * i + 1, 800)) AS h FROM (SELECT doc_id, x, unnest(range(0, n - 399)) AS i FROM d WHERE n >= 400)),
         again AS (SELECT h FROM s GROUP BY h HAVING count(*) > 1),
         hit AS (SELECT doc_id, i, lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS prv, max(i) OVER (PARTITION BY doc_id) AS top
                 FROM s WHERE h IN (SELECT h FROM again)),
         run AS (SELECT doc_id, i AS lo, coalesce(lead(prv_end) OVER (PARTITION BY doc_id ORDER BY i), last_end) AS hi FROM (
                   SELECT doc_id, i, prv + 400 AS prv_end, top + 400 AS last_end FROM hit
                   WHERE prv IS NULL OR i > prv + 400)),
         keep AS (SELECT doc_id, from_, upto FROM (
                    SELECT doc_id, coalesce(lag(hi) OVER (PARTITION BY doc_id ORDER BY lo), 0) AS from_, lo AS upto FROM run
                    UNION ALL SELECT doc_id, max(hi), NULL FROM run GROUP BY doc_id)),
         kept AS (SELECT doc_id, string_agg(substr(x, 2 * from_ + 1, 2 * (coalesce(upto, n) - from_)), '' ORDER BY from_) AS k
                  FROM keep JOIN d USING (doc_id) GROUP BY doc_id),
         tot AS (SELECT doc_id, CAST(sum(hi - lo) AS BIGINT) AS n_removed, count(*) AS n_spans FROM run GROUP BY doc_id)
        SELECT d.doc_id, d.n AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(k, x))) AS kept_sha256
        FROM d LEFT JOIN tot USING (doc_id) LEFT JOIN kept USING (doc_id)""",
    "op9_warc": """
        WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS n, sha1(coalesce(html, '')) AS h FROM pages),
             g AS (SELECT h, max(page_id) AS first_id FROM p WHERE n >= 1000 GROUP BY h)
        SELECT p.page_id, p.n AS payload_bytes, p.h AS payload_digest,
               CASE WHEN p.n >= 1000 AND p.page_id <> g.first_id THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN p.n >= 1000 AND p.page_id <> g.first_id THEN g.first_id END AS refers_to
        FROM p LEFT JOIN g USING (h)""",
    "op13_source_mix": r"""
        WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
                          md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || md5(coalesce(text, ''))) AS key,
                          row_number() OVER () AS rid FROM documents),
             s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
                          row_number() OVER (ORDER BY source NULLS LAST) AS place FROM d GROUP BY source),
             w AS (SELECT *, [5, 2, 1][(place - 1) % 3 + 1] AS weight, 3 * source_size AS most FROM s),
             l AS (SELECT max(CAST(budget - held AS DOUBLE) / units) AS level FROM (
                       SELECT sum(source_size) OVER () AS budget,
                              coalesce(sum(most) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS held,
                              sum(weight) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS units
                       FROM w WINDOW o AS (ORDER BY CAST(most AS DOUBLE) / weight, place))),
             q AS (SELECT rid, doc_id, size, key, source_size, least(weight * level, CAST(most AS DOUBLE)) AS target,
                          CAST(coalesce(sum(size) OVER (PARTITION BY place ORDER BY key, rid
                               ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS sent
                   FROM d JOIN w ON d.source IS NOT DISTINCT FROM w.source, l),
             c AS (SELECT rid, key, round, (round * source_size + sent + size) / target AS finish,
                          least(size, CAST(floor(target) AS BIGINT) - (round * source_size + sent)) AS words
                   FROM q, (VALUES (0), (1), (2)) AS r(round) WHERE size > 0),
             p AS (SELECT rid, words, CAST(coalesce(sum(words) OVER (ORDER BY finish, key, rid, round
                               ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS position
                   FROM c WHERE words > 0),
             g AS (SELECT rid, CAST(sum(words) AS BIGINT) AS taken, min(position) AS first_position FROM p GROUP BY rid)
        SELECT doc_id, size, source_size, target, coalesce(taken, 0) AS taken, first_position
        FROM q LEFT JOIN g USING (rid)""",
    "op12_conversation_trie": r"""
        WITH t AS (SELECT conv_id, dense_rank() OVER (ORDER BY coalesce(role, ''), coalesce(text, '')) AS code,
                          len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS words,
                          row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, sha256(
                              strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) AS pos
                   FROM conversations WHERE conv_id IS NOT NULL),
             own AS (SELECT conv_id, list(code ORDER BY pos) AS codes, """ + _CRC32.format(
                 "[CAST(ascii(x) AS BIGINT) FOR x IN string_split(CAST(conv_id AS VARCHAR), '')]") + r""" % 4 AS h
                     FROM t GROUP BY conv_id),
             seqs AS (SELECT o.conv_id, list_concat(coalesce(b.codes, [])[1:o.h], o.codes[o.h + 1:]) AS s
                      FROM own o LEFT JOIN own b ON b.conv_id = o.conv_id - o.conv_id % 20),
             m AS (SELECT conv_id, s, unnest(range(0, len(s) + 1)) AS d FROM seqs),
             nodes AS (SELECT s[1:d] AS p, d, min(conv_id) AS conv_id, count(*) AS n_convs,
                              sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id)
                                              FILTER (len(s) = d), '')) AS ends_sha256
                       FROM m GROUP BY ALL),
             kids AS (SELECT p[1:d - 1] AS p, count(*) AS n FROM nodes WHERE d > 0 GROUP BY ALL),
             w AS (SELECT DISTINCT code, words FROM t),
             full_ AS (SELECT nodes.*, coalesce(kids.n, 0) AS n_children, (n_convs - 1) * coalesce(words, 0) AS own
                       FROM nodes LEFT JOIN kids ON kids.p = nodes.p LEFT JOIN w ON code = nodes.p[d]),
             above AS (SELECT p, n_children, own, unnest(range(0, d + 1)) AS k FROM full_),
             sub AS (SELECT p[1:k] AS p, count(*) FILTER (n_children = 0) AS n_leaves, CAST(sum(own) AS BIGINT) AS saved_tokens
                     FROM above GROUP BY ALL)
        SELECT f.conv_id, f.d AS depth, u.conv_id AS parent_conv_id, f.n_convs, f.n_children, n_leaves, saved_tokens,
               f.ends_sha256
        FROM full_ f JOIN sub ON sub.p = f.p LEFT JOIN nodes u ON f.d > 0 AND u.d = f.d - 1 AND u.p = f.p[1:f.d - 1]""",
    "op11_spelling_variants": r"""
        WITH RECURSIVE
             run AS (SELECT d, translate(r, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS w, count(*) AS n FROM (
                         SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS d, unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')) AS r
                         FROM documents) GROUP BY ALL),
             hit AS (SELECT w, n, """ + _CRC32.format(
                 "flatten([CASE WHEN unicode(x) < 128 THEN [CAST(unicode(x) AS BIGINT)] "
                 "ELSE [192 + (unicode(x) >> 6), 128 + (unicode(x) & 63)] END FOR x IN string_split(d || ':' || w, '')])")
    + r""" AS h FROM run),
             voc AS (SELECT w, CAST(sum(n) AS BIGINT) AS n FROM (
                         SELECT CASE WHEN h % 199 = 0 THEN w[:h % length(w)] || w[h % length(w) + 2:] ELSE w END AS w, n FROM hit)
                     WHERE length(w) >= 6 GROUP BY w HAVING sum(n) >= 5),
             gap AS (SELECT w, n, p, w[:p - 1] || w[p + 1:] AS g FROM (SELECT w, n, unnest(range(1, length(w) + 1)) AS p FROM voc)),
             near AS (SELECT DISTINCT a.w, a.n, b.w AS o, b.n AS m FROM gap a JOIN gap b ON a.p = b.p AND a.g = b.g AND a.w <> b.w
                      UNION SELECT v.w, v.n, g.w, g.n FROM voc v JOIN gap g ON g.g = v.w
                      UNION SELECT g.w, g.n, v.w, v.n FROM voc v JOIN gap g ON g.g = v.w),
             best AS (SELECT w, count(*) AS n_near, first(o ORDER BY m DESC, o) AS o, max(m) AS m FROM near GROUP BY w),
             formed AS (SELECT voc.w, voc.n, coalesce(n_near, 0) AS n_near, CASE WHEN m >= 5 * n THEN o END AS form,
                               CASE WHEN m >= 5 * n THEN m END AS form_n FROM voc LEFT JOIN best USING (w)),
             chain AS (SELECT w, w AS at FROM formed
                       UNION ALL SELECT chain.w, formed.form FROM chain JOIN formed ON formed.w = chain.at WHERE form IS NOT NULL)
        SELECT f.w AS word, f.form, c.at AS root, f.n, f.n_near, f.form_n FROM formed f JOIN chain c ON c.w = f.w
        JOIN formed e ON e.w = c.at WHERE e.form IS NULL""",
}
