"""Registered queries of lexical search, WARC archives and importance resampling, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from rankloom.llm.common import table
from rankloom.llm.importance_sampling import importance_resample
from rankloom.llm.lexical_search import lexical_search
from rankloom.llm.registry import query
from rankloom.llm.warc import archived_pages, page_records, write_warc
from rankloom.session import scratch_path

SEARCH_SQL = r"""
WITH dw AS (
    SELECT doc_id, regexp_extract_all(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w
    FROM documents
), bw AS (
    SELECT item_id, unnest(regexp_extract_all(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
    FROM benchmark
), q AS (
    SELECT item_id, term, count(*) AS q FROM bw GROUP BY item_id, term
), totals AS (
    SELECT count(*) FILTER (len(w) > 0) AS n_docs, CAST(sum(len(w)) AS BIGINT) AS n_terms FROM dw
), postings AS (
    SELECT doc_id, n, term, count(*) AS tf
    FROM (SELECT doc_id, len(w) AS n, unnest(w) AS term FROM dw) GROUP BY doc_id, n, term
), weights AS (
    SELECT term, CAST(floor(1000 * ln(CAST(2 * n_docs + 2 AS DOUBLE) / (2 * count(*) + 1))) AS BIGINT) AS weight
    FROM postings, totals WHERE term IN (SELECT term FROM q) GROUP BY term, n_docs
), scores AS (
    SELECT item_id, doc_id, CAST(sum(q * weight * ((1000000000 * tf) //
           (1000 * tf + 12 * (75 + (25 * n * n_docs) // n_terms)))) AS BIGINT) AS score
    FROM q JOIN weights USING (term) JOIN postings USING (term), totals GROUP BY item_id, doc_id
), ranked AS (
    SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS place FROM scores WHERE score > 0
)
SELECT item_id, CAST(place AS INTEGER) AS rank, doc_id, score FROM ranked WHERE place <= 20
"""


@query("op11_lexical_search", SEARCH_SQL)
def op11_lexical_search(spark: SparkSession, folder: str) -> DataFrame:
    return lexical_search(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


# base32: five bits a letter
WARC_SQL = r"""
WITH p AS (
    SELECT page_id, coalesce(html, '') AS html, CAST(unhex(sha1(coalesce(html, ''))) AS BIT)::VARCHAR AS bits FROM pages
), d AS (
    SELECT page_id, strlen(html) AS payload_bytes, min(page_id) OVER (PARTITION BY html) AS first_id,
           array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
               1 + CAST(list_reduce(list_transform(range(5), lambda j: CAST(substr(bits, CAST(5 * i + j + 1 AS INTEGER), 1) AS INTEGER)),
                                    lambda x, y: 2 * x + y) AS INTEGER), 1)), '') AS payload_digest
    FROM p
)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> first_id THEN first_id END AS refers_to
FROM d
"""


@query("op12_warc", WARC_SQL)
def op12_warc(spark: SparkSession, folder: str) -> DataFrame:
    path = scratch_path(spark, "warc")
    write_warc(page_records(table(spark, folder, "pages")), path)
    return archived_pages(spark, path)


# crc32 byte by byte over each distinct feature, with the table of its polynomial
RESAMPLING_SQL = r"""
WITH RECURSIVE steps AS (
    SELECT i AS b, i AS v, 0 AS k FROM range(256) t(i)
    UNION ALL
    SELECT b, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END, k + 1 FROM steps WHERE k < 8
), crc AS (
    SELECT list(v ORDER BY b) AS t FROM steps WHERE k = 8
), texts AS (
    SELECT 0 AS side, doc_id, text FROM documents UNION ALL SELECT 1, NULL, text FROM benchmark
), words AS (
    SELECT side, doc_id, regexp_extract_all(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
    FROM texts
), grams AS (
    SELECT side, doc_id, array_to_string(w[i:i + k - 1], ' ') AS g, count(*) AS n
    FROM (SELECT side, doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM words, (VALUES (1), (2), (3)) s(k) WHERE len(w) >= k)
    GROUP BY ALL
), hashed AS (
    SELECT g, xor(list_reduce(
        list_transform(range(len(h) // 2), lambda i: CAST('0x' || substr(h, CAST(2 * i + 1 AS INTEGER), 2) AS BIGINT)),
        lambda c, b: xor(c >> 8, t[1 + (xor(c, b) & 255)]), 4294967295), 4294967295) % 10000 AS bucket
    FROM (SELECT g, hex(encode(g)) AS h FROM (SELECT DISTINCT g FROM grams)), crc
), counts AS (
    SELECT bucket, sum(n) FILTER (side = 0) AS s, sum(n) FILTER (side = 1) AS t FROM grams JOIN hashed USING (g) GROUP BY bucket
), totals AS (
    SELECT coalesce(sum(s), 0) AS s_all, coalesce(sum(t), 0) AS t_all FROM counts
), gains AS (
    SELECT bucket, CAST(floor(1000 * ln((coalesce(t, 0) + 1)::DOUBLE * (s_all + 10000) / ((coalesce(s, 0) + 1)::DOUBLE * (t_all + 10000)))) AS BIGINT) AS gain
    FROM counts, totals
), weights AS (
    SELECT doc_id, sum(n) AS n_features, sum(n * gain) AS weight
    FROM grams JOIN hashed USING (g) JOIN gains USING (bucket) WHERE side = 0 GROUP BY doc_id
), scored AS (
    SELECT w.doc_id, len(w.w) AS n_words, CAST(coalesce(n_features, 0) AS BIGINT) AS n_features, CAST(coalesce(weight, 0) AS BIGINT) AS weight,
           CAST(coalesce(weight, 0) + floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('42:' || w.doc_id), 1, 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296))) AS BIGINT) AS score
    FROM words w LEFT JOIN weights v ON v.doc_id = w.doc_id WHERE side = 0
), placed AS (
    SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS place, count(*) OVER () AS n FROM scored WHERE n_words >= 20
)
SELECT s.doc_id, n_features, weight, score, CASE WHEN place <= 5 * n // 100 THEN place END AS rank
FROM scored s LEFT JOIN placed p ON p.doc_id = s.doc_id
"""


@query("op13_importance_resampling", RESAMPLING_SQL)
def op13_importance_resampling(spark: SparkSession, folder: str) -> DataFrame:
    drawn = importance_resample(table(spark, folder, "documents"), table(spark, folder, "benchmark"))
    return drawn.select("doc_id", "n_features", "weight", "score", "rank")
