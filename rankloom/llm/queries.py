"""The registered queries of the ten operators, and the SQL that must give the same rows."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rankloom.llm.chat_format import format_paths, read_back, reply_paths, turn_chains
from rankloom.llm import search_queries  # registers its queries
from rankloom.llm.common import table
from rankloom.llm.decontamination import decontaminate
from rankloom.llm.minhash_dedup import near_duplicates
from rankloom.llm.packing import pack
from rankloom.llm.quality_rules import BOILERPLATE, Rules, quality_rules
from rankloom.llm.registry import ORACLES, QUERIES, query
from rankloom.llm.rlz_dedup import substring_dedup
from rankloom.llm.secret_scan import secret_spans
from rankloom.llm.suffix_dedup import suffix_dedup
from rankloom.llm.token_counts import token_counts
from rankloom.llm.toxicity import toxicity

__all__ = ["ORACLES", "QUERIES", "search_queries"]

_PHRASES = " OR ".join(f"contains(low, '{p}')" for p in BOILERPLATE)
_RULES = Rules()
QUALITY_SQL = rf"""
WITH d AS (
    SELECT doc_id, coalesce(text, '') AS t,
           regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w
    FROM documents
), lines AS (
    SELECT doc_id, line, regexp_extract_all(line, '[^\x20\x09-\x0D]+') AS lw,
           translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS low
    FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS line FROM d)
), judged AS (
    SELECT doc_id, line, len(lw) AS n,
           (len(lw) < {_RULES.short_line_words} AND NOT regexp_matches(lw[-1], '[.!?:;,"'')\]}}]$'))
             OR 100 * len(regexp_extract_all(line, '[#*$%&|<>]')) >= {_RULES.symbol_percent} * len(lw)
             OR 100 * len(list_filter(lw, lambda x: x IN ('|', '/', '>'))) >= {_RULES.bar_percent} * len(lw)
             OR {_PHRASES} AS bad
    FROM lines WHERE len(lw) > 0
), by_line AS (
    SELECT doc_id, count(*) - count(DISTINCT line) AS n_dup_lines,
           coalesce(sum(n) FILTER (bad), 0) AS lost
    FROM judged GROUP BY doc_id
), grams AS (
    SELECT doc_id, i, w[i:i + 2] AS g
    FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM d WHERE len(w) > 2)
), twice AS (
    SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM grams) WHERE c > 1
), repeats AS (
    SELECT doc_id, count(DISTINCT i + j) AS n FROM twice, (VALUES (0), (1), (2)) v(j) GROUP BY doc_id
), counts AS (
    SELECT d.doc_id, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars,
           len(regexp_extract_all(t, '[#*$%&|<>]')) AS n_symbols, coalesce(n_dup_lines, 0) AS n_dup_lines,
           coalesce(r.n, 0) AS n_repeat_words, coalesce(lost, 0) AS lost
    FROM d LEFT JOIN by_line b ON d.doc_id = b.doc_id LEFT JOIN repeats r ON d.doc_id = r.doc_id
)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars,
       CAST(n_symbols AS BIGINT) AS n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines,
       CAST(n_repeat_words AS BIGINT) AS n_repeat_words, CAST(lost AS BIGINT) AS lost_words,
       n_words < {_RULES.min_words} OR 100 * n_repeat_words > {_RULES.repeat_percent} * n_words AS base_failed,
       n_words >= {_RULES.min_words} AND 100 * n_repeat_words <= {_RULES.repeat_percent} * n_words
         AND 100 * lost <= {_RULES.lost_percent} * n_words AS kept
FROM counts
"""


@query("op10_quality_rules", QUALITY_SQL)
def op10_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    rows = quality_rules(table(spark, folder, "documents"))
    return rows.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "lost_words",
        "base_failed", "kept",
    )


DECONTAMINATION_SQL = r"""
WITH dw AS (
    SELECT doc_id, regexp_extract_all(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
    FROM documents
), bw AS (
    SELECT item_id, regexp_extract_all(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
    FROM benchmark
), windows AS (
    SELECT DISTINCT item_id, least(len(w), 10) AS m, array_to_string(w[i:i + 9], ' ') AS g
    FROM (SELECT item_id, w, unnest(range(1, greatest(2, len(w) - 8))) AS i FROM bw WHERE len(w) > 0)
), places AS (
    SELECT doc_id, m, i, array_to_string(w[i:i + m - 1], ' ') AS g
    FROM (SELECT doc_id, w, m, unnest(range(1, len(w) - m + 2)) AS i
          FROM dw, (SELECT DISTINCT m FROM windows) WHERE len(w) >= m)
), hits AS (
    SELECT doc_id, item_id, i, p.m FROM places p JOIN windows v ON p.g = v.g AND p.m = v.m
), covered AS (
    SELECT doc_id, count(DISTINCT k) AS n FROM (SELECT doc_id, unnest(range(i, i + m)) AS k FROM hits) GROUP BY doc_id
), named AS (
    SELECT doc_id, count(*) AS n, string_agg(item, ',' ORDER BY item) AS ids
    FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hits) GROUP BY doc_id
)
SELECT dw.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(c.n, 0) AS n_hit, coalesce(k.n, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, c.n IS NOT NULL AS contaminated
FROM dw LEFT JOIN covered c ON dw.doc_id = c.doc_id LEFT JOIN named k ON dw.doc_id = k.doc_id
"""


@query("op7_decontamination", DECONTAMINATION_SQL)
def op7_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    found = decontaminate(table(spark, folder, "documents"), table(spark, folder, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        F.size("hit_words").cast("long").alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        "contaminated",
    )


@query("op2_token_counts")
def op2_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    return token_counts(table(spark, folder, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


@query("op8_packing")
def op8_packing(spark: SparkSession, folder: str) -> DataFrame:
    return pack(table(spark, folder, "documents"), public_tokenizers.path("word_bpe_49k.json"))


CHAT_SQL = r"""
WITH turns AS (
    SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')
)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(length(role) + length(text) + 17
                + len(regexp_extract_all(text, '<\\*(\|turn\|>|\|end\|>|s>|/s>|<SYS>>|</SYS>>)|\[\\*(INST\]|/INST\])'))) AS BIGINT) AS formatted_chars
FROM turns GROUP BY conv_id
"""


@query("op9_chat_format", CHAT_SQL)
def op9_chat_format(spark: SparkSession, folder: str) -> DataFrame:
    control = F.lit("</s>[INST] ok [/INST]")
    extra = spark.range(2).select(
        F.lit(-1).cast("long").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        control.alias("text"),
    )
    rows = table(spark, folder, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    turns = read_back(format_paths(reply_paths(turn_chains(rows))))

    def joined(parts) -> Column:
        listed = F.array_sort(F.collect_list(F.struct("place", parts.alias("part"))))
        return F.array_join(F.transform(listed, lambda x: x["part"]), "")

    text = F.col("text")
    return turns.groupBy(F.col("tree").alias("conv_id")).agg(
        F.count("*").alias("n_turns"),
        F.sha2(joined(F.concat("role", F.lit("\n"), "text", F.lit("\n"))), 256).alias("turns_sha256"),
        F.coalesce(F.sum(F.when(F.col("masked"), F.length("text"))), F.lit(0)).alias("loss_chars"),
        F.sha2(joined(F.when(F.col("masked"), text).otherwise("")), 256).alias("loss_sha256"),
        F.max("n_formatted").cast("long").alias("formatted_chars"),
    )


SUBSTRING_SQL = r"""
WITH d AS (
    SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), windows AS (
    SELECT doc_id, i, array_to_string(w[i:i + 12], ' ') AS g
    FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM d WHERE len(w) > 12)
), later AS (
    SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY g) AS f FROM windows) WHERE f < doc_id
), gone AS (
    SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS i FROM later
), kept AS (
    SELECT w.doc_id, string_agg(word, ' ' ORDER BY i) AS t, count(*) AS n
    FROM (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS i FROM d) w
    ANTI JOIN gone USING (doc_id, i) GROUP BY w.doc_id
)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, len(w) - coalesce(n, 0) AS n_removed,
       sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN kept ON d.doc_id = kept.doc_id
"""


@query("op6_substring_dedup", SUBSTRING_SQL)
def op6_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return substring_dedup(table(spark, folder, "documents"))


# bytes as pairs of hexadecimal digits: a window is 200 of them
SUFFIX_SQL = r"""
WITH d AS (
    SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents
), windows AS (
    SELECT doc_id, i, hash(substr(h, 2 * i + 1, 200)) AS a, md5_number(substr(h, 2 * i + 1, 200)) AS b
    FROM (SELECT doc_id, h, unnest(range(0, length(h) // 2 - 99)) AS i FROM d WHERE length(h) >= 200)
), later AS (
    SELECT doc_id, i FROM (
        SELECT doc_id, i, row_number() OVER (PARTITION BY a, b ORDER BY doc_id, i) AS n FROM windows
    ) WHERE n > 1
), edges AS (
    SELECT doc_id, i, max(i + 100) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS e
    FROM later
), numbered AS (
    SELECT doc_id, i, sum(CASE WHEN e IS NULL OR i > e THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS span
    FROM edges
), spans AS (
    SELECT doc_id, span, min(i) AS s, max(i) + 100 AS e FROM numbered GROUP BY doc_id, span
), kept AS (
    SELECT p.doc_id, string_agg(substr(h, 2 * p.at + 1, 2 * (p.until - p.at)), '' ORDER BY p.at) AS k
    FROM (
        SELECT doc_id, coalesce(lag(e) OVER w, 0) AS at, s AS until FROM spans WINDOW w AS (PARTITION BY doc_id ORDER BY s)
        UNION ALL
        SELECT s.doc_id, max(e), any_value(length(h) // 2) FROM spans s JOIN d ON s.doc_id = d.doc_id GROUP BY s.doc_id
    ) p JOIN d ON p.doc_id = d.doc_id GROUP BY p.doc_id
), totals AS (
    SELECT doc_id, sum(e - s) AS n_removed, count(*) AS n_spans FROM spans GROUP BY doc_id
)
SELECT d.doc_id, length(h) // 2 AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed,
       coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(k, CASE WHEN t.doc_id IS NULL THEN h ELSE '' END))) AS kept_sha256
FROM d LEFT JOIN totals t ON d.doc_id = t.doc_id LEFT JOIN kept ON d.doc_id = kept.doc_id
"""


@query("op3_suffix_dedup", SUFFIX_SQL)
def op3_suffix_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return suffix_dedup(table(spark, folder, "documents"))


MINHASH_SQL = r"""
WITH RECURSIVE words AS (
    SELECT doc_id, regexp_extract_all(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x20\x09-\x0D]+') AS w
    FROM documents
), shingles AS (
    SELECT DISTINCT doc_id, hash(g) AS g FROM (
        SELECT doc_id, array_to_string(w[i:i + 4], ' ') AS g
        FROM (SELECT doc_id, w, unnest(range(1, greatest(2, len(w) - 3))) AS i FROM words WHERE len(w) > 0))
), sizes AS (
    SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id
), shared AS (
    SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k
    FROM shingles x JOIN shingles y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY x.doc_id, y.doc_id
), links AS (
    SELECT a, b FROM shared JOIN sizes s ON s.doc_id = a JOIN sizes t ON t.doc_id = b
    WHERE 100 * k >= 85 * (s.n + t.n - k)
), reach AS (
    SELECT a AS node, b AS other FROM links
    UNION
    SELECT r.node, l.b FROM reach r JOIN links l ON r.other = l.a
), least AS (
    SELECT node, min(other) AS m FROM reach GROUP BY node
)
SELECT w.doc_id, coalesce(n, 0) AS n_shingles, least(w.doc_id, coalesce(m, w.doc_id)) AS component_id,
       w.doc_id <= coalesce(m, w.doc_id) AS kept
FROM words w LEFT JOIN sizes s ON s.doc_id = w.doc_id LEFT JOIN least l ON l.node = w.doc_id
"""


@query("op1_minhash_dedup", MINHASH_SQL)
def op1_minhash_dedup(spark: SparkSession, folder: str) -> DataFrame:
    found = near_duplicates(table(spark, folder, "documents"))
    return found.select("doc_id", "n_shingles", "component_id", "kept")


@query("op4_secret_scan")
def op4_secret_scan(spark: SparkSession, folder: str) -> DataFrame:
    found = secret_spans(table(spark, folder, "documents"))
    span = F.col("spans")

    def many(kind: str) -> Column:
        return F.size(F.filter(span, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    def joined(spans: Column) -> Column:
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    base = F.filter(span, lambda s: s["kind"] != "crf")
    return found.select(
        "doc_id", many("assign"), many("access"), many("hex"),
        F.sha2(joined(base), 256).alias("base_sha256"), joined(span).alias("spans"),
    )


@query("op5_toxicity")
def op5_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    return toxicity(table(spark, folder, "documents"), table(spark, folder, "labels"))
