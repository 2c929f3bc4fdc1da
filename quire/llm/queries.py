"""The registered queries ``opN_<name>``, thin over the operators, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm.common import fold, table


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quire.llm import quality_rules as q

    docs = table(spark, sf_dir, "documents")
    model = q.fit(docs, table(spark, sf_dir, "labels"))
    return q.quality_rules(docs.select("doc_id", "text"), model).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "quality_score"
    )


def op2_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quire.llm import chat_format as c

    hard = spark.range(2).select(
        F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit("</s>[INST] ok [/INST]").alias("text"),
    )
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(hard)
    return c.read_back(c.chat_windows(rows)).select(
        "conv_id", "n_turns", F.sha2("turns", 256).alias("turns_sha256"), F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"), "formatted_chars",
    )


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quire.llm.line_dedup import line_dedup

    return line_dedup(table(spark, sf_dir, "documents").select("doc_id", "source", "text")).select("doc_id", "n_lines", "n_dropped", "text")


def op4_context_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quire.llm.context_mixing import score_texts

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = fold(F.col("doc_id"), 7) == 2
    return score_texts(docs.select("doc_id", "text", held_out.alias("held_out")), ~F.col("held_out")).select(
        "doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "bits_per_byte"
    )


def op5_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quire.llm.html_extract import extract

    return extract(table(spark, sf_dir, "pages").select("page_id", "url", "html")).select("page_id", "url", "text", "n_chars")


def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quire.llm.byte_bpe import encode_texts

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return encode_texts(docs, digests=True).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quire.llm import quality_classifier as q

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = q.fit(docs, table(spark, sf_dir, "labels"), learn=fold(F.col("doc_id"), 4) != 2)
    return q.classify(docs, model).select("doc_id", (fold(F.col("doc_id"), 4) == 2).alias("held_out"), "score", "predicted")


def op8_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quire.llm.ngram_join import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "n_links")


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quire.llm.sharding import interleave

    raw = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    rows = table(spark, sf_dir, "documents").select(
        "doc_id", "source", (F.when(F.col("text").isNull(), 0).otherwise(F.octet_length("text")) + 1).cast("long").alias("size"), F.crc32(raw).alias("text_crc32")
    )
    return interleave(rows, ties=("size", "text_crc32")).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quire.llm.decontaminate import find_hits

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    n_hit = F.aggregate("hit_spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return find_hits(docs, table(spark, sf_dir, "benchmark")).select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size("hit_items").cast("long").alias("n_items"),
        F.sha2(F.array_join("hit_items", ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"),
    )


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (
        op1_quality_rules, op2_chat_format, op3_line_dedup, op4_context_mixing, op5_html_extract, op6_byte_bpe, op7_quality_classifier, op8_ngram_join, op9_sharding,
        op10_decontaminate,
    )
}

_OP2 = r"""
WITH RECURSIVE c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
e AS (SELECT *, len(regexp_extract_all(text, '[A-Za-z0-9_]+|[^A-Za-z0-9_\x09-\x0D ]')) + 4 AS tokens,
        length(regexp_replace(text, '([<\[])(\\*)(/?s>|/?INST\]|/?SYS\]|OUT\]|/?ROLE\]|TEXT\])', '\1\\\2\3', 'g')) +
        CASE role WHEN 'user' THEN 13 WHEN 'system' THEN 11 WHEN 'assistant' THEN 9 ELSE 19 +
          length(regexp_replace(role, '([<\[])(\\*)(/?s>|/?INST\]|/?SYS\]|OUT\]|/?ROLE\]|TEXT\])', '\1\\\2\3', 'g')) END AS chars FROM c),
t AS (SELECT *, row_number() OVER w AS i, sum(tokens) OVER w AS upto, sum(chars) OVER w AS chars_upto FROM e
      WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text ROWS UNBOUNDED PRECEDING)),
h AS (SELECT conv_id, role = 'system' AS sys, CASE WHEN role = 'system' THEN tokens ELSE 0 END AS st,
        CASE WHEN role = 'system' THEN chars ELSE 0 END AS sc FROM t WHERE i = 1),
walk AS (SELECT conv_id, CAST(1 AS BIGINT) AS i, CAST(1 AS BIGINT) AS s, CAST(st AS HUGEINT) AS base FROM h
  UNION ALL
  SELECT t.conv_id, t.i, CASE WHEN t.i > w.s AND t.upto - w.base > 896 - h.st THEN t.i ELSE w.s END,
         CASE WHEN t.i > w.s AND t.upto - w.base > 896 - h.st THEN t.upto - t.tokens ELSE w.base END
  FROM walk w JOIN t ON t.conv_id IS NOT DISTINCT FROM w.conv_id AND t.i = w.i + 1 JOIN h ON h.conv_id IS NOT DISTINCT FROM w.conv_id),
win AS (SELECT conv_id, s, max(i) AS e FROM walk GROUP BY ALL),
spans AS (SELECT w.conv_id, w.s, w.e, h.sys AND w.s > 1 AS rep, h.sc,
    CASE WHEN w.s = 1 THEN 1 ELSE (SELECT min(x.i) FROM t x, t y WHERE x.conv_id IS NOT DISTINCT FROM w.conv_id AND y.conv_id IS NOT DISTINCT FROM w.conv_id
      AND y.i = w.s - 1 AND x.i BETWEEN greatest(CASE WHEN h.sys THEN 2 ELSE 1 END, w.s - 4) AND w.s AND y.upto - (x.upto - x.tokens) <= 128) END AS h
  FROM win w JOIN h ON h.conv_id IS NOT DISTINCT FROM w.conv_id),
f AS (SELECT p.conv_id, sum(3 + CASE WHEN p.rep THEN p.sc ELSE 0 END + y.chars_upto - (x.chars_upto - x.chars)) AS n
  FROM (SELECT *, least(coalesce(h, s), s) AS hh FROM spans) p JOIN t x ON x.conv_id IS NOT DISTINCT FROM p.conv_id AND x.i = p.hh
    JOIN t y ON y.conv_id IS NOT DISTINCT FROM p.conv_id AND y.i = p.e GROUP BY ALL)
SELECT t.conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY i)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY i) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(any_value(f.n) AS BIGINT) AS formatted_chars
FROM t JOIN f ON f.conv_id IS NOT DISTINCT FROM t.conv_id GROUP BY t.conv_id
"""

_OP3 = r"""
WITH d AS (SELECT doc_id, text, coalesce('h' || source, '') AS host, string_split(text, chr(10)) AS lines FROM documents),
pairs AS (SELECT DISTINCT rid, host, trim(line, e' \t\x0b\x0c\r') AS line
          FROM (SELECT row_number() OVER () AS rid, host, unnest(lines) AS line FROM d)),
n AS (SELECT host, line, count(*) AS n FROM pairs WHERE line <> '' GROUP BY ALL),
t AS (SELECT host, count(*) AS pages FROM d GROUP BY ALL),
bad AS (SELECT host, list(line) AS bad FROM n JOIN t USING (host) WHERE n >= 5 AND n > CAST(0.01 AS DOUBLE) * pages GROUP BY ALL),
k AS (SELECT doc_id, text, lines, list_filter(lines, lambda x: NOT list_contains(coalesce(bad, []), trim(x, e' \t\x0b\x0c\r'))) AS keep
      FROM d LEFT JOIN bad USING (host))
SELECT doc_id, CAST(coalesce(len(lines), 0) AS BIGINT) AS n_lines,
       CAST(coalesce(len(lines) - len(keep), 0) AS BIGINT) AS n_dropped,
       CASE WHEN text IS NULL THEN NULL ELSE array_to_string(keep, chr(10)) END AS text FROM k
"""

_OP9 = r"""
WITH crc(t) AS (SELECT list_transform(range(256), lambda b: list_reduce([CAST(b AS UBIGINT)] || [CAST(x AS UBIGINT) FOR x IN range(8)],
       lambda c, _x: CASE WHEN c & 1 = 1 THEN xor(CAST(3988292384 AS UBIGINT), c >> 1) ELSE c >> 1 END))),
d AS (SELECT doc_id, coalesce('s' || source, '') AS source, CAST(coalesce(strlen(text), 0) + 1 AS BIGINT) AS size,
        list_reduce([CAST(4294967295 AS UBIGINT)] || [CAST(('0x' || h) AS UBIGINT) FOR h IN regexp_extract_all(hex(encode(coalesce(text, ''))), '..')],
          lambda c, b: xor(c >> 8, t[CAST(xor(c, b) & 255 AS BIGINT) + 1])) AS c,
        md5('20:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS key FROM documents, crc),
r AS (SELECT *, (CAST(row_number() OVER (PARTITION BY source ORDER BY key, doc_id, size, c) AS DOUBLE) - 0.5) / count(*) OVER (PARTITION BY source) AS place FROM d),
p AS (SELECT *, row_number() OVER (ORDER BY place, key, source, doc_id, size, c) - 1 AS pos, count(*) OVER () AS n FROM r),
s AS (SELECT *, CAST((pos * 8) // n AS INTEGER) AS shard FROM p)
SELECT doc_id, size, CAST(xor(c, CAST(4294967295 AS UBIGINT)) AS BIGINT) AS text_crc32, 'rows' AS law, shard,
       CAST(pos - (shard * n + 7) // 8 AS BIGINT) AS slot, CAST(NULL AS INTEGER) AS grown_shard FROM s
"""

_OP10 = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT coalesce(CAST(item_id AS VARCHAR), 'null') AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
s AS (SELECT item, w, least(10, len(w)) AS size FROM b WHERE len(w) > 0),
p AS (SELECT DISTINCT item, size, array_to_string(w[k:k + size - 1], ' ') AS phrase FROM (SELECT *, unnest(range(1, len(w) - size + 2)) AS k FROM s)),
q AS (SELECT rid, k, size, array_to_string(w[k:k + size - 1], ' ') AS phrase
      FROM (SELECT rid, w, size, unnest(range(1, len(w) - size + 2)) AS k FROM d, (SELECT DISTINCT size FROM s))),
h AS (SELECT rid, k, size, item FROM q JOIN p USING (size, phrase)),
n AS (SELECT rid, count(DISTINCT j) AS n_hit FROM (SELECT rid, unnest(range(k, k + size)) AS j FROM h) GROUP BY ALL),
i AS (SELECT rid, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS items FROM h GROUP BY ALL)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated FROM d LEFT JOIN n USING (rid) LEFT JOIN i USING (rid)
"""

ORACLE_SQL: dict[str, str] = {"op10_decontaminate": _OP10, "op2_chat_format": _OP2, "op3_line_dedup": _OP3, "op9_sharding": _OP9}
