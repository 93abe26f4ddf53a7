"""One query for each operator, over its whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexspark.llm import bpe, decontam, embeddings, host_rules, html_text, langid, lm, merkle, minhash, packing, runs, sharding, suffixes

Query = Callable[[SparkSession, str], DataFrame]


def _docs(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/documents.parquet")


def op1_lm_scoring(spark: SparkSession, d: str) -> DataFrame:
    return lm.score(_docs(spark, d), F.crc32(F.col("doc_id").cast("string")) % 7 != 2)


def op2_language_id(spark: SparkSession, d: str) -> DataFrame:
    docs = _docs(spark, d).withColumn("held_out", F.crc32(F.col("doc_id").cast("string")) % 5 == 0)
    model = langid.train_model(docs, ~F.col("held_out"))
    return langid.identify(docs.select("doc_id", "held_out", "text"), model).drop("text")


def op3_packing(spark: SparkSession, d: str) -> DataFrame:
    return packing.pack(_docs(spark, d))


def op4_sharding(spark: SparkSession, d: str) -> DataFrame:
    return sharding.shard(_docs(spark, d))[0]


def op5_minhash(spark: SparkSession, d: str) -> DataFrame:
    return minhash.near_duplicates(_docs(spark, d), width=4)


def op6_host_rules(spark: SparkSession, d: str) -> DataFrame:
    return host_rules.judge(_docs(spark, d)).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op7_embeddings(spark: SparkSession, d: str) -> DataFrame:
    return embeddings.near_duplicates(spark.read.parquet(f"{d}/embeddings.parquet"))


def op8_suffixes(spark: SparkSession, d: str) -> DataFrame:
    return suffixes.remove_repeats(_docs(spark, d)).drop("kept")


def op9_bpe(spark: SparkSession, d: str) -> DataFrame:
    import public_tokenizers

    return bpe.encode_column(_docs(spark, d), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, digests=True)


def op10_html(spark: SparkSession, d: str) -> DataFrame:
    return html_text.extract(spark.read.parquet(f"{d}/pages.parquet"))


def op11_runs(spark: SparkSession, d: str) -> DataFrame:
    return runs.periodic_runs(_docs(spark, d), plant=True, digests=True)


def op12_merkle(spark: SparkSession, d: str) -> DataFrame:
    chars = F.col("n_chars") + F.when(F.crc32(F.col("doc_id").cast("string")) % 7 == 0, 1).otherwise(0)
    leaves = [merkle.leaf(*(F.col(c) for c in ("doc_id", "source", "lang")), n, F.col("text")) for n in (F.col("n_chars"), chars)]
    rows = _docs(spark, d).select("doc_id", "lang", leaves[0].alias("leaf"), leaves[1].alias("changed"))
    proven = merkle.folded_roots(merkle.manifest(rows, "lang", ["doc_id"]), "changed", "folded_root")
    return proven.select("doc_id", "leaf", "subroot", "root", merkle.proof_digest().alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


def op13_decontamination(spark: SparkSession, d: str) -> DataFrame:
    found = decontam.contaminated(_docs(spark, d), spark.read.parquet(f"{d}/benchmark.parquet"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"), "contaminated")


def pipeline(spark: SparkSession, d: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, d)


QUERIES: dict[str, Query] = {f.__name__: f for f in (op1_lm_scoring, op2_language_id, op3_packing, op4_sharding, op5_minhash, op6_host_rules, op7_embeddings, op8_suffixes, op9_bpe, op10_html, op11_runs, op12_merkle, op13_decontamination, pipeline)}

#: DuckDB. Host failure rates are shrunk by the same formula as in host_rules.
ORACLES: dict[str, str] = {
    "op6_host_rules": r"""
WITH w AS (
  SELECT doc_id, source, coalesce(text, '') AS text,
         list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l
  FROM documents),
g AS (
  SELECT doc_id, i, w[i] || chr(10) || w[i + 1] || chr(10) || w[i + 2] AS g
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM w WHERE len(w) >= 3)),
r AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM g) WHERE c > 1),
n AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM r, (SELECT unnest([0, 1, 2]) AS k) GROUP BY doc_id),
m AS (
  SELECT w.doc_id, source, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
         length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
         (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(n.n, 0)::BIGINT AS n_repeat_words
  FROM w LEFT JOIN n ON n.doc_id = w.doc_id),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m),
h AS (SELECT source, count(*)::DOUBLE AS d, count_if(base_failed)::DOUBLE AS f FROM b GROUP BY source),
p AS (SELECT m, least(greatest(m * (1 - m) / greatest(coalesce(v, 0), 1e-9) - 1, 1), 1000) AS s
      FROM (SELECT sum(f) / sum(d) AS m, var_samp(f / d) AS v FROM h)),
q AS (SELECT source, m * s + f AS a, (1 - m) * s + d - f AS c FROM h, p),
v AS (SELECT source, a / (a + c) - 2 * sqrt(a / (a + c) * (1 - a / (a + c)) / (a + c + 1)) <= 0.6 AS ok FROM q)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND ok AS kept
FROM b JOIN v ON b.source IS NOT DISTINCT FROM v.source
""",
    "op12_merkle": r"""
WITH RECURSIVE
d AS (
  SELECT doc_id, lang, text, n_chars,
    CASE WHEN doc_id IS NULL THEN 1 ELSE xor(4294967295, list_reduce(
      list_concat([4294967295::BIGINT], list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)),
      lambda a, b: list_reduce([xor(a, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda y, z: xor(y >> 1, 3988292384::BIGINT * (y & 1))))) END AS crc,
    list_transform([doc_id::VARCHAR, source, lang], lambda v: coalesce(strlen(v) || ':' || v, '-')) AS head, coalesce(strlen(text) || ':' || text, '-') AS body
  FROM documents),
e AS (
  SELECT doc_id, lang, sha256(array_to_string(head, '') || coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-') || body) AS leaf,
    sha256(array_to_string(head, '') || coalesce(strlen(m::VARCHAR) || ':' || m, '-') || body) AS changed
  FROM (SELECT *, n_chars + (crc % 7 = 0)::INT AS m FROM d)),
l AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos FROM e),
t AS (
  SELECT lang, 0 AS level, list(leaf ORDER BY pos) AS nodes FROM l GROUP BY lang
  UNION ALL
  SELECT lang, level + 1, list_transform(range(1, len(nodes) + 1, 2), lambda i: sha256(nodes[i] || coalesce(nodes[i + 1], ''))) FROM t WHERE len(nodes) > 1),
s AS (SELECT lang, nodes[1] AS subroot, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS pos FROM t WHERE len(nodes) = 1),
u AS (
  SELECT 0 AS level, list(subroot ORDER BY pos) AS nodes FROM s
  UNION ALL
  SELECT level + 1, list_transform(range(1, len(nodes) + 1, 2), lambda i: sha256(nodes[i] || coalesce(nodes[i + 1], ''))) FROM u WHERE len(nodes) > 1),
w AS (
  SELECT l.doc_id, l.leaf, l.lang, l.pos, 0 AS part, level, l.pos >> level AS i, nodes FROM l JOIN t ON t.lang IS NOT DISTINCT FROM l.lang WHERE len(nodes) > 1
  UNION ALL
  SELECT l.doc_id, l.leaf, l.lang, l.pos, 1, level, s.pos >> level, nodes FROM l JOIN s ON s.lang IS NOT DISTINCT FROM l.lang, u WHERE len(nodes) > 1),
p AS (
  SELECT lang, pos, list(CASE WHEN i % 2 = 1 THEN 'l' || nodes[i] WHEN i + 1 < len(nodes) THEN 'r' || nodes[i + 2] ELSE 'n' END ORDER BY part, level) AS way
  FROM w GROUP BY lang, pos),
f AS (
  SELECT l.doc_id, l.leaf, s.subroot, (SELECT nodes[1] FROM u WHERE len(nodes) = 1) AS root, coalesce(p.way, []) AS way, l.changed
  FROM l JOIN s ON s.lang IS NOT DISTINCT FROM l.lang LEFT JOIN p ON p.lang IS NOT DISTINCT FROM l.lang AND p.pos = l.pos)
SELECT doc_id, leaf, subroot, root, sha256(array_to_string(list_transform(way, lambda x: x[2:]), '')) AS proof_sha256, folded_root, folded_root = root AS verified
FROM (SELECT *, list_reduce(list_concat([changed], way), lambda a, x: sha256(CASE x[1] WHEN 'l' THEN x[2:] || a WHEN 'r' THEN a || x[2:] ELSE a END)) AS folded_root FROM f)
""",
    "op13_decontamination": r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id,
    list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w
  FROM documents),
b AS (
  SELECT item_id, w, least(len(w), 10) AS size FROM (SELECT item_id,
    list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w
  FROM benchmark) WHERE len(w) > 0),
v AS (SELECT DISTINCT item_id, size, array_to_string(w[i:i + size - 1], ' ') AS win FROM (SELECT *, unnest(range(1, len(w) - size + 2)) AS i FROM b)),
x AS (SELECT r, size, i, array_to_string(w[i:i + size - 1], ' ') AS win FROM (SELECT r, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM d, (SELECT DISTINCT size FROM v))),
m AS (SELECT DISTINCT r, x.size, i, item_id FROM x JOIN v USING (win)),
n AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT DISTINCT r, unnest(range(i, i + size)) AS p FROM m) GROUP BY r),
k AS (SELECT r, list_sort(list(DISTINCT item_id::VARCHAR)) AS ids FROM m WHERE item_id IS NOT NULL GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, len(coalesce(ids, []))::BIGINT AS n_items,
  sha256(array_to_string(coalesce(ids, []), ',')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN n ON n.r = d.r LEFT JOIN k ON k.r = d.r
""",
}
