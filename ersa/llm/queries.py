"""The registered queries of the operators, and DuckDB SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ersa.llm import (ann, jaccard_join, license_scan, line_dedup, merkle_manifest, packing, periodic_runs, quality_classifier, quality_rules,
                      sentencepiece_codec, sharding, substring_dedup, suffix_dedup)
from ersa.llm.common import documents

Query = Callable[[SparkSession, str], DataFrame]

#: Byte limit of a shard in the registered query: UTF-8 text that one task writes comfortably.
SHARD_BYTES = 16 << 20


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffix_dedup.remove_repeats(documents(spark, sf_dir))
    return found.select("doc_id", "n_bytes", (F.col("n_bytes") - F.octet_length("kept")).alias("n_removed"),
                        F.size("removed").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_classifier.classify(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substring_dedup.remove_repeats(documents(spark, sf_dir))
    lost = F.aggregate("removed", F.lit(0).cast("long"), lambda n, s: n + s[1] - s[0])
    return found.select("doc_id", "n_words", lost.alias("n_removed"), F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_components(documents(spark, sf_dir))


def op5_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_codec.encode_documents(documents(spark, sf_dir), columns=("n_tokens", "ids_sha256", "decoded_sha256"))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality(documents(spark, sf_dir)).drop("cleaned")


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir))


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(license_scan.document_files(documents(spark, sf_dir)))


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(documents(spark, sf_dir), SHARD_BYTES)


def op10_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return ann.nearest(table, F.col("id") % 100 == 0, k=10)


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs.find_runs(periodic_runs.with_planted_runs(documents(spark, sf_dir)))
    best = F.get("runs", F.col("strongest"))
    lines = F.concat_ws("", F.transform("runs", lambda r: F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), F.concat(r["period"].cast("string"), F.lit("\n")))))
    return found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best["start"].alias("start"), best["length"].alias("length"),
                        best["period"].alias("period"), F.expr("1000 * runs[strongest].length div runs[strongest].period").alias("exponent_milli"),
                        F.sha2(lines.cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"))


def op12_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = line_dedup.dedup_lines(documents(spark, sf_dir))
    return found.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle_manifest.document_proofs(documents(spark, sf_dir))


def queries() -> dict[str, Query]:
    return {f.__name__: f for f in (op1_suffix_dedup, op2_quality_classifier, op3_substring_dedup, op4_jaccard_join, op5_sentencepiece, op6_quality_rules,
                                    op7_packing, op8_license_scan, op9_sharding, op10_nearest, op11_periodic_runs, op12_line_dedup, op13_merkle_manifest)}


_STOCK = "|".join(quality_rules.BOILERPLATE)
_R = quality_rules.Rules()

OP6_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT rid, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws FROM d),
words AS (SELECT rid, generate_subscripts(ws, 1) AS p, unnest(ws) AS word FROM w),
windows AS (
  SELECT rid, p, word, lead(word, 1) OVER (PARTITION BY rid ORDER BY p) AS word2,
         lead(word, 2) OVER (PARTITION BY rid ORDER BY p) AS word3 FROM words),
marked AS (
  SELECT rid, p, CASE WHEN word3 IS NOT NULL THEN count(*) OVER (PARTITION BY rid, word, word2, word3) ELSE 0 END >= 2 AS again FROM windows),
near AS (
  SELECT rid, p, again OR coalesce(lag(again, 1) OVER o, false) OR coalesce(lag(again, 2) OVER o, false) AS covered
  FROM marked WINDOW o AS (PARTITION BY rid ORDER BY p)),
wordstats AS (SELECT rid, count(*) AS n_words, count(*) FILTER (covered) AS n_repeat_words FROM near GROUP BY rid),
sums AS (SELECT rid, coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0) AS word_chars FROM w),
cut AS (SELECT rid, string_split(text, chr(10)) AS ls FROM d),
lines AS (SELECT rid, generate_subscripts(ls, 1) AS k, unnest(ls) AS line FROM cut),
filled AS (
  SELECT rid, k, line, row_number() OVER (PARTITION BY rid, line ORDER BY k) > 1 AS again,
         octet_length(encode(line)) AS size, len(regexp_extract_all(line, ' ')) + 1 AS n
  FROM lines WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
judged AS (
  SELECT *, length(array_to_string(regexp_extract_all(line, '[^\x20\x09-\x0D]+'), '')) AS chars,
    again
    OR (upper(line) = line AND lower(line) <> line AND n >= {_R.line_min_words})
    OR len(regexp_extract_all(line, '[#*$%&|<>]')) * 100 > size * {_R.line_symbols_percent}
    OR (contains(line, '!!') AND len(regexp_extract_all(line, '!')) * 100 > n * {_R.line_exclamations_percent_of_words})
    OR len(regexp_extract_all(line, '[|»›•·]')) >= {_R.line_menu_separators}
    OR regexp_matches(lower(line), '\b(?:{_STOCK})')
    OR (n >= {_R.line_repeat_words} AND octet_length(encode(CASE WHEN split_part(ltrim(line), ' ', 1) = '' THEN line
          ELSE replace(line, split_part(ltrim(line), ' ', 1), '') END)) * 100 < size * {_R.line_rest_percent}) AS fails
  FROM filled),
linestats AS (
  SELECT rid, count(*) FILTER (again) AS n_dup_lines, count(*) FILTER (fails) AS n_lines_removed,
         coalesce(sum(chars) FILTER (fails), 0) AS n_chars_removed FROM judged GROUP BY rid),
base AS (
  SELECT d.doc_id, coalesce(n_words, 0)::BIGINT AS n_words, word_chars::BIGINT AS word_chars,
         len(regexp_extract_all(text, '[#*$%&|<>]'))::BIGINT AS n_symbols, coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines,
         coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words, coalesce(n_lines_removed, 0)::BIGINT AS n_lines_removed,
         coalesce(n_chars_removed, 0)::BIGINT AS n_chars_removed
  FROM d JOIN sums USING (rid) LEFT JOIN wordstats USING (rid) LEFT JOIN linestats USING (rid))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       n_words < {_R.min_words} OR 100 * n_repeat_words > {_R.max_repeat_percent} * n_words AS base_failed,
       NOT (n_words < {_R.min_words} OR 100 * n_repeat_words > {_R.max_repeat_percent} * n_words)
         AND 100 * n_chars_removed <= {_R.max_lost_percent} * word_chars AS kept,
       n_lines_removed, n_chars_removed
FROM base
"""

OP9_SQL = f"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(strlen(text), 0)::BIGINT AS n_bytes,
         ('0x' || substr(md5(coalesce(doc_id::VARCHAR, chr(0))), 1, 15))::BIGINT AS k FROM documents),
levels AS (SELECT rid, doc_id, n_bytes, t.depth::INTEGER AS depth, k >> (60 - t.depth)::INTEGER AS prefix
           FROM d, (SELECT unnest(range(0, 61)) AS depth) t),
sums AS (SELECT depth, prefix, sum(n_bytes)::BIGINT AS b FROM levels GROUP BY ALL),
fit AS (SELECT l.*, s.b, row_number() OVER (PARTITION BY rid ORDER BY l.depth) AS nth
        FROM levels l JOIN sums s USING (depth, prefix) WHERE s.b <= {SHARD_BYTES})
SELECT doc_id, n_bytes, depth AS shard_depth, prefix AS shard_prefix, 0::BIGINT AS shard_page, b AS shard_bytes
FROM fit WHERE nth = 1
"""


def oracle_sql() -> dict[str, str]:
    return {"op6_quality_rules": OP6_SQL, "op8_license_scan": license_scan.scan_sql(), "op9_sharding": OP9_SQL,
            "op12_line_dedup": line_dedup.OP12_SQL, "op13_merkle_manifest": merkle_manifest.OP13_SQL}
