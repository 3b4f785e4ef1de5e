"""Registered queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontamination, fingerprints, hmm, mixing, nearness, paragraphs, suffixes, tokens, toxicity, urls
from .storage import Scratch, ensure_importable

URL_RULES = (("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/"))


TOXIC_FROM = 0.3
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ensure_importable(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out(mod: int) -> Column:
    """Whether crc32 of doc_id as text leaves 2; a null doc_id counts as an empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), F.lit(mod)) == 2


def op1_toxicity_fm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    scratch = Scratch(spark, "op1")
    machine = toxicity.fit(docs, _table(spark, sf_dir, "labels").filter(~held_out(4)), scratch)
    scratch.drop()
    out = toxicity.score(docs, machine)
    return out.select("doc_id", held_out(4).alias("held_out"), "score", (F.col("score") >= TOXIC_FROM).cast("int").alias("predicted"))


def op2_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.remove_repeats(_table(spark, sf_dir, "documents").select("doc_id", "text"), Scratch(spark, "op2"))


def op3_token_counts(spark: SparkSession, sf_dir: str, vocabulary: str = VOCABULARY) -> DataFrame:
    return tokens.count_by_line(_table(spark, sf_dir, "documents"), tokens.read_ranks(vocabulary))


def op4_minhash_tensored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearness.near_components(_table(spark, sf_dir, "documents").select("doc_id", "text"), Scratch(spark, "op4"))


def op5_hmm_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    scored, vocab, _ = hmm.language_model(docs, ~held_out(7), Scratch(spark, "op5"))
    return scored.select("doc_id", (~F.col("train")).alias("held_out"), "n_tokens", "n_known", F.lit(vocab.total).cast("long").alias("train_tokens"), "base_score", "score")


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), Scratch(spark, "op6"))


def op7_oph_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.compare_with_edits(_table(spark, sf_dir, "documents"))


def op8_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(_table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


OP8_SQL = r"""
WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
        coalesce(CAST(doc_id AS VARCHAR), '') || CASE WHEN count(*) OVER (PARTITION BY doc_id) = 1 THEN ''
          ELSE ':' || sha256(coalesce(text, '')) || ':' || row_number() OVER (PARTITION BY doc_id, sha256(coalesce(text, '')) ORDER BY source) END AS draw_key
      FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT *, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight FROM s),
o AS (SELECT *, CAST(coalesce(sum(2 * source_size) OVER u, 0) AS BIGINT) AS full_before, CAST(sum(weight) OVER v AS BIGINT) AS rest,
        (SELECT CAST(sum(source_size) AS BIGINT) FROM s) AS total
      FROM w WINDOW u AS (ORDER BY 2.0 * source_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
        v AS (ORDER BY 2.0 * source_size / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
l AS (SELECT max((CAST(1.5 AS DOUBLE) * total - full_before) / rest) AS level FROM o
      WHERE (CAST(1.5 AS DOUBLE) * total - full_before) / rest * weight <= 2 * source_size),
t AS (SELECT source, source_size, least(CAST(2 * source_size AS DOUBLE), weight * coalesce(level, 0)) AS target FROM w, l),
r AS (SELECT *, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS rate FROM t)
SELECT d.doc_id, d.size, r.source_size, r.target,
  d.size * CAST(floor(rate) + CASE WHEN CAST('0x' || substr(sha256('mix:' || d.draw_key), 1, 8) AS BIGINT) / 4294967296.0 < rate - floor(rate)
    THEN 1 ELSE 0 END AS BIGINT) AS taken
FROM d JOIN r ON d.source IS NOT DISTINCT FROM r.source
"""


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = urls.judge(_table(spark, sf_dir, "pages").select("page_id", "url"), URL_RULES)
    return out.select("page_id", "host", "path", "rule", "verdict", "score")


def op10_paragraph_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paragraphs.find_repeats(_table(spark, sf_dir, "documents").select("doc_id", "text"), Scratch(spark, "op10"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_toxicity_fm": op1_toxicity_fm,
        "op2_suffix_array_dedup": op2_suffix_array_dedup,
        "op3_token_counts": op3_token_counts,
        "op4_minhash_tensored": op4_minhash_tensored,
        "op5_hmm_lm": op5_hmm_lm,
        "op6_decontamination": op6_decontamination,
        "op7_oph_fingerprints": op7_oph_fingerprints,
        "op8_mix_sources": op8_mix_sources,
        "op9_url_filter": op9_url_filter,
        "op10_paragraph_dedup": op10_paragraph_dedup,
    }


def oracle_sql() -> dict[str, str]:
    return {"op8_mix_sources": OP8_SQL}
