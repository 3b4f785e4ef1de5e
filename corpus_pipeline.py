"""A corpus pipeline of five stages over ``documents``.

Every stage takes (spark, docs, sf_dir) and works on all that its predecessor
kept; all but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph.llm import decontamination, mixing, nearness, suffixes, toxicity
from quillgraph.llm.storage import Scratch, ensure_importable

TOXIC_FROM = 0.3
#: Per cent of their five-word shingles that near copies share; op4 links from its own 85.
NEAR_PERCENT = 80


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the factorization machine scores below TOXIC_FROM.

    Null and empty texts have the score of no known term; without labels of both kinds nothing is known and all have the prior's.  Repeated
    rows score alike.  Every column of docs, whatever its name, passes through.
    """
    ensure_importable(spark)
    scratch = Scratch(spark, "pipeline-toxicity")
    machine = toxicity.fit(docs, _table(spark, sf_dir, "labels"), scratch)
    scratch.drop()
    return toxicity.score(docs, machine, "__toxicity").filter(F.col("__toxicity") < TOXIC_FROM).drop("__toxicity")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate component, the first by doc_id (null first) and text hash.

    Documents without words all stay; of repeated rows one stays.  Columns pass through.
    """
    ensure_importable(spark)
    return nearness.one_of_each(docs, Scratch(spark, "pipeline-nearness"), NEAR_PERCENT)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the bytes that repeated strings cover; characters cut in part go whole, and n_chars follows.

    Every row stays, with an empty text if all of it repeats; a null text becomes an empty one.  Other columns, whatever their names, pass through.
    """
    ensure_importable(spark)
    own = [c for c in docs.columns if c not in ("doc_id", "text", "n_chars")]
    out = suffixes.remove_repeats(docs, Scratch(spark, "pipeline-suffixes"), keep_text=True, carry=own, as_text=True, prefix="__")
    return out.select(*[F.col("__kept").alias("text") if c == "text" else F.length("__kept").cast("long").alias(c) if c == "n_chars" else F.col(f"`{c}`") for c in docs.columns])


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no test item."""
    ensure_importable(spark)
    return decontamination.clean(docs, _table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each copy that the mix takes, numbered by copy_no.

    Null texts have no words; sources, null among them, without words give no rows.  Of the columns of docs those of documents are returned.
    """
    return mixing.emit(mixing.mix(docs)).select("doc_id", "text", "lang", "source", "n_chars", "size", "source_size", "target", "copy_no")


STAGES = [
    ("toxicity", drop_toxic),
    ("near_dedup", drop_near_copies),
    ("suffix_dedup", cut_repeats),
    ("decontamination", drop_leaks),
    ("mixing", mix_sources),
]

#: The stages learn, hash and align, which SQL can't express; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order, each but the last written to the shared folder and read again."""
    scratch = Scratch(spark, "pipeline")
    docs = _table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        docs = out if k == len(STAGES) - 1 else scratch.keep(out, name)
    return docs
