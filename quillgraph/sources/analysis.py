"""Calling an analysis worker per article, and adapting its payloads to graph rows."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PAYLOAD = (
    "status string, classification struct<topic string, subtopic string>, warnings array<string>, "
    "nodes array<struct<id string, kind string, labels array<string>, title string, name string, text string, entity_type string, confidence double>>, "
    "edges array<struct<type string, source string, target string, confidence double, is_primary boolean>>"
)
#: Edge types that are kept, and node kinds that are not.
EDGE_TYPES = ("MENTIONS", "ACTOR", "TARGET", "PLACE", "ASSERTED_BY", "ABOUT", "OCCURRED_ON", "CAUSES", "COVERS", "CONTAINS_STATEMENT", "PART_OF", "PUBLISHED_BY", "CLASSIFIED_AS")


def analyse(articles: DataFrame, call: Callable[[dict], dict], done: DataFrame | None = None) -> DataFrame:
    """(article_id, payload, error_code): the worker's answer for each article that isn't done yet.

    call raises ValueError (400), ConnectionError (503), TimeoutError (504);
    anything else, or an answer without classification, nodes and edges, is 502.
    """
    todo = articles if done is None else articles.join(done.select("article_id").distinct(), "article_id", "left_anti")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            out = []
            for row in pdf.to_dict("records"):
                body, code = None, None
                try:
                    got = call(row)
                    good = isinstance(got.get("classification"), dict) and isinstance(got.get("nodes"), list) and isinstance(got.get("edges"), list)
                    body, code = (json.dumps(got, ensure_ascii=False), None) if good else (None, 502)
                except ValueError:
                    code = 400
                except TimeoutError:
                    code = 504
                except ConnectionError:
                    code = 503
                except Exception:  # the worker's own failure, told as one
                    code = 502
                out.append((row["article_id"], body, code))
            yield pd.DataFrame(out, columns=["article_id", "payload", "error_code"]).astype({"error_code": "Int32"})

    return todo.mapInPandas(run, "article_id long, payload string, error_code int")


def adapt(payloads: DataFrame, drop_kinds: tuple[str, ...] = ("TOKEN", "SENTENCE")) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(nodes, edges, warnings) of payloads (article_id, payload): unknown edge types, dropped kinds and dangling edges go, with a warning."""
    p = payloads.filter("payload is not null").select("article_id", F.from_json("payload", PAYLOAD).alias("p"))
    nodes = p.select("article_id", F.explode("p.nodes").alias("n")).select("article_id", "n.*").withColumn("title", F.coalesce("title", "name", "text"))
    kept = nodes.filter(~F.col("kind").isin(*drop_kinds))
    edges = p.select("article_id", F.explode("p.edges").alias("e")).select("article_id", "e.*")
    known = edges.filter(F.col("type").isin(*EDGE_TYPES))
    ends = kept.select("article_id", "id").distinct()
    good = known.join(ends.withColumnRenamed("id", "source"), ["article_id", "source"], "left_semi").join(ends.withColumnRenamed("id", "target"), ["article_id", "target"], "left_semi")
    bad_type = edges.filter(~F.col("type").isin(*EDGE_TYPES) | F.col("type").isNull()).select("article_id", F.lit("EDGE_TYPE").alias("warning"), F.col("type").alias("what"))
    dangling = known.join(good, ["article_id", "type", "source", "target"], "left_anti").select("article_id", F.lit("DANGLING_EDGE").alias("warning"), F.concat_ws(">", "source", "target").alias("what"))
    dropped = nodes.filter(F.col("kind").isin(*drop_kinds)).select("article_id", F.lit("NODE_KIND").alias("warning"), F.col("id").alias("what"))
    return kept, good, bad_type.unionByName(dangling).unionByName(dropped)
