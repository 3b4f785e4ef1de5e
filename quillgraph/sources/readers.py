"""Article scans: delimited files, JSON lines, landed API responses, paged backfill."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as X

#: Categories in the order that decides which copy of an article stays.
CATEGORIES = ("general", "world", "nation", "business", "technology", "entertainment", "sports", "science", "health")
RESPONSE = "articles array<struct<title string, description string, content string, url string, image string, publishedAt string, source struct<name string, url string>>>"


def read_psv(spark: SparkSession, path: str) -> DataFrame:
    """Pipe-delimited news files with a header: all columns text, bad bytes replaced, rows without article and title dropped."""
    df = spark.read.csv(path, sep="|", header=True, multiLine=True, mode="PERMISSIVE", encoding="UTF-8")
    df = df.toDF(*[c.lstrip("﻿").strip() for c in df.columns])
    blank = lambda c: F.coalesce(F.trim(F.col(c)), F.lit("")) == ""
    return df.filter(~(blank("article") & blank("title")))


def article_id(link: Column, company: Column, title: Column, published: Column) -> Column:
    """SHA-1 of the link, or of company|title|published where there is none."""
    part = lambda c: F.coalesce(c, F.lit(""))
    return F.sha1(F.coalesce(F.nullif(F.trim(link), F.lit("")), F.concat_ws("|", part(company), part(title), part(published))))


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines with a declared schema; blank lines are skipped."""
    return spark.read.schema(schema).json(path).dropna("all")


def map_responses(raw: DataFrame) -> DataFrame:
    """Landed API responses (category, body) as article rows; those without title, url or source name are dropped."""
    each = raw.select("category", F.posexplode(F.from_json("body", RESPONSE)["articles"]).alias("pos", "a")).select("category", "pos", "a.*")
    content = F.coalesce(F.nullif(X.trim_all(F.col("content")), F.lit("")), F.nullif(X.trim_all(F.col("description")), F.lit("")))
    good = (F.coalesce(F.trim("title"), F.lit("")) != "") & (F.coalesce(F.trim("url"), F.lit("")) != "") & (F.coalesce(F.trim("source.name"), F.lit("")) != "")
    url = X.normalise_url(F.col("url"))
    return each.filter(good).select(
        "category", "pos", F.substring(F.trim("title"), 1, 500).alias("title"), url.alias("url"), F.sha2(url, 256).alias("url_hash"),
        F.from_utc_timestamp(F.try_to_timestamp("publishedAt"), "Asia/Seoul").alias("published_at"), content.alias("content"), X.content_type(F.col("content"), F.col("description")).alias("content_type"),
        F.trim("source.name").alias("organization_name"), F.lower(F.try_parse_url("source.url", F.lit("HOST"))).alias("organization_domain"),
    )


def first_by_category(articles: DataFrame, categories: tuple[str, ...] = CATEGORIES) -> DataFrame:
    """One row per url_hash: the first by category order, then place (dropDuplicates wouldn't fix which)."""
    place = F.array_position(F.array(*[F.lit(c) for c in categories]), F.col("category"))
    w = Window.partitionBy("url_hash").orderBy(place, "pos", "url")
    return articles.withColumn("__rn", F.row_number().over(w)).filter("__rn = 1").drop("__rn")


def backfill_slices(spark: SparkSession, start: str, end: str, hours: int, pages: int) -> DataFrame:
    """(slice_start, slice_end, page): [start, end) cut into slices, newest first; one row per request, so requests spread over tasks."""
    one = spark.range(1).select(F.explode(F.sequence(F.lit(start).cast("timestamp"), F.lit(end).cast("timestamp") - F.expr("interval 1 microsecond"), F.expr(f"interval {hours} hours"))).alias("slice_start"))
    sliced = one.withColumn("slice_end", F.least(F.col("slice_start") + F.expr(f"interval {hours} hours"), F.lit(end).cast("timestamp")))
    return sliced.withColumn("page", F.explode(F.sequence(F.lit(1), F.lit(pages)))).orderBy(F.desc("slice_start"), "page")


def until_short_page(fetched: DataFrame, page_size: int) -> DataFrame:
    """Fetched rows (slice_start, page, n, ...) up to each slice's first page shorter than page_size."""
    w = Window.partitionBy("slice_start")
    first = F.min(F.when(F.col("n") < page_size, F.col("page"))).over(w)
    return fetched.withColumn("__s", first).filter("__s is null or page <= __s").drop("__s")


def retryable(status: Column) -> Column:
    """RETRY for 429, STOP for 401 and 403 (the round ends), SKIP for other failures, OK else."""
    return F.when(status == 429, "RETRY").when(status.isin(401, 403), "STOP").when(status >= 400, "SKIP").otherwise("OK")


def stratified_sample(df: DataFrame, month: Column, order: Column, limit: int) -> DataFrame:
    """About ``limit`` rows spread evenly over months (unknown where null): max(1, limit // k) each, the rest to the first month."""
    keyed = df.withColumn("__m", F.coalesce(month, F.lit("unknown")))
    firsts = keyed.groupBy("__m").agg(F.min(order).alias("__o"))
    k = firsts.count()
    per = max(1, limit // max(k, 1))
    lead = firsts.orderBy("__m").limit(1).select("__m", F.lit(max(0, limit - per * k)).alias("__x"))
    w = Window.partitionBy("__m").orderBy(order)
    ranked = keyed.withColumn("__rn", F.row_number().over(w)).join(F.broadcast(lead), "__m", "left")  # one row
    return ranked.filter(F.col("__rn") <= per + F.coalesce("__x", F.lit(0))).orderBy(order).limit(limit).drop("__m", "__rn", "__x")
