"""URL filter: domain rules first, else a character language-model ratio.

Two smoothed variable-order Markov models (Witten-Bell interpolation of
orders 0 to 3 over a fixed alphabet) learn the accepted and the rejected
URLs; the length-normalised log-likelihood difference, cut at a threshold
calibrated on labelled URLs kept out of the fit, judges the rest.
Only built-in DataFrame functions are used.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .storage import Scratch

#: Symbols of the models; any other character is the last one, "*". At most 40**4 four-grams exist.
ALPHABET = "abcdefghijklmnopqrstuvwxyz0123456789/.-*"
_UP, _LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty for a null url or one without ``://``."""
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://(.*)$", 1)
    host = F.translate(F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1), _UP, _LOW)
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    return host, path


def rule_match(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits; null where none does.

    rules: (verdict, "host/path").  A rule fits its host and all subdomains
    if the path starts with the rule's.
    """
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for what, text in sorted(rules, key=lambda x: (len(x[1]), x[1])):
        name, slash, tail = text.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(slash + tail)
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(what)).otherwise(verdict)
    return rule, verdict


def grams(text: Column) -> Column:
    """Every character with its three predecessors, padded at the start and ended by a blank symbol's "*"."""
    other = F.regexp_replace(F.translate(text, _UP, _LOW), r"[^a-z0-9/.\-]", "*")
    padded = F.concat(F.lit("***"), other, F.lit("*"))
    return F.transform(F.sequence(F.lit(1), F.length(padded) - 3), lambda i: F.substring(padded, i, 4))


def ratio_model(labelled: DataFrame) -> DataFrame:
    """(gram, ratio): log10 P(accepted) - log10 P(rejected) of a character after its context.

    labelled: gram, good, bad (counts in either class; both 0 for grams that
    only other URLs have).  One row per gram, at most 40**4.  Each order's
    contexts, at most 40**3 rows of it, and the order below are broadcast.
    """
    below = None
    for k in range(4):  # k characters of context
        each = labelled.groupBy(F.substring("gram", 4 - k, k + 1).alias("g")).agg(F.sum("good").alias("n_good"), F.sum("bad").alias("n_bad"))
        each = each.withColumn("c", F.substring("g", 1, k)).withColumn("low", F.substring("g", 2, k))
        contexts = each.groupBy("c").agg(*[x for cls in ("good", "bad") for x in (F.sum(f"n_{cls}").alias(f"all_{cls}"), F.sum((F.col(f"n_{cls}") > 0).cast("int")).alias(f"types_{cls}"))])
        each = each.join(F.broadcast(contexts), "c")
        if k:
            each = each.join(F.broadcast(below), "low")
        for cls in ("good", "bad"):
            lower = F.col(f"p_{cls}") if k else F.lit(1.0 / len(ALPHABET))
            seen = (F.col(f"n_{cls}") + F.col(f"types_{cls}") * lower) / (F.col(f"all_{cls}") + F.col(f"types_{cls}"))
            each = each.withColumn(f"p_{cls}", F.when(F.col(f"all_{cls}") > 0, seen).otherwise(lower))
        below = each.select(F.col("g").alias("low"), "p_good", "p_bad")
    return below.select(F.col("low").alias("gram"), (F.log10("p_good") - F.log10("p_bad")).alias("ratio"))


def judge(pages: DataFrame, rules: Sequence[tuple[str, str]], fit_share: int = 4, steps: int = 200) -> DataFrame:
    """Pages with host, path, rule, verdict and score (null where a rule decides).

    The models learn from the URLs that rules decide, each distinct URL once;
    one in ``fit_share`` of these (by hash) calibrates the threshold instead,
    over score bins of 1/steps, by the mean of both classes' accuracy; it lies
    halfway between the bins that it parts, ties take the lowest.  Without rejected or accepted URLs every score is 0
    or the threshold is 0, and scores at or above the threshold are allowed.
    The models read the whole url, with query and fragment; null, empty and
    malformed ones, whose host and path are empty, are judged by their text
    like any other.  Repeated urls get equal verdicts.
    """
    h, p = host_path(F.col("url"))
    pages = pages.drop(*[c for c in pages.columns if c in ("host", "path", "rule", "verdict", "score")])
    pages = pages.withColumn("host", h).withColumn("path", p)
    r, v = rule_match(F.col("host"), F.col("path"), rules)
    pages = pages.withColumn("rule", r).withColumn("__v", v)
    pages = pages.withColumn("__t", F.coalesce("url", F.lit("")))
    scratch = Scratch(pages.sparkSession, "urls")
    urls = scratch.keep(pages.groupBy("__t").agg(F.first("__v").alias("__v")), "distinct")
    urls = urls.withColumn("__fit", F.pmod(F.xxhash64("__t"), F.lit(fit_share)) != 0)
    # few bytes, much work: by a set number, which isn't merged into fewer tasks
    urls = urls.repartition(int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions")), "__t")
    each = urls.select("__t", "__v", "__fit", F.explode(grams(F.col("__t"))).alias("gram"))
    learn = F.col("__fit") & F.col("__v").isNotNull()
    counted = each.groupBy("gram").agg(
        F.sum(F.when(learn & (F.col("__v") == "allow"), 1).otherwise(0)).alias("good"),
        F.sum(F.when(learn & (F.col("__v") == "block"), 1).otherwise(0)).alias("bad"),
    )
    model = ratio_model(scratch.keep(counted, "counted"))
    wanted = each.filter("__v is null or not __fit")
    scored = (
        wanted.join(F.broadcast(model), "gram")  # at most 40**4 rows of a four-letter key and a double
        .groupBy("__t")
        .agg(F.sum("ratio").alias("__s"), F.count(F.lit(1)).alias("__n"), F.first("__v").alias("__v"))
        .withColumn("score", F.round(F.col("__s") / F.col("__n"), 9))
    )
    bins = scored.filter("__v is not null").groupBy(F.floor(F.col("score") * steps).alias("b")).agg(
        F.sum((F.col("__v") == "allow").cast("int")).alias("good"), F.sum((F.col("__v") == "block").cast("int")).alias("bad")
    )
    bins = bins.filter(F.col("b").between(-20 * steps, 20 * steps))  # one row a bin: a bounded table
    run = Window.orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    every = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    below = lambda c: F.coalesce(F.sum(c).over(run), F.lit(0)) / F.greatest(F.sum(c).over(every), F.lit(1))
    cut = bins.withColumn("gain", F.round(below("bad") - below("good"), 9))
    # halfway from the end of the last bin below
    cut = cut.withColumn("at", (F.col("b") + F.coalesce(F.lag("b").over(Window.orderBy("b")) + 1, F.col("b"))) / 2).agg(F.max_by("at", F.struct("gain", -F.col("b"))).alias("cut"))
    decided = scored.filter("__v is null").crossJoin(F.broadcast(cut)).select(  # one row
        F.col("__t").alias("__u"), "score",
        F.when(F.col("score") >= F.coalesce(F.col("cut"), F.lit(0)) / steps, "allow").otherwise("block").alias("__m"),
    )
    both = pages.join(decided, F.col("__t") == F.col("__u"), "left")
    return both.withColumn("verdict", F.coalesce("__v", "__m")).drop("__v", "__m", "__t", "__u")
