"""Document fingerprints: one-permutation MinHash with optimal densification.

Only built-in DataFrame functions are used.  Each five-word shingle is hashed
once; the hash's top bits choose a bin, the smallest hash of a bin is its
value.  An empty bin borrows from the bin that a 2-universal hash of (bin,
attempt) names, at the first attempt that meets a filled one.  The low bits
of every value are stored as hex; likeness corrects for chance agreement.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .storage import Scratch

#: log2 of the number of bins; stored bits a bin; probes before an empty bin takes the next filled one.
BIN_BITS, LOW_BITS, PROBES = 7, 8, 24


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once, however often or deep body uses it."""
    return F.transform(F.array(value), body)[0]


def shingle_hashes(text: Column, n: int) -> Column:
    """Hashes of the n-word shingles (repeats included); fewer words make one shingle, none an empty array."""
    spaced = F.lower(F.coalesce(text, F.lit("")))
    for space in "\t\n\x0b\f\r":
        spaced = F.replace(spaced, F.lit(space), F.lit(" "))
    parts = F.array_remove(F.split(spaced, " "), "")

    def rolled(h: Column) -> Column:
        one = lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(n)])
        many = F.transform(F.sequence(F.lit(0), F.size(h) - n), one)
        few = F.array(F.aggregate(h, F.lit(17).cast("long"), lambda a, x: F.xxhash64(a, x)))
        return F.when(F.size(h) >= n, many).when(F.size(h) > 0, few).otherwise(F.array().cast("array<bigint>"))

    return let(F.transform(parts, lambda w: F.xxhash64(w)), rolled)


def fingerprint(text: Column, n: int = 5, bin_bits: int = BIN_BITS, low_bits: int = LOW_BITS, probes: int = PROBES) -> Column:
    """Hex of the packed low bits of each bin; empty for a text without words (or null)."""
    k, digits = 1 << bin_bits, low_bits // 4
    codes = F.array(*[F.lit(f"{v:0{digits}x}") for v in range(1 << low_bits)])
    # every bin has the largest value it can hold, so that each one is met after sorting; a bin left with it is empty
    empty = (1 << (64 - bin_bits)) - 1
    marks = F.array(*[F.lit(((b << (64 - bin_bits)) | empty) - (1 << 64 if b >> (bin_bits - 1) else 0)) for b in range(k)]).cast("array<bigint>")

    def smallest(ordered: Column) -> Column:
        """The smallest hash of each bin."""
        return F.filter(ordered, lambda x, i: (i == 0) | (F.shiftrightunsigned(x.bitwiseXOR(F.get(ordered, i - 1)), 64 - bin_bits) != 0))

    def filled(d: Column) -> Column:
        """Codes of the bins, empty ones from others."""
        probe = lambda b, a: F.get(d, F.pmod(F.xxhash64(b, a), F.lit(k)).cast("int"))
        # the first probes, nearly always enough, are tried one by one
        some = lambda b: [probe(b, F.lit(a)) for a in range(1, 7)]
        more = lambda b: F.aggregate(F.sequence(F.lit(7), F.lit(probes)), F.lit(None).cast("string"), lambda got, a: F.coalesce(got, probe(b, a)))
        ahead = lambda b: F.filter(F.concat(F.slice(d, b + 1, k), d), lambda x: x.isNotNull())[0]
        return F.transform(d, lambda x, b: F.coalesce(x, *some(b), more(b), ahead(b)))

    code = lambda x: F.when(x.bitwiseAND(F.lit(empty)) != empty, F.get(codes, x.bitwiseAND(F.lit((1 << low_bits) - 1)).cast("int")))
    bins = lambda h: let(F.sort_array(F.concat(h, marks)), smallest)
    packed = lambda h: F.array_join(let(F.transform(bins(h), code), filled), "")
    return let(shingle_hashes(text, n), lambda h: F.when(F.size(h) == 0, "").otherwise(packed(h)))


def likeness(a: Column, b: Column, low_bits: int = LOW_BITS) -> Column:
    """Estimated Jaccard similarity of two fingerprints, 0 to 1, chance agreement of the stored bits taken off.

    Two empty fingerprints are alike (1); an empty and another are not (0).
    """
    digits, chance = low_bits // 4, 1.0 / (1 << low_bits)

    def share(ab: Column) -> Column:
        same = F.size(F.filter(F.zip_with(ab["a"], ab["b"], lambda x, y: x == y), lambda x: x))
        return F.greatest(F.lit(0.0), (same / F.size(ab["a"]) - chance) / (1.0 - chance))

    cut = lambda x: F.regexp_extract_all(x, F.lit("." * digits), F.lit(0))
    both = let(F.struct(cut(a).alias("a"), cut(b).alias("b")), share)
    return F.when(a == b, 1.0).when((a == "") | (b == ""), 0.0).otherwise(both)


#: Bucket of null ids: below every bucket of a number, so that it comes last.
_NULLS = -(1 << 63)


def with_next(docs: DataFrame, carry: list[str], width: int = 256) -> DataFrame:
    """Rows with ``next_<column>`` of the next one by descending doc_id (after the last: the first) for each carried column.

    The carried columns hold no nulls.  Null ids come last, ties go by the carried columns.  Ids are dealt to
    buckets of ``width`` values, so no task sees more; only the first row of
    each bucket goes to its neighbour, over the same shuffle.  The order of
    buckets is found likewise, level by level, until one bucket is left.
    """
    bucket = F.coalesce(F.floor(F.col("doc_id") / width).cast("long"), F.lit(_NULLS))
    within = Window.partitionBy("__b").orderBy(F.col("doc_id").desc_nulls_last(), *[F.col(c).desc_nulls_last() for c in carry])
    rows = docs.withColumn("__b", bucket)
    # plain columns in both windows, so that the two can share one shuffle
    dealt = rows.withColumns({f"__lead_{c}": F.lead(c).over(within) for c in carry})
    first = rows.withColumn("__later", F.lag(F.lit(True)).over(within)).filter("__later is null")
    first = first.select(F.col("__b").alias("__fb"), *[F.col(c).alias(f"__first_{c}") for c in carry])
    ends = docs.agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).first()
    span = 1 if ends["lo"] is None else ends["hi"] // width - ends["lo"] // width + 2
    levels = 1
    while span > width:
        span, levels = span // width + 2, levels + 1
    follows = _link(docs.select(bucket.alias("__own")).distinct(), levels, width, Scratch(docs.sparkSession, "order"))
    bridge = follows.join(first, F.col("__succ") == F.col("__fb")).select(F.col("__own").alias("__k"), *[f"__first_{c}" for c in carry])
    out = dealt.join(bridge, F.col("__b") == F.col("__k"), "left")
    out = out.withColumns({f"next_{c}": F.coalesce(f"__lead_{c}", f"__first_{c}") for c in carry})
    return out.drop("__b", "__k", *[f"__lead_{c}" for c in carry], *[f"__first_{c}" for c in carry])


def _link(keys: DataFrame, levels: int, width: int, scratch: Scratch) -> DataFrame:
    """(__own, __succ): every key with the next one by descending order, the last with the first.

    Each level's keys, one for width of the level below, are written, so that plans don't double with every level.
    """
    keys = scratch.keep(keys, f"keys-{levels}")
    own = F.col("__own")
    if levels == 1:  # at most width + 3 rows
        down = Window.orderBy(own.desc())
        every = down.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        return keys.select("__own", F.coalesce(F.lead(own).over(down), F.max(own).over(every)).alias("__succ"))
    keyed = keys.withColumn("__u", F.floor(own / width).cast("long"))
    kept = keyed.withColumn("__n", F.lead(own).over(Window.partitionBy("__u").orderBy(own.desc())))
    first = keyed.groupBy("__u").agg(F.max(own).alias("__f"))
    upper = _link(first.select(F.col("__u").alias("__own")), levels - 1, width, scratch).withColumnsRenamed({"__own": "__uo", "__succ": "__un"})
    bridge = upper.join(first, F.col("__un") == F.col("__u")).select("__uo", "__f")
    return kept.join(bridge, F.col("__u") == F.col("__uo"), "left").select("__own", F.coalesce("__n", "__f").alias("__succ"))


def edit(text: Column, other: Column) -> Column:
    """text with its last floor(n/2) code points replaced by as many first ones of other, or all it has."""
    half = F.floor(F.length(text) / 2).cast("int")
    return F.concat(F.substring(text, F.lit(1), F.length(text) - half), F.substring(other, F.lit(1), half))


def compare_with_edits(docs: DataFrame, width: int = 256) -> DataFrame:
    """Fingerprints of every text (null: empty) and of its edited text, with their likeness.

    near_edited compares the two, near_next the text's with the next
    document's.  Repeated rows are documents of their own (a lone document is
    its own next one); an empty table gives no rows; other columns are not
    read.
    """
    base = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    base = base.withColumn("fingerprint", fingerprint(F.col("text")))
    paired = with_next(base, ["text", "fingerprint"], width)
    paired = paired.withColumn("__edited", edit(F.col("text"), F.col("next_text")))
    paired = paired.withColumn("edited_fingerprint", fingerprint(F.col("__edited")))
    return paired.select(
        "doc_id", F.length("text").cast("long").alias("n_chars"), F.sha2("__edited", 256).alias("edited_sha256"), "fingerprint", "edited_fingerprint",
        likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"),
        likeness(F.col("fingerprint"), F.col("next_fingerprint")).alias("near_next"),
    )
