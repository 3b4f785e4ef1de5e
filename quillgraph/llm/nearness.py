"""MinHash near-duplicate components with tensored banding.

Two collections of M small hashes are made, each of ROWS minhash values; the
key of table (i, j) pairs the i-th of one with the j-th of the other, so
2 * M * ROWS minhash values serve M * M tables of 2 * ROWS each.  Texts that
share a key and whose stored minhash bytes agree enough are candidates, and
full shingle sets decide.  M and the bytes that must agree follow from the
similarity that links.

Both steps look for components, so a pair whose members are joined already
needn't be looked at.  A group's members are first compared within blocks;
only what is then still apart in a group of several blocks is compared across
blocks, and only members outside the group's largest part are copied for it.
A large group of near copies so costs rows in proportion to its size.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .graphs import components
from .joins import spread_lookup
from .storage import Scratch
from .suffixes import _NULL_ID, _pack, _unpack

#: Minhash values of a small hash; words of a shingle.
ROWS, WORDS = 3, 5
#: Part of the pairs at the threshold that may share no table, and that may have too few equal minhash bytes.
MISS, FEWER = 0.001, 0.0004
#: Members, and bytes of texts, of a block.
BLOCK, BLOCK_BYTES = 1024, 1 << 24


def tensor_size(percent: int) -> int:
    """Small hashes of a collection, the fewest that miss a pair at the threshold with a probability of MISS at most."""
    apart, small = 1 - (percent / 100) ** ROWS, 1
    while 1 - (1 - apart**small) ** 2 > MISS:
        small += 1
    return small


def agreement(percent: int) -> int:
    """Stored minhash bytes that must agree: a part of FEWER at most of the pairs at the threshold has less."""
    hashes = 2 * ROWS * tensor_size(percent)
    same = percent / 100 + (1 - percent / 100) / 256
    below, agree = 0.0, 0
    while (below := below + comb(hashes, agree) * same**agree * (1 - same) ** (hashes - agree)) <= FEWER:
        agree += 1
    return agree


def tensor_keys(values: np.ndarray, counts: np.ndarray, small: int, rows: int = ROWS) -> tuple[np.ndarray, np.ndarray]:
    """(keys, minhash bytes) of each non-empty set: values holds the sets one after the other."""
    begin = np.cumsum(counts) - counts
    rng = np.random.default_rng(5)
    seeds = rng.integers(1, 1 << 63, 2 * rows * small, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    low = np.stack([np.minimum.reduceat(K.mix(values * s), begin) for s in seeds], 1)
    parts = []
    for i in range(2 * small):
        h = np.zeros(len(counts), np.uint64)
        for k in range(rows):
            h = K.mix(h * np.uint64(31) + low[:, i * rows + k])
        parts.append(h)
    one, two = np.stack(parts[:small], 1), np.stack(parts[small:], 1)
    table = np.arange(small * small, dtype=np.uint64).reshape(1, small, small)
    keys = K.mix(one[:, :, None] * np.uint64(3) + two[:, None, :] + table)
    return keys.reshape(len(counts), small * small), (low & np.uint64(255)).astype(np.uint8)


def set_hashes(values: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two independent 64-bit hashes of each row's set of distinct values."""
    end, out = np.cumsum(counts), []
    for seed in (0x5851F42D4C957F2D, 0x2545F4914F6CDD1D):
        acc = np.zeros(len(values) + 1, np.uint64)
        np.cumsum(K.mix(K.mix(values ^ np.uint64(seed)) * np.uint64(seed)), out=acc[1:])
        out.append(K.mix(acc[end] - acc[end - counts] + counts.astype(np.uint64)).view(np.int64))
    return out[0], out[1]


def distinct_classes(told: DataFrame, scratch: Scratch, name: str, *values: Column, only: str = "true") -> tuple[DataFrame, DataFrame]:
    """told with a cls that tells all sets apart, and one row (cls, values) for each, or those that ``only`` names (sets of one row may be left out);
    told has two hashes (cls, cls2) of a set.

    One word names a class in all later steps.  Should two classes share it,
    all names are drawn anew from both hashes.
    """
    draw = 0
    while True:
        classes = told.filter("cls is not null").groupBy("cls").agg(*values, F.min("cls2").alias("__lo"), F.max("cls2").alias("__hi"))
        classes = scratch.keep(classes.filter(only), f"{name}-{draw}")
        if classes.filter("__lo <> __hi").isEmpty():
            return told, classes.drop("__lo", "__hi")
        draw += 1
        told = told.withColumn("cls", F.when(F.col("cls").isNotNull(), F.xxhash64("cls", "cls2", F.lit(draw))))


def _describe(small: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, data, offsets in K.chunks(*K.buffers(batch.column("text"))):
                values, counts = K.shingle_sets(data, offsets, WORDS)
                cls, cls2 = set_hashes(values, counts)
                some = counts > 0
                keys, sig = tensor_keys(values, counts[some], small)
                where = np.cumsum(some) - 1
                take = pa.array(np.where(some, where, 0), mask=~some)
                width = keys.shape[1]
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(keys) + 1, dtype=np.int32) * width), pa.array(keys.ravel().view(np.int64)))
                sigs = pa.array([x.tobytes() for x in sig], pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [batch.column("did").slice(i, j - i), batch.column("th").slice(i, j - i), pa.array(counts), pa.array(cls, mask=~some), pa.array(cls2, mask=~some), lists.take(take), sigs.take(take)],
                    ["did", "th", "n", "cls", "cls2", "keys", "sig"],
                )

    return run


def _by_group(batches: Iterator[pa.RecordBatch], key: Callable[[dict], object]) -> Iterator[list[dict]]:
    """Rows with equal keys, which come together."""
    held: list[dict] = []
    for batch in batches:
        for row in batch.to_pylist():
            if held and key(row) != key(held[0]):
                yield held
                held = []
            held.append(row)
    if held:
        yield held


def _edges(a: list[int], b: list[int]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])


def spanning(label: np.ndarray, side: np.ndarray | None, meets: Callable[[int, np.ndarray], np.ndarray]) -> tuple[list[int], list[int]]:
    """Pairs of a spanning forest: label has equal values for members that are joined already, and is brought up to date.

    meets(x, y) gives those of the later members y that are linked with x;
    only members that aren't joined with x yet, and with side only those of
    another side, are asked about.
    """
    xs: list[int] = []
    ys: list[int] = []
    for x in range(len(label) - 1):
        apart = label[x + 1 :] != label[x]
        if side is not None:
            apart &= side[x + 1 :] != side[x]
        y = np.flatnonzero(apart) + x + 1
        if not len(y):
            continue
        y = meets(x, y)
        if len(y):
            labels, at = np.unique(label[y], return_index=True)
            xs += [x] * len(at)
            ys += y[at].tolist()
            label[np.isin(label, labels)] = label[x]
    return xs, ys


def _sketch_finder(agree: int, percent: int, kind: type) -> Callable:
    """Sizes and stored minhash values (of the given kind) allow the similarity."""

    def find(rows: list[dict], label: np.ndarray, side: np.ndarray | None) -> tuple[list[int], list[int]]:
        sig = np.frombuffer(b"".join(r["sig"] for r in rows), kind).reshape(len(rows), -1)
        n = np.array([r["n"] for r in rows])

        def meets(x: int, y: np.ndarray) -> np.ndarray:
            y = y[100 * np.minimum(n[y], n[x]) >= percent * np.maximum(n[y], n[x])]
            return y[(sig[y] == sig[x]).sum(1) >= agree]

        return spanning(label, side, meets)

    return find


def link_sets(sets: list[np.ndarray], label: np.ndarray, side: np.ndarray | None, percent: int) -> tuple[list[int], list[int]]:
    """A spanning forest of the pairs of sorted distinct sets with 100 * intersection >= percent * union."""
    size = np.array([len(s) for s in sets])
    flat = np.concatenate(sets)
    begin = np.cumsum(size) - size
    _, token = np.unique(flat, return_inverse=True)
    mark = np.zeros(int(token.max()) + 1, bool)

    def meets(x: int, y: np.ndarray) -> np.ndarray:
        y = y[100 * np.minimum(size[y], size[x]) >= percent * np.maximum(size[y], size[x])]
        if not len(y):
            return y
        own = token[begin[x] : begin[x] + size[x]]
        mark[own] = True
        if 4 * len(y) > len(sets) - x:
            common = np.add.reduceat(mark[token[begin[x + 1] :]], begin[x + 1 :] - begin[x + 1], dtype=np.int64)[y - x - 1]
        else:
            common = np.array([np.count_nonzero(mark[token[begin[j] : begin[j] + size[j]]]) for j in y.tolist()])
        mark[own] = False
        return y[100 * common >= percent * (size[x] + size[y] - common)]

    return spanning(label, side, meets)


def _exact_finder(percent: int) -> Callable:
    """The full shingle sets reach the similarity."""

    def find(rows: list[dict], label: np.ndarray, side: np.ndarray | None) -> tuple[list[int], list[int]]:
        codec = pa.Codec("zstd", 1)
        texts = pa.array([_unpack(codec, r["z"], r["n_bytes"]).decode() for r in rows], pa.large_string())
        sets: list[np.ndarray] = []
        for _, _, data, offsets in K.chunks(*K.buffers(texts)):
            values, counts = K.shingle_sets(data, offsets, WORDS)
            sets += np.split(values, np.cumsum(counts)[:-1])
        return link_sets(sets, label, side, percent)

    return find


def _edges_of(find: Callable, group: str):
    """Forests of what find sees among rows that come ordered by (group, bi, bj); label and side where they are given."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out_a: list[int] = []
        out_b: list[int] = []
        for rows in _by_group(batches, lambda r: (r[group], r["bi"], r["bj"])):
            if len(rows) < 2:
                continue
            ids = [r["cls"] for r in rows]
            _, label = np.unique(np.array([r["label"] for r in rows]), return_inverse=True)
            side = np.array([r["side"] for r in rows])
            x, y = find(rows, label, None if (side == 0).all() else side)
            out_a += [ids[i] for i in x]
            out_b += [ids[i] for i in y]
            if len(out_a) > 50_000:
                yield _edges(out_a, out_b)
                out_a, out_b = [], []
        if out_a:
            yield _edges(out_a, out_b)

    return run


def grouped_links(rows: DataFrame, group: str, carry: Sequence[str], find: Callable, scratch: Scratch, name: str) -> DataFrame:
    """(node, root): components of the links that find sees among members (cls) of the same group.

    rows has a group's number of blocks in ``blocks``.  First each block's
    members are compared with one another.  Then, for groups of several
    blocks, members in different components so far: all members outside the
    largest component with one another, and with those inside, tile by tile.
    """
    own = F.pmod(F.xxhash64("cls", F.lit(9)), F.col("blocks")).cast("int")
    none = F.lit(0)

    def search(parts: DataFrame) -> DataFrame:
        dealt = parts.select(group, "bi", "bj", "label", "side", "cls", *carry).repartition(group, "bi", "bj").sortWithinPartitions(group, "bi", "bj")
        return dealt.mapInArrow(_edges_of(find, group), "a long, b long")

    found = components(search(rows.select("*", own.alias("bi"), none.alias("bj"), F.col("cls").alias("label"), none.alias("side"))), scratch, f"{name}-within")
    large = rows.filter("blocks > 1")
    if large.isEmpty():
        return found
    large = scratch.keep(large.join(found, F.col("cls") == F.col("node"), "left").withColumn("label", F.coalesce("root", "cls")).select(group, "cls", "label", "blocks", *carry), f"{name}-large")
    per = large.groupBy(group, "label").agg(F.count(F.lit(1)).alias("c"), F.max("blocks").alias("b"))
    per = per.groupBy(group).agg(F.max(F.struct("c", "label")).alias("top"), F.sum("c").alias("all"), F.max("b").alias("b")).filter("all > top.c")
    share = F.col("b") / F.col("all")
    per = scratch.keep(per.select(F.col(group).alias("__g"), F.col("top.label").alias("most"), F.ceil((F.col("all") - F.col("top.c")) * share).cast("int").alias("nb_rest"), F.ceil(F.col("top.c") * share).cast("int").alias("nb_most")), f"{name}-apart")
    if per.isEmpty():
        return found
    both = large.join(per, F.col(group) == F.col("__g"))
    inside = F.col("label") == F.col("most")
    mine = F.pmod(F.xxhash64("cls", F.lit(11)), F.when(inside, F.col("nb_most")).otherwise(F.col("nb_rest"))).cast("int")
    up_to = lambda c: F.sequence(F.lit(0), F.col(c) - 1)
    tile = lambda i, j, side: F.struct(i.cast("int").alias("bi"), j.cast("int").alias("bj"), side.cast("int").alias("side"))
    # tiles of the rest have two blocks of it (bj >= 0), those with the largest component -1 - its block
    rest = F.transform(up_to("nb_rest"), lambda k: tile(F.least("mine", k), F.greatest("mine", k), F.when(F.col("mine") == k, F.lit(0)).otherwise(F.when(F.col("mine") < k, 1).otherwise(2))))
    across = F.transform(up_to("nb_most"), lambda k: tile(F.col("mine"), -1 - k, F.lit(1)))
    most = F.transform(up_to("nb_rest"), lambda k: tile(k, -1 - F.col("mine"), F.lit(2)))
    parts = both.withColumn("mine", mine).select("*", F.explode(F.when(inside, most).otherwise(F.concat(rest, across))).alias("t"))
    more = search(parts.select(group, "cls", "label", "t.bi", "t.bj", "t.side", *carry))
    joined = found.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(more)
    return components(joined, scratch, f"{name}-across")


def candidate_groups(classes: DataFrame, scratch: Scratch, agree: int, percent: int, name: str, kind: type = np.uint8) -> DataFrame:
    """(node, root): groups of classes (cls, n, sig, keys) that chains of candidate pairs join."""
    each = classes.select("cls", F.explode("keys").alias("key"))
    shared = each.groupBy("key").agg(F.count(F.lit(1)).alias("c")).filter("c > 1").select("key", F.ceil(F.col("c") / BLOCK).cast("int").alias("blocks"))
    rows = scratch.keep(each.join(shared, "key"), f"{name}-buckets")
    rows = rows.join(classes.select("cls", "n", "sig"), "cls")
    out = grouped_links(rows, "key", ["n", "sig"], _sketch_finder(agree, percent, kind), scratch, f"{name}-groups")
    scratch.drop(f"{name}-buckets")
    return out


def linked(texts: DataFrame, scratch: Scratch, percent: int, name: str) -> DataFrame:
    """(node, root): components of the exact links among the packed texts (cls, root, z, n_bytes) of each group."""
    sizes = texts.groupBy("root").agg(F.count(F.lit(1)).alias("c"), F.sum("n_bytes").alias("b")).filter("c > 1")
    blocks = F.greatest(F.ceil(F.col("c") / BLOCK), F.ceil(F.col("b") / BLOCK_BYTES)).cast("int")
    rows = texts.withColumnRenamed("root", "group").join(sizes.select(F.col("root").alias("group"), blocks.alias("blocks")), "group")
    return grouped_links(rows, "group", ["z", "n_bytes"], _exact_finder(percent), scratch, f"{name}-links")


def _classes(docs: DataFrame, scratch: Scratch, percent: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(did, th, n, cls) of every row; (cls, times, did, th) of every class, with its first row; (node, root) of linked classes."""
    text = F.coalesce("text", F.lit(""))
    named = docs.select(F.coalesce("doc_id", F.lit(_NULL_ID)).alias("did"), F.xxhash64(text).alias("th"), text.alias("text"))
    told = scratch.keep(named.mapInArrow(_describe(tensor_size(percent)), "did long, th long, n long, cls long, cls2 long, keys array<long>, sig binary"), "described")
    told, classes = distinct_classes(told, scratch, "classes", F.min(F.struct("did", "th", "n", "sig", "keys")).alias("r"), F.count(F.lit(1)).alias("times"))
    classes = classes.select("cls", "times", "r.*")
    groups = candidate_groups(classes, scratch, agreement(percent), percent, "near")
    wanted = groups.join(classes.select("cls", "did", "th"), groups["node"] == classes["cls"]).select("cls", "root", "did", "th")
    packed = named.mapInArrow(_pack, "did long, th long, z binary, n_bytes long").join(wanted, ["did", "th"]).drop("did", "th")
    packed = scratch.keep(packed, "texts").dropDuplicates(["cls"])  # repeated rows have one text
    found = linked(packed, scratch, percent, "near")
    scratch.drop("texts")
    return told, classes, found


def near_components(docs: DataFrame, scratch: Scratch, percent: int = 85) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every document.

    Texts are linked when 100 * intersection >= percent * union of their
    five-word shingle sets (A-Z lower-cased; a shorter text is one shingle);
    equal sets always are.  A null or blank text has an empty set and is
    linked with nothing.  component_id is the smallest doc_id reachable; null
    ids come first only where a component has no other, and are then kept.
    Rows that share a doc_id are documents of their own with one id.
    """
    told, classes, found = _classes(docs, scratch, percent)
    ids = classes.select("cls", "did", "times").join(found, F.col("cls") == F.col("node"), "left").select("cls", "times", F.coalesce("root", "cls").alias("root"), F.nullif("did", F.lit(_NULL_ID)).alias("id"))
    named_root = ids.groupBy("root").agg(F.min("id").alias("component_id"))
    of = scratch.keep(ids.join(named_root, "root").select("cls", "times", "component_id"), "of")
    out = spread_lookup(told.select("did", "n", "cls"), of, "cls", "times", told.count())
    own = F.nullif("did", F.lit(_NULL_ID))
    return out.select(
        own.alias("doc_id"), F.col("n").alias("n_shingles"), F.when(F.col("cls").isNull(), own).otherwise(F.col("component_id")).alias("component_id"),
    ).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def one_of_each(docs: DataFrame, scratch: Scratch, percent: int = 85) -> DataFrame:
    """The rows of docs that stay when each component keeps its first text, by doc_id (null first) and text hash.

    Rows without words all stay; of repeated rows (equal doc_id and text) one
    stays, whichever its other columns are.
    """
    told, classes, found = _classes(docs, scratch, percent)
    ids = classes.select("cls", "did", "th").join(found, F.col("cls") == F.col("node"), "left").withColumn("root", F.coalesce("root", "cls"))
    winners = ids.groupBy("root").agg(F.min(F.struct("did", "th")).alias("w")).select("w.did", "w.th")
    blank = told.filter("cls is null").select("did", "th").distinct()
    stay = scratch.keep(winners.unionByName(blank).withColumnsRenamed({"did": "__did", "th": "__th"}), "stay")
    scratch.drop("described")
    keyed = docs.withColumn("__did", F.coalesce("doc_id", F.lit(_NULL_ID))).withColumn("__th", F.xxhash64(F.coalesce("text", F.lit(""))))
    kept = keyed.join(stay, ["__did", "__th"], "left_semi")
    return kept.dropDuplicates(["__did", "__th"]).select(*docs.columns)
