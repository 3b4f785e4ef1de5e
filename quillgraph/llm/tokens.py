"""Token counts by section, from token offsets.

A whole document is encoded once; the byte length of every token gives its
span, mapped to characters; spans are interval-joined with the document's
sections, and a token that crosses a boundary is allocated by an explicit
rule.  Counting each section by itself would split such tokens.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K

#: How the tokenizer of the .tiktoken files cuts text before merging (fixed value of that vocabulary).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
RULES = ("majority", "start", "fraction")
#: Runs of white space that the pattern takes but for their last character (or whole, at the end of a text) as one piece; longer ones than this
#: are given to the encoder as that piece, since its pattern search fails on very long ones.
_LONG_BLANK = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]{10000,}")
_encoders: dict[str, tuple] = {}


def read_ranks(path: str) -> dict[bytes, int]:
    """Merge ranks of a .tiktoken file; read on the driver and shipped, so executors need no file."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def digest(ranks: dict[bytes, int], pattern: str) -> str:
    """Name of an encoder: two that differ in any rank or the pattern have two."""
    h = hashlib.sha256(pattern.encode())
    for token, i in sorted(ranks.items()):
        h.update(b"%d:%d:" % (i, len(token)) + token)
    return h.hexdigest()


def encode(encoder, text: str, pattern: str) -> list[int]:
    """Tokens of a text of any kind: long white space is cut where PATTERN cuts it."""
    if pattern != PATTERN:
        return encoder.encode_ordinary(text)
    out, at = [], 0
    for blank in _LONG_BLANK.finditer(text):
        end = blank.end() if blank.end() == len(text) else blank.end() - 1
        out += encoder.encode_ordinary(text[at : blank.start()])
        out += encoder._encode_single_piece(text[blank.start() : end])
        at = end
    return out + encoder.encode_ordinary(text[at:])


def _encoder(key: str, ranks: dict[bytes, int], pattern: str):
    if key not in _encoders:
        import tiktoken

        lens = np.zeros(max(ranks.values()) + 1, np.int64)
        for token, i in ranks.items():
            lens[i] = len(token)
        _encoders[key] = tiktoken.Encoding("shipped", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}), lens
    return _encoders[key]


def attribute(token_ends: np.ndarray, section_starts: np.ndarray, char_at: np.ndarray, rule: str) -> tuple[np.ndarray, np.ndarray]:
    """Tokens of each section, and how many tokens cross into or out of it.

    token_ends, section_starts: byte offsets, both rising; the sections tile
    the text.  char_at[b]: characters that begin before byte b.  majority: to
    the section with most of the token's characters, the earlier at a tie;
    start: to the section of its first byte; fraction: by its characters (by
    its bytes if none begins in it).
    """
    n = len(section_starts)
    starts = np.concatenate([[0], token_ends[:-1]])
    a = np.searchsorted(section_starts, starts, "right") - 1
    b = np.searchsorted(section_starts, token_ends - 1, "right") - 1
    count = np.bincount(a[a == b], minlength=n).astype(np.float64)
    crossing = np.zeros(n, np.int64)
    if (cross := np.flatnonzero(a != b)).size:
        width = b[cross] - a[cross] + 1
        token = np.repeat(np.arange(len(cross)), width)
        sec = np.arange(width.sum()) - np.repeat(np.cumsum(width) - width, width) + np.repeat(a[cross], width)
        ends = np.concatenate([section_starts[1:], [len(char_at) - 1]])
        lo, hi = np.maximum(starts[cross][token], section_starts[sec]), np.minimum(token_ends[cross][token], ends[sec])
        crossing = np.bincount(sec, minlength=n)
        chars = (char_at[hi] - char_at[lo]).astype(np.float64)
        whole = np.bincount(token, chars)
        part = np.where(whole[token] > 0, chars, hi - lo)
        if rule == "start":
            count += np.bincount(a[cross], minlength=n)
        elif rule == "fraction":
            count += np.bincount(sec, part / np.bincount(token, part)[token], n)
        else:
            order = np.lexsort((sec, -part, token))
            best = order[np.concatenate([[True], np.diff(token[order]) > 0])]
            count += np.bincount(sec[best], minlength=n)
    return count, crossing


def count_by_line(docs: DataFrame, ranks: dict[bytes, int], rule: str = "majority", pattern: str = PATTERN) -> DataFrame:
    """(doc_id, section, start, end, n_tokens, n_crossing): one row per line of every text.

    Sections are lines with their line feed, start and end are character
    offsets; the n_tokens of a document add up to its encoding's length.  A
    null or empty text has one section without tokens.  With PATTERN white space
    of any length is encoded; another pattern may refuse very long runs.  Repeated rows give
    repeated results, an empty table none; other columns are not read.
    """
    return _count(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.lit(None).cast("array<int>").alias("cuts")), ranks, rule, pattern)


def count_by_field(docs: DataFrame, fields: Sequence[str], ranks: dict[bytes, int], rule: str = "majority", pattern: str = PATTERN) -> DataFrame:
    """As count_by_line, with the named columns, concatenated as they are, as sections (null: empty)."""
    parts = [F.coalesce(F.col(f).cast("string"), F.lit("")) for f in fields]
    sizes = F.array(*[F.octet_length(p) for p in parts])
    return _count(docs.select("doc_id", F.concat(*parts).alias("text"), sizes.alias("cuts")), ranks, rule, pattern)


def _count(texts: DataFrame, ranks: dict[bytes, int], rule: str, pattern: str) -> DataFrame:
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")
    shipped = texts.sparkSession.sparkContext.broadcast((digest(ranks, pattern), ranks))  # one vocabulary file

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, lens = _encoder(*shipped.value, pattern)
        for batch in batches:
            ids, cuts = batch.column("doc_id").to_pylist(), batch.column("cuts").to_pylist()
            column = batch.column("text")
            for i, j, data, offsets in K.chunks(*K.buffers(column)):
                out: list[tuple] = []
                for r in range(i, j):
                    raw = data[offsets[r - i] : offsets[r - i + 1]]
                    char_at = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])
                    if cuts[r] is None:
                        begin = np.concatenate([[0], np.flatnonzero(raw == 10) + 1])
                        begin = begin[: 1 if not len(raw) else None]
                        begin = begin[:-1] if len(begin) > 1 and begin[-1] == len(raw) else begin
                        stop = np.concatenate([begin[1:], [len(raw)]])
                        which = np.arange(len(begin))
                    else:
                        stop = np.cumsum(cuts[r])
                        begin = stop - np.array(cuts[r])
                        which = np.flatnonzero(stop > begin)
                    tokens = np.array(encode(encoder, bytes(raw).decode(), pattern), np.int64)
                    count, crossing = np.zeros(len(begin)), np.zeros(len(begin), np.int64)
                    if len(tokens):
                        count[which], crossing[which] = attribute(np.cumsum(lens[tokens]), begin[which], char_at, rule)
                    out.append((np.full(len(begin), r), np.arange(len(begin)), char_at[begin], char_at[stop], count, crossing))
                row, sec, start, end, count, crossing = (np.concatenate(x) for x in zip(*out, strict=True))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([ids[x] for x in row], pa.int64()), pa.array(sec), pa.array(start), pa.array(end), pa.array(count if rule == "fraction" else count.astype(np.int64)), pa.array(crossing)],
                    ["doc_id", "section", "start", "end", "n_tokens", "n_crossing"],
                )

    kind = "double" if rule == "fraction" else "long"
    return texts.mapInArrow(run, f"doc_id long, section long, start long, end long, n_tokens {kind}, n_crossing long")
