"""Text rules: names, cleaning, URLs, search, similarity.  Built-in functions, but for Unicode normalisation (pandas)."""

from __future__ import annotations

import hashlib
import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import fixed_values as V

def trim_all(x: Column) -> Column:
    """Without Unicode white space at both ends (trim() takes spaces only)."""
    return F.regexp_replace(x, r"^[\s\p{Z}]+|[\s\p{Z}]+$", "")


def collapse(x: Column) -> Column:
    return F.regexp_replace(x, r"[\s\p{Z}]+", " ")


@F.pandas_udf(T.StringType())
def nfkc_casefold(x: pd.Series) -> pd.Series:
    """NFKC, then case folding; there is no built-in for either."""
    return x.map(lambda s: None if s is None else unicodedata.normalize("NFKC", s).casefold())


@F.pandas_udf(T.StringType())
def nfc(x: pd.Series) -> pd.Series:
    return x.map(lambda s: None if s is None else unicodedata.normalize("NFC", s))


def entity_name(x: Column) -> Column:
    """Comparable form of an entity's name; null counts as empty."""
    folded = trim_all(nfkc_casefold(F.coalesce(x, F.lit(""))))
    return collapse(trim_all(F.btrim(folded, F.lit(V.NAME_WRAPS))))


def is_noise_name(x: Column, pronouns: tuple[str, ...] = V.PRONOUNS) -> Column:
    """Whether a name can't be an entity: empty, without letter or digit, a pronoun, a pronoun with a particle, or referring back."""
    core = entity_name(x)
    stem = F.regexp_replace(core, f"({'|'.join(V.PRONOUN_PARTICLES)})$", "")
    return (
        x.isNull() | (core == "") | ~core.rlike("[0-9A-Za-z가-힣]") | core.isin(*pronouns)
        | ((stem != core) & stem.isin(*pronouns)) | F.split(core, " ")[0].isin(*V.REFERENTIAL_PREFIXES)
    )


def alias_key(x: Column) -> Column:
    """Letters and digits of the folded name."""
    return F.regexp_replace(nfkc_casefold(x), r"[^\p{L}\p{N}]", "")


def publisher_slug(x: Column, size: int = 48) -> Column:
    return F.substring(F.regexp_replace(x, r"[^\p{L}\p{N}_-]+", "_"), 1, size)


def clean_lines(text: Column, shortest: int = 10) -> Column:
    """Usable lines, each once, in order: no symbols or emoji, no addresses, complete sentences of ``shortest`` characters at least."""
    symbols = r"[\p{So}\p{Cs}\p{Co}\x{200D}\x{FE0E}\x{FE0F}\x{203C}\x{2049}\x{3030}\x{303D}\x{1F3FB}-\x{1F3FF}※➤◎]"
    bare = lambda s: F.regexp_replace(trim_all(collapse(F.regexp_replace(trim_all(collapse(s)), symbols, ""))), r"\s+([.!?。？！,，、;；:：])", "$1")
    ends = r"""[.!?。？！]["'”’)\]]*(?:\s*(?:\[[^\]]+\]|<[^>]+>))*$"""
    lines = F.transform(F.split(F.coalesce(text, F.lit("")), r"\r\n|[\n\r\x0b\x0c\x{85}\x{2028}\x{2029}]"), bare)
    good = F.filter(lines, lambda s: (F.length(s) >= shortest) & ~s.contains("@") & s.rlike(ends))
    return F.array_join(F.array_distinct(good), "\n")


def _let(value: Column, body) -> Column:
    """body(value), with value computed once."""
    return F.transform(F.array(value), body)[0]


def _first_index(a: Column, test) -> Column:
    return F.get(F.filter(F.transform(a, lambda s, i: F.when(test(s, i), i)), lambda i: i.isNotNull()), F.lit(0))


def clean_body(content: Column, title: Column, long_line: int = 40, least: float = 0.5) -> Column:
    """An article's body without site text: later copies of long lines, everything from an end mark on (but in the first
    line), leading noise and the title, trailing noise and blank lines are taken off.  Where less than ``least`` of the
    text up to its end mark would be left, it stays as it was."""
    lines = F.transform(F.split(F.coalesce(content, F.lit("")), r"\r\n|\n|\r"), trim_all)
    once = lambda a: F.filter(a, lambda s, i: (F.length(s) < long_line) | (F.array_position(a, s) == i + 1))
    end = lambda s, i: (i > 0) & (s.isin(*V.CONTENT_END_MARKERS) | s.rlike(V.TIMESTAMP_LINE))
    cut = lambda a: F.slice(a, F.lit(1), F.coalesce(_first_index(a, end), F.size(a)))
    ahead = lambda s, i: ~((s == "") | s.isin(*V.LEADING_NOISE) | (s == trim_all(F.coalesce(title, F.lit("")))))
    behind = lambda s, i: ~((s == "") | s.rlike(r"^\d+$") | s.isin(*V.TRAILING_NOISE_LINES) | s.rlike(V.TRAILING_NOISE))
    none = F.array().cast("array<string>")
    head = lambda a: F.coalesce(F.slice(a, _first_index(a, ahead) + 1, F.size(a)), none)
    tail = lambda a: F.reverse(F.coalesce(F.slice(F.reverse(a), _first_index(F.reverse(a), behind) + 1, F.size(a)), none))

    def whole(base: Column) -> Column:
        text = F.array_join(base, "\n")
        kept = F.array_join(F.filter(_let(_let(base, head), tail), lambda s: s != ""), "\n")
        return F.when(F.length(kept) < F.length(trim_all(text)) * least, content).otherwise(kept)

    return F.when(trim_all(F.coalesce(content, F.lit(""))) == "", content).otherwise(_let(_let(_let(lines, once), cut), whole))


def names_outlet(title: Column, outlet: Column, domain: Column) -> Column:
    """Whether a title is only the outlet's name (white space and case aside), or known to stand for its domain."""
    squeeze = lambda s: F.lower(F.regexp_replace(s, r"\s+", ""))
    known = F.lit(False)
    for name, titles in V.OUTLET_TITLES_BY_DOMAIN.items():
        known = known | ((F.lower(trim_all(domain)) == name) & squeeze(title).isin(*titles))
    return F.coalesce((squeeze(title) == squeeze(outlet)) | F.coalesce(known, F.lit(False)), F.lit(False))


def repair_title(title: Column, outlet: Column, domain: Column, content: Column, longest: int = 120) -> Column:
    """The body's first meaningful line where the title only names the outlet and the line looks like a title; else the title."""
    lines = F.transform(F.split(F.coalesce(content, F.lit("")), r"\r\n|\n|\r"), trim_all)
    first = F.get(F.filter(lines, lambda s: (s != "") & ~s.isin(*V.LEADING_NOISE)), F.lit(0))
    fit = first.isNotNull() & (F.length(first) <= longest) & ~first.rlike(V.BYLINE) & ~first.rlike(V.SENTENCE_END)
    return F.when(names_outlet(title, outlet, domain) & fit, first).otherwise(title)


def eligible(title: Column, content: Column, shortest: int = 200) -> Column:
    """Whether an article is worth analysing: long enough (in UTF-16 units) and news by its title."""
    body = trim_all(F.coalesce(content, F.lit("")))
    units = F.length(body) + F.length(F.regexp_replace(body, r"[^\x{10000}-\x{10FFFF}]", ""))
    name, bad = F.lower(trim_all(F.coalesce(title, F.lit("")))), F.lit(False)
    for p in V.EXCLUDED_TITLE_PREFIXES:
        bad = bad | name.startswith(p)
    for k in V.EXCLUDED_TITLE_KEYWORDS:
        bad = bad | name.contains(k)
    return (units >= shortest) & ~bad


def content_type(content: Column, description: Column) -> Column:
    """SOURCE_SUMMARY where only a description is there, TRUNCATED_TEXT with a "[N chars]" end, else FULL_TEXT."""
    has = F.coalesce(trim_all(content), F.lit("")) != ""
    return F.when(~has, "SOURCE_SUMMARY").when(content.rlike(r"\[\+?\d+ chars\]\s*$"), "TRUNCATED_TEXT").otherwise("FULL_TEXT")


def normalise_url(url: Column) -> Column:
    """Scheme and host lower-cased, fragment and tracking parameters dropped; what isn't a URL is only trimmed."""
    raw = F.trim(url)
    shape = r"^([A-Za-z][A-Za-z0-9+.\-]*)://([^/?#]+)([^?#]*)(\?[^#]*)?(#.*)?$"
    part = lambda k: F.regexp_extract(raw, shape, k)
    args = F.filter(F.split(F.substring(part(4), 2, 100000), "&"), lambda a: (a != "") & ~F.lower(a).rlike(r"^(utm_[^=]*|fbclid|gclid|igshid)(=|$)"))
    query = F.array_join(args, "&")
    out = F.concat(F.lower(part(1)), F.lit("://"), F.lower(part(2)), part(3), F.when(query != "", F.concat(F.lit("?"), query)).otherwise(""))
    return F.when(raw.rlike(shape), out).otherwise(raw)


def preview(x: Column, longest: int = 120) -> Column:
    return F.when(F.length(x) > longest, F.concat(F.substring(x, 1, longest), F.lit("…"))).when(F.trim(x) != "", x)


def whole_sentences(x: Column, longest: int = 200) -> Column:
    """Up to the last sentence end within ``longest`` code points; null where there is none."""
    head = F.substring(trim_all(collapse(x)), 1, longest)
    return F.nullif(F.regexp_extract(head, r"(?s)^(.*[.!?。？！][\"'”’)]*)", 1), F.lit(""))


def bigrams(x: Column) -> Column:
    """Distinct character bigrams of the lower-cased text without white space."""
    s = F.lower(F.regexp_replace(F.coalesce(x, F.lit("")), r"\s+", ""))
    return F.when(F.length(s) < 2, F.array().cast("array<string>")).otherwise(F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length(s) - 1, F.lit(1))), lambda i: F.substring(s, i, 2))))


def jaccard(a: Column, b: Column) -> Column:
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, 0.0).otherwise(F.size(F.array_intersect(a, b)) / union)


def containment(a: Column, b: Column) -> Column:
    least = F.least(F.size(a), F.size(b))
    return F.when(least == 0, 0.0).otherwise(F.size(F.array_intersect(a, b)) / least)


def matched_tokens(label: Column, tokens: list[str]) -> Column:
    """How many of the query's tokens the label contains."""
    return sum((label.contains(t).cast("int") for t in tokens), F.lit(0))


def search_tier(label: Column, query: str, tokens: list[str]) -> Column:
    """3 for the query itself, 2 for all tokens, 1 for some, 0 for none."""
    n = matched_tokens(label, tokens)
    return F.when(label == query, 3).when(n == len(tokens), 2).when(n > 0, 1).otherwise(0)


def search_query(text: str, most: int = 20, longest: int = 50) -> tuple[str, list[str], str]:
    """(exact phrase, distinct tokens, fingerprint) of a user's search; a ValueError without tokens, with too many or too long ones."""
    phrase = " ".join(unicodedata.normalize("NFKC", text).lower().split())
    words = re.sub(r"[\W_]+", " ", phrase).split()

    def strip(word: str, ends: tuple[str, ...], times: int) -> str:
        for _ in range(times):
            hit = next((e for e in ends if word.endswith(e) and len(word) - len(e) >= 2), "")
            word = word[: len(word) - len(hit)]
        return word

    tokens = list(dict.fromkeys(strip(strip(strip(w, V.SEARCH_PARTICLES, 2), V.SEARCH_ENDINGS, 1), V.SEARCH_PARTICLES, 1) for w in words))
    if not 0 < len(tokens) <= most or any(len(t) > longest for t in tokens):
        raise ValueError("a search needs 1 to 20 words of at most 50 characters")
    return phrase, tokens, hashlib.sha256("\0".join([phrase, *tokens]).encode()).hexdigest()


def object_particle(word: Column) -> Column:
    """을 after a final consonant, else 를."""
    code = F.ascii(F.substring(word, -1, 1))
    return F.when(code.between(0xAC00, 0xD7A3) & ((code - 0xAC00) % 28 != 0), "을").otherwise("를")


def modality(text: Column) -> Column:
    """struct(negated, possible, reported) by surface marks."""
    return F.struct(
        text.rlike("않|못|아니|없").alias("negated"), text.rlike("수 있|가능|전망|예상|것으로 보|듯").alias("possible"),
        text.rlike("밝혔|전했|말했|보도|따르면|알려졌").alias("reported"),
    )


def stable_id(*parts: Column, size: int = 24) -> Column:
    """Hex prefix of the SHA-256 of the parts."""
    return F.substring(F.sha2(F.concat_ws("␟", *parts), 256), 1, size)
