"""Calendar rules: Korean wall time, publication cycles, slots, weeks, time keys, time expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ZONE = "Asia/Seoul"


def parse_mixed(text: Column) -> Column:
    """Instant of an ISO text; one without an offset is Korean wall time; unparseable is null."""
    trimmed = F.trim(text)
    zoned = trimmed.rlike(r"(Z|[+-]\d{2}:?\d{2})$")
    return F.when(zoned, F.try_to_timestamp(trimmed)).otherwise(F.try_to_timestamp(F.concat(trimmed, F.lit("+09:00"))))


def wall_time(instant: Column) -> Column:
    """Korean wall time of an instant in a UTC session."""
    return F.from_utc_timestamp(instant, ZONE)


def cycle(ts: Column) -> Column:
    """AM before noon, PM from noon on."""
    return F.when(F.hour(ts) < 12, "AM").otherwise("PM")


def cycle_available(ts: Column) -> Column:
    """06:00 or 18:00 of the same day."""
    return F.date_trunc("day", ts) + F.when(F.hour(ts) < 12, F.expr("interval 6 hours")).otherwise(F.expr("interval 18 hours"))


def latest_slot(ts: Column, morning: int = 5, evening: int = 17) -> Column:
    """Latest aggregation slot at or before ts; before the morning slot, the evening before."""
    day = F.date_trunc("day", ts)
    return (
        F.when(F.hour(ts) >= evening, day + F.expr(f"interval {evening} hours"))
        .when(F.hour(ts) >= morning, day + F.expr(f"interval {morning} hours"))
        .otherwise(day - F.expr(f"interval {24 - evening} hours"))
    )


def next_hour(ts: Column) -> Column:
    return F.date_trunc("hour", ts + F.expr("interval 1 hour"))


def week_start(ts: Column) -> Column:
    """Monday 00:00."""
    return F.date_trunc("week", ts)


def day_range(lo: str | None, hi: str | None) -> tuple[Column, Column] | None:
    """[lo 00:00, hi + 1 day 00:00) of ISO dates; none if neither is given; an error if one is missing or lo > hi."""
    if lo is None and hi is None:
        return None
    if lo is None or hi is None or lo > hi:
        raise ValueError("a period needs both ends, in order")
    return F.lit(lo).cast("timestamp_ntz"), F.expr(f"timestamp_ntz'{hi}' + interval 1 day")


def time_keys(ts: Column) -> tuple[Column, Column, Column]:
    """Year, month and day keys of the time hierarchy."""
    return F.date_format(ts, "yyyy"), F.date_format(ts, "yyyy-MM"), F.date_format(ts, "yyyy-MM-dd")


def keys_compatible(a: Column, b: Column) -> Column:
    """Whether two time keys agree as far as the coarser goes."""
    n = F.least(F.length(a), F.length(b))
    return F.substring(a, F.lit(1), n) == F.substring(b, F.lit(1), n)


#: Day words and their distance from the day of publication.
DAY_WORDS = {"그저께": -2, "그제": -2, "어제": -1, "전날": -1, "오늘": 0, "이날": 0, "내일": 1, "모레": 2}
#: Year words and their distance from the year of publication.
YEAR_WORDS = {"재작년": -2, "지난해": -1, "작년": -1, "올해": 0, "금년": 0, "내년": 1}


def normalise_expression(text: Column, base: Column) -> Column:
    """struct(value, granularity, status, rule) of a time expression, relative to the date ``base``.

    Absolute dates, day and year words, "coming N일" (rolls into the next
    month) and "N월 [N일]" of the base year resolve; invalid dates,
    durations, repetitions and the rest stay UNRESOLVED.
    """
    y, m, d = (F.regexp_extract(text, p, 1) for p in (r"(\d{4})\s*년", r"(?<!\d)(\d{1,2})\s*월", r"(?<!\d)(\d{1,2})\s*일(?!간|째)"))
    iso = F.regexp_extract(text, r"(\d{4})[-./](\d{1,2})[-./](\d{1,2})", 0)

    def told(value: Column, unit: str, rule: str) -> Column:
        ok = value.isNotNull()
        return F.struct(value.alias("value"), F.when(ok, unit).alias("granularity"), F.when(ok, "RESOLVED").otherwise("UNRESOLVED").alias("status"), F.lit(rule).alias("rule"))

    def date(yy: Column, mm: Column, dd: Column) -> Column:
        return F.date_format(F.try_to_date(F.concat_ws("-", yy, F.lpad(mm, 2, "0"), F.lpad(dd, 2, "0"))), "yyyy-MM-dd")

    def month(yy: Column, mm: Column) -> Column:
        return F.when(mm.cast("int").between(1, 12), F.concat_ws("-", yy, F.lpad(mm, 2, "0")))

    year, none = F.year(base).cast("string"), F.lit(None).cast("string")
    coming = F.when(d.cast("int") >= F.dayofmonth(base), base).otherwise(F.add_months(base, 1))
    out = F.when(text.rlike(r"\d\s*(시간|분|초|주|개월|년)\s*(간|동안)|\d\s*일\s*(간|동안)"), told(none, "", "DURATION")).when(text.rlike("매일|매주|매달|매월|매년|마다"), told(none, "", "SET"))
    out = out.when(iso != "", told(date(*(F.regexp_extract(text, r"(\d{4})[-./](\d{1,2})[-./](\d{1,2})", k) for k in (1, 2, 3))), "DAY", "ISO"))
    out = out.when((y != "") & (m != "") & (d != ""), told(date(y, m, d), "DAY", "YMD")).when((y != "") & (m != ""), told(month(y, m), "MONTH", "YM")).when(y != "", told(y, "YEAR", "Y"))
    out = out.when(text.rlike("이듬해"), F.when(m != "", told(month((F.year(base) + 1).cast("string"), m), "MONTH", "NEXT_YEAR_MONTH")).otherwise(told((F.year(base) + 1).cast("string"), "YEAR", "NEXT_YEAR")))
    for word, n in YEAR_WORDS.items():
        rel = (F.year(base) + n).cast("string")
        out = out.when(text.contains(word), F.when((m != "") & (d != ""), told(date(rel, m, d), "DAY", "YEAR_WORD")).when(m != "", told(month(rel, m), "MONTH", "YEAR_WORD")).otherwise(told(rel, "YEAR", "YEAR_WORD")))
    for word, n in DAY_WORDS.items():
        out = out.when(text.contains(word), told(F.date_format(F.date_add(base, n), "yyyy-MM-dd"), "DAY", "DAY_WORD"))
    out = out.when(text.rlike(r"오는\s*\d{1,2}\s*일"), told(date(F.year(coming).cast("string"), F.month(coming).cast("string"), d), "DAY", "COMING_DAY"))
    out = out.when((m != "") & (d != ""), told(date(year, m, d), "DAY", "MD")).when(m != "", told(month(year, m), "MONTH", "M"))
    return out.otherwise(told(none, "", "NONE"))


def interval_gap(a_start: Column, a_end: Column, b_start: Column, b_end: Column) -> Column:
    """Days between two date intervals; 0 where they touch."""
    return F.greatest(F.datediff(b_start, a_end), F.datediff(a_start, b_end), F.lit(0))
