"""Scalar expressions over text, times, money and keys.  All are built-in functions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

PREFIX = r"(?i)^\s*(tv|radio|press)\s*-\s*"


def normalize(x: Column) -> Column:
    """Lower case without white space at the ends; null is empty."""
    return F.lower(F.regexp_replace(F.coalesce(x, F.lit("")), r"^\s+|\s+$", ""))


def seconds_of_day(x: Column, hours_alone: bool = False, fractions: bool = True) -> Column:
    """Seconds of ``HH:MM[:SS[.f]]``, or of a day's fraction from 0 to below 1; else null.

    hours_alone: ``HH`` counts as well (certificates), where a fraction does not.
    """
    text = F.trim(x)
    parts = F.split(text, ":")
    part = lambda i: F.floor(F.try_element_at(parts, F.lit(i)).try_cast("double"))
    whole = lambda i: F.coalesce(part(i), F.lit(0))
    clock = F.when(part(1).isNotNull() & part(2).isNotNull() & (F.size(parts) <= 3) & ((F.size(parts) < 3) | part(3).isNotNull()), part(1) * 3600 + part(2) * 60 + whole(3))
    fraction = text.try_cast("double")
    out = clock
    if fractions:
        out = F.when((F.size(parts) == 1) & (fraction >= 0) & (fraction < 1), F.round(fraction * 86400)).otherwise(out)
    if hours_alone:
        out = F.when((F.size(parts) == 1) & fraction.isNotNull(), F.floor(fraction) * 3600).otherwise(out)
    return out.cast("int")


def clock_text(seconds: Column) -> Column:
    """HH:MM:SS."""
    two = lambda x: F.lpad(x.cast("string"), 2, "0")
    return F.concat_ws(":", two(F.floor(seconds / 3600)), two(F.floor(seconds / 60) % 60), two(seconds % 60))


def end_of_window(start: Column, end: Column) -> Column:
    """An end at 00:00 after a start past noon is the end of the day."""
    return F.when((end == 0) & (start > 43200), F.lit(86400)).otherwise(end)


def crossing_end(start: Column, end: Column) -> Column:
    """An end before a start past noon lies on the next day."""
    return F.when((end < start) & (start > 43200), end + 86400).otherwise(end)


def media_type(channel: Column) -> Column:
    found = F.lower(F.regexp_extract(channel, PREFIX, 1))
    return F.when(found == "", F.lit("other")).otherwise(found)


def clean_channel(channel: Column) -> Column:
    """The name without its medium, for comparison."""
    return F.lower(F.trim(F.regexp_replace(channel, PREFIX, "")))


def time_band(seconds: Column) -> Column:
    """The part of the day; prime time runs from 19:00 up to midnight."""
    return F.when(seconds.isNull(), "unknown").when(seconds.between(21600, 43199), "morning").when(seconds.between(43200, 68399), "daytime").when(seconds.between(68400, 86399), "primetime").otherwise("latenight")


def dedup_key(*parts: Column, digits: int = 32) -> Column:
    """The first hexadecimal digits of a SHA-256 over parts joined by ``|``; a null part prints None."""
    return F.substring(F.sha2(F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("None")) for p in parts]), 256), 1, digits)


def blank_if_falsy(x: Column) -> Column:
    """Null, empty and 0 as empty text."""
    text = x.cast("string")
    return F.when(text.isNull() | text.isin("", "0"), F.lit("")).otherwise(text)


def log_key(account: Column, channel: Column, date: Column, time: Column, theme: Column, duration: Column, *rest: Column) -> Column:
    """Key of an observed airing; ``rest``: break, position, advertiser, product."""
    return dedup_key(account, channel, date, time, theme, duration, *[blank_if_falsy(x) for x in rest])


def certificate_key(account: Column, channel: Column, date: Column, time: Column, theme: Column, duration: Column) -> Column:
    return dedup_key(F.lit("tc"), account, channel, date, time, theme, duration)


def word_overlap(a: Column, b: Column) -> Column:
    """Share of the distinct words of ``a`` that ``b`` has; 1 if ``a`` has none."""
    words = lambda x: F.array_distinct(F.array_remove(F.split(normalize(x), r"\s+"), ""))
    return F.when(F.size(words(a)) == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(words(a), words(b))) / F.size(words(a)))


def pipe_list(x: Column) -> Column:
    """The non-empty entries of ``a|b|c``."""
    return F.filter(F.transform(F.split(F.coalesce(x, F.lit("")), r"\|"), lambda t: F.trim(t)), lambda t: t != "")


def safe_text(x: Column) -> Column:
    text = F.trim(F.coalesce(x.cast("string"), F.lit("")))
    return F.when(F.lower(text).isin("nan", "none", "nat"), "").otherwise(text)


def safe_int(x: Column) -> Column:
    return F.floor(F.trim(x.cast("string")).try_cast("double")).cast("int")


def safe_decimal(x: Column, kind: str = "decimal(16,2)") -> Column:
    return F.regexp_replace(F.trim(x.cast("string")), ",", "").try_cast(kind)


def safe_date(day: Column, month: Column, year: Column) -> Column:
    """A date, or null where the parts are none."""
    return F.format_string("%04d-%02d-%02d", safe_int(year), safe_int(month), safe_int(day)).try_cast("date")


def money(x: Column) -> Column:
    """Two decimals, halves up."""
    return F.round(x.cast("decimal(30,6)"), 2).cast("decimal(16,2)")


def percent_of(base: Column, rate: Column) -> Column:
    return money(base.cast("decimal(20,4)") * rate.cast("decimal(9,4)") / F.lit(100).cast("decimal(9,4)"))


def money_text(x: Column) -> Column:
    """The amount in free text; null where there is none."""
    return F.regexp_replace(x, "[^0-9.-]", "").try_cast("decimal(16,2)")


def share_percent(part: Column, whole: Column, digits: int = 1) -> Column:
    """Percentage rounded half to even; 0 of nothing."""
    return F.when(whole > 0, F.bround(part * 100.0 / whole, digits)).otherwise(F.lit(0.0))


def next_month_end(month: Column) -> Column:
    """Last day of the month after ``January 2025``."""
    return F.last_day(F.add_months(month_start(month), 1))


def month_start(month: Column) -> Column:
    return F.to_date(F.try_to_timestamp(F.concat(F.lit("1 "), month), F.lit("d MMMM yyyy")))


def month_end(date: Column) -> Column:
    return F.last_day(date)


def compact_number(x: Column) -> Column:
    """1.2M, 45.0K or the number itself."""
    return F.when(x >= 1_000_000, F.concat(F.format_number(x / 1_000_000, 1), F.lit("M"))).when(x >= 1000, F.concat(F.format_number(x / 1000, 1), F.lit("K"))).otherwise(F.format_number(x, 0))


def drop_frames(timecode: Column) -> Column:
    """HH:MM:SS of HH:MM:SS:FF."""
    return F.substring_index(timecode, ":", 3)


def note_or(notes: Column, key: Column, default: Column) -> Column:
    """An entry of a JSON map of texts, or the default where it is missing or blank."""
    value = F.try_element_at(F.from_json(notes, "map<string,string>"), key)
    return F.coalesce(F.nullif(F.trim(value), F.lit("")), default)


STATUS_LABELS = {
    "matched": "Matched",
    "mismatch": "Programme mismatch",
    "late_telecast": "Late telecast",
    "not_aired": "Not aired",
    "no_mapping": "No mapping",
    "extra": "Extra aired",
    "pending": "Pending",
}


def status_label(x: Column) -> Column:
    return F.coalesce(F.create_map(*[F.lit(v) for kv in STATUS_LABELS.items() for v in kv])[x], x)
