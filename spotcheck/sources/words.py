"""Certificates that arrive as words with their places on pages."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.window import Window

DATE = r"\b(\d{1,2}[-/.]\d{1,2}[-/.]\d{2,4})\b"
TIME = r"\b(\d{2}:\d{2}:\d{2}(?::\d{2})?)\b"
#: Lines with one of these, in any case, are headers, footers and notes.
SKIP = (
    "VAT No", "Invoice No", "Invoice Details", r"Date\s*:", r"From\s*:", r"To\s*:", "Contractor Number", "Contract No", "Schedule No", r"Client\s*:", r"Agent\s*:",
    "Ref No", "Client Code", "Agent Code", "Total Value", "Certified By", "Checked By", "Prepared By", "POWER HOUSE", "UNLESS OBJECTIONS", r"Page \d+ of \d+",
    "Prog. Date", "Caption.Copy Title", "Duration .sec.", r"Channel\s*:", "Sr.No.", "MTV Channel", "Braybrooke", "TELECAST CERTIFICATE", r"Advertiser\s*:",
    r"Address\s*:", "Campaign Period", "Account Executive", "Co.Agency", "Release Order Ref", "Traffic Order No", r"Brand\s*:", "TOTAL SPOTS",
    "AUTHORISED SIGNATORY", "System Generated", "Digitally Signed", "Day Time", "Duration Lan Mat", "Cut No", "Product Details", "Posi", "Net Rate",
    "Remarks", "Bill Number", "Booking Number", "Deal Number", "Total Spot", "We certify", "Agency Name", "Printed Date", "Printed Time", "Printed By", "Client Name", "Agent Name",
)
#: Lines of money or dots; durations that stand before a time, and anywhere.
MONEY, DOTS = r"Rs\s*:|^\s*[\d,]+\.\d{2}\s*$", r"\.{4,}"
BEFORE_TIME, ANYWHERE = ("5", "10", "15", "20", "25", "30", "45", "60"), r"\b(10|15|20|25|30|45|60)\b"
#: Words that are neither programme nor theme.
NOISE = (r"^(Mon|Tue|Wed|We|Thu|Fri|Sat|Sun|BS|PO|PD|OTHERS|Rs\.?|[STE])$", r"^CB\s*\d*$", r"^[\d,]+\.\d+$", r"^\.+$", r"^(ITNCOMM|VTVCOMM|ITNOPCL)\w+$", r"^\d{5,}$")
LINE_HEIGHT, COLUMN_GAP, SERIAL_EDGE, CROSSING = 3.0, 4.0, 50, 5


def lines_of_words(words: DataFrame) -> DataFrame:
    """Words (file, page, x0, x1, y, word) with ``line``, the height of the first word of their line.

    From the top of a page, all words within ``LINE_HEIGHT`` of a line's first word belong to
    it; the next word below begins the next line.  Heights are rounded to tenths, so a page has
    a bounded number of them, which one fold per page walks down.
    """
    w = words.withColumn("y", F.round("y", 1))
    heights = w.groupBy("file", "page").agg(F.array_sort(F.collect_set("y")).alias("_ys"))
    begins = F.aggregate("_ys", F.array().cast("array<double>"), lambda lines, y: F.when((F.size(lines) == 0) | (y - F.element_at(lines, -1) > LINE_HEIGHT + 1e-9), F.array_append(lines, y)).otherwise(lines))
    return w.join(heights.select("file", "page", begins.alias("_lines")), ["file", "page"]).withColumn("line", F.array_max(F.filter("_lines", lambda y: y <= F.col("y")))).drop("_lines")


def certificate_words(words: DataFrame) -> DataFrame:
    """file, record, cert_date, programme, aired_time, tc_theme, duration of certificates given as words.

    A line with a date begins a record, others continue it, across pages too; lines of headers,
    money and dots count for nothing.  The date is read in the order that the file's first
    decidable date has, else in the other.  A time from 00:00: is the duration; else a known
    number before the first time, else anywhere.  What is left of the words parts into
    programme and theme at the widest gap between columns, or at `` - ``.  Records without a
    date, a time or any text are left out; null words are no words.
    """
    w = lines_of_words(words.filter("word is not null and y is not null"))
    entry = F.struct("y", "x0", F.col("word").alias("text"), "x1")
    lines = w.groupBy("file", "page", "line").agg(F.array_sort(F.collect_list(entry)).alias("words"))
    lines = lines.withColumn("text", F.array_join("words.text", " "))
    skip = F.col("text").rlike("(?i)" + "|".join(SKIP)) | F.col("text").rlike(MONEY) | F.col("text").rlike(DOTS)
    lines = lines.filter(~skip).withColumn("begins", F.col("text").rlike(DATE))
    down = Window.partitionBy("file").orderBy("page", "line")
    lines = lines.withColumn("record", F.sum(F.col("begins").cast("long")).over(down.rowsBetween(Window.unboundedPreceding, 0))).filter((F.col("record") > 0) & (F.col("begins") | (F.length(F.trim("text")) > 2)))
    each = lines.groupBy("file", "record").agg(F.array_sort(F.collect_list(F.struct("page", "line", "words"))).alias("_lines"), F.max(F.when(F.col("begins"), F.col("text"))).alias("_main"))
    each = each.select("file", "record", F.regexp_extract("_main", DATE, 1).alias("_date"), F.flatten("_lines.words").alias("words"))
    dated = _with_date(each).filter("cert_date is not null").select("file", "record", "cert_date", "_date", F.col("words.text").alias("texts"), F.col("words.x0").alias("x0"), F.col("words.x1").alias("x1"))
    return dated.mapInPandas(_records, "file string, record long, cert_date date, programme string, aired_time string, tc_theme string, duration int")


def _with_date(records: DataFrame) -> DataFrame:
    parts = F.split("_date", "[-/.]")
    a, b = (F.try_element_at(parts, F.lit(i)).try_cast("int") for i in (1, 2))
    order = F.when(b > 12, "month").when(a > 12, "day")
    first = F.first(order, ignorenulls=True).over(Window.partitionBy("file").orderBy("record").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    year = F.try_element_at(parts, F.lit(3))
    year = F.when(F.length(year) == 2, F.concat(F.lit("20"), year)).otherwise(year)
    made = lambda m, d: F.try_to_date(F.concat_ws("-", F.lpad(year, 4, "0"), F.lpad(m, 2, "0"), F.lpad(d, 2, "0")), "yyyy-MM-dd")
    p, q = F.try_element_at(parts, F.lit(1)), F.try_element_at(parts, F.lit(2))
    by_month, by_day = made(p, q), made(q, p)
    return records.withColumn("_order", F.coalesce(first, F.lit("day"))).withColumn("cert_date", F.when(F.col("_order") == "month", F.coalesce(by_month, by_day)).otherwise(F.coalesce(by_day, by_month)))


def _records(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The facts of each record: a few words each."""
    noise, time, dash = re.compile("|".join(f"(?:{n})" for n in NOISE), re.IGNORECASE), re.compile(TIME), re.compile(r"(.*?)\s+-\s*(.*)", re.DOTALL)

    def halves(text: str, least: int) -> tuple[str, str] | None:
        found = dash.fullmatch(text)
        found = found and (found[1].strip(), found[2].strip())
        return found if found and len(found[0]) > 2 and len(found[1]) > least else None

    def facts(texts: list[str], x0: list[float], x1: list[float], date: str) -> tuple | None:
        whole = " ".join(texts)
        times = time.findall(whole)
        if not times:
            return None
        lengths, clocks = [t for t in times if t.startswith("00:00:")], [t for t in times if not t.startswith("00:00:")]
        last = re.search(r"(?:^|\W)(\d+)$", whole[: whole.index(times[0])].strip())
        loose = re.search(ANYWHERE, time.sub(" ", whole))
        duration = int(lengths[0][6:8]) if lengths else int(last[1]) if last and last[1] in BEFORE_TIME else int(loose[1]) if loose else None

        def counts(i: int) -> bool:
            word = texts[i].strip()
            out = len(word) < 2 or date in word or time.search(word) or noise.search(word) or (x0[i] < SERIAL_EDGE and re.fullmatch(r"\d{1,4}", word)) or word == str(duration)
            return not out

        kept = [i for i in range(len(texts)) if counts(i)]
        across = sorted(kept, key=lambda i: x0[i])
        gap, _, left = max(((x0[b] - x1[a], -n, a) for n, (a, b) in enumerate(zip(across, across[1:], strict=False))), default=(0, 0, 0))
        cut = x1[left] + gap / 2 if gap > COLUMN_GAP else None
        programme, theme = [], []
        for i in kept:
            if cut is not None and x0[i] >= cut:
                theme.append(texts[i])
            else:
                both = halves(texts[i], 2) if cut is None or x1[i] > cut + CROSSING else None
                programme.append(both[0] if both else texts[i])
                theme += [both[1]] if both else []
        p, t = " ".join(programme).strip().rstrip("-").strip(), " ".join(theme).strip().lstrip("-").strip()
        if bool(p) != bool(t) and (both := halves(p or t, 0)):
            p, t = both
        if duration and t.endswith(str(duration)):
            t = t[: -len(str(duration))].strip()
        return (p, (clocks or times)[0][:8], t, duration) if p or t else None

    for batch in batches:
        found = [facts(list(t), list(a), list(b), d) for t, a, b, d in zip(batch["texts"], batch["x0"], batch["x1"], batch["_date"], strict=True)]
        out = batch.loc[[f is not None for f in found], ["file", "record", "cert_date"]].reset_index(drop=True)
        rows = pd.DataFrame([f for f in found if f is not None], columns=["programme", "aired_time", "tc_theme", "duration"])
        yield out.join(rows.astype({"duration": "Int32"}))[["file", "record", "cert_date", "programme", "aired_time", "tc_theme", "duration"]]
