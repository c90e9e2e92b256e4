"""Quality rules with thresholds that adapt to each language and source.

The rules' statistics go into quantile sketches: histograms over fixed integer buckets, so
sketches merge by adding counts, exactly and in any order.  Fences from the quartiles of a
document's own language and source replace fixed cutoffs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from spotcheck.llm.frames import materialize

SPACES = "[\\x20\\x09-\\x0D]+"
SYMBOLS = "#*$%&|<>"
WINDOW = 8
#: Metric, in integer buckets: (lower fence?, upper fence?, slack in buckets).
METRICS = {"word_len10": (True, True, 15), "symbols_pm": (False, True, 15), "dup_lines_pm": (False, True, 150), "repeat_pm": (False, True, 100), "length_step": (True, False, 16)}


def _share(part: str, whole: str, scale: int) -> Column:
    """The bucket of a share: whole parts of ``scale``; the last bucket, 1000, also holds all beyond it, which no fence tells apart."""
    return F.when(F.col(whole) > 0, F.least(F.lit(1000), F.expr(f"{part} * {scale} div {whole}"))).otherwise(F.lit(0)).cast("long")


def text_statistics(docs: DataFrame) -> DataFrame:
    """n_words, word_chars, n_symbols, n_dup_lines, n_lines and n_repeat_words of each whole text.

    Built-in expressions only.  A null text has no words.  Windows of eight words are compared
    by 64-bit hashes; only a text with a repeated window sorts them.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select("doc_id", "lang", "source", text.alias("text"))
    rows = rows.withColumns({
        "words": F.array_remove(F.split("text", SPACES), ""),
        "lines": F.filter(F.split("text", "\n"), lambda x: F.length(F.translate(x, " \t\n\x0b\f\r", "")) > 0),
    })
    rows = rows.select(
        "doc_id", "lang", "source",
        F.size("words").cast("long").alias("n_words"),
        F.length(F.translate("text", " \t\n\x0b\f\r", "")).cast("long").alias("word_chars"),
        (F.length("text") - F.length(F.translate("text", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.size("lines").cast("long").alias("n_lines"),
        F.when(F.size("words") >= WINDOW, F.expr(f"transform(sequence(1, size(words) - {WINDOW - 1}), i -> xxhash64(slice(words, i, {WINDOW})))")).alias("_h"),
    )
    rows = rows.withColumn("_s", F.when(F.size(F.array_distinct("_h")) < F.size("_h"), F.expr("array_sort(transform(_h, (x, i) -> struct(x, i)))"))).drop("_h")
    rows = rows.withColumn("_at", F.expr("array_sort(filter(transform(sequence(0, size(_s) - 1), j -> if(coalesce(get(_s, j).x = get(_s, j - 1).x, false) or coalesce(get(_s, j).x = get(_s, j + 1).x, false), get(_s, j).i, -1)), p -> p >= 0))")).drop("_s")
    covered = F.expr(f"aggregate(sequence(0, size(_at) - 1), cast({WINDOW} as bigint), (n, j) -> n + if(j > 0, least({WINDOW}, get(_at, j) - get(_at, j - 1)), 0))")
    return rows.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0)).cast("long")).drop("_at")


def _fences(sketch: DataFrame, min_rows: int, reach: int) -> DataFrame:
    """A row of fences for each language and source, from sketches of (lang, source, metric, bucket, n).

    Where language and source have under ``min_rows`` documents, the merged sketch of the
    language serves, or else that of everything.
    """
    levels = []
    for keep in (("lang", "source"), ("lang",), ()):
        own = sketch.groupBy(*keep, "metric", "bucket").agg(F.sum("n").alias("n"))
        group = Window.partitionBy(*keep, "metric")
        below = F.sum("n").over(group.orderBy("bucket"))
        total = F.sum("n").over(group)
        own = own.select(*keep, "metric", "bucket", below.alias("below"), total.alias("total"))
        quartiles = own.groupBy(*keep, "metric").agg(F.max("total").alias("total"), F.min(F.when(F.expr("4 * below >= total"), F.col("bucket"))).alias("q1"), F.min(F.when(F.expr("4 * below >= 3 * total"), F.col("bucket"))).alias("q3"))
        spread = F.col("q3") - F.col("q1")
        ends = []
        for m, (low, high, slack) in METRICS.items():
            ends += [F.max(F.when(F.col("metric") == m, F.col("q1") - reach * spread - slack)).alias(f"low_{m}")] * low
            ends += [F.max(F.when(F.col("metric") == m, F.col("q3") + reach * spread + slack)).alias(f"high_{m}")] * high
        levels.append(quartiles.groupBy(*keep).agg(F.max("total").alias("total"), *ends))
    names = [c for c in levels[0].columns if c.startswith(("low_", "high_"))]
    renamed = [x.select(*[F.col(c).alias(f"{c}_{i}") for c in x.columns]) for i, x in enumerate(levels)]
    fine, mid, top = renamed
    out = fine.join(mid, F.col("lang_0").eqNullSafe(F.col("lang_1"))).join(F.broadcast(top))  # one row
    pick = lambda c: F.when(F.col("total_0") >= min_rows, F.col(f"{c}_0")).when(F.col("total_1") >= min_rows, F.col(f"{c}_1")).otherwise(F.col(f"{c}_2"))
    return out.select(F.col("lang_0").alias("_lang"), F.col("source_0").alias("_source"), *[pick(c).alias(c) for c in names])


def quality_rules(docs: DataFrame, min_words: int = 20, max_repeat_percent: int = 30, min_rows: int = 50, reach: int = 3) -> DataFrame:
    """Statistics of each whole text and whether it is kept.

    A text fails the base with under ``min_words`` words or more than ``max_repeat_percent``
    percent of them in repeated windows.  Of the others, one is dropped when a metric lies
    beyond the fences of its language and source: ``reach`` interquartile ranges and a slack
    outside the quartiles of the sketch.  Sketches cover all documents that pass the base.

    Null text: no words, so it fails.  Null language or source: a group like any other.
    Repeated rows give a row each and weigh in the sketches as often; an empty table gives an
    empty one; further columns are left out, whatever their names.
    """
    stats = text_statistics(docs)
    stats = stats.withColumns({
        "base_failed": F.expr(f"n_words < {min_words} or 100 * n_repeat_words > {max_repeat_percent} * n_words"),
        "word_len10": _share("word_chars", "n_words", 10),
        "symbols_pm": _share("n_symbols", "word_chars", 1000),
        "dup_lines_pm": _share("n_dup_lines", "n_lines", 1000),
        "repeat_pm": _share("n_repeat_words", "n_words", 1000),
        # sixteen steps to each doubling
        "length_step": F.expr("if(n_words < 32, n_words, shiftright(n_words, length(bin(n_words)) - 5) + 16 * (length(bin(n_words)) - 5))").cast("long"),
    })
    stats = materialize(stats)
    long = stats.filter("not base_failed").select("lang", "source", F.explode(F.create_map(*[x for m in METRICS for x in (F.lit(m), F.col(m))])).alias("metric", "bucket"))
    sketch = long.groupBy("lang", "source", "metric", "bucket").agg(F.count("*").alias("n"))
    fences = _fences(sketch, min_rows, reach)
    joined = stats.join(fences, F.col("lang").eqNullSafe(F.col("_lang")) & F.col("source").eqNullSafe(F.col("_source")), "left")
    inside = F.lit(True)
    for m, (low, high, _) in METRICS.items():
        inside &= (F.col(m) >= F.col(f"low_{m}")) if low else F.lit(True)
        inside &= (F.col(m) <= F.col(f"high_{m}")) if high else F.lit(True)
    kept = ~F.col("base_failed") & F.coalesce(inside, F.lit(True))
    return joined.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", kept.alias("kept"))


SQL = r"""
WITH d AS (SELECT doc_id, lang, source, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, list_filter(string_split_regex(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words,
        list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d),
win AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, list_slice(words, i, i + 7)) AS c
        FROM (SELECT doc_id, words, unnest(range(1, len(words) - 6)) AS i FROM w WHERE len(words) >= 8)),
cov AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM win, range(0, 8) AS t(k) WHERE c > 1 GROUP BY doc_id),
s AS (SELECT w.doc_id, lang, source, CAST(len(words) AS BIGINT) AS n_words,
        CAST(length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
        CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
        CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, CAST(len(lines) AS BIGINT) AS n_lines,
        CAST(coalesce(cov.n, 0) AS BIGINT) AS n_repeat_words FROM w LEFT JOIN cov ON cov.doc_id = w.doc_id),
m AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
        CASE WHEN n_words > 0 THEN least(1000, word_chars * 10 // n_words) ELSE 0 END AS word_len10,
        CASE WHEN word_chars > 0 THEN least(1000, n_symbols * 1000 // word_chars) ELSE 0 END AS symbols_pm,
        CASE WHEN n_lines > 0 THEN least(1000, n_dup_lines * 1000 // n_lines) ELSE 0 END AS dup_lines_pm,
        CASE WHEN n_words > 0 THEN least(1000, n_repeat_words * 1000 // n_words) ELSE 0 END AS repeat_pm,
        CASE WHEN n_words < 32 THEN n_words ELSE (n_words >> (length(bin(n_words)) - 5)) + 16 * (length(bin(n_words)) - 5) END AS length_step FROM s),
l AS (UNPIVOT (SELECT lang, source, word_len10, symbols_pm, dup_lines_pm, repeat_pm, length_step FROM m WHERE NOT base_failed)
      ON word_len10, symbols_pm, dup_lines_pm, repeat_pm, length_step INTO NAME metric VALUE bucket),
q AS (SELECT 0 AS level, lang, source, metric, count(*) AS total, quantile_disc(bucket, 0.25) AS q1, quantile_disc(bucket, 0.75) AS q3 FROM l GROUP BY ALL
      UNION ALL SELECT 1, lang, NULL, metric, count(*), quantile_disc(bucket, 0.25), quantile_disc(bucket, 0.75) FROM l GROUP BY lang, metric
      UNION ALL SELECT 2, NULL, NULL, metric, count(*), quantile_disc(bucket, 0.25), quantile_disc(bucket, 0.75) FROM l GROUP BY metric),
slack AS (SELECT * FROM (VALUES ('word_len10', true, true, 15), ('symbols_pm', false, true, 15), ('dup_lines_pm', false, true, 150),
      ('repeat_pm', false, true, 100), ('length_step', true, false, 16)) AS v(metric, has_low, has_high, slack)),
x AS (UNPIVOT (SELECT doc_id, lang, source, word_len10, symbols_pm, dup_lines_pm, repeat_pm, length_step FROM m WHERE NOT base_failed)
      ON word_len10, symbols_pm, dup_lines_pm, repeat_pm, length_step INTO NAME metric VALUE bucket),
f AS (SELECT x.doc_id, x.metric, x.bucket, slack.*, q.q1, q.q3,
        row_number() OVER (PARTITION BY x.doc_id, x.metric ORDER BY q.level) AS pick
      FROM x JOIN slack ON slack.metric = x.metric JOIN q ON q.metric = x.metric AND (q.total >= 50 OR q.level = 2)
        AND (q.level = 2 OR q.lang IS NOT DISTINCT FROM x.lang) AND (q.level > 0 OR q.source IS NOT DISTINCT FROM x.source)),
bad AS (SELECT DISTINCT doc_id FROM f WHERE pick = 1 AND ((has_low AND bucket < q1 - 3 * (q3 - q1) - slack) OR (has_high AND bucket > q3 + 3 * (q3 - q1) + slack)))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND doc_id NOT IN (SELECT doc_id FROM bad) AS kept FROM m
"""
