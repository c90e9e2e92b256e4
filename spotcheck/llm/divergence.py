"""How far the sources of a language diverge, and by which terms.

Terms are counted by one pass over the texts.  What follows sees cells, not terms: all terms
with the same counts give the same value, so a value is computed once for a cell and weighted
by its number of terms, and only the cells that hold the first ranks are opened again.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from spotcheck.llm.frames import materialize, text_batches
from spotcheck.llm.textbytes import chunks, mix, prefix_hash, slice_hash, tidy, words

_GAP = np.ones(256, bool)
_GAP[0x41:0x5B] = _GAP[0x61:0x7B] = _GAP[0x80:] = False
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32
#: Probabilities are whole numbers of this scale.
SCALE = 1_000_000_000


def term_counts(docs: DataFrame) -> DataFrame:
    """lang, source, term, n (occurrences), in_docs: terms ``[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+`` of each group, A-Z lower-cased.

    Each task adds up the terms of a piece of a batch before anything is shuffled.
    """

    def count(batches):
        for batch in batches:
            names = [batch.column(c).to_pylist() for c in ("lang", "source")]
            for lo, hi, data, offsets in chunks(batch, "text", limit=1 << 20):
                low = _LOWER[data]
                starts, ends, of = words(low, offsets, _GAP)
                if not len(starts):
                    continue
                groups: dict[tuple, int] = {}
                group = np.array([groups.setdefault(g, len(groups)) for g in zip(names[0][lo:hi], names[1][lo:hi], strict=True)])
                h = slice_hash(prefix_hash(low), starts, ends)
                h = mix(h + group[of].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
                order = np.lexsort((of, h))
                h, of = h[order], of[order]
                new = np.append(True, h[1:] != h[:-1])
                first = np.flatnonzero(new)
                n = np.diff(np.append(first, len(h)))
                in_docs = np.add.reduceat((new | np.append(True, of[1:] != of[:-1])).astype(np.int64), first)
                one = order[first]
                raw = low.tobytes()
                terms = [raw[a:b].decode("utf-8", "replace") for a, b in zip(starts[one].tolist(), ends[one].tolist(), strict=True)]
                keys = list(groups)
                of_group = group[of[first]]
                take = [pa.array([k[i] for k in keys], pa.string()).take(pa.array(of_group)) for i in (0, 1)]
                yield pa.RecordBatch.from_arrays([*take, pa.array(terms, pa.string()), pa.array(n), pa.array(in_docs)], ["lang", "source", "term", "n", "in_docs"])

    read = text_batches(_groups_read(docs, "text")).mapInArrow(tidy(count), "lang string, source string, term string, n long, in_docs long")
    return read.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("in_docs").alias("in_docs"))


def _groups_read(docs: DataFrame, *more: str) -> DataFrame:
    return docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", *more)])


def _share(n: str, total: str) -> str:
    """SQL of 1 + floor(SCALE * (n + 2) / (total + 2 * kept)), exactly; without kept terms nothing uses it."""
    return f"1 + (cast({SCALE} as decimal(10,0)) * cast({n} + 2 as decimal(19,0))) div cast(greatest({total} + 2 * kept, 1) as decimal(20,0))"


def _apart(p: str, q: str) -> Column:
    """floor((p - q) * (p - q) / (p + q)), exactly: both are SCALE + 1 at most, so the square is a long."""
    return F.expr(f"(({p} - {q}) * ({p} - {q})) div ({p} + {q})")


def kept_terms(docs: DataFrame, least: int = 10) -> tuple[DataFrame, DataFrame]:
    """The terms that ``least`` documents of their language hold, and all groups.

    First table: lang, source, term, n, lang_n, for counts above 0.  Second: lang, source,
    total (of n), present (terms), lang_total, kept (terms of the language).
    """
    same = Window.partitionBy("lang", "term")
    wide = term_counts(docs).select("lang", "source", "term", "n", F.sum("n").over(same).alias("lang_n"), F.sum("in_docs").over(same).alias("_docs"), (F.row_number().over(same.orderBy("source")) == 1).alias("_first"))
    terms = materialize(wide.filter(F.col("_docs") >= least).drop("_docs"))
    sums = terms.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.count("*").alias("present"), F.sum(F.col("_first").cast("long")).alias("_firsts"))
    groups = _groups_read(docs).distinct().join(sums, ["lang", "source"], "left").fillna(0, ["total", "present", "_firsts"])
    lang = Window.partitionBy("lang")
    groups = groups.select("lang", "source", "total", "present", F.sum("total").over(lang).alias("lang_total"), F.sum("_firsts").over(lang).alias("kept"))
    return terms.drop("_first"), materialize(groups)


def leading_terms(terms: DataFrame, groups: DataFrame, top: int = 10) -> DataFrame:
    """lang, source, item, value, rank: the terms by which a group stands out of its language, down to rank ``top``.

    The terms of a group with one pair of counts are a cell.  Cells are ranked by the number
    of terms in cells of larger value, equal values together; only cells that begin at or
    above ``top`` are opened, and their terms are ranked in the order of their bytes.
    """
    group = Window.partitionBy("lang", "source")
    cells = terms.groupBy("lang", "source", "n", "lang_n").agg(F.count("*").alias("_terms")).join(groups, ["lang", "source"])
    cells = cells.withColumn("_p", F.expr(_share("n", "total"))).withColumn("_q", F.expr(_share("lang_n", "lang_total"))).filter("_p > _q")
    cells = cells.withColumn("value", _apart("_p", "_q"))
    above = F.coalesce(F.sum("_terms").over(group.orderBy(-F.col("value")).rangeBetween(Window.unboundedPreceding, -1)), F.lit(0))
    first = cells.withColumn("_above", above).filter(F.col("_above") < top).select("lang", "source", "n", "lang_n", "value")
    opened = terms.join(first, ["lang", "source", "n", "lang_n"])
    rank = F.row_number().over(group.orderBy(F.desc("value"), "term"))
    return opened.withColumn("rank", rank).filter(F.col("rank") <= top).select("lang", "source", F.col("term").alias("item"), "value", "rank")


def source_pairs(terms: DataFrame, groups: DataFrame) -> DataFrame:
    """lang, source, item, value, rank: how far each other source of the language is from a source, over all kept terms.

    Both counts of a term make its cell.  What terms of one source alone add follows from the
    source's own counts; cells of terms that both have correct that sum; terms of neither are
    one cell.  So no row is made for a term that a source lacks, and the terms of two sources
    meet only where both have them.
    """
    a = groups.select("lang", F.col("source").alias("a"), F.col("total").alias("total_a"), F.col("present").alias("present_a"), "kept")
    b = groups.select("lang", F.col("source").alias("b"), F.col("total").alias("total_b"), F.col("present").alias("present_b"))
    zeros = {"a0": F.expr(_share("0", "total_a")), "b0": F.expr(_share("0", "total_b"))}
    pairs = materialize(a.join(b, "lang").filter("a < b").withColumns(zeros))  # the rows of the result, halved
    value = {
        "none": pairs.select("lang", "a", "b", ((F.col("kept") - F.col("present_a") - F.col("present_b")) * _apart("a0", "b0")).alias("_v")),
    }
    counts = terms.groupBy("lang", "source", "n").agg(F.count("*").alias("_terms"))
    for one, other in (("a", "b"), ("b", "a")):
        met = counts.withColumnRenamed("source", one).join(pairs, ["lang", one]).withColumn("_p", F.expr(_share("n", f"total_{one}")))
        value[one] = met.select("lang", "a", "b", (F.col("_terms") * _apart("_p", f"{other}0")).alias("_v"))
    left, right = terms.select("lang", "term", F.col("source").alias("a"), F.col("n").alias("_na")), terms.select("lang", "term", F.col("source").alias("b"), F.col("n").alias("_nb"))
    both = left.join(right, ["lang", "term"]).filter("a < b").groupBy("lang", "a", "b", "_na", "_nb").agg(F.count("*").alias("_terms"))
    both = both.join(pairs, ["lang", "a", "b"]).withColumns({"_p": F.expr(_share("_na", "total_a")), "_q": F.expr(_share("_nb", "total_b"))})
    more = _apart("_p", "_q") - _apart("_p", "b0") - _apart("a0", "_q") + _apart("a0", "b0")
    value["both"] = both.select("lang", "a", "b", (F.col("_terms") * more).alias("_v"))
    rows = value["none"]
    for name in ("a", "b", "both"):
        rows = rows.unionByName(value[name])
    sums = rows.groupBy("lang", "a", "b").agg(F.sum("_v").alias("value"))
    sides = F.explode(F.array(F.struct(F.col("a").alias("source"), F.col("b").alias("item")), F.struct(F.col("b").alias("source"), F.col("a").alias("item")))).alias("_s")
    out = sums.select("lang", "value", sides).select("lang", "_s.source", "_s.item", "value")
    return out.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")))


def audit_sources(docs: DataFrame, least: int = 10, top: int = 10) -> DataFrame:
    """lang, source, part, item, value, rank: ``source_pairs`` as part ``pair`` and ``leading_terms`` as part ``term``.

    Nulls of text, lang and source read as empty; a group whose texts have no term takes part;
    a language without kept terms gives pairs of value 0 and no terms; repeated rows are
    documents of their own; ties stand in UTF-8 order; an empty table gives an empty one;
    further columns are not read.
    """
    terms, groups = kept_terms(docs, least)
    parts = [(source_pairs(terms, groups), "pair"), (leading_terms(terms, groups, top), "term")]
    pair, term = (df.select("lang", "source", F.lit(part).alias("part"), "item", "value", F.col("rank").cast("int")) for df, part in parts)
    return pair.unionByName(term)


SQL = r"""
WITH d AS (SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents),
w AS (SELECT id, lang, source, translate(unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS term FROM d),
k AS (SELECT lang, term, count(*) AS lang_n FROM w GROUP BY lang, term HAVING count(DISTINCT id) >= 10),
v AS (SELECT lang, count(*) AS kept, sum(lang_n) AS lang_total FROM k GROUP BY lang),
n AS (SELECT lang, source, term, count(*) AS n FROM w JOIN k USING (lang, term) GROUP BY ALL),
g AS (SELECT lang, source, coalesce(total, 0) AS total FROM (SELECT DISTINCT lang, source FROM d) LEFT JOIN (SELECT lang, source, sum(n) AS total FROM n GROUP BY ALL) USING (lang, source)),
c AS (SELECT g.lang, g.source, k.term, coalesce(n.n, 0) AS n, CAST(1 + 1000000000::HUGEINT * (coalesce(n.n, 0) + 2) // (g.total + 2 * v.kept) AS BIGINT) AS p,
        CAST(1 + 1000000000::HUGEINT * (k.lang_n + 2) // (v.lang_total + 2 * v.kept) AS BIGINT) AS q
      FROM g JOIN k USING (lang) JOIN v USING (lang) LEFT JOIN n ON n.lang = g.lang AND n.source = g.source AND n.term = k.term),
f AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value
      FROM c AS a JOIN c AS b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
r AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(f.value, 0) AS BIGINT) AS value
      FROM g AS a JOIN g AS b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source
      UNION ALL SELECT lang, source, 'term', term, (p - q) * (p - q) // (p + q) FROM c WHERE n > 0 AND p > q)
SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM r) WHERE part = 'pair' OR rank <= 10
"""
