"""Mixing sources to token targets by entropy balancing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window, WindowSpec

from spotcheck.llm.frames import discard, materialize, ordered, running_totals

#: Sums of doubles are taken over whole multiples of 1 / UNIT, so that any order gives the same sum.
UNIT = 1 << 20


def exact_sum(x: Column, over: WindowSpec) -> Column:
    return F.sum(F.round(x * UNIT).cast("decimal(38,0)")).over(over).cast("double") / UNIT


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """A row for each source with ``source_size``: its target.

    Sources in code-point order, null last, take the weights in turn.  They share ``share``
    times all sizes by weight; what lies above ``most`` times a source's size is shared again
    by weight among the others until none is above.
    """
    table = ordered(sizes.withColumn("_last", F.col("source").isNull()), "_last", "source").withColumn("_one", F.lit(1))
    table = running_totals(table, ["_last", "source"], {"_place": "_one"})
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("_place") % len(weights) + 1).cast("int"))
    table = materialize(table.select("source", "source_size", weight.alias("weight"), (F.col("source_size") * most).alias("top")))
    total = table.agg(F.sum("source_size")).first()[0] or 0
    level, capped = 0.0, -1
    while True:  # each turn caps one more source at least
        over = F.col("top") <= F.col("weight") * level
        fixed, open_weight, n = table.agg(F.sum(F.when(over, F.col("top")).otherwise(0.0)), F.sum(F.when(over, 0.0).otherwise(F.col("weight"))), F.count(F.when(over, 1))).first()
        if n == capped or not open_weight:
            break
        level, capped = (share * total - fixed) / open_weight, n
    return table.withColumn("target", F.least(F.col("top"), F.col("weight") * level))


#: Newton steps in one plan: they share one shuffle of the classes by source.
STEPS = 6


def balance(classes: DataFrame, most: float = 2.0, tolerance: float = 1e-6, rounds: int = 60) -> DataFrame:
    """Rates whose expected sizes meet each source's target, by Newton steps on the dual.

    classes: rows of source, size, n (documents of that size), source_size and target.  Among
    all rates between 0 and ``most`` that meet the targets, entropy balancing takes those
    nearest to one copy each in relative entropy: min(most, exp(tilt * size / scale)), with
    one dual variable, the tilt, for each source's constraint.  Each round sums the gradient
    and the curvature over the classes of a source and takes a Newton step, kept inside
    the bracket of the root that the signs of earlier gradients give.  The classes of a source
    (its distinct sizes) carry its state, so rounds need no join, and ``STEPS`` of them are
    one plan; only whether a source is left open comes to the driver.
    """
    whole = Window.partitionBy("source")
    inf = F.lit(1e6)
    now = classes.withColumn("_x", F.col("size") / F.greatest(F.col("source_size") / F.greatest(F.col("source_n"), F.lit(1)), F.lit(1.0)))
    now = now.withColumns({"tilt": F.lit(0.0), "_low": -inf, "_high": inf, "_open": F.lit(True)})
    for done_rounds in range(0, rounds, STEPS):
        before = now
        for _ in range(min(STEPS, rounds - done_rounds)):
            rate = F.least(F.lit(most), F.exp(F.least(F.col("tilt") * F.col("_x"), F.lit(50.0))))
            mass = F.col("n") * F.col("size") * rate
            now = now.withColumns({"_got": exact_sum(mass, whole), "_curve": exact_sum(F.when(rate < most, mass * F.col("_x")).otherwise(0.0), whole)})
            gap = F.col("target") - F.col("_got")
            low = F.when(gap > 0, F.col("tilt")).otherwise(F.col("_low"))
            high = F.when(gap > 0, F.col("_high")).otherwise(F.col("tilt"))
            now = now.withColumns({"_gap": gap, "_low": low, "_high": high})
            newton = F.col("tilt") + F.col("_gap") / F.col("_curve")
            inside = (F.col("_curve") > 0) & (newton > F.col("_low")) & (newton < F.col("_high"))
            halved = F.when(F.col("_high") >= 1e6, F.greatest(F.col("_low") * 2, F.lit(1.0))).when(F.col("_low") <= -1e6, F.least(F.col("_high") * 2, F.lit(-1.0))).otherwise((F.col("_low") + F.col("_high")) / 2)
            done = F.abs("_gap") <= F.greatest(F.lit(tolerance) * F.col("target"), F.lit(1e-3))
            step = F.when(done, F.col("tilt")).when(inside, newton).otherwise(halved)
            now = now.withColumns({"tilt": step, "_open": ~done & (F.col("tilt") < 1e5)}).drop("_got", "_curve", "_gap")
        now = materialize(now)
        discard(before)
        if not now.filter("_open").limit(1).count():
            break
    full = F.col("target") >= most * F.col("source_size")  # only the most of every document meets it
    rate = F.when(full, F.lit(most)).otherwise(F.least(F.lit(most), F.exp(F.least(F.round("tilt", 9) * F.col("_x"), F.lit(50.0)))))
    return now.withColumn("rate", rate).drop("_x", "tilt", "_low", "_high", "_open")


def copies_by_class(classes: DataFrame, most: int = 2) -> DataFrame:
    """Whole copies for each class of equal source and size, from its rate.

    Along the sizes of a source the expected copies are summed and the sum is rounded, so a
    source's words stay within about its largest document of the target.
    """
    along = Window.partitionBy("source").orderBy("size")
    expected = F.sum(F.round(F.col("n") * F.col("rate") * UNIT).cast("long")).over(along)
    upto = F.floor((expected + UNIT // 2) / UNIT)
    out = classes.withColumn("_upto", upto.cast("long"))
    own = F.col("_upto") - F.coalesce(F.lag("_upto").over(along), F.lit(0))
    return out.withColumn("copies", F.least(own, F.col("n") * most)).drop("_upto")


def settle(plan: DataFrame, most: int = 2, rounds: int = 4) -> DataFrame:
    """One copy more or less in the class whose size best fits what a source still lacks or exceeds.

    Each round leaves a smaller gap or none; rounding alone leaves gaps as large as a long document.
    The rounds go over the classes of a source and share one shuffle.
    """
    whole = Window.partitionBy("source")
    for _ in range(rounds):
        at = plan.withColumn("_gap", F.col("target") - F.sum(F.col("copies") * F.col("size")).over(whole))
        size = F.abs("_gap")
        fits = F.when(F.col("_gap") > 0, F.col("copies") < F.col("n") * most).otherwise(F.col("copies") > 0) & (F.col("size") > 0) & (F.col("size") < 2 * size)
        at = at.withColumn("_best", F.min(F.when(fits, F.struct(F.abs(size - F.col("size")).alias("off"), F.col("size").alias("size")))).over(whole))
        step = F.when(F.col("size") == F.col("_best.size"), F.signum("_gap").cast("long")).otherwise(F.lit(0))
        plan = at.withColumn("copies", F.col("copies") + F.coalesce(step, F.lit(0))).drop("_gap", "_best")
    return plan


def word_count(text: Column) -> Column:
    return F.size(F.array_remove(F.split(F.coalesce(text.cast("string"), F.lit("")), "[\\x20\\x09-\\x0D]+"), "")).cast("long")


def mix(docs: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, most: int = 2, salt_rows: int = 2000, with_source: bool = False) -> DataFrame:
    """How many words of each document the mix takes: 0 to ``most`` whole copies of it.

    A document's size is its words ``[^\\x20\\x09-\\x0D]+`` (null text: none).  Rates depend
    on source and size alone, so the Newton rounds run on the table of distinct sources and
    sizes; within a class the documents of smallest id hash get the odd copies.  Ranks in a
    class are taken in salted parts of about ``salt_rows``, so that a third of all rows in
    one class is no single task.

    Null sources are a source of their own, the last.  Repeated rows share one place in turn
    (each row is a document); empty texts take nothing; an empty table gives an empty one;
    further columns are left out; with_source adds the row's source.
    """
    words = word_count(F.col("text"))
    rows = materialize(docs.select(F.col("doc_id").cast("long"), F.col("source").cast("string"), words.alias("size"), F.xxhash64("doc_id", F.lit(6)).alias("_h")))
    classes = materialize(rows.groupBy("source", "size").agg(F.count("*").alias("n")))
    sizes = classes.groupBy("source").agg(F.sum(F.col("n") * F.col("size")).alias("source_size"), F.sum("n").alias("source_n"))
    targets = source_targets(sizes.select("source", "source_size"), weights, share, most)
    # both are small: a row for each source
    known = sizes.join(targets.select(F.col("source").alias("_source"), "target"), F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    withs = classes.join(known.withColumnRenamed("source", "_source"), F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    plan = settle(copies_by_class(balance(withs, most), most), most)
    plan = plan.select(F.col("source").alias("_source"), F.col("size").alias("_size"), "n", "source_size", "target", "copies", F.ceil(F.col("n") / salt_rows).alias("_parts"))
    plan = materialize(plan)
    joined = rows.join(plan, F.col("source").eqNullSafe(F.col("_source")) & (F.col("size") == F.col("_size")))
    part = F.floor(F.shiftrightunsigned("_h", 32) * F.col("_parts") / F.lit(1 << 32))
    joined = joined.withColumn("_part_no", part)
    keys = ["source", "size", "_part_no"]
    counts = joined.groupBy(*keys).agg(F.count("*").alias("_n"))
    before = Window.partitionBy("source", "size").orderBy("_part_no").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select(F.col("source").alias("_s"), F.col("size").alias("_z"), F.col("_part_no").alias("_p"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    inner = F.row_number().over(Window.partitionBy(*keys).orderBy("_h", "doc_id")) - 1
    ranked = joined.withColumn("_rank", inner).join(counts, F.col("source").eqNullSafe(F.col("_s")) & (F.col("size") == F.col("_z")) & (F.col("_part_no") == F.col("_p")))
    whole, odd = F.floor(F.col("copies") / F.col("n")), F.col("copies") % F.col("n")
    own = whole + F.when(F.col("_rank") + F.col("_base") < odd, 1).otherwise(0)
    return ranked.select("doc_id", "size", "source_size", "target", (own * F.col("size")).cast("long").alias("taken"), own.cast("int").alias("copies"), *["source"] * with_source)
