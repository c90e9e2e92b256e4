"""Deferred acceptance: rows of one side work down ordered lists of the other side.

The lists are written once.  What changes is one row for each left row, which says where it
stands in which of its lists; a round moves these rows alone.
"""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Observation, functions as F
from pyspark.sql.window import Window

from spotcheck.sources.staging import discard, materialize

#: Lists of no more places than this, some 30 MB, are broadcast to the rows that ask; others are partitioned by place.
BROADCAST_PLACES = 1 << 20


def numbered(kinds: DataFrame) -> DataFrame:
    """Distinct rows with a number ``list`` each, written, so that the numbers stay."""
    return materialize(kinds.distinct().withColumn("list", F.monotonically_increasing_id()))


def with_number(rows: DataFrame, kinds: DataFrame, name: str) -> DataFrame:
    """``rows`` with the number of their kind in column ``name``; nulls meet nulls."""
    keys = [c for c in kinds.columns if c != "list"]
    k = kinds.select(*[F.col(c).alias(f"_k_{c}") for c in keys], F.col("list").alias(name))
    met = [F.col(c).eqNullSafe(F.col(f"_k_{c}")) for c in keys]
    out = rows.join(k, met[0] if len(met) == 1 else F.expr(" and ".join(f"{c} <=> _k_{c}" for c in keys)), "left")
    return out.drop(*[f"_k_{c}" for c in keys])


def in_order(rows: DataFrame, *order: str) -> DataFrame:
    """Rows with their place ``pos``, from 0, in the order of their ``list``."""
    return rows.withColumn("pos", F.row_number().over(Window.partitionBy("list").orderBy(*order)).cast("long") - 1)


def days_of(lists: DataFrame, day: str) -> DataFrame:
    """list, ``day``, and the places lo to hi of the rows of that day, in lists that are in the order of ``day``."""
    before = Window.partitionBy("list").orderBy(day).rowsBetween(Window.unboundedPreceding, -1)
    days = lists.groupBy("list", day).agg(F.count("*").alias("_n"))
    return days.withColumn("lo", F.coalesce(F.sum("_n").over(before), F.lit(0))).withColumn("hi", F.col("lo") + F.col("_n") - 1).drop("_n")


def from_day(asked: DataFrame, lists: DataFrame, day: str, after: bool) -> DataFrame:
    """``asked`` (list and ``day``) with the places lo to hi of all rows on or after that day (strictly after it, if asked), in lists that are in its order."""
    days = lists.groupBy("list", day).agg(F.count("*").alias("_n"))
    points = asked.select("list", day).distinct().withColumn("_n", F.lit(0).cast("long"))
    upto = Window.partitionBy("list").orderBy(day).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    own, whole = Window.partitionBy("list", day), Window.partitionBy("list")
    counts = days.unionByName(points).select("list", day, "_n", (F.sum("_n").over(upto) - (F.lit(0) if after else F.sum("_n").over(own))).alias("lo"), (F.sum("_n").over(whole) - 1).alias("hi"))
    return asked.join(counts.filter("_n = 0 and lo <= hi").drop("_n"), ["list", day])


def settle(wishes: DataFrame, lists: DataFrame, shared: bool = True, rounds: int = 4) -> DataFrame:
    """left, right, seg: the only stable matching, in which each left row goes as far up its lists as it can.

    wishes: left and wishes, an array in the order of a left row's lists (few each) of structs
    seg, list (a number), lo, hi (the places that it may take there, first best) and key (what
    rights prefer by, least first; no two left rows have one).  lists: a written table of list,
    pos (from 0, without gaps), right, and, unless ``shared``, the key of each place.

    In a line (one of a shared list, unless wishes name several) lo never falls as keys rise.
    Of two of its wishes the later one can't end before the earlier one, so a row moves down
    past all that stand before it in one step: the i-th may stand at max(pos_j - j) + i, less
    one for each row in between that fell off its own end.  A chain of rows that want the same
    places is therefore one round, not one round each.  Rows count from where a line begins
    anew, at a place that none of the earlier ones can reach.

    All rounds move a row for each left row; lists stay where they are, partitioned by place.
    The wishes of one list are sorted in one task (a streaming window).  ``rounds`` is the
    number that one job makes before it looks whether any row was shut out.  If wishes has a
    column ``region``, of which no two share a right, only regions where one was go on.
    """
    extra = ["region"] if "region" in wishes.columns else []
    state = wishes.filter(F.size("wishes") > 0).select("left", "wishes", F.lit(0).alias("at"), F.col("wishes")[0]["lo"].alias("pos"), *extra)
    places = lists.select("list", "pos", "right", *([] if shared else ["key"]))
    small, kept = lists.count() <= BROADCAST_PLACES, None
    if small:
        places = F.broadcast(places)
    else:  # partitioned once, for all rounds
        kept = places = places.repartition(int(lists.sparkSession.conf.get("spark.sql.shuffle.partitions")), "list", "pos").persist(StorageLevel.DISK_ONLY)
    before, done, tables = None, [], []
    while True:
        for i in range(1 if extra and not done else rounds):
            state = _round(state, places, shared, move=shared and (i == 0 or bool(extra)))
        seen = Observation()
        state = materialize(state.observe(seen, F.count(F.when(F.col("lost"), 1)).alias("lost")))
        if not seen.get["lost"]:
            break
        if not extra:
            discard(before)
            before, state = state, state.select("left", "wishes", "at", "pos")
            continue
        tables.append(state)
        open_ = state.filter("lost").select("region").distinct()
        done.append(state.join(open_, "region", "left_anti"))
        state = state.join(open_, "region", "left_semi").select("left", "wishes", "at", "pos", "region")
        if not small:  # the places that these may still take
            wanted = state.select(F.explode("wishes").alias("w")).select("w.list").distinct()
            some = materialize(lists.join(wanted, "list", "left_semi").select(places.columns))
            tables.append(some)
            small = some.count() <= BROADCAST_PLACES
            if small:
                places = F.broadcast(some)
    if kept is not None:
        kept.unpersist()
    if not extra:
        discard(before)
    chosen = lambda rows: rows.select("left", "right", F.col("wishes")[F.col("at")]["seg"].alias("seg"))
    if not done:
        return chosen(state)
    out = chosen(state)
    for rows in done:
        out = out.unionByName(chosen(rows))
    out = materialize(out)
    discard(state, *tables)
    return out


def wish(seg: int | Column, list_: str | Column, key: Column, line: Column | None = None) -> Column:
    """A wish for the places lo to hi of a list; ``line`` is a number of those of it whose lo never falls as keys rise."""
    return F.struct(F.lit(seg).cast("int").alias("seg"), (F.col(list_) if isinstance(list_, str) else list_).alias("list"), F.col("lo").cast("long").alias("lo"), F.col("hi").cast("long").alias("hi"), key.alias("key"), (F.lit(0) if line is None else line).cast("long").alias("line"))


def _round(state: DataFrame, places: DataFrame, shared: bool, move: bool) -> DataFrame:
    """All rows ask at their places; those that a better row shuts out go on by one.  ``move``: first past all that stand before them."""
    now = F.col("wishes")[F.col("at")]
    extra = ["region"] if "region" in state.columns else []
    if move:
        state = state.select("left", "wishes", "at", "pos", *extra, now["list"].alias("list"), now["line"].alias("_in"), now["key"].alias("_key"))
        line = Window.partitionBy("list", "_in").orderBy("_key")
        reach = F.max(now["hi"]).over(line.rowsBetween(Window.unboundedPreceding, -1))
        state = state.withColumn("_anew", F.coalesce((F.col("pos") > reach).cast("long"), F.lit(0)))
        state = state.withColumn("_part", F.sum("_anew").over(line.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
        line = Window.partitionBy("list", "_in", "_part").orderBy("_key")
        state = state.withColumn("_i", F.row_number().over(line))
        state = state.withColumn("_least", F.max(F.col("pos") - F.col("_i")).over(line.rowsBetween(Window.unboundedPreceding, Window.currentRow)) + F.col("_i"))
        fell = F.coalesce(F.sum((F.col("_least") > now["hi"]).cast("long")).over(line.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        state = state.select("left", "wishes", "at", F.greatest(F.col("pos"), F.col("_least") - fell).alias("pos"), *extra)
    over = F.col("pos") > now["hi"]
    state = state.filter(~over | (F.col("at") + 1 < F.size("wishes")))
    state = state.select("left", "wishes", (F.col("at") + over.cast("int")).alias("at"), F.when(over, F.get("wishes", F.col("at") + 1)["lo"]).otherwise(F.col("pos")).alias("pos"), *extra)
    met = state.withColumn("list", now["list"]).join(places, ["list", "pos"])
    key = now["key"] if shared else F.col("key")
    first = F.row_number().over(Window.partitionBy("right").orderBy(key)) == 1
    return met.select("left", "wishes", "at", (F.col("pos") + (~first).cast("long")).alias("pos"), *extra, "right", (~first).alias("lost"))
