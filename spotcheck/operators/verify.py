"""Planned spots against observed airings."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.window import Window

from spotcheck.functions.scalars import clean_channel, end_of_window, normalize, word_overlap
from spotcheck.operators.assign import assign
from spotcheck.operators.mapping import brand_themes, with_themes
from spotcheck.operators.settle import days_of, from_day, in_order, numbered, settle, wish, with_number
from spotcheck.sources.staging import discard, materialize

OVERSHOOT, OVERLAP = 600, 0.5
#: Verdict of each pass.
VERDICTS = {1: "matched", 2: "mismatch", 3: "mismatch", 4: "late_telecast"}


#: What a spot and an airing of one of its themes have to share.
KEY = ["account_id", "channel_key", "theme_key", "duration"]
#: Airings of a spot's window; one without a bound, or an airing without a time, lies in it as far as is known.
INSIDE = "coalesce(air_secs between start_secs and stop, start_secs is null or stop is null)"


def _sides(spots: DataFrame, logs: DataFrame, mappings: DataFrame, source: str) -> tuple[DataFrame, DataFrame]:
    """Spots with a row for each theme, and airings, under the names that they meet by."""
    s = with_themes(spots, brand_themes(mappings, logs, source))
    s = s.withColumns({"channel_key": clean_channel(F.col("channel")), "theme_key": normalize(F.col("advt_theme")), "stop": end_of_window(F.col("start_secs"), F.col("end_secs"))})
    s = s.select("spot_id", *KEY, "spot_date", "start_secs", "stop", "programme", "schedule_number", "map_product")
    product = normalize(F.col("product")) if "product" in logs.columns else F.lit("")
    r = logs.select("log_id", "account_id", clean_channel(F.col("channel")).alias("channel_key"), normalize(F.col("advt_theme")).alias("theme_key"), "duration", "log_date", "air_secs", "program", product.alias("log_product"))
    return s, r


def _of_the_day(s: DataFrame, r: DataFrame) -> list[DataFrame]:
    """Rows of spots with airings of their day, for each of the first three passes; ``pass`` is a constant in each.

    Windows meet by their hours (those without a bound by the day), ends by blocks of ten
    minutes, programmes by the pairs of names that agree.
    """
    r, by = r.withColumn("spot_date", F.col("log_date")), [*KEY, "spot_date"]
    over, bounds = F.col("air_secs") - F.col("stop"), F.col("start_secs").isNotNull() & F.col("stop").isNotNull()
    after = F.coalesce((over > 0) & (over <= OVERSHOOT), F.lit(False))
    a, b = F.floor(F.col("start_secs") / 3600), F.floor(F.col("stop") / 3600)
    hours = s.filter(bounds & (F.col("start_secs") <= F.col("stop"))).withColumn("_hour", F.explode(F.sequence(a, b)))
    inside = hours.join(r.withColumn("_hour", F.floor(F.col("air_secs") / 3600)), [*by, "_hour"]).drop("_hour")
    inside = inside.unionByName(s.filter(~bounds).join(r, by)).filter(INSIDE)
    block = F.floor(F.col("stop") / OVERSHOOT)
    ends = s.filter("stop is not null").withColumn("_block", F.explode(F.array(block, block + 1)))
    late = ends.join(r.withColumn("_block", F.floor(F.col("air_secs") / OVERSHOOT)), [*by, "_block"]).drop("_block").filter(after)
    named = _programmes(s, r)
    like = s.join(named, F.expr("account_id = _a and programme <=> _p")).drop("_a", "_p").alias("s").join(r.alias("r"), F.expr(" and ".join([*(f"s.{c} = r.{c}" for c in by), "s._q <=> r.program"])))
    like = like.select("s.*", *[f"r.{c}" for c in r.columns if c not in by]).drop("_q").filter(f"not {INSIDE}").filter(~after)
    with_pass = lambda df, n, measure: df.withColumns({"pass": F.lit(n), "measure": measure.cast("bigint")})
    return [with_pass(inside, 1, F.lit(0)), with_pass(late, 2, over), with_pass(like, 3, F.col("air_secs"))]


def _later(s: DataFrame, r: DataFrame) -> DataFrame:
    """Rows of spots with airings in their window on any day, met by the hours of the window."""
    hours = s.withColumn("_hour", F.explode(F.sequence(F.floor(F.coalesce("start_secs", F.lit(0)) / 3600), F.floor(F.coalesce("stop", F.lit(86400)) / 3600))))
    return hours.join(r.withColumn("_hour", F.floor(F.col("air_secs") / 3600)), [*KEY, "_hour"]).drop("_hour").filter(INSIDE)


#: A mapping's product, if any, has to be the airing's.
SAME_PRODUCT = "map_product = '' or map_product = log_product"


def candidates(spots: DataFrame, logs: DataFrame, mappings: DataFrame, source: str = "theme") -> DataFrame:
    """All pairs that some pass allows, with the first such pass and its measure.

    1: aired in the window; 2: up to ten minutes after it; 3: same day under the same
    programme; 4: on a later day, in the window.  Each pass joins by what its pairs share, and
    a filter on ``pass`` leaves out the joins of the others.
    """
    s, r = _sides(spots, logs, mappings, source)
    late = _later(s, r).filter("log_date > spot_date").withColumns({"pass": F.lit(4), "measure": F.lit(0).cast("bigint")})
    cols = [*KEY, "spot_id", "log_id", "schedule_number", "pass", "spot_date", "start_secs", "measure", "log_date", "air_secs"]
    out = None
    for pairs in (*_of_the_day(s, r), late):
        pairs = pairs.filter(SAME_PRODUCT).select(cols)
        out = pairs if out is None else out.unionByName(pairs)
    return out


def candidate_counts(spots: DataFrame, logs: DataFrame, mappings: DataFrame, source: str = "theme") -> DataFrame:
    """pass, n, spots, logs: the number of candidates, and of the spots and airings among them.

    Pairs are counted, not made: airings meet each distinct window of a class once (for the
    late pass once for all days), and the spots of a window count by their number.
    """
    s, r = _sides(spots, logs, mappings, source)
    s = s.drop("schedule_number")
    kinds = numbered(s.drop("spot_id"))
    late_kinds = numbered(s.drop("spot_id", "spot_date", "programme"))
    s = materialize(with_number(with_number(s, kinds, "_kind"), late_kinds, "_late").select("spot_id", "spot_date", "_kind", "_late"))
    held = kinds.join(s.groupBy(F.col("_kind").alias("list")).agg(F.count("*").alias("_n")), "list")
    met = None
    for pairs in _of_the_day(held, r):
        pairs = pairs.filter(SAME_PRODUCT).select("pass", "list", "log_id", "_n")
        met = pairs if met is None else met.unionByName(pairs)
    met = materialize(met)
    by_log = met.groupBy("pass", "log_id").agg(F.sum("_n").alias("n")).groupBy("pass").agg(F.sum("n").alias("n"), F.count("*").alias("logs"))
    by_spot = s.join(met.select("pass", F.col("list").alias("_kind")).distinct(), "_kind").groupBy("pass", "spot_id").agg(F.lit(1)).groupBy("pass").agg(F.count("*").alias("spots"))
    found = materialize(_later(late_kinds, r).filter(SAME_PRODUCT).select("list", "log_id", "log_date"))
    days = s.filter("spot_date is not null").groupBy(F.col("_late").alias("list"), F.col("spot_date").alias("day")).agg(F.count("*").alias("_p"))
    aired = found.filter("log_date is not null").groupBy("list", F.col("log_date").alias("day")).agg(F.count("*").alias("_q"))
    before = Window.partitionBy("list").orderBy("day").rowsBetween(Window.unboundedPreceding, -1)
    run = days.join(aired, ["list", "day"], "full").fillna(0, ["_p", "_q"]).withColumn("_before", F.coalesce(F.sum("_p").over(before), F.lit(0)))
    total = run.agg(F.sum(F.col("_before") * F.col("_q")).alias("n")).filter("n > 0")
    ends = run.groupBy("list").agg(F.min(F.when(F.col("_p") > 0, F.col("day"))).alias("_first"), F.max(F.when(F.col("_q") > 0, F.col("day"))).alias("_last"))
    some_logs = found.join(ends, "list").filter("log_date > _first").select("log_id").distinct().agg(F.count("*").alias("logs"))
    some_spots = s.join(ends.withColumnRenamed("list", "_late"), "_late").filter("spot_date < _last").select("spot_id").distinct().agg(F.count("*").alias("spots"))
    late = F.lit(4).alias("pass")
    out = by_log.join(by_spot, "pass").select("pass", "n", "spots", "logs")
    return out.unionByName(total.select(late, "n").join(some_spots.select(late, "spots"), "pass").join(some_logs.select(late, "logs"), "pass"))


#: What spots and airings have to share: a class.
CLASS = ["account_id", "channel_key", "brand_key", "duration"]


def class_logs(spots: DataFrame, logs: DataFrame, mappings: DataFrame, source: str = "theme") -> DataFrame:
    """The airings of each brand of the mappings, by class: a row for each brand that a theme may stand for."""
    themes = brand_themes(mappings, logs, source).withColumn("theme_key", normalize(F.col("advt_theme"))).drop("advt_theme").distinct()
    brands = spots.select("account_id", normalize(F.col("brand")).alias("brand_key")).distinct()
    product = normalize(F.col("product")) if "product" in logs.columns else F.lit("")
    r = logs.select("log_id", "account_id", clean_channel(F.col("channel")).alias("channel_key"), normalize(F.col("advt_theme")).alias("theme_key"), "duration", "log_date", "air_secs", "program", product.alias("log_product"))
    met = r.join(themes.join(brands, ["account_id", "brand_key"], "left_semi"), ["account_id", "theme_key"])
    met = met.filter(F.col("map_duration").isNull() | (F.col("map_duration") == F.col("duration")))
    met = met.filter((F.col("map_product") == "") | (F.col("map_product") == F.col("log_product")))
    return met.select(*CLASS, "log_id", "log_date", "air_secs", "program").distinct()


def _carried(r: DataFrame) -> list[str]:
    return [c for c in r.columns if c not in (*CLASS, "program")]


def _in_window(kinds: DataFrame, r: DataFrame) -> DataFrame:
    """The airings of each class and window, joined by the hours of the window."""
    a, b = F.floor(F.coalesce("start_secs", F.lit(0)) / 3600), F.floor(F.coalesce("stop", F.lit(86400)) / 3600)
    hours = kinds.filter(a <= b).withColumn("hour", F.explode(F.sequence(a, b)))
    inside = F.coalesce(F.col("air_secs").between(F.col("start_secs"), F.col("stop")), F.col("start_secs").isNull() | F.col("stop").isNull())
    met = hours.join(r.withColumn("hour", F.floor(F.coalesce("air_secs", F.lit(0)) / 3600)), [*CLASS, "hour"]).filter(inside)
    return met.select("list", *_carried(r))


def _after_window(kinds: DataFrame, r: DataFrame) -> DataFrame:
    """The airings up to ten minutes after each class's ends of windows, joined by blocks of ten minutes."""
    block = F.floor(F.col("stop") / OVERSHOOT)
    ends = kinds.filter("stop is not null").withColumn("block", F.explode(F.array(block, block + 1)))
    over = F.col("air_secs") - F.col("stop")
    met = ends.join(r.withColumn("block", F.floor(F.col("air_secs") / OVERSHOOT)), [*CLASS, "block"]).filter((over > 0) & (over <= OVERSHOOT))
    return met.select("list", *_carried(r))


def _programmes(planned: DataFrame, aired: DataFrame) -> DataFrame:
    """Account _a, planned _p and aired _q names of programmes that agree; names meet by a word."""
    planned, aired = planned.select("account_id", "programme").distinct(), aired.select("account_id", "program").distinct()
    words = lambda c: F.array_distinct(F.array_remove(F.split(normalize(F.col(c)), r"\s+"), ""))
    own = F.when(F.size(words("programme")) == 0, F.array(F.lit(""))).otherwise(words("programme"))  # a name without words is like all
    pairs = planned.withColumn("_w", F.explode(own)).join(aired.withColumn("_w", F.explode(F.concat(words("program"), F.array(F.lit(""))))), ["account_id", "_w"])
    return pairs.filter(word_overlap(F.col("programme"), F.col("program")) >= OVERLAP).select(F.col("account_id").alias("_a"), F.col("programme").alias("_p"), F.col("program").alias("_q")).distinct()


def _under_programme(kinds: DataFrame, r: DataFrame) -> DataFrame:
    """The airings of each class under programmes like the planned one."""
    pairs = _programmes(kinds, r)
    wanted = kinds.join(pairs, F.expr("account_id = _a and programme <=> _p")).select(*CLASS, "list", "_q")
    met = wanted.alias("n").join(r.alias("r"), F.expr(" and ".join([*(f"n.{c} = r.{c}" for c in CLASS), "n._q <=> r.program"]))).select("list", "r.*")
    return met.select("list", *_carried(r))


KINDS = {"_w": (1, ["start_secs", "stop"], _in_window), "_o": (2, ["stop"], _after_window), "_p": (3, ["programme"], _under_programme)}


def _rank_of(n: int):
    return F.lit(n << 48) + F.col("_rank")


def _placed(wishes: DataFrame, lists: DataFrame) -> DataFrame:
    got = settle(wishes, lists, rounds=6)
    return got.select(F.col("left").alias("spot_id"), F.col("right").alias("log_id"), F.col("seg").alias("pass"))


def _own_day(s: DataFrame, n: int, c: str, r: DataFrame, spans: DataFrame, odd: DataFrame | None, taken: DataFrame | None) -> DataFrame:
    """Spots on the airings of their day in the lists ``c``: (spot_id, log_id, pass).

    The free airings of a class and day stand in one list, by time; a window, or the airings of
    a programme, is a span of it.  So windows that hold the same free airings are one line,
    whatever their bounds.  Only airings that are no span have a list of their own.
    """
    free = r.withColumn("_free", F.lit(1)) if taken is None else r.join(taken.select("log_id", F.lit(0).alias("_taken")), "log_id", "left").withColumn("_free", F.coalesce("_taken", F.lit(1))).drop("_taken")
    run = Window.partitionBy("_base").orderBy("_pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    free = materialize(free.select("_base", "_pos", "log_id", "log_date", "air_secs", "_free", F.sum("_free").over(run).alias("_run")))
    lists = free.filter("_free = 1").select(F.col("_base").alias("list"), (F.col("_run") - 1).alias("pos"), F.col("log_id").alias("right"))
    solid = spans.filter(f"_kind = '{c}' and _solid").join(free.select("_base", F.col("_pos").alias("_lo"), (F.col("_run") - F.col("_free")).alias("lo")), ["_base", "_lo"])
    solid = solid.join(free.select("_base", F.col("_pos").alias("_hi"), (F.col("_run") - 1).alias("hi")), ["_base", "_hi"]).filter("lo <= hi")
    solid = solid.select(F.col("list").alias(c), F.col("log_date").alias("spot_date"), F.col("_base").alias("list"), "lo", "hi")
    if odd is not None:
        own = odd.join(free.filter("_free = 1").select("log_id").distinct(), "log_id", "left_semi").withColumnRenamed("log_id", "right")
        own = materialize(in_order(own.withColumn("list", -1 - F.col("list")), "log_date", "air_secs", "right"))
        solid = solid.unionByName(days_of(own, "log_date").select((-1 - F.col("list")).alias(c), F.col("log_date").alias("spot_date"), "list", "lo", "hi"))
        lists = lists.unionByName(own.select("list", "pos", "right"))
    asked = s.join(solid, [c, "spot_date"])
    line = F.when(F.col("_bound"), -1).otherwise(F.col("lo")) if n == 1 else F.col("lo")  # windows in the order of their starts are one line
    wishes = asked.select(F.col("spot_id").alias("left"), F.array(wish(n, "list", _rank_of(n), line)).alias("wishes"), F.xxhash64("_scope", "spot_date").alias("region"))
    wishes = materialize(wishes)
    wanted = wishes.select(F.col("wishes")[0]["list"].alias("list")).distinct()
    out = materialize(_placed(wishes, lists.join(wanted, "list", "left_semi")))
    discard(free, wishes)
    return out


def _later_days(s: DataFrame, kinds: DataFrame, r: DataFrame, taken: DataFrame) -> DataFrame:
    """Spots on the airings left in their window on later days, by time; windows that hold the same airings are one list."""
    left = r.join(taken.select("log_id"), "log_id", "left_anti")
    left = materialize(left.withColumn("_at", F.row_number().over(Window.partitionBy(*CLASS).orderBy("air_secs", "log_date", "log_id"))))
    some = kinds.filter("_kind = '_w'").join(s.select(F.col("_w").alias("list")).distinct(), "list", "left_semi")
    members = materialize(_in_window(some, left).select("list", "log_id", "log_date", "air_secs", "_at"))
    held = members.groupBy("list").agg(F.min("_at").alias("_lo"), F.max("_at").alias("_hi"), F.count("*").alias("_n")).join(some.select(*CLASS, "list"), "list")
    same = F.when(F.col("_hi") - F.col("_lo") + 1 == F.col("_n"), F.col("_lo")).otherwise(-1 - F.col("list"))
    one = materialize(held.select(F.col("list").alias("_w"), F.min("list").over(Window.partitionBy(*CLASS, same, "_hi")).alias("list")))
    lists = members.join(one.select("list").distinct(), "list", "left_semi").select("list", "log_date", "air_secs", F.col("log_id").alias("right"))
    lists = materialize(in_order(lists, "log_date", "air_secs", "right"))
    discard(members)
    asked = s.join(one, "_w").select("spot_id", "list", F.col("spot_date").alias("log_date"), "_rank", "_scope")
    asked = from_day(asked, lists, "log_date", after=True)
    out = materialize(_placed(asked.select(F.col("spot_id").alias("left"), F.array(wish(4, "list", _rank_of(4))).alias("wishes"), F.col("_scope").alias("region")), lists))
    discard(left, lists)
    return out


def place_spots(spots: DataFrame, logs: DataFrame, mappings: DataFrame, source: str = "theme") -> DataFrame:
    """The airing that each spot takes, by schedule (text order), pass, day, start and id: spot_id, log_id, pass.

    The schedules of a scope (account and channel) go one after the other, those of all scopes
    side by side, and the passes of a schedule in turn; each takes from what the earlier ones
    leave.  There is no table of pairs: lists grow with airings, and rounds move a row for each
    spot.
    """
    r = materialize(class_logs(spots, logs, mappings, source))
    s = spots.select("spot_id", "account_id", clean_channel(F.col("channel")).alias("channel_key"), normalize(F.col("brand")).alias("brand_key"), "duration", "spot_date", "start_secs",
                     end_of_window(F.col("start_secs"), F.col("end_secs")).alias("stop"), "programme", F.coalesce("schedule_number", F.lit("")).alias("_number"))
    s = s.join(r.select(*CLASS).distinct(), CLASS, "left_semi")
    rank = F.row_number().over(Window.partitionBy("account_id", "channel_key", "duration").orderBy("spot_date", "start_secs", "spot_id"))
    turn = F.dense_rank().over(Window.partitionBy("account_id", "channel_key").orderBy("_number"))
    s = materialize(s.withColumns({"_rank": rank.cast("long"), "_turn": turn, "_scope": F.xxhash64("account_id", "channel_key", "duration"), "_bound": F.col("start_secs").isNotNull() & F.col("stop").isNotNull()}).drop("_number"))
    rows = [s.select(F.lit(k).alias("_kind"), *CLASS, *[(F.col(c) if c in own else F.lit(None).cast(s.schema[c].dataType)).alias(c) for c in ("start_secs", "stop", "programme")]) for k, (_, own, _) in KINDS.items()]
    kinds = numbered(rows[0].unionByName(rows[1]).unionByName(rows[2]))
    days = numbered(r.select(*CLASS, "log_date"))
    r = in_order(with_number(r, days, "list"), "air_secs", "log_id").withColumnsRenamed({"list": "_base", "pos": "_pos"})
    r, spans = materialize(r), None
    for kind, (_, own, members) in KINDS.items():
        some = kinds.filter(F.col("_kind") == kind).select(*CLASS, *own, "list")
        s, found = with_number(s, some, kind), members(some, r)
        found = found.groupBy("list", "log_date", "_base").agg(F.min("_pos").alias("_lo"), F.max("_pos").alias("_hi"), F.count("*").alias("_n")).withColumn("_kind", F.lit(kind))
        spans = found if spans is None else spans.unionByName(found)
    s = materialize(s.select("spot_id", "spot_date", "_rank", "_scope", "_bound", "_w", "_o", "_p", "_turn"))
    spans = materialize(spans.withColumn("_solid", F.col("_hi") - F.col("_lo") + 1 == F.col("_n")).drop("_n"))
    others = {x["_kind"] for x in spans.filter("not _solid").select("_kind").distinct().collect()}
    odd = {}
    for kind in others:
        _, own, members = KINDS[kind]
        some = kinds.filter(F.col("_kind") == kind).select(*CLASS, *own, "list")
        odd[kind] = materialize(members(some, r).join(spans.filter("not _solid").select("list", "log_date"), ["list", "log_date"], "left_semi").select("list", "log_id", "log_date", "air_secs"))
    out, join = None, lambda a, b: b if a is None else a.unionByName(b)
    for turn in range(1, (s.agg(F.max("_turn")).first()[0] or 0) + 1):
        now = s.filter(F.col("_turn") == turn)
        for c, (n, _, _) in KINDS.items():
            got = _own_day(now, n, c, r, spans, odd.get(c), out)
            out, now = join(out, got), now.join(got, "spot_id", "left_anti")
        out = out.unionByName(_later_days(now, kinds, r, out))
    return s.select("spot_id", F.lit(None).cast("long").alias("log_id"), F.lit(0).alias("pass")).limit(0) if out is None else out


def verify(spots: DataFrame, logs: DataFrame, mappings: DataFrame, source: str = "theme", claimed: DataFrame | None = None, done: DataFrame | None = None, cap: DataFrame | None = None, manual: DataFrame | None = None) -> DataFrame:
    """A verdict for every spot, and the airing it took.

    Spots go by schedule (text order), then pass, date, start and id; airings by date, time
    and id (``place_spots``).  ``claimed`` (log_id) are airings taken before, ``done`` (spot_id) spots that keep
    an earlier verdict (smart runs), ``cap`` (account_id, channel, last_date) the data's end,
    after which a spot is pending, ``manual`` (spot_id, log_id) pairs that win over any other.
    """
    if done is not None:
        spots = spots.join(done.select("spot_id").distinct(), "spot_id", "left_anti")
    free = logs
    for used in (claimed, manual):
        if used is not None:
            free = free.join(used.select("log_id").distinct(), "log_id", "left_anti")
    open_ = spots if manual is None else spots.join(manual.select("spot_id").distinct(), "spot_id", "left_anti")
    if cap is not None:
        ends = cap.groupBy("account_id", clean_channel(F.col("channel")).alias("_ch")).agg(F.max("last_date").alias("last_date"))
        open_ = open_.withColumn("_ch", clean_channel(F.col("channel"))).join(ends, ["account_id", "_ch"], "left").drop("_ch").withColumn("_pending", F.coalesce(F.col("spot_date") > F.col("last_date"), F.lit(False)))
        pending = open_.filter("_pending").select("spot_id")
        open_ = open_.filter("not _pending").drop("_pending", "last_date")
    pairs = place_spots(open_, free, mappings, source)
    if manual is not None:
        pairs = pairs.unionByName(manual.select("spot_id", "log_id", F.lit(1).alias("pass")))
    mapped = mappings.select("account_id", normalize(F.col("brand")).alias("brand_key"), F.lit(True).alias("_mapped")).distinct()
    out = spots.withColumn("brand_key", normalize(F.col("brand"))).join(pairs, "spot_id", "left").join(mapped, ["account_id", "brand_key"], "left")
    status = F.create_map(*[F.lit(x) for kv in VERDICTS.items() for x in kv])[F.col("pass")]
    status = F.coalesce(status, F.when(F.col("_mapped"), "not_aired").otherwise("no_mapping"))
    if cap is not None:
        out = out.join(pending.withColumn("_late", F.lit(True)), "spot_id", "left")
        status = F.when(F.col("_late"), "pending").otherwise(status)
    return out.withColumn("status", status).select("spot_id", "account_id", "channel", "schedule_number", "brand", "spot_date", "start_secs", "end_secs", "duration", "programme", "status", "pass", "log_id")


def extra_aired(logs: DataFrame, verdicts: DataFrame, mappings: DataFrame, sponsor_words: list[str] | None = None, claimed: DataFrame | None = None) -> DataFrame:
    """Airings of mapped themes that no spot took, without sponsorship tags."""
    out = logs.join(verdicts.filter("log_id is not null").select("log_id"), "log_id", "left_anti")
    if claimed is not None:
        out = out.join(claimed.select("log_id").distinct(), "log_id", "left_anti")
    mapped = brand_themes(mappings, logs).select("account_id", "advt_theme").distinct()
    out = out.join(mapped, ["account_id", "advt_theme"], "left_semi")
    if sponsor_words:
        theme = normalize(F.col("advt_theme"))
        out = out.filter(~F.exists(F.array(*[F.lit(w.lower()) for w in sponsor_words]), lambda w: F.contains(theme, w)))
    return out


def pending_spots(spots: DataFrame, verdicts: DataFrame, ad_type: str = "COMMERCIAL BENEFITS") -> DataFrame:
    """Active spots without a verdict."""
    return spots.filter(F.col("ad_type") == ad_type).join(verdicts.select("spot_id"), "spot_id", "left_anti")


def orphans(claims: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Claims on airings that no verdict stands behind; in tables of claims they are simply left out."""
    return claims.join(verdicts.select("spot_id"), claims["left_id"] == verdicts["spot_id"], "left_anti")


def scope_window(headers: DataFrame, spots: DataFrame, logs: DataFrame) -> DataFrame:
    """For each account and channel: first and last day to verify, and the latest day of the logs.

    Days come from the headers (with their makeup end), else from the spots themselves.  Names
    of a channel with and without its medium are one channel, shown as the spots have it.
    """
    by = lambda df: df.groupBy("account_id", clean_channel(F.col("channel")).alias("_ch"))
    h = by(headers).agg(F.min("channel").alias("c1"), F.min("start_date").alias("h1"), F.max(F.greatest("end_date", F.coalesce("makeup_end_date", "end_date"))).alias("h2"))
    s = by(spots).agg(F.min("channel").alias("c2"), F.min("spot_date").alias("s1"), F.max("spot_date").alias("s2"))
    last = by(logs).agg(F.max("log_date").alias("latest"))
    out = s.join(h, ["account_id", "_ch"], "full").join(last, ["account_id", "_ch"], "left")
    end = F.coalesce("h2", "s2")
    return out.select("account_id", F.coalesce("c2", "c1").alias("channel"), F.coalesce("h1", "s1").alias("first_date"), end.alias("last_date"), F.least(end, F.col("latest")).alias("cap_date"))


def latest_versions(headers: DataFrame) -> DataFrame:
    """The highest version of each schedule number."""
    w = Window.partitionBy("account_id", "channel", "month", "schedule_number").orderBy(F.desc("version"), F.desc("schedule_id"))
    return headers.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def makeup_schedules(headers: DataFrame) -> DataFrame:
    """Latest versions of schedules that make up for an active one."""
    active = latest_versions(headers)
    parents = active.filter("parent_schedule_id is null").select(F.col("schedule_id").alias("parent_schedule_id"))
    return active.join(parents, "parent_schedule_id", "left_semi")


def tolerant_match(spots: DataFrame, logs: DataFrame, theme_of: DataFrame, days: int = 0) -> DataFrame:
    """The older rule: one log theme for a brand and duration (any duration failing that), within ``days``, else shifted, else missed."""
    scope = ["account_id", "_ch"]
    exact = theme_of.filter("map_duration is not null").select("account_id", "brand_key", F.col("map_duration").alias("duration"), F.col("advt_theme").alias("t1"))
    any_ = theme_of.groupBy("account_id", "brand_key").agg(F.min("advt_theme").alias("t2"))
    s = spots.withColumns({"brand_key": normalize(F.col("brand")), "_ch": clean_channel(F.col("channel"))}).join(exact, ["account_id", "brand_key", "duration"], "left").join(any_, ["account_id", "brand_key"], "left")
    s = s.withColumn("advt_theme", F.coalesce("t1", "t2"))
    pairs = s.join(logs.withColumn("_ch", clean_channel(F.col("channel"))).select("log_id", *scope, "advt_theme", "duration", "log_date", "air_secs"), [*scope, "advt_theme", "duration"])
    gap = F.abs(F.datediff("log_date", "spot_date"))
    inside = F.col("air_secs").between(F.col("start_secs"), F.col("end_secs")) & (gap <= days)
    pairs = pairs.filter(gap <= max(days, 1)).withColumn("tier", F.when(inside, 1).otherwise(2))
    got = assign(pairs.select("spot_id", "log_id", "tier", "log_date", "air_secs"), "spot_id", "log_id", [F.col("spot_id"), F.col("tier"), F.col("log_date"), F.col("air_secs")])
    return spots.join(got.select("spot_id", "log_id", "tier"), "spot_id", "left").withColumn("status", F.expr("case tier when 1 then 'matched' when 2 then 'shifted' else 'missed' end"))
