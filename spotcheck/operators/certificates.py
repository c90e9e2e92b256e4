"""Channel certificates against logs and schedules."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator
from math import isnan

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from spotcheck.functions.scalars import clean_channel, crossing_end, normalize, pipe_list
from spotcheck.operators.assign import assign
from spotcheck.operators.mapping import brand_themes, certificate_themes, resolve_patterns
from spotcheck.operators.settle import from_day, in_order, numbered, settle, wish, with_number
from spotcheck.sources.staging import materialize

TOLERANCE, GRACE, NEAR = 5, 600, 7200
NONE = float("nan")  # one object, so that windows without a time are one kind


def allowed_themes(certs: DataFrame, logs: DataFrame, mappings: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Certificate themes and durations whose brands expect themes in the log; and what they expect there.

    (account_id, tc_theme, cert_dur), and the same with each theme of the logs and the product
    that it needs ('': any).  A mapping of one duration holds for that duration alone.
    """
    d = certs.select("account_id", "tc_theme", F.coalesce("duration", F.lit(0)).alias("cert_dur")).distinct()
    c = certificate_themes(mappings, certs).select("account_id", "brand_key", "tc_theme", "map_duration")
    of_duration = F.col("map_duration").isNull() | (F.col("map_duration") == F.col("cert_dur"))
    brands = materialize(d.join(c, ["account_id", "tc_theme"]).filter(of_duration).select("account_id", "tc_theme", "cert_dur", "brand_key").distinct())
    key = ["account_id", "brand_key"]
    patterns = mappings.filter(F.length(normalize(F.col("theme"))) > 0).select("account_id", normalize(F.col("brand")).alias("brand_key"), F.col("duration").alias("map_duration"))
    expecting = brands.join(patterns, key).filter(of_duration).select("account_id", "tc_theme", "cert_dur").distinct()
    expected = brands.join(brand_themes(mappings, logs), key).filter(of_duration)
    return expecting, materialize(expected.groupBy("account_id", "tc_theme", "cert_dur", "advt_theme").agg(F.collect_set("map_product").alias("_products")))


#: Earlier certificates choose first, the nearest log row, ties to the earlier one.
CONFIRM_ORDER = ("cert_date", "cert_secs", "cert_id", "gap", "air_secs")


def confirm(certs: DataFrame, logs: DataFrame, mappings: DataFrame, tolerance: int = TOLERANCE, any_duration: DataFrame | None = None, claimed: DataFrame | None = None) -> DataFrame:
    """Certificate rows and the log rows that confirm them, one to one, of ``confirmable`` pairs."""
    return assign(confirmable(certs, logs, mappings, tolerance, any_duration, claimed), "cert_id", "log_id", [F.col(x) for x in CONFIRM_ORDER], scope=["account_id", "ch", "day"])


def confirmable(certs: DataFrame, logs: DataFrame, mappings: DataFrame, tolerance: int = TOLERANCE, any_duration: DataFrame | None = None, claimed: DataFrame | None = None) -> DataFrame:
    """Pairs of certificate and log rows of the same channel, day and duration, within ``tolerance`` seconds.

    A theme whose brands have themes in the log needs a log row of one of them, and of the
    product that the mapping names, if it names one.  ``any_duration`` (account_id, tc_theme, and
    ch and month if they matter) names themes for which durations may differ.  Times join on
    blocks of the tolerance, so a busy day is no theta join.
    """
    if claimed is not None:
        logs = logs.join(claimed.select("log_id").distinct(), "log_id", "left_anti")
    width = tolerance + 1
    c = certs.select("cert_id", "account_id", clean_channel(F.col("channel")).alias("ch"), "cert_date", F.col("air_secs").alias("cert_secs"), F.expr("nullif(duration, 0)").alias("cert_dur"), "tc_theme")
    c = c.withColumn("block", F.explode(F.array(*[F.floor((F.col("cert_secs") + d) / width) for d in (-width, 0, width)])))
    product = normalize(F.coalesce("product", F.lit(""))) if "product" in logs.columns else F.lit("")
    r = logs.select("log_id", "account_id", clean_channel(F.col("channel")).alias("ch"), F.col("log_date").alias("cert_date"), "air_secs", F.expr("nullif(duration, 0)").alias("duration"), "advt_theme", product.alias("product")).withColumn("block", F.floor(F.col("air_secs") / width))
    pairs = c.join(r, ["account_id", "ch", "cert_date", "block"]).withColumn("gap", F.abs(F.col("air_secs") - F.col("cert_secs"))).filter(F.col("gap") <= tolerance)
    if any_duration is None:
        pairs = pairs.filter(F.col("cert_dur").eqNullSafe(F.col("duration")))
    else:
        keys = ["account_id", "tc_theme", *(c for c in ("ch", "month") if c in any_duration.columns)]
        pairs = pairs.withColumn("month", F.trunc("cert_date", "month")).join(any_duration.select(*keys).distinct().withColumn("_any", F.lit(True)), keys, "left")
        pairs = pairs.filter(F.col("_any") | F.col("cert_dur").eqNullSafe(F.col("duration"))).drop("_any", "month")
    expecting, expected = allowed_themes(certs, logs, mappings)
    pairs = pairs.withColumn("cert_dur", F.coalesce("cert_dur", F.lit(0)))
    pairs = pairs.join(expecting.withColumn("_mapped", F.lit(True)), ["account_id", "tc_theme", "cert_dur"], "left").join(expected, ["account_id", "tc_theme", "cert_dur", "advt_theme"], "left")
    right = F.array_contains("_products", "") | F.array_contains("_products", F.col("product"))
    pairs = pairs.filter(F.col("_mapped").isNull() | right)
    return pairs.select("account_id", "ch", "cert_id", "log_id", "cert_date", "cert_secs", "gap", "air_secs", F.col("cert_date").alias("day"))


def sponsored_themes(spots: DataFrame, certs: DataFrame, mappings: DataFrame) -> DataFrame:
    """Certificate themes that stand for a brand with sponsorship spots on a channel in a month: their durations say nothing.

    account_id, ch, month (its first day), tc_theme, as ``confirmable`` takes it.
    """
    brands = spots.filter("ad_type = 'SPONSORSHIP'").select("account_id", clean_channel(F.col("channel")).alias("ch"), F.trunc("spot_date", "month").alias("month"), normalize(F.col("brand")).alias("brand_key")).distinct()
    named = certificate_themes(mappings, certs).select("account_id", "brand_key", "tc_theme").distinct()
    return brands.join(named, ["account_id", "brand_key"]).select("account_id", "ch", "month", "tc_theme").distinct()


def certified_brands(certs: DataFrame, mappings: DataFrame) -> DataFrame:
    """account_id, tc_theme, cert_dur (0: none) and the brands that a certificate of that name may stand for, in order.

    Mappings go by brand, theme and duration; names of the mappings that stand for a
    certificate's go by the first mapping that has them, and their brands in turn.
    """
    each = mappings.select("account_id", "brand", "duration", F.struct("brand", "theme", "duration").alias("_own"), F.posexplode(pipe_list(F.col("tc_theme"))).alias("_pos", "pattern"))
    each = each.withColumns({"pattern": normalize(F.col("pattern")), "_own": F.struct("_own", "_pos")})
    each = each.withColumn("_first", F.min("_own").over(Window.partitionBy("account_id", "pattern")))
    themes = resolve_patterns(each, certs.select("account_id", "tc_theme"), "pattern", "tc_theme", ["account_id"])
    met = certs.select("account_id", "tc_theme", F.coalesce("duration", F.lit(0)).alias("cert_dur")).distinct().join(themes, ["account_id", "tc_theme"])
    met = met.filter(F.col("duration").isNull() | (F.col("duration") == F.col("cert_dur")))
    brand = normalize(F.col("brand"))
    first = met.groupBy("account_id", "tc_theme", "cert_dur", brand.alias("brand_key")).agg(F.min(F.struct("_first", "_own")).alias("_place"))
    return first.groupBy("account_id", "tc_theme", "cert_dur").agg(F.sort_array(F.collect_list(F.struct("_place", "brand_key")))["brand_key"].alias("brands"))


def to_schedule(certs: DataFrame, spots: DataFrame, mappings: DataFrame) -> DataFrame:
    """Confirmed certificates on the planned spots of their brand, not before the spot's day, by the air time of the log.

    certs: certificates whose ``air_secs`` is the log row's.  Certificates go by day and id.
    Of the brands in order (``certified_brands``) the first that has a free spot of a day up to
    the certificate's decides alone: a spot whose window (with ten minutes' grace, past midnight
    too) holds the time, else the spot whose centre is nearest, within two hours, else, for
    lack of a time, any; then by the spot's day and id.
    """
    brands = certified_brands(certs, mappings)
    c = certs.withColumn("cert_dur", F.coalesce("duration", F.lit(0))).join(brands, ["account_id", "tc_theme", "cert_dur"])
    return place_by_time(c.select(*_scope(), "cert_id", "brands", "cert_date", "air_secs"), _windows(spots, normalize(F.col("brand"))))


def time_belt(certs: DataFrame, spots: DataFrame) -> DataFrame:
    """Confirmed certificates without a brand on commercial spots of the same duration, by time alone."""
    c = certs.filter("air_secs is not null").select(*_scope(), "cert_id", F.array(F.lit("")).alias("brands"), "cert_date", "air_secs")
    return place_by_time(c, _windows(spots.filter(F.col("ad_type") == "COMMERCIAL BENEFITS"), F.lit("")))


def _scope() -> list[Column]:
    return [F.col("account_id"), clean_channel(F.col("channel")).alias("ch"), F.col("duration")]


def _windows(spots: DataFrame, brand: Column) -> DataFrame:
    return spots.select(*_scope(), "spot_id", brand.alias("brand_key"), "spot_date", "start_secs", crossing_end(F.col("start_secs"), F.col("end_secs")).alias("stop"))


def place_by_time(certs: DataFrame, spots: DataFrame) -> DataFrame:
    """cert_id, spot_id, tier (1: in the window, 2: near, 3: no time), measure, cert_date.

    One shuffle by scope (account, channel, duration; nulls meet).  The rows of a scope, sorted
    by day, stream through one pass that keeps, for each brand and kind of window, the queue
    of its free spots: the head is the spot that comes first, so a certificate looks at one
    spot for each kind of window, not at all spots, and no pairs are made or written.  Work
    grows with certificates and spots, memory with the spots that are still free.  A scope is
    one stream, as each certificate depends on those before it.
    """
    key = F.to_json(F.struct("account_id", "ch", "duration")).alias("scope")
    secs = lambda c: F.coalesce(F.col(c).cast("double"), F.lit(float("nan"))).alias(c)
    none = F.lit(float("nan"))
    s = spots.filter("spot_date is not null").select(key, F.unix_date("spot_date").alias("day"), F.lit(0).alias("kind"), F.col("spot_id").alias("id"), F.array(F.coalesce("brand_key", F.lit(""))).alias("brands"), secs("start_secs"), secs("stop"), none.alias("air_secs"))
    c = certs.filter("cert_date is not null").select(key, F.unix_date("cert_date").alias("day"), F.lit(1).alias("kind"), F.col("cert_id").alias("id"), "brands", none.alias("start_secs"), none.alias("stop"), secs("air_secs"))
    lined = s.unionByName(c).repartition("scope").sortWithinPartitions("scope", "day", "kind", "id")
    out = lined.mapInPandas(_queues, "cert_id long, spot_id long, tier int, measure double, day int")
    return out.withColumn("cert_date", F.date_from_unix_date("day")).drop("day")


def _queues(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    scope, free = None, {}  # brand: {(start, stop): its free spots in order}

    def take(brands: list[str], air: float) -> tuple[deque, int, float] | None:
        for brand in brands:
            open_ = [(window, queue) for window, queue in free.get(brand, {}).items() if queue]
            if not open_:
                continue
            if isnan(air):
                return min((queue for _, queue in open_), key=lambda q: q[0]), 3, 0.0
            best = None
            for (start, stop), queue in open_:
                if isnan(start) or isnan(stop):
                    continue
                at = air + 86400 if stop > 86400 and air < start else air
                inside, far = start <= at <= stop + GRACE, abs(at - (start + stop) / 2)
                if inside or far <= NEAR:
                    found = ((1, 0.0) if inside else (2, far), queue[0], queue)
                    best = found if best is None or found[:2] < best[:2] else best
            return best and (best[2], *best[0])  # the first brand with a free spot decides
        return None

    for batch in batches:
        got = []
        for at, day, kind, id_, brands, start, stop, air in zip(*(batch[c].tolist() for c in ("scope", "day", "kind", "id", "brands", "start_secs", "stop", "air_secs")), strict=True):
            if at != scope:
                scope, free = at, {}
            if kind == 0:
                window = (start if start == start else NONE, stop if stop == stop else NONE)
                free.setdefault(brands[0], {}).setdefault(window, deque()).append((day, id_))
            elif (won := take(brands, air)) is not None:
                queue, tier, measure = won
                got.append((id_, queue.popleft()[1], tier, measure, day))
        yield pd.DataFrame(got, columns=["cert_id", "spot_id", "tier", "measure", "day"]).astype({"cert_id": "int64", "spot_id": "int64", "tier": "int32", "measure": "float64", "day": "int32"})


def unconfirmed_to_schedule(certs: DataFrame, spots: DataFrame, mappings: DataFrame) -> DataFrame:
    """Spots, by day, start and id, take the earliest certificate of their brand's themes on or after their day.

    Themes go in the order of the mapping, those of one pattern by their first certificate;
    durations agree, and those that are missing or 0 agree with each other.  The certificates
    of a theme are one list for all spots, so there is no table of pairs.
    """
    first = Window.partitionBy("account_id", "tc_theme")
    own = [F.col("account_id"), clean_channel(F.col("channel")).alias("ch"), F.coalesce("duration", F.lit(0)).alias("d")]
    c = certs.select(*own, "tc_theme", "cert_id", F.col("cert_date").alias("day"), "air_secs").filter("day is not null")
    kinds = numbered(c.select("account_id", "ch", "d", "tc_theme"))
    lists = materialize(in_order(with_number(c, kinds, "list").withColumnRenamed("cert_id", "right").select("list", "day", "air_secs", "right"), "day", "air_secs", "right"))
    seen = c.select("account_id", "tc_theme", F.min(F.struct("day", "cert_id")).over(first).alias("_first")).distinct()
    themes = certificate_themes(mappings, certs).join(seen, ["account_id", "tc_theme"])
    rank = F.row_number().over(Window.partitionBy("account_id", "ch", "d").orderBy("spot_date", "start_secs", "spot_id")).cast("long")
    s = spots.select(*own, "spot_id", normalize(F.col("brand")).alias("brand_key"), "spot_date", "start_secs").withColumn("_rank", rank)
    s = s.join(themes, ["account_id", "brand_key"]).filter(F.col("map_duration").isNull() | (F.col("map_duration") == F.col("d")))
    asked = with_number(s.select("account_id", "ch", "d", "tc_theme", "spot_id", "place", "_first", "_rank", F.col("spot_date").alias("day")), kinds, "list").filter("list is not null")
    turn = F.row_number().over(Window.partitionBy("spot_id").orderBy("place", "_first", "list"))
    wishes = from_day(asked, lists, "day", after=False).withColumn("_turn", turn)
    wishes = wishes.groupBy(F.col("spot_id").alias("left")).agg(F.sort_array(F.collect_list(wish(F.col("_turn"), "list", F.col("_rank")))).alias("wishes"))
    return settle(wishes, lists).select(F.col("left").alias("spot_id"), F.col("right").alias("cert_id"))


def chain(certs: DataFrame, logs: DataFrame, spots: DataFrame, mappings: DataFrame) -> DataFrame:
    """cert_id, step, log_id, spot_id: what each certificate ends as.

    ``brand``: confirmed and on a spot of its brand; ``theme``: unconfirmed, taken by a spot of
    its theme that the first step left; ``belt``: confirmed and on a spot that both left, by
    time alone; ``extra``: on none.
    """
    have = materialize(confirm(certs, logs, mappings).select("cert_id", "log_id", F.col("air_secs").alias("_log_secs")))
    timed = certs.join(have, "cert_id").withColumn("_own_secs", F.col("air_secs")).withColumn("air_secs", F.col("_log_secs"))
    on = materialize(to_schedule(timed, spots, mappings).select("cert_id", "spot_id"))
    left = spots.join(on, "spot_id", "left_anti")
    loose = materialize(unconfirmed_to_schedule(extras(certs, have), left, mappings).select("cert_id", "spot_id"))
    left = left.join(loose, "spot_id", "left_anti")
    rest = extras(timed, on).withColumn("air_secs", F.coalesce("_log_secs", "_own_secs"))
    belt = materialize(time_belt(rest, left).select("cert_id", "spot_id"))
    steps = [df.withColumn("step", F.lit(step)) for df, step in ((on, "brand"), (loose, "theme"), (belt, "belt"))]
    placed = steps[0].unionByName(steps[1]).unionByName(steps[2])
    out = certs.select("cert_id").join(have.select("cert_id", "log_id"), "cert_id", "left").join(placed, "cert_id", "left")
    return out.select("cert_id", F.coalesce("step", F.lit("extra")).alias("step"), "log_id", "spot_id")


def standalone(certs: DataFrame, logs: DataFrame, mappings: DataFrame, theme_map: DataFrame, tolerance: int = TOLERANCE) -> DataFrame:
    """Certificates on logs by a map of themes where it has an entry (exact duration first), else as ``confirm``.

    theme_map: account_id, tc_theme, tc_duration, log_theme, log_duration; it may cross
    durations and its log rows need only share the day and the time.
    """
    exact = theme_map.filter("tc_duration is not null").select("account_id", "tc_theme", F.col("tc_duration").alias("duration"), F.struct("log_theme", "log_duration").alias("m1"))
    loose = theme_map.filter("tc_duration is null").select("account_id", "tc_theme", F.struct("log_theme", "log_duration").alias("m2"))
    c = certs.join(exact, ["account_id", "tc_theme", "duration"], "left").join(loose, ["account_id", "tc_theme"], "left").withColumn("m", F.coalesce("m1", "m2"))
    mapped = c.filter("m is not null")
    width = tolerance + 1
    m = mapped.select("cert_id", "account_id", "cert_date", F.col("air_secs").alias("cert_secs"), F.col("m.log_theme").alias("advt_theme"), F.coalesce("m.log_duration", "duration").alias("duration"))
    m = m.withColumn("block", F.explode(F.array(*[F.floor((F.col("cert_secs") + d) / width) for d in (-width, 0, width)])))
    r = logs.select("log_id", "account_id", F.col("log_date").alias("cert_date"), "air_secs", "duration", "advt_theme").withColumn("block", F.floor(F.col("air_secs") / width))
    pairs = m.join(r, ["account_id", "cert_date", "advt_theme", "duration", "block"]).withColumn("gap", F.abs(F.col("air_secs") - F.col("cert_secs"))).filter(F.col("gap") <= tolerance)
    pairs = pairs.select("account_id", F.col("cert_date").alias("day"), "cert_id", "log_id", "cert_date", "cert_secs", "gap", "air_secs")
    by_map = assign(pairs, "cert_id", "log_id", [F.col(x) for x in ("cert_date", "cert_secs", "cert_id", "gap", "air_secs")], scope=["account_id", "day"])
    rest = c.filter("m is null").select(certs.columns)
    return by_map.withColumn("by_map", F.lit(True)).unionByName(confirm(rest, logs, mappings, tolerance, claimed=by_map).withColumn("by_map", F.lit(False)))


def extras(certs: DataFrame, *matched: DataFrame) -> DataFrame:
    """Certificates on which no step found a spot."""
    for m in matched:
        certs = certs.join(m.select("cert_id").distinct(), "cert_id", "left_anti")
    return certs
