"""Brands and the names that logs and certificates use for them."""

from __future__ import annotations

import difflib

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import DoubleType
from pyspark.sql.window import Window

from spotcheck.functions.scalars import normalize, pipe_list


def resolve_patterns(patterns: DataFrame, names: DataFrame, pattern: str, name: str, scope: list[str]) -> DataFrame:
    """Pairs of a pattern's row and each distinct name it stands for.

    A pattern that ends in ``*`` stands for all names with that prefix, any other for itself;
    case and outer blanks don't count.  Names are spread into their prefixes, so both kinds
    are equi-joins.
    """
    p = patterns.withColumn("_p", normalize(F.col(pattern)))
    star = F.col("_p").endswith("*")
    p = p.withColumn("_stem", F.when(star, F.regexp_replace("_p", r"\*$", "")).otherwise(F.col("_p"))).withColumn("_star", star)
    n = names.select(*scope, F.col(name)).distinct().withColumn("_n", normalize(F.col(name)))
    whole = n.select(*scope, name, F.col("_n").alias("_stem"), F.lit(False).alias("_star"))
    prefixes = n.withColumn("_i", F.explode(F.sequence(F.lit(0), F.length("_n")))).select(*scope, name, F.expr("substring(_n, 1, _i)").alias("_stem"), F.lit(True).alias("_star"))
    return p.join(whole.unionByName(prefixes), [*scope, "_stem", "_star"]).drop("_p", "_stem", "_star")


def brand_themes(mappings: DataFrame, logs: DataFrame, source: str = "theme") -> DataFrame:
    """account_id, brand key, duration (null: any), product ('' : any) and each theme of the logs."""
    out = resolve_patterns(mappings.filter(F.length(normalize(F.col(source))) > 0), logs.select("account_id", "advt_theme"), source, "advt_theme", ["account_id"])
    return out.select("account_id", normalize(F.col("brand")).alias("brand_key"), F.col("duration").alias("map_duration"), normalize(F.col("product")).alias("map_product"), F.col("advt_theme")).distinct()


def certificate_themes(mappings: DataFrame, certs: DataFrame) -> DataFrame:
    """account_id, brand key, place of the theme in the brand's list and each certificate theme."""
    each = mappings.select("account_id", "brand", "duration", F.posexplode(pipe_list(F.col("tc_theme"))).alias("place", "pattern"))
    out = resolve_patterns(each, certs.select("account_id", F.col("tc_theme")), "pattern", "tc_theme", ["account_id"])
    return out.select("account_id", normalize(F.col("brand")).alias("brand_key"), F.col("duration").alias("map_duration"), "place", F.col("tc_theme")).distinct()


def with_themes(spots: DataFrame, themes: DataFrame) -> DataFrame:
    """A row for each spot and theme that its brand may air under; a mapping's duration, if any, must agree."""
    s = spots.withColumn("brand_key", normalize(F.col("brand")))
    return s.join(themes, ["account_id", "brand_key"]).filter(F.col("map_duration").isNull() | (F.col("map_duration") == F.col("duration")))


@F.pandas_udf(DoubleType())
def sequence_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Similarity of two texts as matching blocks give it; for distinct pairs only."""
    return pd.Series([difflib.SequenceMatcher(None, x or "", y or "").ratio() for x, y in zip(a, b, strict=True)])


@F.pandas_udf(DoubleType())
def token_sort_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """The same after the words of each are put in order."""
    key = lambda x: " ".join(sorted((x or "").lower().split()))
    return pd.Series([difflib.SequenceMatcher(None, key(x), key(y)).ratio() for x, y in zip(a, b, strict=True)])


def look_alikes(names: DataFrame, known: DataFrame, name: str, other: str, least: float, top: int = 5) -> DataFrame:
    """For each distinct name, the most similar known names above ``least`` (0 or more).

    The ratio is at most 2 * (common letters) / (both lengths), so a pair above ``least`` has
    a length and a number of common letters that each name alone bounds from below.  With the
    letters of all names (a repeated letter counted up) in one order, such a pair shares one
    among the first of each: the block.  No pair above ``least`` is left out.
    """
    size = F.size("_l")
    need = F.floor(least * (size + F.floor(size * least / (2 - least)) + 1) / 2 - 1e-6) + 1  # common letters with the shortest possible partner
    letters = lambda c: F.transform(F.sequence(F.lit(1), F.length(c)), lambda i: F.substring(c, i, F.lit(1)))
    numbered = lambda c: F.sort_array(F.transform(letters(c), lambda x, i: F.concat(F.lpad(F.size(F.filter(F.slice(letters(c), F.lit(1), i), lambda y: y == x)).cast("string"), 6, "0"), x)), asc=False)

    def blocks(df: DataFrame, c: str, own: str) -> DataFrame:
        df = df.withColumn("_l", numbered(F.col(c)))
        return df.select(c, F.col("_l").alias(own), F.explode(F.slice("_l", F.lit(1), F.greatest(size - need + 1, F.lit(1)).cast("int"))).alias("_g"))

    a = names.select(normalize(F.col(name)).alias(name)).filter(F.length(name) > 0).distinct()
    b = known.select(normalize(F.col(other)).alias(other)).filter(F.length(other) > 0).distinct()
    near = 2.0 * F.size(F.array_intersect("_x", "_y")) / (F.size("_x") + F.size("_y")) > least
    pairs = blocks(a, name, "_x").join(blocks(b, other, "_y"), "_g").filter(near).select(name, other).distinct()
    scored = pairs.withColumn("ratio", sequence_ratio(F.col(name), F.col(other))).filter(F.col("ratio") > least)
    place = F.row_number().over(Window.partitionBy(name).orderBy(F.desc("ratio"), other))
    return scored.withColumn("place", place).filter(F.col("place") <= top)
