"""Minimax contiguous sharding of ordered atomic groups."""

from __future__ import annotations

import json
from bisect import bisect_right

from pyspark.sql import DataFrame, SparkSession, functions as F

from spotcheck.llm.frames import join_by_group, materialize, ordered, running_totals

#: Gaps asked about in one round, and cells of the grid by which they meet the groups.
GAPS, CELLS = 512, 4096


class KnownEnds:
    """Ends of groups (running sums of sizes) seen so far, and how far each is known to be the last.

    ``floor`` finds the last end at or before a place.  Where that is not known yet, the low
    answer is the last seen end and the high one the place itself, so greedy checks with
    either bound the true check.  Between ``until`` of one seen end and the next seen end lies
    a gap: places where ends may be that have not been seen.
    """

    def __init__(self, total: int):
        self.total, self.ends, self.until = total, [0, total], [0, total]

    def floor(self, x: int, high: bool) -> int:
        if x >= self.total:
            return self.total
        i = bisect_right(self.ends, x) - 1
        return x if high and x > self.until[i] else self.ends[i]

    def gaps(self, ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
        """The gaps (first place, last place) that hold a place of one of the ranges."""
        out = set()
        for low, high in ranges:
            for i in range(max(bisect_right(self.ends, low) - 1, 0), len(self.ends) - 1):
                first, last = self.until[i] + 1, self.ends[i + 1] - 1
                if first > high:
                    break
                if first <= last and max(first, low) <= min(last, high):
                    out.add((first, last))
        return sorted(out)

    def learn(self, first: int, last: int, buckets: list[tuple[int, int, int]]) -> None:
        """All ends in a gap: least, greatest and number in each of consecutive buckets."""
        i = bisect_right(self.ends, first) - 1
        starts = [b[0] for b in buckets] + [last + 1]
        self.until[i] = starts[0] - 1
        new = []
        for (least, most, n), after in zip(buckets, starts[1:], strict=True):
            if most > least:
                new.append((least, most - 1 if n == 2 else least))
            new.append((most, after - 1))
        self.ends[i + 1 : i + 1] = [e for e, _ in new]
        self.until[i + 1 : i + 1] = [u for _, u in new]


def greedy(capacity: int, shards: int, known: KnownEnds, high: bool) -> list[int]:
    """The places up to which each shard could reach, and where they end; greedy from the left."""
    places, at = [], 0
    for _ in range(shards):
        places.append(at + capacity)
        at = known.floor(at + capacity, high)
    return [*places, at]


def smallest_capacity(low: int, high: int, shards: int, known: KnownEnds, optimistic: bool) -> int:
    """Binary search of the smallest capacity with which the greedy check passes."""
    while low < high:
        middle = (low + high) // 2
        if greedy(middle, shards, known, optimistic)[-1] >= known.total:
            high = middle
        else:
            low = middle + 1
    return low


def small_table(spark: SparkSession, rows: list[dict], schema: str) -> DataFrame:
    """A table of a few rows from the driver, without Python workers."""
    return spark.range(1).select(F.inline(F.from_json(F.lit(json.dumps(rows)), f"array<struct<{schema}>>")))


def ends_in(groups: DataFrame, gaps: list[tuple[int, int]], each: int, grid: int) -> list[list[tuple[int, int, int]]]:
    """For each gap: least, greatest and number of the ends in each of its at most ``each`` buckets.

    Groups meet the gaps by cells of a grid; the gaps (``GAPS`` at most, spread over ``CELLS``
    cells at most) are the only broadcast.
    """
    asked = [{"cell": cell, "number": i, "first": a, "last": b, "step": -(-(b - a + 1) // each)} for i, (a, b) in enumerate(gaps) for cell in range(a // grid, b // grid + 1)]
    table = F.broadcast(small_table(groups.sparkSession, asked, "cell: bigint, number: int, first: bigint, last: bigint, step: bigint"))
    met = groups.select("end", F.expr(f"end div {grid}").alias("cell")).join(table, "cell").filter(F.col("end").between(F.col("first"), F.col("last")))
    found = met.groupBy("number", F.expr("(end - first) div step").alias("bucket")).agg(F.min("end").alias("least"), F.max("end").alias("most"), F.count("*").alias("n")).collect()  # len(gaps) * each rows at most
    out: list[list] = [[] for _ in gaps]
    for r in sorted(found, key=lambda r: r["least"]):
        out[r["number"]].append((r["least"], r["most"], r["n"]))
    return out


def minimax_cuts(groups: DataFrame, shards: int, fanout: int = 16384) -> list[int]:
    """The cuts of the smallest feasible capacity over a table with ``end`` and ``size``.

    The check needs only the ends of groups near possible cuts.  Binary searches on what is
    known give the least and the greatest capacity that can still be the answer, and with
    them the places where each cut can still lie.  A round asks, in one aggregate of at most
    ``fanout`` rows, for the ends in the gaps of what is known there, the largest gaps first.
    Every gap that is asked about falls apart into gaps of a fraction of its length or
    becomes known, so each round learns something, whatever the sizes; without gaps the two
    capacities are the same and the check is exact.
    """
    total, biggest = groups.agg(F.max("end"), F.max("size")).first()
    if not total:
        return [0] * (shards - 1)
    known, least, grid = KnownEnds(total), max(biggest, -(-total // shards)), -(-total // CELLS)
    while True:
        low, high = (smallest_capacity(least, total, shards, known, optimistic) for optimistic in (True, False))
        places = zip(greedy(low, shards, known, False)[:-1], greedy(high, shards, known, True)[:-1], strict=True)
        gaps = known.gaps([(a, b) for a, b in places if a < total])
        if not gaps:
            break
        gaps = sorted(sorted(gaps, key=lambda g: g[0] - g[1])[: max(1, min(GAPS, fanout // 2))])
        for (a, b), buckets in zip(gaps, ends_in(groups, gaps, max(2, fanout // len(gaps)), grid), strict=True):
            known.learn(a, b, buckets)
    at, cuts = 0, []
    for _ in range(shards - 1):
        at = known.floor(at + low, False)
        cuts.append(at)
    return cuts


def shard_documents(docs: DataFrame, shards: int = 16) -> DataFrame:
    """Every document's shard, 0 to ``shards`` - 1, and its gapless place there.

    A document weighs its UTF-8 bytes plus 1.  Equal texts are one atomic group; groups stand
    in the order of their smallest doc_id and shards are runs of groups.  The largest shard
    is as small as runs of whole groups allow (law ``bytes``).

    A null text is as an empty one.  Repeated rows are kept and placed one by one; null ids
    come first; an empty table gives an empty one; further columns are left out.  A group
    with a third of all rows is summed before it is shuffled, its rows are ranged over
    several partitions by doc_id, and the rows of large groups (at most 4,096 groups) meet
    their shard without a shuffle.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), F.unhex(F.sha2(text, 256)).alias("_group"))
    rows = materialize(rows)
    groups = rows.groupBy("_group").agg(F.sum("size").alias("size"), F.min("doc_id").alias("first"), F.count("*").alias("rows"))
    placed = running_totals(ordered(groups, "first", "_group"), ["first", "_group"], {"start": "size"})
    placed = materialize(placed.select("_group", "size", "rows", "start", (F.col("start") + F.col("size")).alias("end")))
    cuts = minimax_cuts(placed, shards)
    shard = sum((F.when(F.col("start") >= c, 1).otherwise(0) for c in cuts), F.lit(0)).cast("int")
    joined = materialize(join_by_group(rows, placed.select("_group", "rows", "start", shard.alias("shard")), "_group").drop("_group"))
    slots = running_totals(ordered(joined, "start", "doc_id").withColumn("_one", F.lit(1)), ["start", "doc_id"], {"slot": "_one"}, by=["shard"])
    return slots.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", F.col("slot").cast("long"), F.lit(None).cast("int").alias("grown_shard"))


SQL = r"""
WITH RECURSIVE crc AS (SELECT list_transform(range(0, 256), lambda i: list_reduce(list_prepend(i, range(0, 8)),
        lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
r AS (SELECT doc_id, text, CAST(strlen(text) + 1 AS BIGINT) AS size,
        xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(regexp_extract_all(hex(encode(text)), '..'), lambda h: CAST(('0x' || h) AS BIGINT))),
          lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) AS crc FROM d, crc),
g AS (SELECT text, sum(size) AS size, min(doc_id) AS first FROM r GROUP BY text),
p AS (SELECT text, size, CAST(sum(size) OVER (ORDER BY first) AS BIGINT) AS stop, CAST(sum(size) OVER (ORDER BY first) - size AS BIGINT) AS start FROM g),
t AS (SELECT CAST(max(stop) AS BIGINT) AS total, CAST(greatest(max(size), (sum(size) + 15) // 16) AS BIGINT) AS least FROM p),
-- one greedy step, or one halving of the range of capacities, in each turn
search AS (SELECT least AS lo, total AS hi, (least + total) // 2 AS mid, CAST(0 AS BIGINT) AS pos, 0 AS step FROM t
  UNION ALL
  SELECT lo, hi, (lo + hi) // 2, CASE WHEN step = 16 OR pos = total THEN 0 ELSE nxt END, CASE WHEN step = 16 OR pos = total THEN 0 ELSE step + 1 END
  FROM (SELECT s.step, s.pos, t.total, s.mid,
          CASE WHEN (s.step = 16 OR s.pos = total) AND s.pos < total THEN s.mid + 1 ELSE s.lo END AS lo,
          CASE WHEN s.pos = total THEN s.mid ELSE s.hi END AS hi,
          (SELECT CAST(coalesce(max(stop), 0) AS BIGINT) FROM p WHERE stop <= s.pos + s.mid) AS nxt
        FROM search AS s, t WHERE s.lo < s.hi)),
best AS (SELECT min(lo) AS c FROM search WHERE lo = hi),
cuts AS (SELECT 0 AS shard, CAST(0 AS BIGINT) AS pos UNION ALL
  SELECT shard + 1, (SELECT CAST(max(stop) AS BIGINT) FROM p WHERE stop <= cuts.pos + c) FROM cuts, best WHERE shard < 15)
SELECT r.doc_id, r.size, CAST(r.crc AS BIGINT) AS text_crc32, 'bytes' AS law, CAST(k.shard AS INTEGER) AS shard,
  row_number() OVER (PARTITION BY k.shard ORDER BY p.start, r.doc_id) - 1 AS slot, CAST(NULL AS INTEGER) AS grown_shard
FROM r JOIN p ON p.text = r.text JOIN (SELECT pos, min(shard) AS dummy, max(shard) AS shard FROM cuts GROUP BY pos) AS k
  ON k.pos = (SELECT max(pos) FROM cuts WHERE pos <= p.start)
"""
