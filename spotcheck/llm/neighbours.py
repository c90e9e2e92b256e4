"""Approximate nearest neighbours by a hierarchical k-means tree searched best bin first."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.window import Window

from spotcheck.llm.frames import join_by_group, materialize

#: Vectors the tree is fitted on at most; every vector is indexed.
SAMPLE = 16384
#: Queries whose exact neighbours calibrate the number of leaf visits.
CALIBRATION = 200


class Tree:
    """Nodes of a k-means tree: centres of the children, and the number of each leaf."""

    def __init__(self, sample: np.ndarray, leaf_share: float, branches: int = 16, seed: int = 3):
        """leaf_share: a node with no more than this part of the sample is a leaf."""
        self.centres: list[np.ndarray | None] = []
        self.children: list[list[int]] = []
        self.leaf: list[int] = []
        self.leaves = 0
        self._grow(sample, max(1.0, leaf_share * len(sample)), branches, np.random.default_rng(seed))

    def _grow(self, x: np.ndarray, small: float, branches: int, rng: np.random.Generator) -> int:
        node = len(self.children)
        self.centres.append(None)
        self.children.append([])
        self.leaf.append(-1)
        k = int(min(branches, max(2, np.ceil(len(x) / small)), len(x)))
        if len(x) > small and k > 1:
            c, of = kmeans(x, k, rng)
            if len(c) > 1:
                self.centres[node] = c
                self.children[node] = [self._grow(x[of == j], small, branches, rng) for j in range(len(c))]
                return node
        self.leaf[node] = self.leaves
        self.leaves += 1
        return node

    def assign(self, x: np.ndarray) -> np.ndarray:
        """The leaf of each vector, by the nearest child at each node."""
        out, todo = np.zeros(len(x), np.int32), [(0, np.arange(len(x)))]
        while todo:
            node, rows = todo.pop()
            if self.leaf[node] >= 0:
                out[rows] = self.leaf[node]
            elif len(rows):
                near = distances(x[rows], self.centres[node]).argmin(1)
                todo += [(child, rows[near == j]) for j, child in enumerate(self.children[node])]
        return out

    def visit(self, q: np.ndarray) -> Iterator[int]:
        """Leaves in the order of best bin first: always down from the nearest branch not taken yet."""
        queue, order = [(0.0, 0, 0)], 1
        while queue:
            _, _, node = heapq.heappop(queue)
            while self.leaf[node] < 0:
                d = distances(q[None], self.centres[node])[0]
                best = int(d.argmin())
                for j, child in enumerate(self.children[node]):
                    if j != best:
                        heapq.heappush(queue, (float(d[j]), order, child))
                        order += 1
                node = self.children[node][best]
            yield self.leaf[node]


def distances(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return (x * x).sum(1)[:, None] - 2 * x @ c.T + (c * c).sum(1)


def kmeans(x: np.ndarray, k: int, rng: np.random.Generator, passes: int = 10) -> tuple[np.ndarray, np.ndarray]:
    c = x[rng.choice(len(x), k, replace=False)]
    of = distances(x, c).argmin(1)
    for _ in range(passes):
        c = np.stack([x[of == j].mean(0) if (of == j).any() else x[rng.integers(len(x))] for j in range(k)])
        new = distances(x, c).argmin(1)
        if (new == of).all():
            break
        of = new
    used = np.unique(of)
    return c[used], np.searchsorted(used, of)


def lifted(x: np.ndarray, longest: float) -> np.ndarray:
    """Vectors with one more component that makes all equally long: then nearest is largest inner product."""
    rest = np.maximum(longest * longest - (x * x).sum(1), 0.0)
    return np.hstack([x, np.sqrt(rest)[:, None]])


def matrix(column: pa.Array | pd.Series) -> np.ndarray:
    values = column.to_pylist() if isinstance(column, pa.Array) else list(column)
    return np.frombuffer(b"".join(values), np.float64).reshape(len(values), -1) if values else np.zeros((0, 1))


def valid_vectors(rows: DataFrame, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """vec_id, vec (its doubles as bytes) and length of the vectors that take part."""
    values = F.col(vector).cast("array<double>")
    rows = rows.select(F.col(key).cast("long").alias("vec_id"), values.alias("v"))
    rows = rows.filter("vec_id is not null and size(v) > 0 and forall(v, x -> x is not null and not isnan(x) and abs(x) < double('inf')) and exists(v, x -> x != 0)")

    def pack(batches):
        for batch in batches:
            v = batch.column("v")
            flat, at = np.asarray(v.flatten(), np.float64), np.append(0, np.cumsum(v.value_lengths().to_numpy(zero_copy_only=False)))
            parts = [flat[a:b] for a, b in zip(at[:-1], at[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array([p.tobytes() for p in parts], pa.binary()), pa.array([len(p) for p in parts], pa.int32()), pa.array([float(p @ p) for p in parts], pa.float64())], ["vec_id", "vec", "dims", "length2"])

    return rows.mapInArrow(pack, "vec_id long, vec binary, dims int, length2 double")


def best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Columns of the k largest scores of a row, ties to smaller ids."""
    if len(scores) > 4 * k:
        keep = np.flatnonzero(scores >= np.partition(scores, len(scores) - k)[len(scores) - k])
    else:
        keep = np.arange(len(scores))
    return keep[np.lexsort((ids[keep], -scores[keep]))[:k]]


def floors(q: np.ndarray, leaves: list[np.ndarray], x: np.ndarray, leaf: np.ndarray, k: int, longest: float) -> np.ndarray:
    """For each query a score that the k best of the visited leaves reach, from those of some vectors x that lie in them.

    A little is taken off for rounding; with fewer than k vectors there it is minus infinity.
    """
    out = np.full(len(q), -np.inf)
    for lo in range(0, len(q), 256):
        scores = q[lo : lo + 256] @ x.T
        for i, row in enumerate(scores, lo):
            row = row[np.isin(leaf, leaves[i])]
            if len(row) >= k:
                out[i] = np.partition(row, len(row) - k)[len(row) - k] - 1e-9 * longest * np.sqrt(q[i] @ q[i])
    return out


def search(rows: DataFrame, every: int = 20, k: int = 20, recall: float = 0.95, leaf_rows: int = 256, shelf_rows: int = 4096) -> DataFrame:
    """The k largest inner products of each query vector among all other vectors.

    Queries are the rows whose vec_id is divisible by ``every``.  Equal vectors are indexed
    once with their k + 1 smallest ids, so a vector with very many copies is one entry.

    The tree is fitted on ``SAMPLE`` vectors at most, with leaves of about ``leaf_rows``
    vectors; all vectors are assigned to leaves.  The leaf visits of a search are widened
    until ``CALIBRATION`` queries, whose neighbours are known from a pass over all rows in
    blocks, find ``recall`` of them.  Leaves lie on shelves of about ``shelf_rows`` vectors;
    larger leaves are split over several, and the queries of a shelf into packets, so a
    crowded leaf is no single task.  There are as many leaves as the sample allows, ``SAMPLE``
    at most, so with more vectors leaves are larger and a search reads more of them.

    The vectors of the sample are vectors of the index, so those that lie in the leaves of a
    search tell a score that its k + 1 best reach.  Shelves return what reaches it, instead of
    k + 1 rows each; the result is the same.

    Vectors that are null, zero, hold null or non-finite components, or have another number
    of components than most, take no part, nor do rows without a vec_id.  A repeated vec_id with the same vector counts
    once.  Empty tables give empty ones; fewer candidates give fewer rows.
    """
    spark = rows.sparkSession
    packed = materialize(valid_vectors(rows).distinct())
    common = packed.groupBy("dims").count().orderBy(F.desc("count"), "dims").first()
    schema = "query_id long, rank int, vec_id long, score double"
    if common is None:
        return spark.createDataFrame([], schema)
    packed = packed.filter(F.col("dims") == common["dims"])
    few = F.row_number().over(Window.partitionBy("vec").orderBy("vec_id"))
    few = packed.select("vec_id", "vec", "length2").withColumn("_n", few).filter(F.col("_n") <= k + 1)
    unique = materialize(few.groupBy("vec").agg(F.min("vec_id").alias("vid"), F.max("length2").alias("length2"), F.sort_array(F.collect_list("vec_id")).alias("ids")))  # k + 1 ids at most
    n, longest2 = unique.agg(F.count("*"), F.max("length2")).first()
    longest = float(np.sqrt(longest2))
    sample = unique.orderBy(F.xxhash64("vid"), "vid").select("vec").limit(SAMPLE).collect()  # bounded
    tree = Tree(lifted(matrix(pd.Series([r[0] for r in sample])), longest), leaf_rows / n)
    shared = spark.sparkContext.broadcast((tree, longest))  # no larger than the sample

    def assign(batches):
        t, m = shared.value
        for batch in batches:
            leaf = t.assign(lifted(matrix(batch.column("vec")), m)) if batch.num_rows else np.zeros(0, np.int32)
            yield pa.RecordBatch.from_arrays([batch.column("vid"), pa.array(leaf), batch.column("vec"), batch.column("ids")], ["vid", "leaf", "vec", "ids"])

    index = materialize(unique.select("vid", "vec", "ids").mapInArrow(assign, "vid long, leaf int, vec binary, ids array<long>"))
    placed = index.orderBy(F.xxhash64("vid"), "vid").select("vec", "leaf").limit(SAMPLE).collect()  # the sample again, with its leaves
    known = spark.sparkContext.broadcast((matrix(pd.Series([r["vec"] for r in placed])), np.array([r["leaf"] for r in placed])))
    asked = materialize(packed.filter(F.col("vec_id") % every == 0).select(F.col("vec_id").alias("query_id"), "vec"))
    queries = asked.groupBy("vec").agg(F.count("*").alias("rows")).join(index.select("vid", "vec"), "vec")
    queries = materialize(queries)
    asked = materialize(join_by_group(asked, queries, "vec").select("query_id", "vid"))  # a vector may have very many query copies
    visits = calibrated_visits(queries, index, shared, k, recall)

    counts = {r["leaf"]: r["count"] for r in index.groupBy("leaf").count().collect()}  # a row for each leaf
    shelves, at, load = {}, 0, 0
    for leaf in sorted(counts):
        parts = -(-counts[leaf] // shelf_rows)
        if load and (parts > 1 or load + counts[leaf] > shelf_rows):
            at, load = at + 1, 0
        shelves[leaf] = (at, parts)
        at, load = (at + parts, 0) if parts > 1 else (at, load + counts[leaf])

    def route(batches):
        t, m = shared.value
        for batch in batches:
            x, out = matrix(batch.column("vec")), []
            high = lifted(x, m) if len(x) else x
            high[:, -1:] = 0.0  # a query is not lifted
            visited = [[leaf for leaf, _ in zip(t.visit(row), range(visits), strict=False)] for row in high]
            least = floors(x, visited, *known.value, k + 1, m)
            for vid, v, first_to_last, low in zip(batch.column("vid").to_pylist(), batch.column("vec").to_pylist(), visited, least.tolist(), strict=True):
                on: dict[int, list[int]] = {}
                for leaf in first_to_last:
                    first, parts = shelves.get(leaf, (0, 0))
                    for shelf in range(first, first + parts):
                        on.setdefault(shelf, []).append(leaf)
                out += [(shelf, vid, v, leaves, low) for shelf, leaves in on.items()]
            columns = list(zip(*out, strict=True)) or [[], [], [], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(columns, (pa.int32(), pa.int64(), pa.binary(), pa.list_(pa.int32()), pa.float64()), strict=True)], ["shelf", "qid", "qvec", "leaves", "least"])

    routed = materialize(queries.repartition(F.col("vid")).mapInArrow(route, "shelf int, qid long, qvec binary, leaves array<int>, least double"))
    crowd = F.broadcast(routed.groupBy("shelf").agg(F.ceil(F.count("*") / shelf_rows).cast("int").alias("packets")))  # a row for each shelf
    on = F.broadcast(spark.createDataFrame([(leaf, first, parts) for leaf, (first, parts) in shelves.items()], "leaf int, first int, parts int"))  # a row for each leaf, SAMPLE at most
    stored = index.join(on, "leaf").withColumn("shelf", (F.col("first") + F.pmod(F.xxhash64("vid"), F.col("parts"))).cast("int"))
    stored = stored.join(crowd, "shelf").withColumn("packet", F.explode(F.sequence(F.lit(0), F.col("packets") - 1))).drop("packets", "first", "parts")
    routed = routed.join(crowd, "shelf").withColumn("packet", F.pmod(F.xxhash64("qid"), F.col("packets")).cast("int")).drop("packets")

    def meet(q: pd.DataFrame, x: pd.DataFrame) -> pd.DataFrame:
        if not len(q) or not len(x):
            return pd.DataFrame({"qid": [], "vid": [], "score": [], "ids": []})
        xs, qs, vid, leaf = matrix(x["vec"]), matrix(q["qvec"]), x["vid"].to_numpy(), x["leaf"].to_numpy()
        ids, out = x["ids"].to_numpy(), []
        rows_of = {j: np.flatnonzero(leaf == j) for j in np.unique(leaf)}
        for at in range(0, len(qs), 512):
            scores = qs[at : at + 512] @ xs.T
            for qid, leaves, least, row in zip(*(q[c].iloc[at : at + 512] for c in ("qid", "leaves", "least")), scores, strict=True):
                seen = np.concatenate([rows_of[j] for j in leaves if j in rows_of] or [np.zeros(0, np.int64)])
                seen = seen[row[seen] >= least]
                top = seen[best(row[seen], vid[seen], k + 1)]
                out += zip([qid] * len(top), vid[top].tolist(), row[top].tolist(), ids[top], strict=True)
        return pd.DataFrame(out, columns=["qid", "vid", "score", "ids"])

    near = routed.groupBy("shelf", "packet").cogroup(stored.groupBy("shelf", "packet")).applyInPandas(meet, "qid long, vid long, score double, ids array<long>")
    order = [F.desc("score"), "vid"]
    near = near.withColumn("_n", F.row_number().over(Window.partitionBy("qid").orderBy(*order))).filter(F.col("_n") <= k + 1)
    each = near.select("qid", "score", F.explode("ids").alias("id"))
    each = each.withColumn("_n", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("score"), "id"))).filter(F.col("_n") <= k + 1)
    lists = each.groupBy(F.col("qid").alias("vid")).agg(F.sort_array(F.collect_list(F.struct("_n", "id", "score"))).alias("found"))  # k + 1 at most
    answers = join_by_group(asked, lists.join(queries.select("vid", "rows"), "vid"), "vid").select("query_id", F.expr(f"slice(filter(found, x -> x.id != query_id), 1, {k})").alias("found"))
    return answers.select("query_id", F.posexplode("found").alias("rank", "f")).select("query_id", (F.col("rank") + 1).cast("int").alias("rank"), F.col("f.id").alias("vec_id"), F.col("f.score").alias("score"))


def calibrated_visits(queries: DataFrame, index: DataFrame, shared, k: int, recall: float) -> int:
    """The fewest leaf visits with which best bin first finds ``recall`` of some queries' true neighbours."""
    some = queries.orderBy(F.xxhash64("vid"), "vid").limit(CALIBRATION).collect()  # bounded
    tree, longest = shared.value
    if not some:
        return tree.leaves
    asked, own = matrix(pd.Series([r["vec"] for r in some])), np.array([r["vid"] for r in some])

    def brute(batches):
        for batch in batches:
            x, vid, leaf = matrix(batch.column("vec")), np.asarray(batch.column("vid")), np.asarray(batch.column("leaf"))
            out = []
            for i, row in enumerate(asked @ x.T if len(x) else []):
                top = best(np.where(vid == own[i], -np.inf, row), vid, k)
                out += [(i, float(row[j]), int(vid[j]), int(leaf[j])) for j in top if vid[j] != own[i]]
            columns = list(zip(*out, strict=True)) or [[], [], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.float64(), pa.int64(), pa.int32()), strict=True)], ["i", "score", "vid", "leaf"])

    true = index.select("vid", "vec", "leaf").mapInArrow(brute, "i int, score double, vid long, leaf int")
    true = true.withColumn("_n", F.row_number().over(Window.partitionBy("i").orderBy(F.desc("score"), "vid"))).filter(F.col("_n") <= k)
    wanted: dict[int, list[int]] = {}
    for r in true.select("i", "leaf").collect():  # k rows for each calibration query
        wanted.setdefault(r["i"], []).append(r["leaf"])
    found = np.zeros(tree.leaves + 1, np.int64)  # neighbours by the visit that meets them
    for i, leaves in wanted.items():
        turn = {leaf: t for t, leaf in enumerate(tree.visit(np.append(asked[i], 0.0)), 1)}
        for leaf in leaves:
            found[turn[leaf]] += 1
    total, visits = max(1, int(found.sum())), 1
    while visits < tree.leaves and found[: visits + 1].sum() < recall * total:
        visits += 1
    return visits
