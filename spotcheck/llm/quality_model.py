"""Quality classifier: a linear hinge-loss model over n-gram indicators scaled by class log-count ratios."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from spotcheck.llm.frames import discard, materialize, text_batches
from spotcheck.llm.textbytes import chunks, mix, prefix_hash, release, slice_hash, tidy, words

BITS = 18
#: Largest number of labelled documents that the model is fitted on, and of those in a fold.
MAX_LABELLED, FOLD_ROWS = 20000, 2500


_KIND = np.full(256, 3, np.int64)
_KIND[ord("A") : ord("Z") + 1], _KIND[ord("a") : ord("z") + 1], _KIND[ord("0") : ord("9") + 1] = 0, 1, 2


def held_out(key: Column) -> Column:
    """Rows whose labels are never learned: crc32 of doc_id as text leaves 2 modulo 4."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct feature numbers of each text, one after another, and how many each has.

    The indicators: runs of one, two and three bytes within a text, words, pairs of
    neighbouring words, and runs of one, two and three word shapes, all hashed to 2**BITS
    features.  A word's shape is the kind of its first and last byte (upper case, lower case,
    digit, other) and whether it is the word before once more.
    """
    n, kinds = len(offsets) - 1, []
    wide = data.astype(np.uint32)
    code = wide
    for size in (1, 2, 3):
        if size > 1:
            code = code[:-1] * np.uint32(257) + wide[size - 1 :] + np.uint32(1) if len(code) > 1 else code[:0]
        # the runs that begin in a text's last bytes would leave it
        kinds.append(((code * np.uint32(2654435761) + np.uint32(size * 40503)) >> np.uint32(32 - BITS), offsets[:-1], np.maximum(offsets[1:] - size + 1, offsets[:-1])))
    starts, ends, of = words(data, offsets)
    h = slice_hash(prefix_hash(data), starts, ends)
    pair = of[1:] == of[:-1]
    two = np.append(np.where(pair, h[1:] * np.uint64(3) + h[:-1], h[:-1]), h[-1:])  # a last word has no pair
    bounds = np.searchsorted(of, np.arange(n + 1))
    for number in (h, two):
        kinds.append(((mix(number) >> np.uint64(64 - BITS)).astype(np.uint32), bounds[:-1], bounds[1:]))
    same = np.append(False, pair & (h[1:] == h[:-1])) if len(h) else np.zeros(0, bool)
    shape = (_KIND[data[starts]] * 8 + _KIND[data[ends - 1]] * 2 + same).astype(np.uint64)
    run = shape
    for size in (1, 2, 3):
        if size > 1:
            run = run[:-1] * np.uint64(32) + shape[size - 1 :] if len(run) > 1 else run[:0]
        kinds.append(((mix(run + np.uint64(size << 32)) >> np.uint64(64 - BITS)).astype(np.uint32), bounds[:-1], np.maximum(bounds[1:] - size + 1, bounds[:-1])))
    flags, found = np.zeros(1 << BITS, bool), [np.zeros(0, np.int64)]
    for i in range(n):
        for number, first, last in kinds:
            flags[number[first[i] : last[i]]] = True
        found.append(np.flatnonzero(flags))
        flags[found[-1]] = False
    return np.concatenate(found), np.array([len(x) for x in found[1:]], np.int64)


def log_count_ratio(index: np.ndarray, counts: np.ndarray, label: np.ndarray) -> np.ndarray:
    """Smoothed log ratio of the features' document counts in the two classes."""
    pos, neg = np.ones(1 << BITS), np.ones(1 << BITS)
    for row, y in zip(np.split(index, np.cumsum(counts)[:-1]), label, strict=True):
        (pos if y == 1 else neg)[row] += 1  # a text's features are distinct
    return np.log(pos / pos.sum()) - np.log(neg / neg.sum())


def damping(index: np.ndarray, counts: np.ndarray, ratio: np.ndarray) -> float:
    """The median squared length of the rows, added to each before scaling: short texts stay near the bias."""
    lengths = [float(ratio[row] @ ratio[row]) for row in np.split(index, np.cumsum(counts)[:-1])] if len(counts) else [1.0]
    return float(np.median(lengths))


def dual_coordinate_descent(index: np.ndarray, counts: np.ndarray, label: np.ndarray, ratio: np.ndarray, damp: float, cost: float = 10.0, passes: int = 12) -> tuple[np.ndarray, float]:
    """Weights and bias minimising |w|^2 / 2 plus ``cost`` times the hinge losses.

    Each text's row is its features' ratios, scaled by their damped length; one dual variable
    at a time is brought to its optimum between 0 and the cost.
    """
    ends, n = np.cumsum(counts), len(counts)
    y = np.where(label == 1, 1.0, -1.0)
    value, square = ratio.astype(np.float32)[index], np.zeros(n)  # a task holds these and ``index``, nothing of their size besides
    for i in range(n):
        row = value[ends[i] - counts[i] : ends[i]]
        square[i] = np.dot(row, row)
        row /= np.float32(np.sqrt(square[i] + damp))
    curve = 1.0 + square / (square + damp)  # the bias adds 1
    w, bias, alpha, rng = np.zeros(len(ratio)), 0.0, np.zeros(n), np.random.default_rng(7)
    for _ in range(passes):
        moved = 0.0
        for i in rng.permutation(n):
            j, x = index[ends[i] - counts[i] : ends[i]], value[ends[i] - counts[i] : ends[i]]
            slope = y[i] * (w[j] @ x + bias) - 1.0
            new = min(max(alpha[i] - slope / curve[i], 0.0), cost)
            if new != alpha[i]:
                step = (new - alpha[i]) * y[i]
                w[j] += step * x
                bias += step
                moved = max(moved, abs(new - alpha[i]))
                alpha[i] = new
        if moved < 1e-3:
            break
    return w, bias


def margins(index: np.ndarray, counts: np.ndarray, weights: np.ndarray, ratio: np.ndarray, bias: float, damp: float) -> np.ndarray:
    """The decision value of each text; ``weights`` already hold the ratios as a factor."""
    n = len(counts)
    if not n:
        return np.zeros(0)
    owner = np.repeat(np.arange(n), counts)
    length = np.sqrt(np.bincount(owner, ratio[index] ** 2, n) + damp)
    return np.bincount(owner, weights[index], n) / length + bias


def _extracted(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """The features of each text of a batch, as ``features`` gives them."""
    index, counts = [np.zeros(0, np.int32)], [np.zeros(0, np.int64)]
    for _, _, data, offsets in chunks(batch, "text"):
        i, c = features(data, offsets)
        index.append(i.astype(np.int32))
        counts.append(c)
    return np.concatenate(index), np.concatenate(counts)


def averaged(models: list[dict], without: int | None = None) -> dict:
    """The mean of the models: of the weights with their ratios as a factor, of the ratios, biases and dampings.

    ``without`` leaves out the model of one fold, if there is another.
    """
    some = [m for m in models if m["fold"] != without] or models
    mean = lambda k: np.mean([m[k] for m in some], axis=0, dtype=np.float64)
    return {"weights": mean("weights"), "ratio": mean("ratio"), "bias": float(mean("bias")), "damp": float(mean("damp"))}


def fit(labelled: DataFrame, fold_rows: int = FOLD_ROWS, threshold: float = 0.7) -> dict:
    """A model from a bounded number of rows of ``doc_id``, ``text`` and ``label`` (0 or 1).

    One text of each doc_id and label teaches, however often rows repeat.  The texts are
    dealt into folds of about ``fold_rows``, two at least; a task fits one fold, and the model
    is the mean of theirs.  The score is calibrated on margins of that mean: each labelled row
    is judged by the mean of all folds but its own.  What comes back is bounded: a model of
    2**BITS weights from each fold, and a margin of each labelled row.  With one class only,
    the score is that class's.
    """
    texts = labelled.groupBy(F.col("doc_id").cast("long").alias("doc_id"), F.col("label").cast("int").alias("label")).agg(F.min(F.col("text").cast("string")).alias("text"))
    stored = materialize(texts)
    folds = max(2, -(-stored.count() // fold_rows))
    table = text_batches(stored.withColumn("fold", F.pmod(F.xxhash64("doc_id"), F.lit(folds))))

    def learn_fold(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["doc_id", "label"])
        index, counts = _extracted(pa.RecordBatch.from_arrays([pa.array(group["text"], pa.string())], ["text"]))
        label = group["label"].to_numpy(np.int64)
        ratio = log_count_ratio(index, counts, label)
        damp = damping(index, counts, ratio)
        w, bias = dual_coordinate_descent(index, counts, label, ratio, damp)
        del index
        release()
        return pd.DataFrame({"fold": group["fold"].iloc[:1], "weights": [(w * ratio).astype(np.float32).tobytes()], "ratio": [ratio.astype(np.float32).tobytes()], "bias": [bias], "damp": [damp]})

    found = table.groupBy("fold").applyInPandas(learn_fold, "fold long, weights binary, ratio binary, bias double, damp double").collect()  # ``folds`` rows at most
    if not found:
        return {"weights": np.zeros(1 << BITS), "ratio": np.ones(1 << BITS), "bias": 0.0, "damp": 1.0, "slope": 1.0, "centre": 0.0, "threshold": threshold}
    models = [r.asDict() | {k: np.frombuffer(r[k], np.float32) for k in ("weights", "ratio")} for r in sorted(found, key=lambda r: r["fold"])]
    shared = table.sparkSession.sparkContext.broadcast(models)  # ``folds`` times two arrays of 2**BITS weights

    def judge(batches):
        for batch in (b.slice(at, 256) for b in batches for at in range(0, b.num_rows, 256)):
            fold, label = np.asarray(batch.column("fold")), batch.column("label")
            margin = np.zeros(batch.num_rows)
            for f in np.unique(fold):
                own, m = np.flatnonzero(fold == f), averaged(shared.value, without=f)
                margin[own] = margins(*_extracted(batch.take(pa.array(own))), m["weights"], m["ratio"], m["bias"], m["damp"])
            yield pa.RecordBatch.from_arrays([pa.array(margin), label], ["margin", "label"])

    told = table.mapInArrow(tidy(judge), "margin double, label int").collect()  # a row for each labelled one
    discard(stored)
    shared.unpersist()
    centre, slope = calibrate(np.array([r["margin"] for r in told]), np.array([r["label"] for r in told], np.int64))
    return averaged(models) | {"slope": slope, "centre": centre, "threshold": threshold}


def calibrate(told: np.ndarray, label: np.ndarray) -> tuple[float, float]:
    """The margin that parts the classes with fewest errors (the middle of the best gap), and a slope."""
    if label.min(initial=1) == label.max(initial=0) or not len(label):
        return (-np.inf if len(label) and label[0] == 1 else np.inf if len(label) else 0.0), 1.0
    order = np.argsort(told, kind="stable")
    m, y = told[order], label[order]
    errors = np.append(0, np.cumsum(y)) + np.append(np.cumsum((1 - y)[::-1])[::-1], 0)  # those below count as 0
    best = np.flatnonzero(errors == errors.min())
    cut = best[len(best) // 2]
    low, high = m[max(cut - 1, 0)], m[min(cut, len(m) - 1)]
    spread = max(float(np.abs(m - (low + high) / 2).mean()), 1e-6)
    return float((low + high) / 2), 2.0 / spread


def _scores(batch: pa.RecordBatch, m: dict) -> np.ndarray:
    """The score of each text: a logistic curve of the margin that meets the threshold where the classes part best."""
    out = [np.zeros(0)]
    for _, _, data, offsets in chunks(batch, "text"):
        out.append(margins(*features(data, offsets), m["weights"], m["ratio"], m["bias"], m["damp"]))
    lift = np.clip(m["slope"] * (np.concatenate(out) - m["centre"]), -30, 30) + np.log(m["threshold"] / (1 - m["threshold"]))
    return 1 / (1 + np.exp(-lift))


def score(docs: DataFrame, model: dict) -> DataFrame:
    """doc_id, score and predicted of each whole text, in one pass without a shuffle.

    Empty and null texts score by the bias alone; repeated rows get a row each; an empty
    table gives an empty one; further columns are left out.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # two arrays of 2**BITS weights

    def tell(batches):
        for batch in batches:
            value = _scores(batch, shared.value)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(value), pa.array((value >= shared.value["threshold"]).astype(np.int32))], ["doc_id", "score", "predicted"])

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return text_batches(rows).mapInArrow(tidy(tell), "doc_id long, score double, predicted int")


def accepted(docs: DataFrame, model: dict) -> DataFrame:
    """The rows, with all their columns, whose score reaches the threshold; one pass, no shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def keep(batches):
        for batch in batches:
            yield batch.filter(pa.array(_scores(batch, shared.value) >= shared.value["threshold"]))

    return text_batches(docs).mapInArrow(tidy(keep), docs.schema)


def learn(docs: DataFrame, labels: DataFrame, label: str = "quality", threshold: float = 0.7, max_labelled: int = MAX_LABELLED) -> dict:
    """A model from the labels, other than the held out ones, of documents in ``docs``.

    At most ``max_labelled`` labels are used, those of smallest id hash.  Null labels and ids
    teach nothing; of differing labels of one document the larger counts.
    """
    taught = labels.filter(F.col(label).isin(0, 1) & ~held_out(F.col("doc_id"))).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(label).alias("label"))
    texts = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    # the bounded choice is made on ids, before any text is moved
    chosen = taught.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labelled)
    return fit(texts.join(F.broadcast(chosen), "doc_id"), threshold=threshold)


def classify(docs: DataFrame, labels: DataFrame, label: str = "quality", threshold: float = 0.7, max_labelled: int = MAX_LABELLED) -> DataFrame:
    """Score every document with a model learned from the labels that are not held out.

    Labels enter the fit only; language, source and id never enter a score.  Null texts are
    empty, repeated rows give a row each, an empty table gives an empty one, and further
    columns are left out.
    """
    return score(docs, learn(docs, labels, label, threshold, max_labelled))
