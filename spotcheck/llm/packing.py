"""Best-fit packing whose bin counts are certified by dual-feasible-function bounds."""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from spotcheck.llm.frames import materialize, text_batches
from spotcheck.llm.textbytes import chunks, tidy
from spotcheck.llm.tokencounts import encoder


def cut_pieces(docs: DataFrame, tokenizer: str, capacity: int = 1024, end_id: int = 2, with_ids: bool = False) -> DataFrame:
    """Token pieces of each whole text: its ids and ``end_id``, cut only if longer than ``capacity``.

    Of a longer document the first piece holds the remainder, all others are full.  A null
    text is empty: one piece with ``end_id`` alone.  with_ids adds the piece's ids as a
    little-endian binary column.  One pass, no shuffle.
    """

    def cut(batches):
        worker = encoder(tokenizer, True)
        for batch in batches:
            rows, parts = [], []
            for lo, _, data, offsets in chunks(batch, "text"):
                counts, flat = worker.encode(data, offsets, want_ids=True)
                at = np.append(0, np.cumsum(counts))
                for i in range(len(counts)):
                    ids = flat[at[i] : at[i + 1]].astype("<u4").tobytes() + int(end_id).to_bytes(4, "little")
                    n = len(ids) // 4
                    cuts = [0, *range(n % capacity or capacity, n + 1, capacity)]
                    for piece, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
                        raw = ids[4 * a : 4 * b]
                        rows.append((lo + i, piece, a, b - a, zlib.crc32(raw)))
                        if with_ids:
                            parts.append(raw)
            r = np.array(rows, np.int64).reshape(-1, 5)
            out = [batch.column("doc_id").take(pa.array(r[:, 0])), pa.array(r[:, 1].astype(np.int32)), *(pa.array(r[:, j]) for j in (2, 3, 4))]
            out += [pa.array(parts, pa.binary())] if with_ids else []
            yield pa.RecordBatch.from_arrays(out, ["doc_id", "piece", "start", "length", "ids_crc32", *["ids"] * with_ids])

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return text_batches(rows).mapInArrow(tidy(cut, keep=True), "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids)


def lower_bound(histogram: np.ndarray) -> int:
    """Bins that any packing needs, by dual feasible functions.

    histogram[x]: items of size x, for x up to the capacity C.  Takes the best of three
    families of functions u with sum(u) <= 1 over every bin: rounding to k-ths, dropping
    small items against large ones, and rounding both by a unit.
    """
    n = np.asarray(histogram, np.int64)
    cap = len(n) - 1
    x = np.arange(cap + 1)
    best = -(-int(n @ x) // cap)
    for k in range(1, 101):
        scaled = x * (k + 1)
        value = np.where(scaled % cap == 0, x * k, scaled // cap * cap)  # u * k * cap
        best = max(best, -(-int(n @ value) // (k * cap)))
    for e in np.flatnonzero(n[: cap // 2 + 1])[1 if n[0] else 0 :]:
        if e == 0:
            continue
        large_whole = np.where(x > cap - e, cap, np.where(x >= e, x, 0))
        best = max(best, -(-int(n @ large_whole) // cap))
        unit = cap // e
        value = np.where(x > cap / 2, unit - (cap - x) // e, (x >= e).astype(np.int64))  # u * unit
        best = max(best, -(-int(n @ value) // unit))
    return best


def best_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin of each item, and how full each bin is; the fullest bin that still has room takes an item."""
    bins, fill = np.zeros(len(lengths), np.int64), []
    open_by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms = 0  # bit r: some bin has room r
    order = np.argsort(-lengths, kind="stable")
    for i, size in zip(order.tolist(), lengths[order].tolist(), strict=True):
        fits = rooms >> size
        if fits:
            room = size + (fits & -fits).bit_length() - 1
            b = open_by_room[room].pop()
            if not open_by_room[room]:
                rooms &= ~(1 << room)
        else:
            room, b = capacity, len(fill)
            fill.append(0)
        bins[i] = b
        fill[b] += size
        if room > size:
            open_by_room[room - size].append(b)
            rooms |= 1 << (room - size)
    return bins, np.array(fill, np.int64)


def pack(pieces: DataFrame, capacity: int = 1024, per_partition: int = 20000, rounds: int = 6) -> DataFrame:
    """Put pieces (any columns with ``length`` from 1 to ``capacity``) into few bins.

    Pieces are dealt at random to partitions of about ``per_partition`` and packed best fit
    decreasing in each.  A partition whose number of bins is its lower bound is certified: no
    packing of it has fewer, so its bins are closed, but for the emptiest one.  Of the others
    the bins without slack are closed.  The documents of the bins that stay open are dealt
    anew, so that partitions with gaps exchange documents, and packed again, until the bound
    of the whole is reached, a round saves no bin (it is dropped), or after ``rounds``.
    Memory in a task follows ``per_partition`` alone, whatever keys or sources the pieces
    come from.

    Adds sequence_id (any numbers) and offset (place in the bin, without gaps); columns of
    these names are replaced, and so are ``_deal`` and ``_open``.  Repeated rows
    are dealt one by one and packed as often as they stand there; an empty table stays empty.
    """
    pieces = materialize(pieces.drop("sequence_id", "offset", "_deal", "_open"))
    names = pieces.columns

    def pack_group(group: pd.DataFrame) -> pd.DataFrame:
        lengths = group["length"].to_numpy(np.int64)
        bins, fill = best_fit_decreasing(lengths, capacity)
        order = np.argsort(bins, kind="stable")
        ends = np.cumsum(lengths[order])
        first = np.append(True, bins[order][1:] != bins[order][:-1])
        offset = np.empty(len(lengths), np.int64)
        offset[order] = ends - lengths[order] - np.maximum.accumulate(np.where(first, ends - lengths[order], 0))
        open_ = fill < capacity
        if len(fill) <= lower_bound(np.bincount(lengths, minlength=capacity + 1)):  # certified
            open_ &= np.arange(len(fill)) == fill.argmin()
        return group.assign(sequence_id=bins, offset=offset, _open=open_[bins])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema)
    schema += ", _deal long, sequence_id long, offset long, _open boolean"

    def dealt(rows: DataFrame, salt: int, n: int) -> DataFrame:
        groups = max(1, -(-n // per_partition))
        # the rows of a written table, so that equal ones part and a task run again deals alike
        mixed = rows.select(*names, F.pmod(F.xxhash64(F.lit(salt), F.monotonically_increasing_id()), F.lit(groups)).alias("_deal"))
        out = mixed.groupBy("_deal").applyInPandas(pack_group, schema)
        number = (F.lit(salt) * F.lit(1 << 52) + F.col("_deal") * F.lit(1 << 20)) + F.col("sequence_id")
        return materialize(out.withColumn("sequence_id", number))

    histogram = np.zeros(capacity + 1, np.int64)  # as many rows as the capacity at most
    for size, n in pieces.groupBy("length").count().collect():
        histogram[size] = n
    bound, rest = lower_bound(histogram), int(histogram.sum())
    kept, current, closed = None, dealt(pieces, 0, rest), 0
    for salt in range(1, rounds + 1):
        first = F.col("offset") == 0
        done, loose, bins = current.agg(F.count(F.when(~F.col("_open") & first, 1)), F.count(F.when(F.col("_open"), 1)), F.count(F.when(first, 1))).first()
        if closed + bins <= bound or loose == 0:
            break
        again = dealt(current.filter("_open"), salt, loose)
        if again.filter("offset = 0").count() >= bins - done:
            break
        settled = current.filter("not _open")
        kept, closed, current = settled if kept is None else kept.unionByName(settled), closed + done, again
    everything = current if kept is None else kept.unionByName(current)
    return everything.drop("_deal", "_open")


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = 1024, end_id: int = 2, per_partition: int = 20000) -> DataFrame:
    """``cut_pieces`` and ``pack``: where each piece of each document stands in which sequence.

    A null or empty text is one piece with ``end_id`` alone; repeated rows are packed one by
    one; ids may be null; an empty table gives an empty one; further columns are left out.
    """
    return pack(cut_pieces(docs, tokenizer, capacity, end_id), capacity, per_partition)
