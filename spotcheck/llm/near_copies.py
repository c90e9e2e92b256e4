"""Near-duplicate documents by improved consistent weighted sampling over TF-IDF shingles."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from spotcheck.llm.components import components
from spotcheck.llm.filters import bloom, contains, maybe_in
from spotcheck.llm.frames import discard, join_by_group, materialize, text_batches
from spotcheck.llm.textbytes import chunks, mix, prefix_hash, release, slice_hash, spread, tidy, words

SHINGLE = 5
#: A shingle is common beyond this share of all documents; more than ``TABLE`` cannot be (12 MB broadcast).
COMMON, TABLE = 1e-3, 1 << 20
#: Distinct shingles of documents that a task counts at once.
SEND = 1 << 20
#: Bytes of text in a counting task, at least.
TASK_BYTES = 16 << 20
SAMPLES = 64
#: Largest chance that the bands lose a pair at the wanted similarity.
LOSS = 1e-3
#: Bytes of text in one pass of array code.
PASS_BYTES = 1 << 19
#: Pairs whose shingles a task holds at once.
PASS_PAIRS = 128
#: Entries of a bucket that are compared with all those of other classes in it; larger buckets are split by rare shingles.
SMALL = 32
#: Entries, and bytes of text, of either side that a task compares at once with all of the other; shingles in one matrix product.
BLOCK, BLOCK_BYTES, COLUMNS = 1024, 8 << 20, 2048
#: Rows that the whole comparison of large buckets may read for each of their entries, before more rounds are tried to make it smaller.
COPIES = 4
_rng = np.random.default_rng(11)
_N = 1 << 16
# draws of the sampler: gamma(2, 1), the logarithm of gamma(2, 1), uniform
_R = _rng.gamma(2.0, 1.0, _N).astype(np.float32).clip(1e-3)
_LOG_C = np.log(_rng.gamma(2.0, 1.0, _N)).astype(np.float32)
_BETA = _rng.random(_N).astype(np.float32)
_ODD = _rng.integers(1 << 62, 1 << 63, SAMPLES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingles(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct five-word shingles of each text: hashes in order, times each occurs, and how many a text has.

    A text of one to four words is one shingle; one without words has none.
    """
    starts, ends, of = words(data, offsets)
    n = len(offsets) - 1
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(n, np.int64)
    h = slice_hash(prefix_hash(data), starts, ends)
    per = np.bincount(of, minlength=n)
    first = np.cumsum(per) - per
    padded = np.append(h, np.zeros(SHINGLE - 1, np.uint64))
    owner = np.append(of, np.full(SHINGLE - 1, -1))
    sum_ = np.zeros(len(h), np.uint64)
    for j in range(SHINGLE):
        sum_ += np.where(owner[j : j + len(h)] == of, padded[j : j + len(h)], np.uint64(j + 1)) * _ODD[j]
    place = np.arange(len(h)) - first[of]
    keep = place < np.maximum(per[of] - SHINGLE + 1, 1)
    code, of = mix(sum_[keep]), of[keep]
    order = np.lexsort((code, of))
    code, of = code[order], of[order]
    new = np.append(True, (code[1:] != code[:-1]) | (of[1:] != of[:-1]))
    at = np.flatnonzero(new)
    return code[at], np.diff(np.append(at, len(code))), np.bincount(of[at], minlength=n)


def bands_for(similarity: float) -> tuple[int, int, int]:
    """Bands, samples in a band, and the least number of equal samples of a pair worth verifying.

    The longest bands that lose a pair of the similarity with a chance of ``LOSS`` at most
    (single samples, if no length does); five deviations are allowed for the equal samples.
    """
    rows = next((r for r in (16, 8, 4, 2) if (1 - similarity**r) ** (SAMPLES // r) <= LOSS), 1)
    return SAMPLES // rows, rows, max(1, int(SAMPLES * similarity - 5 * np.sqrt(SAMPLES * similarity * (1 - similarity))))


def common_shingles(texts: DataFrame) -> tuple[DataFrame, float, int]:
    """code and n of every shingle that more than some number of documents hold, that number, and the number of all documents.

    The number is ``COMMON`` of all documents (one at least), or as many more as keep the table
    within ``TABLE`` rows, so it follows the mean length of documents and not their number.
    A shingle of more than a share of all documents is in more than that share of the
    documents of some chunk.  So tasks first tell what is that frequent in a chunk of theirs,
    and then the counts of those shingles alone: exact counts, without a shuffle of all.
    """
    total, size = texts.agg(F.count("*"), F.sum(F.octet_length("text"))).first()
    context = texts.sparkSession.sparkContext
    # small partitions are read together: a share of few documents tells little
    rows = texts.select("text").coalesce(max(context.defaultParallelism, (size or 0) // TASK_BYTES))

    def counted(batches, tell):
        full, codes, docs, held = None, [], 0, 0
        for batch in batches:
            for lo, hi, data, offsets in chunks(batch, "text", PASS_BYTES):
                code, _, _ = shingles(data, offsets)  # distinct in each text
                codes.append(code)
                docs, held = docs + hi - lo, held + len(code)
                if held >= SEND:
                    if full is not None:
                        yield tell(*full)
                    full, codes, docs, held = (np.concatenate(codes), docs), [], 0, 0
        if full is not None:  # what is left goes along with the last full chunk
            codes, docs, held = [full[0], *codes], docs + full[1], held + len(full[0])
        if held:
            yield tell(np.concatenate(codes), docs)

    def table(code: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(code.view(np.int64)), pa.array(n.astype(np.int64))], ["code", "n"])

    share = max(COMMON, 1 / max(total, 1))

    def frequent(batches):
        def tell(code, docs):
            distinct, n = np.unique(code, return_counts=True)
            some = n > share * docs * (1 - 1e-9) if docs < total else n > 1
            # the number of all shingles goes along as that of code 0
            return table(np.append(np.uint64(0), distinct[some]), np.append(len(code), n[some]))

        return counted(batches, tell)

    first = materialize(rows.mapInArrow(tidy(frequent), "code long, n long").groupBy("code").agg(F.sum("n").alias("n")))
    shingles_of_all = first.filter("code = 0").agg(F.sum("n")).first()[0] or 0
    least = max(share * total, shingles_of_all / TABLE)
    flags, bits = bloom(first.filter("code != 0"), "code")
    flags = context.broadcast(flags)

    def count(batches):
        def tell(code, _):
            return table(*np.unique(code[contains(flags.value, bits, code)], return_counts=True))

        return counted(batches, tell)

    exact = rows.mapInArrow(tidy(count), "code long, n long").groupBy("code").agg(F.sum("n").alias("n")).filter(F.col("n") > F.lit(least * (1 + 1e-9)))
    return materialize(exact), least, total


def packed(table: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """A bounded table of code and n as arrays in the order of the codes."""

    def pack(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([np.asarray(batch.column(c)).tobytes()], pa.binary()) for c in ("code", "n")], ["code", "n"])

    rows = table.select("code", "n").mapInArrow(pack, "code binary, n binary").collect()
    code, n = (np.frombuffer(b"".join(r[c] for r in rows), t) for c, t in (("code", np.uint64), ("n", np.int64)))
    order = np.argsort(code)
    return code[order], n[order].astype(np.float32)


def sketch(code: np.ndarray, weight: np.ndarray, per: np.ndarray) -> np.ndarray:
    """Consistent weighted samples of each text with shingles: a row of SAMPLES hashes.

    Two texts share a sample with the probability of their weighted Jaccard similarity.
    """
    per = per[per > 0]
    out = np.zeros((len(per), SAMPLES), np.uint64)
    if not len(per):
        return out
    first = np.cumsum(per) - per
    log_w, place = np.log(weight).astype(np.float32), np.arange(len(code))
    for k in range(SAMPLES):
        at = (code * _ODD[k] >> np.uint64(48)).astype(np.int64)
        r, beta = _R[at], _BETA[at]
        t = np.floor(log_w / r + beta)
        a = _LOG_C[at] - r * (t - beta) - r
        low = np.repeat(np.minimum.reduceat(a, first), per)
        won = np.minimum.reduceat(np.where(a == low, place, len(code)), first)
        out[:, k] = mix(code[won] + t[won].astype(np.int64).view(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return out


def weighted_jaccard(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Sum of the smaller weights over sum of the larger, for (hashes in order, weights)."""
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    shared = float(np.minimum(a[1][i], b[1][j]).sum(dtype=np.float64))
    total = float(a[1].sum(dtype=np.float64) + b[1].sum(dtype=np.float64)) - shared
    return shared / total if total > 0 else 0.0


#: Number of the text, shingle and weight of each occurrence of a shingle; a repeated one goes by its turn, too.
Side = tuple[np.ndarray, np.ndarray, np.ndarray]


def overlaps(a: Side, b: Side) -> np.ndarray:
    """Sums of the smaller weights of each text of one side and each of the other, but for rounding."""
    (of_a, code_a, one), (of_b, code_b, _) = a, b
    both = np.intersect1d(code_a, code_b)
    out = np.zeros((int(of_a.max(initial=-1)) + 1, int(of_b.max(initial=-1)) + 1))
    sides = []
    for of, code, value in ((of_a, code_a, one), (of_b, code_b, np.ones(len(code_b), np.float32))):
        at = np.searchsorted(both, code)
        hit = both[np.minimum(at, len(both) - 1)] == code if len(both) else np.zeros(len(code), bool)
        order = np.argsort(at[hit], kind="stable")
        sides.append((at[hit][order], of[hit][order], value[hit][order]))
    for lo in range(0, len(both), COLUMNS):
        wide, dense = min(COLUMNS, len(both) - lo), []
        for (at, of, value), n in zip(sides, out.shape, strict=True):
            i, j = np.searchsorted(at, [lo, lo + wide])
            dense.append(np.zeros((n, wide), np.float32))
            dense[-1][of[i:j], at[i:j] - lo] = value[i:j]
        out += dense[0] @ dense[1].T
    return out


def near_copies(docs: DataFrame, similarity: float = 0.8) -> DataFrame:
    """doc_id and class_id of every document: the smallest doc_id it is linked to.

    Equal texts are one entry.  Documents that share a band of samples are candidates; links
    are pairs of weighted Jaccard similarity ``similarity`` or more over whole texts.  A
    shingle of few documents weighs 1 for each time it occurs, a common one less, down to a
    half for one of every document: passages that many share count for less, and copies still
    resemble copies.

    In each bucket every entry meets the smallest one.  In buckets of a few entries those of
    different classes then meet each other.  In larger buckets of several classes an entry
    meets those with which it shares one of its rarest shingles, which together weigh just
    over ``1 - similarity`` of it: a link always shares one.  Groups of such a shingle that
    are large meet representatives of their classes.  That leaves few classes, and what is
    still in several of them in a large bucket is compared whole: every entry outside the
    bucket's largest class with every entry of another class, by matrix products over blocks
    of texts, of which only the links come out that join classes.  Only where that would read
    more than ``COPIES`` rows an entry do further rounds of other representatives come first,
    until one brings no new link; they save work and decide nothing.  So no candidate goes
    without a comparison, no step makes a row for each pair of a large group, and pairs within
    a class are neither needed nor made.

    Empty and null texts are equal to each other; a text of one to four words is one shingle;
    repeated rows get a row each; rows without a doc_id take no part; an empty table gives an
    empty one; further columns are left out.
    """
    spark = docs.sparkSession
    bands, rows, least_equal = bands_for(similarity)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    texts = docs.filter(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long"), text.alias("text"))
    text_batches(texts)
    frequent, common, total = common_shingles(texts)
    hot = spark.sparkContext.broadcast(packed(frequent))

    def unit(code: np.ndarray) -> np.ndarray:
        """What one occurrence of each shingle weighs."""
        weight, (codes, counts) = np.ones(len(code), np.float32), hot.value
        if len(codes):
            at = np.minimum(np.searchsorted(codes, code), len(codes) - 1)
            hit = codes[at] == code
            weight[hit] *= 1.0 - np.log(counts[at[hit]] / np.float32(common)) / np.float32(2 * np.log(total / common))
        return weight

    def weighted(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Hashes, weights and number of shingles of each text."""
        code, times, per = shingles(data, offsets)
        return code, times.astype(np.float32) * unit(code), per

    digest = F.expr("substring(unhex(sha2(text, 256)), 1, 16)")
    drawn = materialize(texts.select("doc_id", digest.alias("digest")))
    named = materialize(drawn.groupBy("digest").agg(F.min("doc_id").alias("entry"), F.count("*").alias("rows")))
    one = maybe_in(named, "entry")
    firsts = texts.filter(one(F.col("doc_id"))).withColumn("digest", digest)  # and few others

    def draw(batches):
        for batch in batches:
            keys, samples = [], []
            for _, _, data, offsets in chunks(batch, "text", PASS_BYTES):
                code, weight, per = weighted(data, offsets)
                s = sketch(code, weight, per)
                b = np.zeros((len(s), bands), np.uint64) + np.arange(bands, dtype=np.uint64)
                for j in range(rows):
                    b = mix(b * np.uint64(31) + s[:, j::rows])
                at = np.cumsum(per > 0) - 1
                some = [(b[i].view(np.int64), (s[i] >> np.uint64(33)).astype(np.int32)) if p else ([], []) for i, p in zip(at, per, strict=True)]
                keys += [x[0] for x in some]
                samples += [x[1] for x in some]
            yield pa.RecordBatch.from_arrays([batch.column("digest"), pa.array(keys, pa.list_(pa.int64())), pa.array(samples, pa.list_(pa.int32()))], ["digest", "keys", "samples"])

    sketched = firsts.select("text", "digest").mapInArrow(tidy(draw), "digest binary, keys array<long>, samples array<int>")
    sketched = sketched.groupBy("digest").agg(F.first("keys").alias("keys"), F.first("samples").alias("samples"))
    entries = materialize(named.join(sketched, "digest"))
    samples = entries.select(F.col("entry").alias("_e"), "samples")

    def alike(pairs: DataFrame) -> DataFrame:
        """Distinct pairs (a, b) whose samples agree often enough."""
        both = pairs.distinct().join(samples.toDF("a", "x"), "a").join(samples.toDF("b", "y"), "b")
        return both.filter(F.expr(f"size(filter(zip_with(x, y, (p, q) -> p = q), e -> e)) >= {least_equal}")).select("a", "b")

    def texts_of(some: DataFrame) -> DataFrame:
        """entry and text of each of some entries."""
        wanted = maybe_in(some, "entry")
        exact = some.select("entry").distinct().join(entries.select("entry", "digest"), "entry")
        found = firsts.filter(wanted(F.col("doc_id"))).select(F.col("doc_id").alias("entry"), "digest", "text")
        return materialize(found.join(exact, ["entry", "digest"]).dropDuplicates(["entry"]).select("entry", "text"))

    def verify(pairs: DataFrame, whole: DataFrame) -> DataFrame:
        """The pairs (a, b) that are links."""

        def compare(batches):
            for batch in batches:
                kept = np.zeros(batch.num_rows, bool)
                for at in range(0, batch.num_rows, PASS_PAIRS):
                    both = (_rows(batch.slice(at, PASS_PAIRS), side, weighted) for side in "ab")
                    for i, (x, y) in enumerate(zip(*both, strict=True), at):
                        kept[i] = weighted_jaccard(x, y) >= similarity
                mask = pa.array(kept)
                yield pa.RecordBatch.from_arrays([batch.column("a").filter(mask), batch.column("b").filter(mask)], ["a", "b"])

        with_b = pairs.join(whole.toDF("b", "text_b"), "b")
        return with_b.join(whole.toDF("a", "text_a"), "a").select("a", "b", "text_a", "text_b").mapInArrow(tidy(compare), "a long, b long")

    def rare(batches):
        """The shingles of each entry that come first by frequency and together weigh more than 1 - similarity of it."""
        for batch in batches:
            ids, out, of = np.asarray(batch.column("entry")), [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for lo, _, data, offsets in chunks(batch, "text", PASS_BYTES):
                code, weight, per = weighted(data, offsets)
                owner, (codes, counts) = np.repeat(np.arange(len(per)), per), hot.value
                n = np.zeros(len(code), np.float32)
                if len(codes):
                    at = np.minimum(np.searchsorted(codes, code), len(codes) - 1)
                    n = np.where(codes[at] == code, counts[at], n)
                order = np.lexsort((code, n, owner))
                before = np.cumsum(weight[order], dtype=np.float64) - weight[order]
                first = np.cumsum(per) - per
                before -= np.repeat(before[first[per > 0]], per[per > 0])
                limit = (1 - similarity) * (1 + 1e-6) * np.bincount(owner, weight, len(per))
                take = order[before <= limit[owner]]
                out.append(code[take].view(np.int64))
                of.append(ids[lo + owner[take]])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(out)), pa.array(np.concatenate(of))], ["h", "entry"])

    def grouped(members: DataFrame) -> DataFrame:
        """The members (h, entry) of groups of more than one, with the number of members and the smallest one."""
        groups = members.groupBy("h").agg(F.count("*").alias("n"), F.min("entry").alias("hub")).filter("n > 1")
        return materialize(members.join(groups, "h"))

    def mixed(members: DataFrame, root: DataFrame) -> DataFrame:
        """The members of groups that hold several classes, with their class."""
        placed = members.join(root.toDF("entry", "root"), "entry", "left").withColumn("root", F.coalesce("root", "entry"))
        several = placed.groupBy("h").agg(F.min("root").alias("low"), F.max("root").alias("high")).filter("low < high").select("h")
        return placed.join(several, "h", "left_semi")

    def others(placed: DataFrame) -> DataFrame:
        """Pairs of different classes in groups of a few members."""
        few = placed.filter(F.col("n") <= SMALL).select("h", "entry", "root")
        met = few.toDF("h", "a", "ra").join(few.toDF("h", "b", "rb"), "h").filter("a < b and ra != rb")
        return met.select("a", "b")

    def representatives(placed: DataFrame, turn: int) -> DataFrame:
        """Each member of a large group with one of its largest class, and with one of another class."""
        large = placed.filter(F.col("n") > SMALL)
        # drawn anew for each group and turn, those with the least of their own much more often: they are like most others
        number = -F.log((F.pmod(F.xxhash64("entry", "h", F.lit(turn)), F.lit(1 << 40)) + 1) / F.lit(float(1 << 40))) * F.pow(F.col("lone") + 1.0, F.lit(4.0))
        classes = large.groupBy("h", "root").agg(F.count("*").alias("of"), F.min_by("entry", number).alias("chosen"), F.min(number).alias("number"))
        main = classes.groupBy("h").agg(F.max_by("root", F.struct("of", "root")).alias("main"), F.max_by("chosen", F.struct("of", "root")).alias("x"))
        second = classes.join(main, "h").filter("root != main").groupBy("h").agg(F.min_by("root", "number").alias("second"), F.min_by("chosen", "number").alias("y"))
        met = large.join(main.join(second, "h"), "h")
        met = met.select("entry", F.explode(F.array(F.when(F.col("root") != F.col("main"), F.col("x")), F.when(F.col("root") != F.col("second"), F.col("y")))).alias("z")).filter("z is not null")
        return met.select(F.least("entry", "z").alias("a"), F.greatest("entry", "z").alias("b"))

    def block(side: pa.Table) -> tuple[list[int], list[int], Side, list[tuple[np.ndarray, np.ndarray]]]:
        """Entries, their classes, occurrences of their shingles, and (hashes in order, weights) of each."""
        sets, of, codes, ones = [], [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)], [np.zeros(0, np.float32)]
        for lo, _, data, offsets in chunks(side, "text", PASS_BYTES):
            code, times, per = shingles(data, offsets)
            one, ends = unit(code), np.cumsum(per)
            sets += [(code[e - p : e], (times[e - p : e].astype(np.float32) * one[e - p : e])) for e, p in zip(ends, per, strict=True)]
            turn = spread(times).astype(np.uint64)
            again = np.repeat(code, times)
            again[turn > 0] = mix(again[turn > 0] + turn[turn > 0] * np.uint64(0x9E3779B97F4A7C15))
            of.append(lo + np.repeat(np.repeat(np.arange(len(per)), per), times))
            codes.append(again)
            ones.append(np.repeat(one, times))
        return side.column("entry").to_pylist(), side.column("root").to_pylist(), (np.concatenate(of), np.concatenate(codes), np.concatenate(ones)), sets

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        """Links of texts of two blocks that join their classes."""
        out: list[tuple[int, int]] = []
        if left.num_rows and right.num_rows:
            (a, root_a, side_a, sets_a), (b, root_b, side_b, sets_b) = block(left), block(right)
            both = overlaps(side_a, side_b)
            weigh = lambda sets: np.array([float(w.sum(dtype=np.float64)) for _, w in sets])
            likely = both >= (similarity - 1e-3) * (weigh(sets_a)[:, None] + weigh(sets_b) - both)
            likely &= np.array(root_a)[:, None] != np.array(root_b)
            joined: dict[int, int] = {}

            def top(x: int) -> int:
                while x in joined:
                    x = joined[x]
                return x

            for i, j in zip(*(x.tolist() for x in np.nonzero(likely)), strict=True):
                x, y = top(root_a[i]), top(root_b[j])
                if x != y and weighted_jaccard(sets_a[i], sets_b[j]) >= similarity:
                    joined[max(x, y)] = min(x, y)
                    out.append((min(a[i], b[j]), max(a[i], b[j])))
        release()
        return pa.table({"a": pa.array([x for x, _ in out], pa.int64()), "b": pa.array([y for _, y in out], pa.int64())})

    def dealt(placed: DataFrame, whole: DataFrame) -> tuple[DataFrame, int, int]:
        """The entries of buckets of several classes, each bucket's largest class, and into how many blocks and packets it goes.

        With the number of entries, and of the rows that their comparison reads.
        """
        placed = materialize(placed.select("h", "entry", "root").join(whole.select("entry", F.octet_length("text").alias("bytes")), "entry"))
        classes = placed.groupBy("h", "root").agg(F.count("*").alias("of"), F.sum("bytes").alias("bytes"))
        main = classes.groupBy("h").agg(F.max_by("root", F.struct("of", "root")).alias("main"), F.max("of").alias("of"), F.sum("of").alias("n"), F.sum("bytes").alias("bytes"), F.max_by("bytes", F.struct("of", "root")).alias("main_bytes"))

        def parts(n: Column, bytes_: Column) -> Column:
            return F.greatest(F.lit(1), F.ceil(n / F.lit(BLOCK)), F.ceil(bytes_ / F.lit(BLOCK_BYTES))).cast("int")

        main = main.select("h", "main", "n", "of", parts(F.col("n"), F.col("bytes")).alias("blocks"), parts(F.col("n") - F.col("of"), F.col("bytes") - F.col("main_bytes")).alias("packets"))
        main = materialize(main)
        n, read = main.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.expr("sum((n - of) * blocks + n * packets)"), F.lit(0))).first()
        return placed.join(main.drop("n", "of"), "h"), n, read

    def rest(dealt: DataFrame, whole: DataFrame) -> DataFrame:
        """Links (a, b) that join all classes of each bucket between which it has any."""
        own, all_ = lambda of, seed: F.pmod(F.xxhash64("entry", F.lit(seed)), F.col(of)).cast("int"), lambda of: F.explode(F.sequence(F.lit(0), F.col(of) - 1))
        ask = dealt.filter("root != main").withColumn("packet", own("packets", 1)).withColumn("block", all_("blocks"))
        have = dealt.withColumn("block", own("blocks", 2)).withColumn("packet", all_("packets"))
        names = ["entry", "h", "block", "packet", "root", "text"]
        ask, have = (x.select(*names[:-1]).join(whole, "entry").select(*names).toDF(*names).groupBy("h", "block", "packet") for x in (ask, have))
        return ask.cogroup(have).applyInArrow(meet, "a long, b long").distinct()

    def merged(root: DataFrame, found: DataFrame) -> DataFrame:
        """The classes (id, root) with those joined that further links connect."""
        up = found.join(root.toDF("a", "x"), "a", "left").join(root.toDF("b", "y"), "b", "left")
        top = components(materialize(up.select(F.coalesce("x", "a").alias("a"), F.coalesce("y", "b").alias("b")).distinct()))
        moved = root.join(top.toDF("root", "top"), "root", "left").select("id", F.coalesce("top", "root").alias("root"))
        return materialize(moved.unionByName(top.join(root.select("id"), "id", "left_anti")))

    members = grouped(entries.select(F.explode("keys").alias("h"), "entry"))
    whole = texts_of(members)
    tried = materialize(alike(members.filter("entry > hub").select(F.col("hub").alias("a"), F.col("entry").alias("b"))))
    links = materialize(verify(tried, whole))
    # one step along the links tells most classes: those of copies of one smallest document
    near = links.groupBy(F.col("b").alias("entry")).agg(F.min("a").alias("root"))
    placed = materialize(mixed(members, near))
    pairs = others(placed)
    crowd = materialize(placed.filter(F.col("n") > SMALL).select("entry").distinct())
    crowded = crowd.limit(1).count() > 0
    if crowded:
        whole_crowd = materialize(whole.join(crowd, "entry", "left_semi"))
        rarest = materialize(whole_crowd.mapInArrow(tidy(rare), "h long, entry long"))
        groups = grouped(rarest)
        lone = rarest.groupBy("entry").count().join(groups.groupBy("entry").agg(F.count("*").alias("met")), "entry").select("entry", (F.col("count") - F.col("met")).alias("lone"))
        groups = materialize(groups.join(lone, "entry").select("h", "entry", "n", "lone"))
        placed = materialize(mixed(groups, near))
        pairs = pairs.unionByName(others(placed)).unionByName(representatives(placed, 0))
    new = materialize(alike(pairs).join(tried, ["a", "b"], "left_anti"))
    links = materialize(links.unionByName(verify(new, whole)))
    root = materialize(components(links))
    turn, more = 1, crowded
    while crowded:
        left, n, read = dealt(mixed(members.filter(F.col("n") > SMALL), root), whole_crowd)
        if not n:
            break
        if not more or read <= COPIES * n:
            root = merged(root, materialize(rest(left, whole_crowd)))
            break
        placed = materialize(mixed(groups.filter(F.col("n") > SMALL), root))
        tried = tried.unionByName(new)
        new = materialize(alike(representatives(placed, turn)).join(tried, ["a", "b"], "left_anti"))
        found = materialize(verify(new, whole_crowd))
        turn, more = turn + 1, found.limit(1).count() > 0
        if more:
            root = merged(root, found)
    classes = materialize(named.join(root.toDF("entry", "class_id"), "entry", "left").select("digest", "entry", "rows", F.coalesce("class_id", "entry").alias("class_id")))
    discard(named, entries, members, whole, links, root, *([whole_crowd, rarest, groups, placed] if crowded else []))
    return join_by_group(drawn, classes, "digest").select("doc_id", "class_id", F.col("entry").alias("copy_of"))


def _rows(batch: pa.RecordBatch, side: str, weighted) -> list[tuple[np.ndarray, np.ndarray]]:
    """(hashes, weights) of each text of one side."""
    out = []
    for _, _, data, offsets in chunks(batch, f"text_{side}", PASS_BYTES):
        code, weight, per = weighted(data, offsets)
        ends = np.cumsum(per)
        out += [(code[e - p : e], weight[e - p : e]) for e, p in zip(ends, per, strict=True)]
    return out
