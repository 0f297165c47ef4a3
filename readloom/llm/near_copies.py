"""Near copies by SimHash: texts whose five-word shingles have a Jaccard similarity of 0.8 or more.

A text's fingerprint has FP_BITS bits over its distinct shingles. Texts meet in buckets, by bands of least shingle hashes,
and are compared there bit-sliced: bit planes stand vertically, carry-save counters add up the differing bits of 64 texts
at once, and blocks are abandoned once all exceed the radius. Fingerprints that differ in few bits are near copies; where
they leave it open, and for short texts, the exact similarity of the shingles decides. At 0.8 bands miss a pair once in 500.

In a bucket, members of one group are not compared with each other: texts are compared with a few leaders, and those outside
the largest group then with all. A bucket of more than MOST_IN_TASK texts is dealt to several tasks, whose first texts are
compared, and those outside the largest group then go to each of these tasks.

Of larger buckets only pairs that span are judged at first. What these leave in different components and may be alike is then
compared as a whole, by the shingles and within tasks, which send links that join and no other pairs.

Given results: a null text counts as an empty one; texts without words are alike; a text of fewer words than a shingle is one
shingle. Upper case A-Z counts as lower case. An empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from readloom.llm.common import Tokens, discard, each_text_once, materialise, mix, pair_hash, small, text_steps
from readloom.llm.components import connected_components, roots, unite

WIDTH, SIMILARITY = 5, 0.8
#: Bits of a fingerprint, and bytes. At similarity 0.8, 78 differ, give or take 8.
FP_BITS, FP_BYTES = 512, 64
#: Differing bits up to which texts of SURE_SHINGLES or more are near copies, and up to which the shingles are compared.
SURE, POSSIBLE, SURE_SHINGLES = 48, 128, 64
#: Differing bits by which larger buckets are connected step by step.
LEVELS = (64, 72, 80, 88, 96, 112, POSSIBLE)
#: Bands of a text, and least hashes of a band.
BANDS, ROWS = 12, 4
#: Texts up to which all possible pairs of a bucket are compared by their shingles, leaders of larger ones, and texts of a bucket that a task holds.
FEW, LEADERS, MOST_IN_TASK = 64, 8, 4096
#: Rows of 16 bytes up to which a table is broadcast.
BROADCAST_ROWS = 500_000
_rng = np.random.default_rng(20240608)
_factors = _rng.integers(1, 2**63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_words = _rng.integers(1, 2**63, FP_BITS // 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
#: A byte's bits, each in a byte of its own.
_spread = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).copy().view(np.uint64).ravel()


def shingles(texts: list[bytes]) -> list[np.ndarray]:
    """Sorted distinct hashes of each text's shingles; one at least."""
    words = Tokens(texts, fold=True)
    found = []
    for a, b in zip(words.bounds[:-1].tolist(), words.bounds[1:].tolist()):
        h = words.hash[a:b]
        n = max(1, len(h) - WIDTH + 1)
        g = np.full(n, min(len(h), WIDTH), dtype=np.uint64)
        for k in range(min(len(h), WIDTH)):
            g = pair_hash(g, h[k : k + n])
        found.append(np.unique(g))
    return found


def fingerprint(g: np.ndarray) -> bytes:
    """A bit is 1 if over half the shingles have it, or half and the least one does."""
    counts = np.zeros(FP_BITS, dtype=np.int64)
    for k in range(0, len(g), 255):  # as many as a byte can count
        bits = mix(g[k : k + 255, None] * _words).view(np.uint8)
        counts += np.add.reduce(_spread[bits], axis=0).view(np.uint8)
    own = np.unpackbits(mix(g[:1] * _words).view(np.uint8))
    return np.packbits(2 * counts + own > len(g)).tobytes()


def marker(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """mapInArrow over (t, text): (t, fp, short, bands)."""
    for batch in batches:
        for s, texts in text_steps(batch.column(1)):
            sets = shingles(texts)
            g, starts = np.concatenate(sets), np.cumsum([0, *(len(x) for x in sets[:-1])])
            bands = np.empty((len(sets), BANDS), dtype=np.uint64)
            for band in range(BANDS):
                key = np.full(len(sets), band, dtype=np.uint64)
                for f in _factors[band * ROWS : (band + 1) * ROWS]:
                    key = pair_hash(key, np.minimum.reduceat(mix(g * f), starts))
                bands[:, band] = key
            columns = [batch.column(0).slice(s.start, s.stop - s.start), pa.array([fingerprint(x) for x in sets], pa.binary()), pa.array([len(x) < SURE_SHINGLES for x in sets]), pa.array(list(bands.view(np.int64)), pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, names=["t", "fp", "short", "bands"])


def planes_of(fp: np.ndarray) -> np.ndarray:
    """Bit planes of fingerprints (n, FP_BYTES): planes[bit, word], 64 lanes a word; lanes beyond n are 0."""
    words = -(-len(fp) // 64)
    bits = np.zeros((words * 64, FP_BITS), dtype=np.uint8)
    bits[: len(fp)] = np.unpackbits(fp, axis=1)
    return np.ascontiguousarray(np.packbits(np.ascontiguousarray(bits.T), axis=1, bitorder="little")).view(np.uint64)


def _above(counter: list[np.ndarray], most: int) -> np.ndarray:
    """Lanes whose vertical counter exceeds `most`, from the highest bit down."""
    above, equal = np.zeros_like(counter[0]), ~np.zeros_like(counter[0])
    for k in range(len(counter) - 1, -1, -1):
        if most >> k & 1:
            equal &= counter[k]
        else:
            above |= equal & counter[k]
            equal &= ~counter[k]
    return above


def near_lanes(asks: np.ndarray, planes: np.ndarray, most: int, first: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(row of asks, lane, differing bits) of all that differ in at most `most` bits. asks: (m, FP_BYTES); first: the word from which each row is compared.

    Carry-save adders take eight planes a step; pairs of a row and 64 lanes that all exceed are abandoned after each 64 planes.
    """
    words = planes.shape[1]
    bits = np.unpackbits(asks, axis=1).astype(bool)
    upto = np.zeros(len(asks), dtype=np.int64) if first is None else first
    count = words - upto
    ends = np.cumsum(count)
    begin = 0
    while begin < len(asks):
        end = max(begin + 1, int(np.searchsorted(ends, (ends[begin - 1] if begin else 0) + (1 << 14), "right")))
        q = np.repeat(np.arange(begin, end), count[begin:end])
        w = np.arange(len(q)) - np.repeat(np.cumsum(count[begin:end]) - count[begin:end], count[begin:end]) + upto[q]
        counter = [np.zeros(len(q), dtype=np.uint64) for _ in range(10)]
        for plane in range(0, FP_BITS, 8):
            x = [planes[plane + k][w] ^ np.where(bits[q, plane + k], ~np.uint64(0), np.uint64(0)) for k in range(8)]

            def add(level: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
                half = counter[level] ^ a  # noqa: B023
                carry = (counter[level] & a) | (half & b)  # noqa: B023
                counter[level] = half ^ b  # noqa: B023
                return carry

            fours = [add(1, add(0, x[k], x[k + 1]), add(0, x[k + 2], x[k + 3])) for k in (0, 4)]
            carry = add(2, *fours)
            for level in range(3, 10):
                counter[level], carry = counter[level] ^ carry, counter[level] & carry
            if plane % 64 == 56:
                live = ~_above(counter, most) != 0
                if live.sum() < 0.9 * len(live):
                    q, w, counter = q[live], w[live], [c[live] for c in counter]
                if not len(q):
                    break
        if len(q):
            near = ~_above(counter, most)
            row, lane = np.nonzero(np.unpackbits(near.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"))
            apart = np.zeros(len(row), dtype=np.int64)
            for level, c in enumerate(counter):
                apart += ((c[row] >> lane.astype(np.uint64)) & np.uint64(1)).astype(np.int64) << level
            yield q[row], w[row] * 64 + lane, apart
        begin = end


def merging(parent: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Unite the sets of a[i] and b[i] for all i, in place; places of pairs that join all that these join, fewer than sets."""
    kept, at = [], np.arange(len(a))
    while True:
        ra, rb = roots(parent, a[at]), roots(parent, b[at])
        apart = ra != rb
        at, ra, rb = at[apart], ra[apart], rb[apart]
        if not len(at):
            return np.concatenate(kept) if kept else at
        _, first = np.unique(np.maximum(ra, rb), return_index=True)
        kept.append(at[first])
        unite(parent, ra[first], rb[first])


def compared(fp: np.ndarray, short: np.ndarray, asks: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Of the texts of a bucket, each one's root among sure near copies, and the pairs (n, 2) that are possible.

    Of few texts these are all pairs; of many, for each of LEVELS, pairs that connect what pairs up to so many differing bits connect.
    asks: places of those to be compared with all; by default few are all compared, many as the module says.
    """
    n = len(fp)
    planes, parent = planes_of(fp), np.arange(n)
    by_level = [np.arange(n) for _ in LEVELS]
    pairs = [np.zeros((0, 2), dtype=np.int64)]

    def ask(rows: np.ndarray, later: bool) -> None:
        for q, b, apart in near_lanes(fp[rows], planes, POSSIBLE, rows // 64 if later else None):
            a = rows[q]
            good = (b < n) & ((a < b) if later else (a != b))
            a, b, apart = a[good], b[good], apart[good]
            sure = (apart == 0) | ((apart <= SURE) & ~(short[a] | short[b]))
            unite(parent, a[sure], b[sure])
            apart[roots(parent, a) == roots(parent, b)] = 0
            if n <= FEW:
                pairs.append(np.stack([a, b], axis=1)[apart > 0])
                continue
            for level, up in zip(LEVELS, by_level):
                low = np.flatnonzero(apart <= level)
                keep = low[merging(up, a[low], b[low])]
                pairs.append(np.stack([a, b], axis=1)[keep[apart[keep] > 0]])

    if asks is not None:
        ask(asks, False)
    elif n <= FEW:
        ask(np.arange(n), True)
    else:
        led: set[int] = set()
        for k in range(n):
            if len(led) == LEADERS:
                break
            if int(roots(parent, np.array([k]))[0]) not in led:
                ask(np.array([k]), False)
                led = {int(roots(parent, np.array([x]))[0]) for x in [*led, k]}
        up = roots(parent, np.arange(n))
        kinds, size = np.unique(up, return_counts=True)
        rest = np.flatnonzero(up != kinds[np.argmax(size)])
        if len(rest):
            ask(rest, False)
    up = roots(parent, np.arange(n))
    found = np.concatenate(pairs)
    return up, np.unique(np.sort(found[up[found[:, 0]] != up[found[:, 1]]], axis=1), axis=0)


def linker(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """mapInArrow over (k, t, fp, short, asks) sorted by k: links (sure, a, b) within each k."""

    def solved(t, fp, short, asks):
        up, pairs = compared(np.frombuffer(b"".join(fp), dtype=np.uint8).reshape(len(fp), FP_BYTES), short, np.flatnonzero(asks) if asks.any() else None)
        moved = np.flatnonzero(up != np.arange(len(up)))
        a, b = np.concatenate([moved, pairs[:, 0]]), np.concatenate([up[moved], pairs[:, 1]])
        return t[a], t[b], np.arange(len(a)) < len(moved)

    def sent(rows):
        a, b, sure = (np.concatenate(x) for x in zip(*rows))
        return pa.RecordBatch.from_arrays([pa.array(sure), pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["sure", "a", "b"])

    hold, out = None, []
    for batch in batches:
        now = [batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(2).to_pylist(), *(batch.column(k).to_numpy(zero_copy_only=False) for k in (3, 4))]
        if hold is not None:
            now = [x + y if isinstance(x, list) else np.concatenate([x, y]) for x, y in zip(hold, now)]
        if not len(now[0]):
            continue
        cut = [0, *(np.flatnonzero(np.diff(now[0])) + 1).tolist(), len(now[0])]
        for a, b in zip(cut[:-2], cut[1:-1]):
            if b - a > 1:
                out.append(solved(*(x[a:b] for x in now[1:])))
        hold = [x[cut[-2] :] for x in now]
        if out:
            yield sent(out)
            out = []
    if hold is not None and len(hold[0]) > 1:
        yield sent([solved(*hold[1:])])


def linked(rows: DataFrame, name: str) -> DataFrame:
    """(sure, a, b) of rows (k, t, fp, short, asks)."""
    rows = rows.select("k", "t", "fp", "short", "asks").repartition("k").sortWithinPartitions("k")
    return materialise(rows.mapInArrow(linker, "sure boolean, a long, b long"), name)


def groups_of(batches: Iterator[pa.RecordBatch]) -> Iterator[list]:
    """The columns, as arrays or lists of bytes, of the rows of each value of the first, by which rows come sorted."""
    hold = None
    for batch in batches:
        now = [c.to_pylist() if pa.types.is_binary(c.type) else c.to_numpy(zero_copy_only=False) for c in batch.columns]
        if hold is not None:
            now = [x + y if isinstance(x, list) else np.concatenate([x, y]) for x, y in zip(hold, now)]
        if not len(now[0]):
            continue
        cut = [0, *(np.flatnonzero(np.diff(now[0])) + 1).tolist(), len(now[0])]
        for a, b in zip(cut[:-2], cut[1:-1]):
            yield [x[a:b] for x in now]
        hold = [x[cut[-2] :] for x in now]
    if hold is not None and len(hold[0]):
        yield hold


def left_open(fp: list[bytes], root: np.ndarray, asks: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places of the pairs, of one that asks and any, that are possible and of different roots."""
    fp = np.frombuffer(b"".join(fp), dtype=np.uint8).reshape(len(fp), FP_BYTES)
    rows = np.flatnonzero(asks)
    for q, b, _ in near_lanes(fp[rows], planes_of(fp), POSSIBLE):
        a = rows[q]
        a, b = a[b < len(fp)], b[b < len(fp)]
        good = (root[a] != root[b]) & ((a < b) | ~asks[b])
        if good.any():
            yield a[good], b[good]


def asker(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """mapInArrow over (k, t, fp, root, asks) sorted by k: (k, t) of those that a pair is left open of."""
    for k, t, fp, root, asks in groups_of(batches):
        found = np.zeros(len(t), dtype=bool)
        for a, b in left_open(fp, root, asks):
            found[a] = found[b] = True
        if found.any():
            yield pa.RecordBatch.from_arrays([pa.array(k[found]), pa.array(t[found])], names=["k", "t"])


def both_similar(x: np.ndarray, y: np.ndarray) -> bool:
    """Whether the sorted distinct shingles of two texts are similar."""
    both = len(np.intersect1d(x, y, assume_unique=True)) if min(len(x), len(y)) >= SIMILARITY * max(len(x), len(y)) else 0
    return both >= SIMILARITY * (len(x) + len(y) - both)


def settler(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """mapInArrow over (k, t, fp, root, asks, w) sorted by k: links (a, b) of similar texts that join what no other links join."""
    for _, t, fp, root, asks, w in groups_of(batches):
        sets = [np.frombuffer(x, dtype=np.uint64) for x in w]
        up = np.unique(root, return_inverse=True)[1]
        parent, links = np.arange(len(t)), []
        for a, b in left_open(fp, root, asks):
            for i, j in zip(a.tolist(), b.tolist()):
                p, q = (int(roots(parent, up[[x]])[0]) for x in (i, j))
                if p != q and both_similar(sets[i], sets[j]):
                    parent[max(p, q)] = min(p, q)
                    links.append((int(t[i]), int(t[j])))
        if links:
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*links)], names=["a", "b"])


def settled(marked: DataFrame, root: DataFrame, rows: DataFrame) -> DataFrame | None:
    """(a, b): links of similar texts in different components, from buckets of more than FEW texts; None where nothing is left open."""
    each = marked.join(root.withColumnRenamed("node", "t"), "t", "left").select("t", "fp", F.coalesce("root", "t").alias("root"), F.explode("bands").alias("bucket"))
    kinds = each.groupBy("bucket", "root").agg(F.count(F.lit(1)).alias("n"))
    mixed = kinds.groupBy("bucket").agg(F.sum("n").alias("n"), F.max_by("root", F.struct("n", "root")).alias("main"), F.count(F.lit(1)).alias("roots")).where(f"n > {FEW} and roots > 1")
    mixed = materialise(mixed.select("bucket", "main", F.ceil(F.col("n") / MOST_IN_TASK).cast("int").alias("parts")), "mixed")
    if mixed.isEmpty():
        return None
    each = each.join(small(mixed, BROADCAST_ROWS), "bucket").withColumn("asks", F.col("root") != F.col("main"))
    own = F.when(F.col("asks"), F.sequence(F.lit(0), F.col("parts") - 1)).otherwise(F.array(F.pmod(F.xxhash64("t", "bucket"), F.col("parts")).cast("int")))
    each = materialise(each.withColumn("part", F.explode(own)).select(F.xxhash64("bucket", "part").alias("k"), "t", "fp", "root", "asks"), "outside")
    by_key = lambda x: x.repartition("k").sortWithinPartitions("k")
    left = materialise(by_key(each).mapInArrow(asker, "k long, t long"), "left")
    if left.isEmpty():
        return None
    involved = small(materialise(left.select("t").distinct(), "involved"), BROADCAST_ROWS)
    sets = materialise(rows.join(involved, "t", "left_semi").mapInArrow(shingler, "t long, w binary").groupBy("t").agg(F.first("w").alias("w")), "shingles")
    again = each.join(left, ["k", "t"]).join(sets, "t").select("k", "t", "fp", "root", "asks", "w")
    found = materialise(by_key(again).mapInArrow(settler, "a long, b long"), "settled")
    for done in (each, left, sets):
        discard(done)
    return found


def shingler(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for s, texts in text_steps(batch.column(1)):
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(s.start, s.stop - s.start), pa.array([x.tobytes() for x in shingles(texts)], pa.binary())], names=["t", "w"])


def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """mapInArrow over (a, b, wa, wb): the pairs that are similar enough."""
    for batch in batches:
        good = []
        for wa, wb in zip(batch.column(2), batch.column(3)):
            x, y = (np.frombuffer(w.as_buffer(), dtype=np.uint64) for w in (wa, wb))
            good.append(both_similar(x, y))
        keep = pa.array(good, pa.bool_())
        yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep)], names=["a", "b"])


def similar(pairs: DataFrame, rows: DataFrame) -> DataFrame:
    """Those of the pairs (a, b) of texts whose shingles are similar."""
    involved = materialise(pairs.select(F.col("a").alias("t")).union(pairs.select("b")).distinct(), "involved")
    if involved.count() <= BROADCAST_ROWS:
        sets = rows.join(F.broadcast(involved), "t", "left_semi").mapInArrow(shingler, "t long, w binary")
    else:
        sets = rows.mapInArrow(shingler, "t long, w binary").join(involved, "t", "left_semi")
    sets = materialise(sets.groupBy("t").agg(F.first("w").alias("w")), "shingles")
    one = pairs.join(sets.select(F.col("t").alias("a"), F.col("w").alias("wa")), "a")
    two = one.join(sets.select(F.col("t").alias("b"), F.col("w").alias("wb")), "b").select("a", "b", "wa", "wb")
    found = materialise(two.mapInArrow(judge, "a long, b long"), "similar")
    discard(involved)
    discard(sets)
    return found


def links_of(marked: DataFrame) -> DataFrame:
    """(sure, a, b): near copies, and pairs that may be, among the texts of `marked`."""
    rows = marked.select("t", "fp", "short", F.explode("bands").alias("bucket"))
    count = materialise(marked.select(F.explode("bands").alias("bucket")).groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "buckets")
    large = count.where(F.col("n") > MOST_IN_TASK).select("bucket", F.ceil(F.col("n") / MOST_IN_TASK).cast("int").alias("parts"))  # a row for each MOST_IN_TASK texts at most
    parted = rows.join(F.broadcast(large), "bucket", "left").withColumn("part", F.when(F.col("parts").isNotNull(), F.pmod(F.xxhash64("t", "bucket"), F.col("parts")).cast("int")).otherwise(0))
    key = F.xxhash64("bucket", "part").alias("k")
    found = linked(parted.select(key, "*", F.lit(False).alias("asks")), "links")
    if large.isEmpty():
        return found
    hot = materialise(parted.where("parts is not null"), "hot")
    first = hot.groupBy("bucket", "part", F.pmod(F.xxhash64("t"), F.lit(LEADERS)).alias("some")).agg(F.min_by(F.struct("t", "fp", "short"), "t").alias("x"))
    found = found.union(linked(first.select(F.col("bucket").alias("k"), "x.*", F.lit(False).alias("asks")), "leaders"))
    root = connected_components(found.where("sure").select("a", "b"))
    hot = hot.join(root.withColumnRenamed("node", "t"), "t", "left").withColumn("root", F.coalesce("root", "t"))
    main = hot.groupBy("bucket", "root").agg(F.count(F.lit(1)).alias("n")).groupBy("bucket").agg(F.max_by("root", "n").alias("main"))
    hot = materialise(hot.join(F.broadcast(main), "bucket"), "rooted")  # as many rows as `large`
    outside = hot.where("root <> main")
    if outside.isEmpty():
        return found
    asks = outside.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    both = hot.where("root = main").select(key, "t", "fp", "short", F.lit(False).alias("asks")).union(asks.select(key, "t", "fp", "short", F.lit(True).alias("asks")))
    return found.union(linked(both, "outside"))


def components(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, t, root) for each row; t: xxhash64 of the text; root: the text that names the component."""
    rows = each_text_once(docs, id, text)
    marked = materialise(rows.mapInArrow(marker, "t long, fp binary, short boolean, bands array<long>").dropDuplicates(["t"]), "fingerprints")
    links = links_of(marked)
    sure = links.where("sure").select("a", "b")
    roots_ = materialise(connected_components(sure), "roots")
    name = lambda side: small(roots_.select(F.col("node").alias(side), F.col("root").alias(f"{side}_root")), BROADCAST_ROWS)
    open_ = links.where("not sure").select("a", "b").distinct().join(name("a"), "a", "left").join(name("b"), "b", "left")
    open_ = materialise(open_.where("coalesce(a_root, a) <> coalesce(b_root, b)").select("a", "b"), "open")
    alike = sure.union(similar(open_, rows))
    found = connected_components(alike)
    if (more := settled(marked, found, rows)) is not None:
        found = connected_components(alike.union(more))
    own = docs.select(F.col(id).alias(id), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("t"))
    return own.join(found.withColumnRenamed("node", "t"), "t", "left").select(id, "t", F.coalesce("root", "t").alias("root"))
