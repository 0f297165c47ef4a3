"""SimHash near-duplicates: fingerprints of word shingles, linked by bit-sliced comparison within pigeonhole buckets.

Given results: a null text counts as an empty one; a text without words has fingerprint zero and is linked like any other.
Repeated rows each keep their row. A null doc_id takes part in linking; a component of null ids alone has a null id.
An empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from readloom.llm.common import append_columns, discard, materialise, numbered, place_of, small
from readloom.llm.components import connected_components, roots, unite

ALL = (1 << 64) - 1
#: A bucket of more distinct fingerprints is dealt again by more of its bits: among tasks, or within one.
DEAL_AGAIN, SPLIT_AGAIN = 32768, 1024
#: Rows of 24 bytes up to which the list of rows to keep is broadcast; a longer one is joined by shuffle.
KEEP_ROWS = 1_000_000


def fingerprint(text: bytes, width: int = 4) -> int:
    words = text.lower().split()
    if not words:
        return 0
    line = b" ".join(words)
    digest = xxhash.xxh64_digest
    if len(words) <= width:
        return int.from_bytes(digest(line, 42), "big")
    ends = [e - 1 for e in accumulate(len(w) + 1 for w in words)]
    starts = [0, *(e + 1 for e in ends)]
    joined = b"".join([digest(line[a:b], 42) for a, b in zip(starts, ends[width - 1 :])])
    count = len(joined) // 8
    bits = np.unpackbits(np.frombuffer(joined, dtype=np.uint8).reshape(count, 8), axis=1)
    ones = np.add.reduce(bits, axis=0, dtype=np.uint32)
    return int.from_bytes(np.packbits(ones * 2 > count).tobytes(), "big")


def with_fingerprints(docs: DataFrame, text: str = "text", name: str = "fingerprint", width: int = 4) -> DataFrame:
    """docs and a long whose 64 bits are the fingerprint of the column `text`."""

    def make():
        return lambda texts: [np.array([fingerprint(x, width) for x in texts], dtype=np.uint64).view(np.int64)]

    return append_columns(docs, text, [T.StructField(name, T.LongType())], make)


def exceeds(ones, twos, fours, over, radius: int) -> np.ndarray:
    """Lanes whose counter is above the radius, by comparing its bits from the top."""
    above, equal = over.copy(), ~over
    for bit, plane in ((4, fours), (2, twos), (1, ones)):
        if radius & bit:
            equal &= plane
        else:
            above |= equal & plane
            equal &= ~plane
    return above


def bit_sliced_unions(values: np.ndarray, starts: np.ndarray, radius: int, parent: np.ndarray, offset: np.ndarray) -> None:
    """Unite, in `parent`, all values of a bucket that differ in at most `radius` (up to 7) bits.

    values: fingerprints, bucket by bucket; starts: where buckets begin, and the end; offset: each value's place in parent.
    Each bucket's values lie in lanes of 64-bit words, as 64 bit planes. One (value, word) pair compares a value with up to
    64 others: a plane's differing lanes are added into vertical counters, two planes a carry-save step, and pairs whose
    lanes all exceed the radius are abandoned every eight planes.
    """
    if not len(values):
        return
    sizes = np.diff(starts)
    words = (sizes + 63) // 64
    first_word = np.concatenate([[0], np.cumsum(words)])
    bucket = np.repeat(np.arange(len(sizes)), sizes)
    lane = first_word[bucket] * 64 + np.arange(len(values)) - starts[:-1][bucket]
    lanes = np.zeros(first_word[-1] * 64, dtype=np.uint64)
    lanes[lane] = values
    valid = np.zeros(len(lanes), dtype=np.uint8)
    valid[lane] = 1
    who = np.zeros(len(lanes), dtype=np.int64)
    who[lane] = np.arange(len(values))
    pack = lambda x: np.packbits(x, bitorder="little").view(np.uint64)
    planes = [pack(((lanes >> np.uint64(j)) & np.uint64(1)).astype(np.uint8)) for j in range(64)]
    invalid = ~pack(valid)
    own = lane // 64
    pairs = first_word[bucket + 1] - own
    upto = np.concatenate([[0], np.cumsum(pairs)])
    begin = 0
    while begin < len(values):
        end = max(begin + 1, int(np.searchsorted(upto, upto[begin] + (1 << 16), "right")) - 1)
        q = np.repeat(np.arange(begin, end), pairs[begin:end])
        w = own[q] + np.arange(len(q)) - (upto[q] - upto[begin])
        ones, twos, fours, over = (np.zeros(len(q), dtype=np.uint64) for _ in range(4))
        for j in range(0, 64, 2):
            v = values[q] >> np.uint64(j)
            x = planes[j][w] ^ (np.uint64(0) - (v & np.uint64(1)))
            y = planes[j + 1][w] ^ (np.uint64(0) - ((v >> np.uint64(1)) & np.uint64(1)))
            half = ones ^ x
            carry = (ones & x) | (half & y)
            ones = half ^ y
            up = twos & carry
            twos ^= carry
            over |= fours & up
            fours ^= up
            if j % 8 == 6:
                dead = exceeds(ones, twos, fours, over, radius) | invalid[w]
                live = dead != np.uint64(ALL)
                if live.sum() < 0.8 * len(live):
                    q, w, ones, twos, fours, over = (a[live] for a in (q, w, ones, twos, fours, over))
        near = ~(exceeds(ones, twos, fours, over, radius) | invalid[w])
        hit = near != 0
        q, w, near = q[hit], w[hit], near[hit]
        for s in range(0, len(q), 1 << 14):
            row, bit = np.nonzero(np.unpackbits(near[s : s + (1 << 14)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"))
            a, b = q[s + row], who[w[s + row] * 64 + bit]
            unite(parent, offset[a[b > a]], offset[b[b > a]])
        begin = end


def blocks(mask: int, parts: int) -> list[int]:
    """Divide the bits of a mask among so many masks."""
    at = [i for i in range(64) if mask >> i & 1]
    return [sum(1 << i for i in at[len(at) * k // parts : len(at) * (k + 1) // parts]) for k in range(parts)]


def unions(values: np.ndarray, starts: np.ndarray, radius: int, parent: np.ndarray, offset: np.ndarray, free: int = ALL) -> None:
    """bit_sliced_unions, large buckets first split by those of their bits that vary.

    Two values within the radius agree on at least one of radius + 1 blocks of the varying bits: the split is exact.
    """
    sizes = np.diff(starts)
    for k in np.flatnonzero(sizes > SPLIT_AGAIN):
        part, place = values[starts[k] : starts[k + 1]], offset[starts[k] : starts[k + 1]]
        varying = int(np.bitwise_or.reduce(part) ^ np.bitwise_and.reduce(part)) & free
        if varying.bit_count() < 3 * (radius + 1):
            bit_sliced_unions(part, np.array([0, len(part)]), radius, parent, place)
            continue
        for block in blocks(varying, radius + 1):
            key = part & np.uint64(block)
            order = np.argsort(key, kind="stable")
            cut = np.flatnonzero(np.diff(key[order])) + 1
            unions(part[order], np.concatenate([[0], cut, [len(part)]]), radius, parent, place[order], free & ~block)
    small = sizes <= SPLIT_AGAIN
    if small.all():
        bit_sliced_unions(values, starts, radius, parent, offset)
    elif small.any():
        keep = np.repeat(small, sizes)
        bit_sliced_unions(values[keep], np.concatenate([[0], np.cumsum(sizes[small])]), radius, parent, offset[keep])


def key_masks(count: int, radius: int) -> list[int]:
    """Masks of which any two fingerprints within the radius agree on one: all but `radius` of so many blocks.

    More fingerprints get more blocks, and so keys of more bits, that buckets stay at some hundreds by chance.
    """
    for parts in range(radius + 1, radius + 5):
        bits = 64 * (parts - radius) // parts
        if count <= 256 << bits or parts == radius + 4:
            each = blocks(ALL, parts)
            return [sum(x) for x in combinations(each, parts - radius)]
    raise AssertionError


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def linker(radius: int, deal_again: int):
    """mapInArrow over (t, bucket, fp), sorted by bucket: edges (kind 0: a, b), and rows of too large buckets (kind 1: fp, t)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def made(kind, a, b):
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(a), kind, dtype=np.int32)), pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["kind", "a", "b"])

        def solved(t, key, fp):
            starts = np.concatenate([[0], np.flatnonzero(np.diff(key)) + 1, [len(key)]])
            parent = np.arange(len(fp))
            unions(fp, starts, radius, parent, np.arange(len(fp)))
            up = roots(parent, np.arange(len(fp)))
            moved = up != np.arange(len(fp))
            return made(0, fp[moved], fp[up[moved]])

        hold, passing = [np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint64)], None
        for batch in batches:
            new = [batch.column(0).to_numpy().astype(np.int64), batch.column(1).to_numpy(), batch.column(2).to_numpy().view(np.uint64)]
            t, key, fp = (np.concatenate(x) for x in zip(hold, new))
            if not len(key):
                continue
            if passing is not None:  # the rest of a bucket found too large
                rest = len(key) if (key == passing).all() else int(np.argmax(key != passing))
                if rest:
                    yield made(1, fp[:rest], t[:rest])
                t, key, fp = t[rest:], key[rest:], fp[rest:]
                if not len(key):
                    hold = [t, key, fp]
                    continue
                passing = None
            last = len(key) - int(np.argmax(key[::-1] != key[-1])) if (key != key[-1]).any() else 0
            if last:
                yield from large(t[:last], key[:last], fp[:last], solved, made)
            t, key, fp = t[last:], key[last:], fp[last:]
            if len(key) > deal_again:
                yield made(1, fp, t)
                passing = key[0]
                t, key, fp = t[:0], key[:0], fp[:0]
            hold = [t, key, fp]
        if len(hold[1]):
            yield from large(*hold, solved, made)

    def large(t, key, fp, solved, made):
        """Whole buckets; those over the limit go on to the next deal."""
        starts = np.concatenate([[0], np.flatnonzero(np.diff(key)) + 1, [len(key)]])
        big = np.repeat(np.diff(starts) > deal_again, np.diff(starts))
        if big.any():
            yield made(1, fp[big], t[big])
        if not big.all():
            yield solved(t[~big], key[~big], fp[~big])

    return run


def link_fingerprints(nodes: DataFrame, radius: int = 4, deal_again: int = DEAL_AGAIN) -> DataFrame:
    """Edges (a, b) that connect all distinct fingerprints `fp` (long) within the radius: a spanning forest of each bucket."""
    masks = key_masks(nodes.count(), radius)
    edges = None
    rows = nodes.select("fp", F.lit(-1).alias("from"))
    groups = {-1: list(range(len(masks)))}
    for level in range(3):
        table = [F.struct(F.lit(t).alias("t"), F.col("fp").bitwiseAND(F.lit(_signed(masks[t]))).alias("part")) for t in range(len(masks))]
        if level == 0:
            choice = F.array(*table)
        else:
            per = len(masks) // len(groups)
            choice = F.slice(F.array(*table), F.col("from") * per + 1, F.lit(per))
        keyed = rows.select("fp", F.explode(choice).alias("k")).select(F.col("k.t").alias("t"), F.xxhash64("k.t", "k.part").alias("bucket"), "fp")
        # the last deal takes buckets whole: all their fingerprints agree on most bits, so that their number is bounded
        run = linker(radius, deal_again if level < 2 else 1 << 62)
        found = materialise(keyed.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(run, "kind int, a long, b long"), "links")
        new = found.where("kind = 0").select("a", "b")
        edges = new if edges is None else edges.union(new)
        rows = found.where("kind = 1").select(F.col("a").alias("fp"), F.col("b").cast("int").alias("from"))
        if level == 2 or rows.isEmpty():
            return edges
        groups = dict.fromkeys(range(len(masks)))
        masks = [m | b for m in masks for b in blocks(ALL & ~m, radius + 1)]
    return edges


def components(docs: DataFrame, id: str = "doc_id", text: str = "text", radius: int = 4, width: int = 4) -> DataFrame:
    """(id, t, fp, root, component_id) for each row.

    t: xxhash64 of the text; root: a fingerprint that names the component, whose smallest id component_id is.
    """
    rows = docs.select(F.col(id).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text")).withColumn("t", F.xxhash64("text"))
    marked = materialise(with_fingerprints(rows, "text", "fp", width).select("id", "t", "fp"), "fingerprints")
    nodes = materialise(marked.groupBy("fp").agg(F.min("id").alias("low")), "nodes")
    edges = link_fingerprints(nodes.select("fp"), radius)
    found = connected_components(edges)
    rooted = nodes.join(found.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "low", F.coalesce("root", "fp").alias("root"))
    rooted = materialise(rooted, "rooted")
    low = materialise(rooted.groupBy("root").agg(F.min("low").alias("component_id")), "low")
    names = materialise(rooted.join(low, "root").select("fp", "root", "component_id"), "names")
    for done in (nodes, rooted, low):
        discard(done)
    return marked.join(names, "fp").select(F.col("id").alias(id), "t", "fp", "root", "component_id")


def keep_one(docs: DataFrame, id: str = "doc_id", text: str = "text", find=components) -> DataFrame:
    """docs with one row of each component: of its smallest id (without ids: of one text), all columns as they were.

    `find` gives the components, by default by fingerprints. Of rows that repeat that id with texts of the component, the smallest hash of the text decides, then the columns' values.
    """
    rows, id, text = numbered(docs), place_of(docs, id), place_of(docs, text)
    found = materialise(find(rows, id, text).select(F.col(id).alias("_id"), F.col("t").alias("_t"), "root"), "found")
    first = found.groupBy("root").agg(F.min(F.struct(F.col("_id").isNull(), "_id", "_t")).alias("m")).select("m._id", "m._t")
    count = found.groupBy("_id", "_t").agg(F.count(F.lit(1)).alias("_n")).withColumnsRenamed({"_id": "_i", "_t": "_k"})
    keep = materialise(first.join(count, F.col("_id").eqNullSafe(F.col("_i")) & (F.col("_t") == F.col("_k"))).select("_id", "_t", "_n"), "kept")
    discard(found)
    same = rows[id].eqNullSafe(F.col("_id")) & (F.xxhash64(F.coalesce(rows[text], F.lit(""))) == F.col("_t"))
    once, more = (small(keep.where(x), KEEP_ROWS) for x in ("_n = 1", "_n > 1"))
    single = rows.join(once, same, "left_semi")
    if not more.isEmpty():
        row = F.min(F.struct(*[rows[c] for c in rows.columns])).alias("_row")
        single = single.union(rows.join(more, same).groupBy("_id", "_t").agg(row).select("_row.*"))
    return single.toDF(*docs.columns)


def query(spark, sf_dir: str) -> DataFrame:
    found = components(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
