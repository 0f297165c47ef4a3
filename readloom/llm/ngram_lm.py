"""An interpolated modified Kneser-Ney bigram model, counted in Spark and kept as sorted hash arrays in shared files.

Texts are words with A-Z lower-cased and one end; a text begins in a context of its own. Tasks count the bigrams of their
texts and deal packed arrays to shards by the bigram's hash, so that a frequent word is spread over all shards. A shard
writes its bigrams as sorted arrays of hashes (those seen once need no count), and passes sums by word on to word shards,
which write sorted arrays of counts and continuations. A worker that scores maps these files into memory and looks up whole
batches by binary search. Words and bigrams are known by 64 bits of hash.

Given results: a null or empty text is its end alone. Without training texts each text scores as of one unknown token kind.
Repeated rows count and are scored each; a null id is in the fold of the empty text. Other columns are ignored by the query.
"""

from __future__ import annotations

import math
import os
import sys
import tempfile
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from readloom.llm.common import Tokens, append_columns, in_fold, local_path, new_path, pair_hash, shard_bits, text_steps

BEGIN, END = np.uint64(0x5851F42D4C957F2D), np.uint64(0x14057B7EF767814F)
#: Rows whose crc32 of the id leaves no remainder by this are held out of training.
HELD_OUT = 10
#: Tokens whose bigrams a task counts before it deals them out, and bytes of input a shard.
TASK_TOKENS, SHARD_BYTES = 1_500_000, 8 << 20
#: Tasks, as a power of 2, that shards are dealt to at most; more shards follow each other in a task.
MOST_TASKS = 13


def write_file(uri: str, arrays: list[np.ndarray]) -> None:
    """Arrays one after the other, each preceded by its length; in place under its name only when complete."""
    blob = b"".join(np.uint64(len(a)).tobytes() + a.tobytes() + bytes(-a.nbytes % 8) for a in arrays)
    if path := local_path(uri):
        os.makedirs(os.path.dirname(path), exist_ok=True)
        part = f"{path}.{uuid.uuid4().hex}"
        with open(part, "wb") as f:
            f.write(blob)
        os.replace(part, path)
    else:
        fs, path = pafs.FileSystem.from_uri(uri)
        fs.create_dir(os.path.dirname(path), recursive=True)
        with fs.open_output_stream(path) as f:
            f.write(blob)


def map_file(uri: str, kinds: list[type]) -> list[np.ndarray]:
    """The arrays of a file, memory-mapped; a file in another store is fetched first, to a name that is gone at once."""
    path = local_path(uri)
    if path:
        data = np.memmap(path, dtype=np.uint8, mode="r")
    else:
        fs, path = pafs.FileSystem.from_uri(uri)
        with tempfile.NamedTemporaryFile() as f:
            with fs.open_input_stream(path) as source:
                while block := source.read(1 << 24):
                    f.write(block)
            f.flush()
            data = np.memmap(f.name, dtype=np.uint8, mode="r")
    out, at = [], 0
    for kind in kinds:
        n = int(data[at : at + 8].view(np.uint64)[0])
        size = n * np.dtype(kind).itemsize
        out.append(data[at + 8 : at + 8 + size].view(kind))
        at += 8 + size + -size % 8
    return out


def bigrams_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Contexts, tokens, and the tokens of each text."""
    words = Tokens(texts, fold=True)
    n = words.counts + 1
    ends = np.cumsum(n)
    token = np.full(ends[-1] if len(ends) else 0, END, dtype=np.uint64)
    inner = np.ones(len(token), dtype=bool)
    inner[ends - 1] = False
    token[inner] = words.hash
    context = np.empty_like(token)
    context[1:] = token[:-1]
    context[ends - n] = BEGIN
    return context, token, n


def shard_of(h: np.ndarray, bits: int) -> np.ndarray:
    return (h >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(h), dtype=np.int64)


def runs(values: np.ndarray) -> np.ndarray:
    """Where runs of equal values begin, and the end."""
    return np.concatenate([[0], np.flatnonzero(values[1:] != values[:-1]) + 1, [len(values)]]) if len(values) else np.zeros(1, dtype=np.int64)


def packed(fields: list[pa.Array], names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(fields, names=names)


def counter(bits: int):
    """mapInArrow over (text): for each shard, its bigrams as tokens with run lengths, contexts by place in a list, and counts above one."""

    def flush(context: list[np.ndarray], token: list[np.ndarray]) -> pa.RecordBatch:
        u, w = np.concatenate(context), np.concatenate(token)
        context.clear()
        token.clear()
        key = pair_hash(u, w)
        order = np.argsort(key)
        cut = runs(key[order])
        first = order[cut[:-1]]
        count = np.diff(cut)
        del order, cut
        u, w, shard = u[first], w[first], shard_of(key[first], bits)
        order = np.argsort((shard.astype(np.uint64) << np.uint64(40)) | (w >> np.uint64(24)), kind="stable")
        u, w, shard, count = u[order], w[order], shard[order], count[order]
        edge = runs(shard)
        rows = []
        for a, b in zip(edge[:-1], edge[1:]):
            run = runs(w[a:b])
            kinds, place = np.unique(u[a:b], return_inverse=True)
            more = np.flatnonzero(count[a:b] > 1)
            place = place.astype(np.uint16 if len(kinds) < 1 << 16 else np.uint32)
            parts = (w[a:b][run[:-1]], np.diff(run).astype(np.uint32), kinds, place, more.astype(np.uint32), count[a:b][more].astype(np.uint32))
            rows.append((int(shard[a]), *(x.tobytes() for x in parts)))
        return packed([pa.array(x, t) for x, t in zip(zip(*rows), [pa.int32()] + [pa.binary()] * 6)], ["shard", *"abcdef"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context, token, n = [], [], 0
        for batch in batches:
            for _, texts in text_steps(batch.column(0)):
                u, w, _ = bigrams_of(texts)
                context.append(u)
                token.append(w)
                n += len(u)
                if n >= TASK_TOKENS:
                    yield flush(context, token)
                    n = 0
        if n:
            yield flush(context, token)

    return run


def by_shard(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[list]]]:
    """Rows of each shard, from rows sorted by shard."""
    now, rows = None, []
    for batch in batches:
        columns = [c.to_pylist() for c in batch.columns]
        for row in zip(*columns):
            if row[0] != now and rows:
                yield now, rows
                rows = []
            now = row[0]
            rows.append(row[1:])
    if rows:
        yield now, rows


def dealt(rows: DataFrame, bits: int) -> DataFrame:
    """Rows of 2 ** bits shards, and of shards under zero, dealt to MOST_TASKS tasks at most and sorted by shard in each."""
    n = 1 << min(bits, MOST_TASKS)
    part = F.shiftright("shard", max(0, bits - MOST_TASKS))
    return rows.repartitionById(n, F.when(F.col("shard") < 0, F.pmod(F.xxhash64("shard", *rows.columns[1:3]), F.lit(n))).otherwise(part).cast("int")).sortWithinPartitions("shard")


def joined(rows: list, k: int, kind: type) -> np.ndarray:
    return np.concatenate([np.frombuffer(r[k], dtype=kind) for r in rows]) if rows else np.zeros(0, dtype=kind)


def sums(key: np.ndarray, *values: np.ndarray) -> list[np.ndarray]:
    """Distinct keys, sorted, and the sums of the values of each."""
    order = np.argsort(key)
    key = key[order]
    cut = runs(key)[:-1]
    return [key[cut], *(np.add.reduceat(v[order].astype(np.uint64), cut) if len(cut) else v[:0].astype(np.uint64) for v in values)]


def unpacked(row: tuple) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Token, context and count of each bigram of a row that `counter` packed."""
    w = np.repeat(np.frombuffer(row[0], np.uint64), np.frombuffer(row[1], np.uint32))
    place = np.frombuffer(row[3], np.uint16 if len(row[3]) == 2 * len(w) else np.uint32)
    count = np.ones(len(w), dtype=np.uint64)
    count[np.frombuffer(row[4], np.uint32)] = np.frombuffer(row[5], np.uint32)
    return w, np.frombuffer(row[2], np.uint64)[place], count


def bigram_shards(path: str, bits: int):
    """mapInArrow over the counted bigrams: writes a shard's file, passes sums by token (kind 0), by context (1) and totals (2)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard, rows in by_shard(batches):
            w, u, count = (np.concatenate(x) for x in zip(*map(unpacked, rows)))
            del rows
            key = pair_hash(u, w)
            order = np.argsort(key)
            key = key[order]
            cut = runs(key)[:-1]
            key, first, count = key[cut], order[cut], np.add.reduceat(count[order], cut)
            u, w = u[first], w[first]
            once = count == 1
            write_file(f"{path}/bigrams/{shard}", [key[once], key[~once], count[~once]])
            out = []
            for kind, (h, *v) in enumerate((sums(w, count, np.ones(len(w), dtype=np.uint64)), sums(u, count == 1, count == 2, count > 2))):
                part = shard_of(h, bits)
                edge = runs(part)
                out += [(int(part[a]), kind, h[a:b].tobytes(), *(x[a:b].astype(np.uint32 if x.max() < 1 << 32 else np.uint64).tobytes() for x in v), *[b""] * (3 - len(v))) for a, b in zip(edge[:-1], edge[1:])]
            out.append((0, 2, np.array([(count == k).sum() for k in (1, 2, 3, 4)], dtype=np.int64).tobytes(), b"", b"", b""))
            yield packed([pa.array(x, t) for x, t in zip(zip(*out), [pa.int32(), pa.int32()] + [pa.binary()] * 4)], ["shard", "kind", "a", "b", "c", "d"])

    return run


def _counts(rows: list, k: int) -> np.ndarray:
    """Counts that each row holds with 4 or 8 bytes, as many as it has hashes."""
    return np.concatenate([np.frombuffer(r[k], np.uint32 if len(r[k]) < len(r[1]) else np.uint64).astype(np.uint64) for r in rows]) if rows else np.zeros(0, np.uint64)


#: Tokens, words and bigrams; words after 1, 2, 3, 4 and more than 2 contexts; bigrams seen 1, 2, 3 and 4 times.
TOTALS = ["tokens", "words", "followers", "b1", "b2", "b3", "b4", "b3more", "n1", "n2", "n3", "n4"]


def word_shards(path: str):
    """mapInArrow over sums by word: writes a shard's file, and returns totals for the discounts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard, rows in by_shard(batches):
            tokens, contexts = ([r for r in rows if r[0] == kind] for kind in (0, 1))
            low = sum((np.frombuffer(r[1], np.int64) for r in rows if r[0] == 2), np.zeros(4, np.int64))
            del rows
            w, u = joined(tokens, 1, np.uint64), joined(contexts, 1, np.uint64)
            zero = lambda x: np.zeros(len(x), dtype=np.uint64)
            columns = [np.concatenate(x) for x in ((w, u), (_counts(tokens, 2), zero(u)), (_counts(tokens, 3), zero(u)), *((zero(w), _counts(contexts, k)) for k in (2, 3, 4)))]
            key, count, before, *after = sums(*columns)
            write_file(f"{path}/words/{shard}", [key, count, *(x.astype(np.uint32) for x in (before, *after))])
            total = [int(count.sum()), int((count > 0).sum()), int(before.sum()), *(int((before == k).sum()) for k in (1, 2, 3, 4)), int((before > 2).sum()), *low.tolist()]
            yield packed([pa.array([x], pa.int64()) for x in total], TOTALS)

    return run


def discounts(n: list[int]) -> np.ndarray:
    """Modified Kneser-Ney discounts for counts 0, 1, 2 and 3 or more, from how many counts are 1, 2, 3 and 4.

    A corpus too small for the estimate has three quarters for each.
    """
    if min(n[:3]) > 0:
        y = n[0] / (n[0] + 2 * n[1])
        d = [k - (k + 1) * y * n[k] / n[k - 1] for k in (1, 2, 3)]
        if all(0 < x < k for k, x in enumerate(d, 1)):
            return np.array([0, *d])
    return np.array([0, 0.75, 0.75, 0.75])


@dataclass
class Model:
    path: str
    bits: int
    tokens: int
    words: int
    followers: int
    discount: np.ndarray
    low_discount: np.ndarray
    low_spread: float

    def reader(self):
        """A function from texts to their scores, over files that a worker process maps as they are first needed, for all its tasks."""
        known = vars(sys).setdefault("_readloom_maps", {})  # this module comes to each task by value, and so can't hold them
        if self.path not in known:
            known.clear()
        maps = known.setdefault(self.path, {})

        def opened(kind: str, shard: int) -> list[np.ndarray]:
            if (kind, shard) not in maps:
                kinds = [np.uint64, np.uint64] + [np.uint32] * 4 if kind == "words" else [np.uint64] * 3
                try:
                    maps[kind, shard] = map_file(f"{self.path}/{kind}/{shard}", kinds)
                except FileNotFoundError:  # no hash of the shard was seen
                    maps[kind, shard] = [np.zeros(0, dtype=k) for k in kinds]
            return maps[kind, shard]

        def found(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            at = np.searchsorted(keys, wanted)
            at[at == len(keys)] = 0
            return at, keys[at] == wanted if len(keys) else np.zeros(len(wanted), dtype=bool)

        def words(h: np.ndarray) -> np.ndarray:
            """Count, and numbers of contexts and of followers by their count, of sorted hashes."""
            out = np.zeros((5, len(h)))
            shard = shard_of(h, self.bits)
            edge = runs(shard)
            for a, b in zip(edge[:-1], edge[1:]):
                keys, *values = opened("words", int(shard[a]))
                at, here = found(keys, h[a:b])
                for k, v in enumerate(values):
                    if len(keys):
                        out[k, a:b] = np.where(here, v[at], 0)
            return out

        def pairs(h: np.ndarray) -> np.ndarray:
            out = np.zeros(len(h))
            shard = shard_of(h, self.bits)
            edge = runs(shard)
            for a, b in zip(edge[:-1], edge[1:]):
                once, more, count = opened("bigrams", int(shard[a]))
                _, here = found(once, h[a:b])
                at, often = found(more, h[a:b])
                out[a:b] = np.where(often, count[at], here) if len(more) else here
            return out

        def score(texts: list[bytes]) -> list[np.ndarray]:
            context, token, n = bigrams_of(texts)
            kinds, place = np.unique(np.concatenate([context, token]), return_inverse=True)
            table = words(kinds)
            u, w = place[: len(token)], place[len(token) :]
            keys, which = np.unique(pair_hash(context, token), return_inverse=True)
            both = pairs(keys)[which]
            count, before = table[0], table[1]
            followers = count.copy()
            followers[kinds == BEGIN] = words(np.array([END]))[0, 0]  # as many beginnings as ends
            low = self.low_spread / (self.words + 1)
            if self.followers:
                low = low + np.maximum(before - self.low_discount[np.minimum(before, 3).astype(int)], 0) / self.followers
            low = np.broadcast_to(low, count.shape)
            seen = followers > 0
            spread = np.where(seen, self.discount[1:] @ table[2:], 1) / np.where(seen, followers, 1)
            p = np.maximum(both - self.discount[np.minimum(both, 3).astype(int)], 0) / np.where(seen, followers, 1)[u] + spread[u] * low[w]
            base = np.log10((count + 0.1) / (self.tokens + 0.1 * (self.words + 1)))[w]
            first = np.cumsum(n) - n
            return [n, np.add.reduceat((count > 0)[w].astype(np.int64), first), np.add.reduceat(base, first), np.add.reduceat(np.log10(p), first)]

        return score


def train(docs: DataFrame, text: str = "text") -> Model:
    """Count the model of all rows of docs. Its files stay in the shared folder, under `Model.path`."""
    spark = docs.sparkSession
    rows = docs.select(text)
    bits = shard_bits(rows, SHARD_BYTES)
    path = new_path(spark, "bigram_model")
    kinds = ", ".join(f"{c} binary" for c in "abcdef")
    counted = rows.mapInArrow(counter(bits), f"shard int, {kinds}")
    summed = dealt(counted, bits).mapInArrow(bigram_shards(path, bits), "shard int, kind int, a binary, b binary, c binary, d binary")
    totals = dealt(summed, bits).mapInArrow(word_shards(path), ", ".join(f"{c} long" for c in TOTALS))
    t = [x or 0 for x in totals.agg(*[F.sum(c) for c in TOTALS]).first()]
    tokens, kinds_seen, followers, b1, b2, b3, b4, b3more = t[:8]
    low = discounts([b1, b2, b3, b4])
    spread = float(low[1:] @ np.array([b1, b2, b3more])) / followers if followers else 1.0
    return Model(path, bits, tokens, kinds_seen, followers, discounts(t[8:12]), low, spread)


SCORES = [T.StructField("n_tokens", T.LongType()), T.StructField("n_known", T.LongType()), T.StructField("base_score", T.DoubleType()), T.StructField("score", T.DoubleType())]


def with_scores(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """docs and, of each whole text, n_tokens, n_known, base_score (add-0.1 unigrams) and score (log10 probability)."""
    return append_columns(docs, text, SCORES, model.reader)


def perplexity(scored: DataFrame) -> DataFrame:
    """(perplexity) of all scored rows together."""
    return scored.select(F.pow(F.lit(10.0), F.try_divide(-F.sum("score"), F.sum("n_tokens"))).alias("perplexity"))


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    held = in_fold(F.col("doc_id"), HELD_OUT)
    model = train(docs.where(~held))
    scored = with_scores(docs, model)
    return scored.select("doc_id", held.alias("held_out"), "n_tokens", "n_known", F.lit(model.tokens).cast("long").alias("train_tokens"), "base_score", "score")
