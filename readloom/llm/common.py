"""Helpers that the training-data operators share: shared storage, byte-level tokenising, appended columns."""

from __future__ import annotations

import gc
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from readloom.storage import materialise as materialise
from readloom.storage import new_path as new_path
from readloom.storage import own_dir

#: Words between ASCII white space: the regular expression, and the same as a table over bytes.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Bytes of text that one vectorised step takes at a time; a longer document is a step of its own.
STEP_BYTES = 2 << 20

#: Rows of 16 bytes up to which the table of texts with copies is broadcast; a longer one is joined by shuffle.
COPIED_ROWS = 500_000

def clean_up(spark: SparkSession) -> None:
    """Delete all intermediate tables of this application; results that were not written by then can't be read any more."""
    delete_path(spark, own_dir(spark))


def tables_now(spark: SparkSession) -> set[str]:
    """The folders of this application's intermediate tables."""
    path = spark._jvm.org.apache.hadoop.fs.Path(own_dir(spark))  # noqa: SLF001
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())  # noqa: SLF001
    return {str(f.getPath()) for f in fs.listStatus(path)} if fs.exists(path) else set()


def discard(df: DataFrame) -> None:
    """Delete a materialised table that nothing reads any more."""
    path = getattr(df, "_readloom_path", None)
    if path:
        delete_path(df.sparkSession, path.rsplit("/", 1)[0])  # its folder in `own_dir` is its own


def parent_of(df: DataFrame) -> str:
    """The folder in `own_dir` of a materialised table, as `tables_now` lists it."""
    path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df._readloom_path).getParent()  # noqa: SLF001
    return str(path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).makeQualified(path))  # noqa: SLF001


def delete_path(spark: SparkSession, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)  # noqa: SLF001
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)  # noqa: SLF001


def release(spark: SparkSession) -> None:
    """Let the driver collect what it no longer refers to, so that shuffle files of finished steps are deleted by now."""
    gc.collect()
    spark._jvm.System.gc()  # noqa: SLF001


def shard_bits(df: DataFrame, shard_bytes: int) -> int:
    """Bits that number so many shards that each has about `shard_bytes` of the bytes that df reads."""
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())  # noqa: SLF001
    if size >= 1 << 60:  # not known
        size = df.rdd.getNumPartitions() << 25
    return max(2, math.ceil(math.log2(max(1, size / shard_bytes))))


def small(table: DataFrame, most: int, weight: Column | None = None) -> DataFrame:
    """A written table, marked for broadcast if its counted rows, or the sum of their weights, are few enough; otherwise joins of it shuffle."""
    size = table.count() if weight is None else table.agg(F.sum(weight)).first()[0] or 0
    return F.broadcast(table) if size <= most else table


def each_text_once(docs: DataFrame, id: str, text: str) -> DataFrame:
    """(t, text): of rows with equal texts those with the least hash of their id, so that copies are not read on; t: xxhash64 of the text."""
    body = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.xxhash64(body).alias("t"), F.xxhash64(F.col(id)).alias("i"), body.alias("text"))
    copied = rows.groupBy(F.col("t").alias("u")).agg(F.min("i").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    copied = small(materialise(copied.select("u", "first"), "copied"), COPIED_ROWS)
    return rows.join(copied, F.col("t") == F.col("u"), "left").where("first is null or first = i").select("t", "text")


def local_path(uri: str) -> str | None:
    """The plain path of a file: URI, None for another store."""
    if uri.startswith("file:"):
        return "/" + uri[5:].lstrip("/")
    return uri if "://" not in uri else None


def ascii_lower(column):
    """A-Z only, other letters as they are."""
    return F.translate(column, UPPER, LOWER)


def in_fold(doc_id, modulus: int):
    """True where crc32 of the id as text leaves no remainder. A null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % modulus == 0


def text_bytes(column: pa.Array) -> list[bytes]:
    """UTF-8 of each row; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return [x or b"" for x in column.cast(kind).to_pylist()]


def text_steps(column: pa.Array, most: int = STEP_BYTES) -> Iterator[tuple[slice, list[bytes]]]:
    """Consecutive slices of the rows that hold about `most` bytes each, and their texts; only a slice's texts are copied."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    size = pc.binary_length(column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()))
    size = size.fill_null(0).to_numpy(zero_copy_only=False)
    begin = total = 0
    for i, n in enumerate(size.tolist()):
        if total and total + n > most:
            yield slice(begin, i), text_bytes(column.slice(begin, i - begin))
            begin, total = i, 0
        total += n
    if begin < len(size):
        yield slice(begin, len(size)), text_bytes(column.slice(begin))


def numbered(df: DataFrame) -> DataFrame:
    """df with its columns named c0, c1 and so on, so that no name clashes with those of an operator; `toDF` gives them back."""
    return df.toDF(*(f"c{k}" for k in range(len(df.columns))))


def place_of(df: DataFrame, name: str) -> str:
    """What `numbered` calls the column."""
    return f"c{df.columns.index(name)}"


def append_columns(df: DataFrame, text: str, added: list[T.StructField], make: Callable[[], Callable[[list[bytes]], list]]) -> DataFrame:
    """All columns of df, and those in `added` computed from the column `text`, in one Arrow pass without a shuffle.

    `make` runs once a task and returns a function from the rows' bytes to one array a field. A column of df that has the name
    of an added one is replaced.
    """
    clash = {f.name.lower() for f in added}
    at = df.columns.index(text)
    stay = [k for k, c in enumerate(df.columns) if c.lower() not in clash]
    types = [pa_type(f.dataType) for f in added]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fn = make()
        for batch in batches:
            if batch.num_rows == 0:
                continue
            parts = [fn(texts) for _, texts in text_steps(batch.column(at))]
            new = [pa.array(np.concatenate([np.asarray(p[k]) for p in parts]), type=t) if not pa.types.is_string(t) else pa.array([x for p in parts for x in p[k]], type=t) for k, t in enumerate(types)]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in stay), *new], names=[*(batch.schema.names[k] for k in stay), *(f.name for f in added)])

    return df.mapInArrow(run, T.StructType([*(df.schema.fields[k] for k in stay), *added]))


def pa_type(kind: T.DataType) -> pa.DataType:
    return {"long": pa.int64(), "integer": pa.int32(), "double": pa.float64(), "boolean": pa.bool_(), "string": pa.string(), "binary": pa.binary(), "float": pa.float32()}[kind.typeName()]


class Tokens:
    """Words of many texts at once, by numpy: where they begin and end in the joined bytes, and a 64-bit hash of each.

    The hash is a polynomial over random values of the bytes, so it does not depend on where a word stands. White space
    has the value 0 and, with `fold`, A-Z have the values of a-z.
    """

    _rng = np.random.default_rng(20240607)
    _values = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    _base = int(_rng.integers(1 << 40, 1 << 62, dtype=np.uint64)) | 1
    _powers = np.ones(1, dtype=np.uint64)
    _inverse = np.ones(1, dtype=np.uint64)

    @classmethod
    def _grow(cls, n: int) -> None:
        if len(cls._powers) >= n:
            return
        n = max(n, STEP_BYTES + 4096)
        back = pow(cls._base, -1, 1 << 64)

        def series(base: int) -> np.ndarray:
            out = np.full(n, base, dtype=np.uint64)
            out[0] = 1
            return np.multiply.accumulate(out)

        cls._powers, cls._inverse = series(cls._base), series(back)

    def __init__(self, texts: list[bytes], fold: bool, hashes: bool = True) -> None:
        self.offsets = np.zeros(len(texts) + 1, dtype=np.int64)
        np.cumsum([len(x) for x in texts], out=self.offsets[1:])
        self.data = np.frombuffer(b"".join(texts), dtype=np.uint8)
        n = len(self.data)
        solid = ~SPACE[self.data]
        first = np.empty(n, dtype=bool)
        last = np.empty(n, dtype=bool)
        if n:
            first[0], last[-1] = solid[0], solid[-1]
            np.greater(solid[1:], solid[:-1], out=first[1:])
            np.greater(solid[:-1], solid[1:], out=last[:-1])
            edge = self.offsets[1:-1]
            edge = edge[(edge > 0) & (edge < n)]
            first[edge] = solid[edge]
            last[edge - 1] = solid[edge - 1]
        self.start = np.flatnonzero(first)
        self.end = np.flatnonzero(last) + 1
        #: words of text i are those from bounds[i] to bounds[i + 1]
        self.bounds = np.searchsorted(self.start, self.offsets)
        self.counts = np.diff(self.bounds)
        if hashes:
            self.hash = self._hash(fold, n)

    def _hash(self, fold: bool, n: int) -> np.ndarray:
        if not len(self.start):
            return np.zeros(0, dtype=np.uint64)
        self._grow(n)
        values = self._values.copy()
        values[SPACE] = 0
        if fold:
            values[65:91] = values[97:123]
        h = np.add.reduceat(values[self.data] * self._powers[:n], self.start)
        h *= self._inverse[self.start]
        return mix(h)

    def sums(self) -> tuple[np.ndarray, np.ndarray]:
        """Sums of the words' hashes up to each word, times powers of the base, and inverse powers: hashes of rows of words."""
        n = len(self.hash)
        self._grow(n)
        return np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum(self.hash * self._powers[:n])]), self._inverse[:n]

    def row(self) -> np.ndarray:
        """The text that each word is of."""
        return np.repeat(np.arange(len(self.counts)), self.counts)


def mix(h: np.ndarray) -> np.ndarray:
    """Spread a 64-bit hash over all its bits."""
    h = h ^ (h >> np.uint64(31))
    h *= np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    return h


def pair_hash(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return mix(a * np.uint64(0xA24BAED4963EE407) + b)
