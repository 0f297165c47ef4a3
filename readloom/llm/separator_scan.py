"""Token counts by separator scan over flat token files without an index.

A file is token ids of a fixed width, each document followed by an end-of-document id. Files are cut into blocks; a task
reads a block and finds the separators by one vectorised comparison. A prefix scan over the blocks' summaries (separators
in it, place of the last) gives each block the number of documents before it and where its first document began, so that
documents that span blocks are stitched without reading anything twice.

Given results: an empty file has no documents; two separators in a row hold an empty document; tokens after the last
separator are a document that is not closed. `write_tokens` gives a null text no tokens; its rows, repeated or without an id,
are documents each. An empty table gives empty files or none. A file whose size is not a whole number of ids is an error.
"""

from __future__ import annotations

import base64
import re
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from readloom.llm.common import local_path, materialise, new_path, text_steps

#: The tokenizer's rank file, its end-of-document id (free in the ranks) and its pattern.
TOKENIZER, SEPARATOR = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken", 50256
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
BLOCK_TOKENS, CACHED_WORDS = 4 << 20, 200_000


def opened(uri: str):
    """(file system, path) of a URI."""
    path = local_path(uri)
    return (pafs.LocalFileSystem(), path) if path else pafs.FileSystem.from_uri(uri)


def encoder(ranks_path: str):
    """A function from a text to its ids, packed in 16 bits. Words are remembered, since a corpus repeats them."""
    import tiktoken

    with open(ranks_path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    encode = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
    known: dict[str, bytes] = {}
    #: runs of blanks, which the pattern divides by what follows: such a text is encoded whole
    blanks = re.compile(r"[^\S ]\s| \s|\s$|[\x1c-\x1f]")

    def word(piece: str) -> bytes:
        ids = np.array(encode(piece), dtype=np.uint16).tobytes()
        if len(known) < CACHED_WORDS:
            known[piece] = ids
        return ids

    def run(text: str) -> bytes:
        if blanks.search(text):
            return np.array(encode(text), dtype=np.uint16).tobytes()
        first, *rest = text.split(" ")
        parts = [word(first) if first else b""]
        get = known.get
        parts += [get(p) or word(p) for p in map(" ".__add__, rest)]
        return b"".join(parts)

    return run


def write_tokens(docs: DataFrame, path: str, id: str = "doc_id", text: str = "text", tokenizer: str = TOKENIZER, separator: int = SEPARATOR) -> DataFrame:
    """Write a flat file of 16-bit ids a task under `path`; (file, place, id): which document is where in its file."""
    rows = docs.select(id, text)
    kind = dict(rows.dtypes)[id]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end = encoder(tokenizer), np.uint16(separator).tobytes()
        name, place = f"{TaskContext.get().partitionId():06d}.tokens", 0
        fs, folder = opened(path)
        fs.create_dir(folder, recursive=True)
        part = f"{folder}/.{name}.{uuid.uuid4().hex}"
        with fs.open_output_stream(part) as f:
            for batch in batches:
                for s, texts in text_steps(batch.column(1)):
                    f.write(b"".join(encode(t.decode("utf-8", "replace")) + end for t in texts))
                n = batch.num_rows
                yield pa.RecordBatch.from_arrays([pa.array([name] * n, pa.string()), pa.array(np.arange(place, place + n)), batch.column(0)], names=["file", "place", id])
                place += n
        fs.move(part, f"{folder}/{name}")

    return materialise(rows.mapInArrow(run, f"file string, place long, `{id}` {kind}"), "places")


def blocks_of(spark: SparkSession, path: str, block_tokens: int, width: int) -> DataFrame:
    """(file, block, offset, tokens) over all files under `path`, whose sizes Spark lists without reading them."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.tokens").load(path).select(F.element_at(F.split("path", "/"), -1).alias("file"), "length")
    files = files.select("file", F.when(F.col("length") % width == 0, F.col("length") / width).otherwise(F.raise_error(F.concat(F.lit("not a whole number of ids: "), "file"))).cast("long").alias("n"))
    block = F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / block_tokens)))
    out = files.where("n > 0").select("file", "n", block.alias("block"))
    start = F.col("block") * block_tokens
    return out.select("file", "block", start.alias("start"), F.least(F.lit(block_tokens).cast("long"), F.col("n") - start).alias("tokens"))


def scan(spark: SparkSession, path: str, separator: int = SEPARATOR, kind: str = "uint16", block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """(file, place, start, n_tokens, closed) for each document of the files under `path`."""
    width = np.dtype(kind).itemsize

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, folder = opened(path)
        for batch in batches:
            for name, block, start, tokens in zip(*(c.to_pylist() for c in batch.columns)):
                with fs.open_input_file(f"{folder}/{name}") as f:
                    ids = np.frombuffer(f.read_at(tokens * width, start * width), dtype=kind)
                at = np.flatnonzero(ids == separator)
                last = start + int(at[-1]) + 1 if len(at) else None
                columns = [[name], [block], [start + tokens], [len(at)], [last], [at.astype(np.uint32).tobytes()], [start]]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, [pa.string(), *[pa.int64()] * 4, pa.binary(), pa.int64()])], names=["file", "block", "stop", "found", "last", "at", "start"])

    blocks = blocks_of(spark, path, block_tokens, width)
    found = materialise(blocks.repartition("file", "block").mapInArrow(find, "file string, block long, stop long, found long, last long, at binary, start long"), "separators")
    # a row a block, without the separators themselves
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    prefix = found.select("file", "block", F.coalesce(F.sum("found").over(before), F.lit(0)).alias("places"), F.coalesce(F.max("last").over(before), F.lit(0)).alias("begun"), F.max("stop").over(whole).alias("end"))

    def stitch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, at, start, stop, place, begun, end in zip(*(c.to_pylist() for c in batch.columns)):
                ends = np.frombuffer(at, dtype=np.uint32).astype(np.int64) + start
                begins = np.concatenate([[begun], ends + 1])
                closed = np.ones(len(ends), dtype=bool)
                if stop == end and begins[-1] < end:  # the file ends within a document
                    ends, closed = np.append(ends, end), np.append(closed, False)
                n = len(ends)
                begins = begins[:n]
                yield pa.RecordBatch.from_arrays([pa.array([name] * n, pa.string()), pa.array(place + np.arange(n)), pa.array(begins), pa.array(ends - begins), pa.array(closed)], names=["file", "place", "start", "n_tokens", "closed"])

    rows = found.join(prefix, ["file", "block"]).select("file", "at", "start", "stop", "places", "begun", "end")
    return rows.mapInArrow(stitch, "file string, place long, start long, n_tokens long, closed boolean")


def query(spark, sf_dir: str) -> DataFrame:
    path = new_path(spark, "tokens")
    places = write_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), path)
    return places.join(scan(spark, path), ["file", "place"]).select("doc_id", "n_tokens", "closed")
