"""Sharding by a consistent-hash ring with virtual nodes and bounded loads.

A document's place on the ring is the hash of its text, so that equal texts stay together. The ring is cut into fixed cells;
each cell belongs to the next virtual node clockwise. Shards take their own cells, clockwise, up to the capacity; what is
beyond goes on clockwise to the next shard with room. The walk runs over the cells' byte totals, a bounded table, after the
few rows that are large against a shard; rows then find their shard by the bytes before them in their cell, and their slot
by the rows before them in their shard.

Given results: a null text is as an empty one. Documents with equal texts are split only where a shard gets full within
them. Repeated rows and null ids each have a slot. An empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from readloom.llm.common import materialise
from readloom.llm.ordered import running

SHARDS, VIRTUAL_NODES = 24, 64
#: Cells of the ring, as a power of 2, and how far above the mean a shard may be filled.
CELL_BITS, SLACK = 14, 0.002
#: A row of more than this share of a shard is large: placed by itself, before the others.
LARGE = 200


def virtual_nodes(shards: int, each: int, cells: int) -> tuple[list[int], list[int]]:
    """Cells in which the virtual nodes stand, clockwise, and their shards. A new shard adds nodes and moves none."""
    place = lambda s, k: int.from_bytes(hashlib.sha256(f"{s}/{k}".encode()).digest()[:8], "big")
    ring = sorted((place(s, k) * cells >> 64, s) for s in range(shards) for k in range(each))
    return [c for c, _ in ring], [s for _, s in ring]


def walk(load: dict[tuple[bool, int], tuple[int, int]], shards: int, each: int, slack: float) -> dict[tuple[bool, int], list[tuple[int, int]]]:
    """For each key of load, the shards that take its bytes, in order, and how many each takes.

    load: (large, place on the ring) to (rows, bytes of all). Keys of large rows hold one text; their rows are placed one by
    one, the largest first, each on the first shard clockwise that has room for it, or else on that with the most room.
    Cells of other rows follow: a shard takes their bytes up to the capacity, and what is beyond goes on clockwise.
    """
    total = sum(size for _, size in load.values())
    capacity = int(total * (1 + slack) / shards) + 1
    at, owner = virtual_nodes(shards, each, 1 << CELL_BITS)
    room = [capacity] * shards
    taken: dict[tuple[bool, int], list[tuple[int, int]]] = {}

    def take(key, s: int, size: int) -> None:
        room[s] -= size
        own = taken.setdefault(key, [])
        if own and own[-1][0] == s:
            own[-1] = (s, own[-1][1] + size)
        else:
            own.append((s, size))

    for key in sorted((k for k in load if k[0]), key=lambda k: (-load[k][1] // load[k][0], k)):
        n, size = load[key][0], load[key][1] // load[key][0]
        node = bisect_left(at, (key[1] % (1 << 64)) >> (64 - CELL_BITS)) % len(at)
        ahead = list(dict.fromkeys(owner[node:] + owner[:node]))
        for _ in range(n):
            take(key, next((s for s in ahead if room[s] >= size), max(ahead, key=lambda s: room[s])), size)
    pieces = [(key, bisect_left(at, key[1]) % len(at), load[key][1]) for key in sorted(k for k in load if not k[0])]
    while pieces:
        beyond = []
        for key, node, size in pieces:
            most = min(size, max(0, room[owner[node]]))
            if most:
                take(key, owner[node], most)
            if size > most:
                beyond.append((key, (node + 1) % len(at), size - most))
        pieces = beyond
    return taken


def shard(docs: DataFrame, id: str = "doc_id", text: str = "text", shards: int = SHARDS, each: int = VIRTUAL_NODES, slack: float = SLACK) -> DataFrame:
    """(id, size, text_crc32, shard, slot) for each row."""
    spark = docs.sparkSession
    body = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.col(id).alias("id"), (F.octet_length(body) + 8).cast("long").alias("size"), F.crc32(body.cast("binary")).alias("text_crc32"), F.xxhash64(body).alias("g"))
    rows = materialise(rows.withColumn("r", F.xxhash64("g", "id")), "places")
    total = rows.agg(F.sum("size")).first()[0] or 0
    large = F.col("size") > max(8, total // (shards * LARGE))
    cell = F.shiftrightunsigned("g", 64 - CELL_BITS)
    rows = rows.withColumn("large", large).withColumn("place", F.when(large, F.col("g")).otherwise(cell))
    # a row a cell, and one for each text of large rows, of which all rows together have room for LARGE a shard
    load = {(r[0], r[1]): (r[2], r[3]) for r in rows.groupBy("large", "place").agg(F.count(F.lit(1)), F.sum("size")).collect()}
    taken = walk(load, shards, each, slack)
    whole, split = [], []
    for key, parts in taken.items():
        upto = 0
        for k, (s, n) in enumerate(parts):
            if len(parts) == 1:
                whole.append((*key, s))
            else:
                split.append((*key, s, upto, upto + n if k + 1 < len(parts) else 1 << 62))
            upto += n
    # as bounded as load is, times the shards at most
    whole = F.broadcast(spark.createDataFrame(whole, "large boolean, place long, shard int"))
    split = F.broadcast(spark.createDataFrame(split, "large boolean, place long, shard int, lo long, hi long"))
    key, columns = ["large", "place"], ["id", "size", "text_crc32", "g", "r", "shard"]
    alone = rows.join(whole, key).select(columns)
    parts = running(rows.join(split.select(key).distinct(), key, "left_semi"), key, ["g", "r"], "size", "before")
    middle = F.col("before") + F.floor(F.col("size") / 2)
    parts = parts.join(split, key).where((middle >= F.col("lo")) & (middle < F.col("hi"))).select(columns)
    placed = running(alone.union(parts), ["shard"], ["g", "r"], None, "slot")
    return placed.select(F.col("id").alias(id), "size", "text_crc32", "shard", "slot")


def query(spark, sf_dir: str) -> DataFrame:
    return digest(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def digest(docs: DataFrame) -> DataFrame:
    found = shard(docs.select("doc_id", "text"))
    return found.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
