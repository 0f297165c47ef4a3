"""Mixing sources to target weights by cube-method balanced sampling.

Each document of a source is due the same number of copies, its source's target over its source's size; the whole part is
sure, the fraction is an inclusion probability. Blocks of a source's documents move these probabilities through the null
space of two constraints, words and documents, three documents at a time, until all but two of a block are 0 or 1; what
is left of all blocks moves on in blocks of its own, round by round, until one block of a source is left. Each block keeps a
dozen documents of all sizes back. Those of a source's last block, which a source of one block has in the first round, and
its last two land on the choice that comes nearest to the source's words and documents.

Given results: a null text has no words; a null source is a source, the last. A source without words has target 0, and its
documents are taken 0 words. Repeated rows are documents each. The random moves are seeded by the rows' hashes, so that
reruns agree. An empty table gives an empty result. Other columns are ignored by `mix` and kept by `mixed_documents`.
"""

from __future__ import annotations

import random

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from readloom.llm.common import WORD, discard, materialise, numbered, place_of, small

WEIGHTS = (1, 2, 3)
#: Most copies of a document, and about how many documents a block has.
MOST_COPIES, BLOCK = 3, 4096
#: Documents of a block that are kept for the landing; of an earlier block a quarter at most, that rounds come to an end.
LANDING = 12
#: Rows of some 40 bytes up to which the list of copies is broadcast; a longer one is joined by shuffle.
COPY_ROWS = 500_000


def flight(p: list[float], size: list[int], rng: random.Random) -> list[int]:
    """Move p in place until no three fractions are left; the places of those left."""
    active: list[int] = []
    small = 1e-9
    for k in range(len(p)):
        if not small < p[k] < 1 - small:
            p[k] = float(round(p[k]))
            continue
        active.append(k)
        while len(active) == 3:
            a, b, c = active
            u = (size[b] - size[c], size[c] - size[a], size[a] - size[b])
            if u == (0, 0, 0):
                u = (1, -1, 0)
            forth = back = float("inf")
            for k2, d in zip(active, u):
                if d > 0:
                    forth, back = min(forth, (1 - p[k2]) / d), min(back, p[k2] / d)
                elif d < 0:
                    forth, back = min(forth, p[k2] / -d), min(back, (1 - p[k2]) / -d)
            step = forth if rng.random() * (forth + back) < back else -back
            left = []
            for k2, d in zip(active, u):
                x = p[k2] + step * d
                if small < x < 1 - small:
                    p[k2] = x
                    left.append(k2)
                else:
                    p[k2] = float(round(x))
            active = left if len(left) < 3 else left[:2]
    return active


def land(p: list[float], size: list[int], left: list[int]) -> None:
    """Set the last fractions to the 0s and 1s that keep words, and to a lesser part documents, nearest to their sums."""
    if not left:
        return
    choices = (np.arange(1 << len(left))[:, None] >> np.arange(len(left))) & 1
    words, due = np.array([size[k] for k in left], dtype=float), np.array([p[k] for k in left])
    off = np.abs(choices @ words - due @ words) / max(1.0, words.mean()) + 0.02 * np.abs(choices.sum(1) - due.sum())
    for k, v in zip(left, choices[int(np.argmin(off))].tolist()):
        p[k] = float(v)


def ladder(size: list[int], some: int) -> list[int]:
    """Places of some documents whose sizes halve from the largest on, as nearly as they can, so that their sums lie close."""
    free, wanted = set(range(len(size))), float(max(size))
    for _ in range(some):
        free.remove(min(free, key=lambda k: (abs(size[k] - wanted), k)))
        wanted /= 2
    return sorted(set(range(len(size))) - free)


def mover(most: int):
    """Move a block's fractions, but those of some documents of all sizes; the only block of a source, of `most` documents, lands."""

    def run(block: pd.DataFrame) -> pd.DataFrame:
        block = block.sort_values(["h", "id", "size"], kind="stable", na_position="first")
        p, size = block["p"].tolist(), block["size"].tolist()
        rng = random.Random(int(block["h"].iloc[0]) ^ len(p))
        last = int(block["n"].iloc[0]) <= most
        kept = ladder(size, min(LANDING, len(p) if last else len(p) // 4))
        rest = sorted(set(range(len(p))) - set(kept))
        own = [p[k] for k in rest]
        left = [rest[k] for k in flight(own, [size[k] for k in rest], rng)]
        for k, v in zip(rest, own):
            p[k] = v
        if last:
            land(p, size, sorted([*left, *kept]))
        return block.assign(p=p)

    return run


def targets(sources: DataFrame) -> DataFrame:
    """(source, source_size, n, target): words by weight, none above MOST_COPIES times its source's, the excess shared again.

    sources has (source, source_size, n). Weights follow the order of sources by code point, null last, through WEIGHTS.
    """
    spread = sources.repartitionByRange(F.col("source").asc_nulls_last()).withColumn("_task", F.spark_partition_id())
    spread = materialise(spread, "sources")
    starts, at = {}, 0
    for task, n in sorted(spread.groupBy("_task").count().collect()):  # a row a task
        starts[task], at = at, at + n
    first = F.coalesce(*[F.when(F.col("_task") == t, F.lit(s)) for t, s in starts.items()], F.lit(0))
    place = first + F.row_number().over(Window.partitionBy("_task").orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), (place % len(WEIGHTS) + 1).cast("int"))
    table = materialise(spread.select("source", "source_size", "n", weight.cast("long").alias("w"), (MOST_COPIES * F.col("source_size")).alias("most")), "weights")
    total, weights = table.agg(F.sum("source_size"), F.sum("w")).first()
    rate = total / weights if weights else 0.0
    while True:  # a round caps one more source at least
        capped, rest = table.agg(F.sum(F.when(rate * F.col("w") > F.col("most"), F.col("most")).otherwise(0)), F.sum(F.when(rate * F.col("w") > F.col("most"), 0).otherwise(F.col("w")))).first()
        again = (total - capped) / rest if rest else rate
        if again == rate:
            break
        rate = max(rate, again)
        if again < rate:
            break
    return table.select("source", "source_size", "n", F.least(F.col("most").cast("double"), rate * F.col("w")).alias("target"))


def units(docs: DataFrame, id: str, text: str, source: str) -> DataFrame:
    body = F.coalesce(F.col(text), F.lit(""))
    return docs.select(F.col(id).alias("id"), F.col(source).alias("source"), F.regexp_count(body, F.lit(WORD)).cast("long").alias("size"), unit_key(F.col(id), body, F.col(source)).alias("h"))


def unit_key(id: Column, text: Column, source: Column) -> Column:
    return F.xxhash64(id, F.coalesce(text, F.lit("")), source)


def mix(docs: DataFrame, id: str = "doc_id", text: str = "text", source: str = "source", block: int = BLOCK) -> DataFrame:
    """(id, source, size, h, source_size, target, copies) for each row of docs; h: unit_key of the row."""
    rows = materialise(units(docs, id, text, source), "units")
    table = materialise(targets(rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n"))), "targets")
    due = F.coalesce(F.try_divide(F.col("target"), F.col("source_size").cast("double")), F.lit(0.0))
    right = table.withColumnRenamed("source", "_source")
    rows = rows.join(right, rows.source.eqNullSafe(right._source)).drop("_source").withColumn("due", due)
    near = F.abs(F.col("due") - F.round("due")) < 1e-9
    rows = rows.withColumn("sure", F.when(near, F.round("due")).otherwise(F.floor("due")).cast("int")).withColumn("p", F.when(near, 0.0).otherwise(F.col("due") - F.floor("due")))
    columns = ["id", "source", "size", "h", "source_size", "target", "sure", "p"]
    left, settled, blocks = rows.select("*").where("p > 0"), [rows.where("p = 0").select(columns)], F.ceil(F.col("n") / block)
    most = table.agg(F.max("n")).first()[0] or 0
    turn = 0
    while most:
        last = most <= block
        parts = left.withColumn("block", F.pmod(F.xxhash64(F.lit(turn), "h"), blocks.cast("long")))
        schema = ", ".join(f"`{n}` {t}" for n, t in parts.dtypes)
        moved = materialise(parts.groupBy("source", "block").applyInPandas(mover(block), schema).drop("block"), "moved")
        settled.append(moved.where("p = 0 or p = 1").select(columns))
        if last:
            break
        rest = moved.where("p > 0 and p < 1").drop("n")
        count = materialise(rest.groupBy(F.col("source").alias("_source")).agg(F.count(F.lit(1)).alias("n")), "left")
        most = count.agg(F.max("n")).first()[0] or 0
        left = rest.join(count, rest.source.eqNullSafe(count._source)).drop("_source")
        turn += 1
    out = settled[0]
    for x in settled[1:]:
        out = out.union(x)
    return out.select(F.col("id").alias(id), F.col("source").alias(source), "size", "h", "source_size", "target", (F.col("sure") + F.col("p").cast("int")).alias("copies"))


def mixed_documents(docs: DataFrame, id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """docs with each row as often as it is taken, all columns as they were."""
    rows, id, text, source = numbered(docs), place_of(docs, id), place_of(docs, text), place_of(docs, source)
    own = rows.columns
    taken = mix(rows, id, text, source).groupBy(F.col("h").alias("_h"), F.col(id).alias("_id")).agg(F.count(F.lit(1)).alias("_n"), F.array_sort(F.collect_list("copies")).alias("_copies"))
    taken = materialise(taken, "copies")
    rows = rows.withColumns({"_key": unit_key(F.col(id), F.col(text), F.col(source))})
    same = lambda a, b: (a["_key"] == b["_h"]) & a[id].eqNullSafe(b["_id"])
    once, more = (small(taken.where(x), COPY_ROWS) for x in ("_n = 1", "_n > 1"))
    single = rows.join(once, same(rows, once)).select(*[rows[c] for c in own], F.get("_copies", F.lit(0)).alias("_times"))
    if not more.isEmpty():
        single = single.union(several_rows(rows, more, same, own))
    return single.where("_times > 0").select(*own, F.explode(F.sequence(F.lit(1), F.col("_times")))).select(*own).toDF(*docs.columns)


def several_rows(rows: DataFrame, more: DataFrame, same, columns: list[str]) -> DataFrame:
    """Rows that share id, source and text: the first in the order of their columns takes the first number of copies."""
    row = F.struct(*[rows[c] for c in columns])
    place = F.row_number().over(Window.partitionBy("_h", "_id").orderBy(row)) - 1
    return rows.join(more, same(rows, more)).select(*[rows[c] for c in columns], F.get("_copies", place).alias("_times"))


def query(spark, sf_dir: str) -> DataFrame:
    found = mix(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source"))
    return found.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))
