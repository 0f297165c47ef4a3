"""Bounded samples of rows for fitting a classifier."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from readloom.llm.common import in_fold

#: About the most labelled rows, and rows of any kind, that a classifier is fitted on; those with the smallest hashes of their ids.
MOST_LABELLED, MOST_UNLABELLED = 20_000, 20_000
#: Rows whose crc32 of the id leaves no remainder by this are never learned from.
HELD_OUT = 5


def least_hashes(key: Column, rows: int, most: int) -> Column:
    """True for about `most` of so many keys, a hundredth less rather than more; for all where there are no more."""
    share = 1.0 if rows <= most else 0.99 * most / rows
    return F.pmod(F.xxhash64(F.lit("sample"), key), F.lit(1 << 40)) < int(share * (1 << 40))


def chosen_labels(labels: DataFrame, label: str, most: int, id: str) -> DataFrame:
    """(_id, label int) of about `most` labelled ids outside the held-out fold.

    An id with several labels has that of the majority, 1 in a tie; rows with a null id or label do not count.
    """
    found = labels.where(F.col(id).isNotNull() & F.col(label).isNotNull() & ~in_fold(F.col(id), HELD_OUT)).select(F.col(id).alias("_id"), F.col(label).cast("double").alias("_label"))
    found = found.where(least_hashes(F.col("_id"), found.count(), most))
    return found.groupBy("_id").agg((F.avg("_label") >= 0.5).cast("int").alias("label"))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, most: int = MOST_LABELLED, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(text, label int) of about `most` labelled ids outside the held-out fold, each text and label once."""
    rows = docs.select(F.col(id).alias("_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    return rows.join(F.broadcast(chosen_labels(labels, label, most, id)), "_id").select("text", "label").dropDuplicates()  # about `most` small rows


def training_sample(docs: DataFrame, labels: DataFrame, label: str, most: int = MOST_LABELLED, most_unlabelled: int = MOST_UNLABELLED, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(text, label int, part int) of about `most` labelled ids and about `most_unlabelled` documents, outside the held-out fold, each text once in a part.

    part: where there is a label, by the id, 0 for three quarters and 1 for the others; 2 where none was taken, or there is none.
    """
    chosen = chosen_labels(labels, label, most, id).withColumn("part", (F.pmod(F.xxhash64(F.lit("part"), "_id"), F.lit(4)) == 3).cast("int"))
    rows = docs.where(F.col(id).isNotNull() & ~in_fold(F.col(id), HELD_OUT)).select(F.col(id).alias("_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    taken = rows.join(F.broadcast(chosen), "_id", "left").where(F.col("label").isNotNull() | least_hashes(F.col("_id"), docs.count(), most_unlabelled))  # about `most` small rows
    return taken.select("text", "label", F.coalesce("part", F.lit(2)).alias("part")).dropDuplicates()
