"""Subsets of reads."""

from __future__ import annotations

import warnings

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from readloom.experiment import ModExperiment

KEY = ["sample", "read_id"]


def normalise_reads(reads: DataFrame, wanted: DataFrame | list[str] | dict[str, list]) -> DataFrame:
    """(sample, read_id, place) from full ids, or by sample from ids, 1-based numbers or a list of booleans."""
    spark = reads.sparkSession
    if isinstance(wanted, DataFrame):
        return wanted.select(*KEY, F.monotonically_increasing_id().alias("place"))
    if not isinstance(wanted, dict):
        asked = spark.createDataFrame([(r, i) for i, r in enumerate(wanted)], "read_id string, place long")
        found = asked.join(reads.select(*KEY), "read_id", "left")
        if not found.where("sample is null").isEmpty():
            raise ValueError("some of the reads are not there")
        return found.select(*KEY, "place")
    rows, numbers = [], []
    counts = dict(reads.groupBy("sample").count().where(F.col("sample").isin(*wanted)).collect())
    if unknown := set(wanted) - {r[0] for r in reads.select("sample").distinct().where(F.col("sample").isin(*wanted)).collect()}:
        raise ValueError(f"unknown samples {sorted(unknown)}")
    for sample, index in wanted.items():
        n = counts.get(sample, 0)
        if index and all(isinstance(x, bool) for x in index):
            if len(index) != n:
                raise ValueError(f"{sample!r} has {n} reads, not {len(index)}")
            index = [i + 1 for i, x in enumerate(index) if x]
        if index and all(isinstance(x, int) for x in index):
            if not all(1 <= x <= n for x in index):
                raise ValueError(f"a number is out of the range of the {n} reads of {sample!r}")
            numbers += [(sample, x, i) for i, x in enumerate(index)]
        else:
            rows += [(sample, x, i) for i, x in enumerate(index)]
    by_id = spark.createDataFrame(rows, "sample string, read_id string, place long")
    if not by_id.join(reads, KEY, "left_anti").isEmpty():
        raise ValueError("some of the reads are not there")
    by_number = spark.createDataFrame(numbers, "sample string, read_ord int, place long").join(reads.select(*KEY, "read_ord"), ["sample", "read_ord"])
    return by_id.union(by_number.select(*KEY, "place"))


def subset_reads(experiment: ModExperiment, wanted, prune: bool = True, invert: bool = False) -> ModExperiment:
    """Only the wanted reads in their order, or all others in the old order. Positions stay; n_reads follows.

    Samples that are not named keep no reads; prune removes samples without any.
    """
    if experiment.calls is None:
        warnings.warn("there is no read-level table: nothing to subset", stacklevel=2)
        return experiment
    chosen = normalise_reads(experiment.reads, wanted)
    how = "left_anti" if invert else "left_semi"
    keep = lambda t: None if t is None else t.join(chosen, KEY, how)
    reads = keep(experiment.reads)
    if not invert:
        reads = reads.drop("read_ord").join(chosen.select(*KEY, (F.col("place") + 1).cast("int").alias("read_ord")), KEY).select(*experiment.reads.columns)
    counts = reads.groupBy("sample").agg(F.count(F.lit(1)).cast("int").alias("n_reads"))
    samples = experiment.samples.drop("n_reads").join(counts, "sample", "inner" if prune else "left").fillna(0, ["n_reads"])
    found = experiment.with_(reads=reads, calls=keep(experiment.calls), read_stats=keep(experiment.read_stats), samples=samples)
    if prune and experiment.pileup is not None:
        found = found.with_(pileup=experiment.pileup.join(samples.select("sample"), "sample", "left_semi"))
    return found
