"""Joins of positions with genomic ranges, and merging of ranges."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Bases a bin has. A range is in all bins that it touches, a position in one: their join has an equality to deal by.
BIN = 1 << 16


def _binned(regions: DataFrame) -> DataFrame:
    return regions.withColumnsRenamed({"chrom": "_chrom", "strand": "_strand", "start": "_start", "end": "_end"}).withColumn("_bin", F.explode(F.sequence(F.floor(F.col("_start") / BIN), F.floor(F.col("_end") / BIN))))


def _joined(positions: DataFrame, regions: DataFrame, how: str) -> DataFrame:
    """A few ranges are broadcast by Spark itself, as their size tells; many are shuffled by sequence and bin."""
    left = positions.withColumn("_at", F.floor(F.col("pos") / BIN))
    right = _binned(regions)
    strand = (F.col("_strand") == "*") | (F.col("strand") == "*") | (F.col("_strand") == F.col("strand"))
    on = (F.col("chrom") == F.col("_chrom")) & (F.col("_at") == F.col("_bin")) & F.col("pos").between(F.col("_start"), F.col("_end")) & strand
    return left.join(right, on, how).drop("_at")


def overlap_join(positions: DataFrame, regions: DataFrame) -> DataFrame:
    """Each position with each range that it lies in, and the range's region_idx and region."""
    return _joined(positions, regions.select("region_idx", "region", "chrom", "start", "end", "strand"), "inner").drop("_chrom", "_strand", "_start", "_end", "_bin")


def overlap_semi(positions: DataFrame, regions: DataFrame) -> DataFrame:
    return _joined(positions, regions.select("chrom", "start", "end", "strand"), "left_semi")


def overlap_anti(positions: DataFrame, regions: DataFrame) -> DataFrame:
    return _joined(positions, regions.select("chrom", "start", "end", "strand"), "left_anti")


def merge_regions(regions: DataFrame) -> DataFrame:
    """(chrom, start, end): ranges without strand, those that overlap or touch as one."""
    before = Window.partitionBy("chrom").orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1)
    upto = Window.partitionBy("chrom").orderBy("start", "end")
    marked = regions.withColumn("_new", F.when(F.col("start") <= F.max("end").over(before) + 1, 0).otherwise(1))
    return marked.withColumn("_island", F.sum("_new").over(upto)).groupBy("chrom", "_island").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("_island")
