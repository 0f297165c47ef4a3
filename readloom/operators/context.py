"""Sequence contexts of positions from a tiled reference, and filters on them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from readloom.functions.sequence import context_of, matches_context, odd_width

#: Bases a tile of the reference starts, and how far it reaches into the next: any window up to 1000 wide lies in one tile.
TILE, OVERLAP = 1 << 14, 1024


def tiles(sequences: DataFrame, tile: int = TILE) -> DataFrame:
    """(chrom, tile_idx, tile_start, seq, chrom_len) of (chrom, seq); tile_start is 1-based."""
    rows = sequences.select("chrom", "seq", F.length("seq").alias("chrom_len"))
    index = F.explode(F.sequence(F.lit(0), F.greatest(F.floor((F.col("chrom_len") - 1) / tile), F.lit(0)).cast("int")))
    rows = rows.select("chrom", "seq", "chrom_len", index.alias("tile_idx"))
    first = F.greatest(F.col("tile_idx") * tile + 1 - OVERLAP, F.lit(1))
    return rows.select("chrom", "tile_idx", first.alias("tile_start"), F.substring("seq", first, F.col("tile_idx") * tile + tile + OVERLAP - first + 1).alias("seq"), "chrom_len")


def extract_seq_context(positions: DataFrame, width: int, reference: DataFrame, tile: int = TILE, pad_before_rc: bool = False) -> DataFrame:
    """positions and seq_context, `width` bases around pos (or around the middle of start to end, where there are such columns)."""
    width = odd_width(width)
    rows = positions
    if "start" in positions.columns and "pos" not in positions.columns:
        rows = rows.withColumn("pos", F.floor((F.col("start") + F.col("end")) / 2).cast("int"))
    rows = rows.withColumn("tile_idx", F.floor((F.col("pos") - 1) / tile).cast("int"))
    strand = F.col("strand") if "strand" in rows.columns else F.lit("*")
    joined = rows.join(reference, ["chrom", "tile_idx"], "left")
    found = context_of(F.col("seq"), F.col("tile_start"), F.col("chrom_len"), F.col("pos"), strand, width, pad_before_rc)
    return joined.withColumn("seq_context", found).select(*positions.columns, "seq_context")


def add_seq_context(experiment, width: int, reference: DataFrame, **options):
    return experiment.with_(positions=extract_seq_context(experiment.positions, width, reference, **options))


def filter_context(rows: DataFrame, patterns: str | list[str], context: str = "seq_context") -> DataFrame:
    """Rows whose context matches any of the IUPAC patterns."""
    if context not in rows.columns:
        raise ValueError("there are no sequence contexts: add them first")
    return rows.where(matches_context(F.col(context), patterns))
