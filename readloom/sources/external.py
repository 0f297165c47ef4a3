"""Extraction by the external tool modkit, where it is installed."""

from __future__ import annotations

import shutil
import subprocess
from collections.abc import Iterator
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from readloom.functions.sequence import regions_frame
from readloom.operators.ranges import merge_regions
from readloom.storage import new_path


def modkit_version(modkit: str | None = None) -> str | None:
    tool = modkit or shutil.which("modkit")
    try:
        return subprocess.run([tool, "--version"], capture_output=True, text=True, check=True).stdout.strip() if tool else None
    except (OSError, subprocess.CalledProcessError):
        return None


def extract_commands(modkit: str, bam: str, regions: list[str] | None, folder: str, num_reads: int | None = None, extra: tuple[str, ...] = ()) -> list[list[str]]:
    """A command for each region; without a region the index is ignored where reads are limited."""
    out = []
    for i, region in enumerate(regions or [None]):
        limits = [*(["--num-reads", str(num_reads)] if num_reads else []), *(["--region", region] if region else ["--ignore-index"] if num_reads else [])]
        out.append([modkit, "extract", "full", *limits, *extra, bam, f"{folder}/{i}.tsv"])
    return out


def modkit_extract(spark: SparkSession, bam: str, out: str, regions: list[str] | None = None, num_reads: int | None = None, modkit: str | None = None, extra: tuple[str, ...] = ()) -> DataFrame:
    """Run modkit on each merged region, and write the distinct rows of all as one table of tab-separated text under `out`."""
    tool = modkit or shutil.which("modkit")
    if not tool or modkit_version(tool) is None:
        raise FileNotFoundError("modkit is not installed")
    merged = None
    if regions:
        rows = merge_regions(regions_frame(spark, regions)).orderBy("chrom", "start").collect()  # the caller's regions
        merged = [f"{r['chrom']}:{r['start']}-{r['end']}" for r in rows]
    commands = extract_commands(tool, bam, merged, raw := new_path(spark, "extracted"), num_reads, extra)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for command in batch["command"]:
                target = command[-1].removeprefix("file:")
                Path(target).parent.mkdir(parents=True, exist_ok=True)
                subprocess.run([*command[:-1], target], check=True, capture_output=True)
            yield batch[["at"]]

    # a task a region; the tool writes to a path, so that the shared folder must be mounted where it runs
    table = spark.createDataFrame(list(enumerate(commands)), "at int, command array<string>")
    table.repartitionByRange(len(commands), "at").mapInPandas(run, "at int").count()
    rows = spark.read.option("sep", "\t").option("header", True).csv(raw).dropDuplicates()
    rows.write.option("sep", "\t").option("header", True).csv(out)
    return spark.read.option("sep", "\t").option("header", True).csv(out)
