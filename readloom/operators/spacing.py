"""Distances between modified bases of a read, and the nucleosome repeat length."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from readloom.functions import kernels
from readloom.schema import check_scalar


def calc_and_count_dist(query: list[int], reference: list[int], counts: list[int]) -> list[int]:
    """counts and the pairs with reference - query = 1, 2, ...; both lists must be sorted."""
    q, r = np.asarray(query), np.asarray(reference)
    if (np.diff(q) < 0).any() or (np.diff(r) < 0).any():
        raise ValueError("both must be sorted")
    out = np.array(counts, dtype=np.int64)
    begin, end = np.searchsorted(r, q, "right"), np.searchsorted(r, q + len(out), "right")
    for a, b, x in zip(begin, end, q):
        np.add.at(out, r[a:b] - x - 1, 1)
    return out.tolist()


def modbase_spacing(calls: DataFrame, least_prob: float = 0.5, pool_reads: bool = True, dmax: int = 1000, assay: str = "mod_prob", fill: bool = True, groups: DataFrame | None = None) -> DataFrame:
    """(sample[, read_id], d, n): how often two modified bases of a read are d = 1..dmax apart on a sequence.

    A range frame looks ahead by dmax from each base: one shuffle by read and sequence, and no pairs beyond dmax are made.
    fill: all d are there, with 0 where there is nothing, for each of `groups` (or those with calls).
    """
    check_scalar(dmax, int, within=(1, 10_000_000), name="dmax")
    check_scalar(least_prob, float, within=(0, 1), name="least_prob")
    key = ["sample"] if pool_reads else ["sample", "read_id"]
    ahead = Window.partitionBy("sample", "read_id", "chrom").orderBy("pos").rangeBetween(1, dmax)
    rows = calls.where(F.col(assay) >= least_prob).select("sample", "read_id", "chrom", "pos", F.collect_list("pos").over(ahead).alias("next"))
    pairs = rows.select(*key, "pos", F.explode("next").alias("other")).select(*key, (F.col("other") - F.col("pos")).alias("d"))
    counts = pairs.groupBy(*key, "d").agg(F.count(F.lit(1)).alias("n"))
    if not fill:
        return counts
    whole = (groups if groups is not None else calls).select(*key).distinct()
    return whole.select(*key, F.explode(F.sequence(F.lit(1), F.lit(dmax))).alias("d")).join(counts, [*key, "d"], "left").fillna(0, ["n"])


_SERIES = "d int, count double, smooth double, trend double, residual double, is_peak boolean, nrl double, nrl_low double, nrl_high double, intercept double, r2 double, p double"


def _series(mind: int, use_peaks: Sequence[int], span1, span2, key: list[str]):
    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("d")
        counts = np.zeros(int(group["d"].max()))
        counts[group["d"].to_numpy() - 1] = group["n"]
        found = kernels.estimate_nrl(counts, mind, use_peaks, span1, span2)
        n = len(counts)
        out = {k: group[k].iloc[0] for k in key} | {"d": np.arange(1, n + 1, dtype=np.int32), "count": counts}
        late = np.full(n, np.nan)
        for name in ("smooth", "trend", "residual"):
            column = late.copy()
            if found:
                column[found["first"] - 1 :] = found[name]
            out[name] = column
        peaks = found["peaks"].astype(int) if found else []
        out["is_peak"] = np.isin(np.arange(1, n + 1), peaks)
        fit = found["fit"] if found else {}
        out |= {"nrl": fit.get("slope"), "nrl_low": fit.get("low"), "nrl_high": fit.get("high"), "intercept": fit.get("intercept"), "r2": fit.get("r2"), "p": fit.get("p")}
        return pd.DataFrame(out).astype({c: float for c in ("nrl", "nrl_low", "nrl_high", "intercept", "r2", "p")})

    return run


def spacing_series(spacing: DataFrame, mind: int = 140, use_peaks: Sequence[int] = (1, 2, 3, 4, 5), span1: float | None = None, span2: float | None = None) -> DataFrame:
    """For each sample and d: count, smooth, trend, residual, peaks, and the line through the peaks of the given numbers. A group has dmax rows."""
    key = [c for c in ("sample", "read_id") if c in spacing.columns]
    fields = ", ".join(f"{k} string" for k in key)
    rows = spacing.select(*key, F.col("d").cast("int"), F.col("n").cast("double"))
    return rows.groupBy(*key).applyInPandas(_series(mind, use_peaks, span1, span2, key), f"{fields}, {_SERIES}")


def estimate_nrl(spacing: DataFrame, **options) -> DataFrame:
    """(sample, nrl, nrl_low, nrl_high, peaks); NaN for a histogram of zeros."""
    key = [c for c in ("sample", "read_id") if c in spacing.columns]
    series = spacing_series(spacing, **options)
    return series.groupBy(*key).agg(F.first("nrl").alias("nrl"), F.first("nrl_low").alias("nrl_low"), F.first("nrl_high").alias("nrl_high"), F.array_sort(F.collect_list(F.when(F.col("is_peak"), F.col("d")))).alias("peaks"))


