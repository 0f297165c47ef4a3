"""Quality statistics of reads, after filters on regions, contexts and coverage."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from readloom.experiment import POSITION, ModExperiment
from readloom.functions import kernels
from readloom.operators.context import filter_context
from readloom.operators.ranges import overlap_semi
from readloom.schema import check_scalar, check_vector

STATISTICS = (
    "mean_mod_prob", "frac_mod", "mean_conf", "mean_conf_unm", "mean_conf_mod", "frac_low_conf", "iqr_mod_prob", "sd_mod_prob",
    "sentr_mod_prob", "lag1d_mod_prob", "ac_mod_prob", "pac_mod_prob",
)
#: Values above which the entropy of a read is computed.
LEAST_FOR_ENTROPY = 64


def filter_calls(experiment: ModExperiment, regions: DataFrame | None = None, context: str | list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(positions, calls) in the regions and with the context."""
    positions, calls = experiment.positions, experiment.calls
    if regions is not None:
        positions, calls = overlap_semi(positions, regions), overlap_semi(calls, regions)
    if context is not None:
        positions = filter_context(positions, context)
        calls = calls.join(positions.select(*POSITION), POSITION, "left_semi")
    return positions, calls


def coverage(positions: DataFrame, samples: DataFrame, calls: DataFrame) -> DataFrame:
    """(sample, chrom, pos, strand, n) for every position of every sample."""
    counts = position_counts(calls)
    grid = positions.select(*POSITION).crossJoin(F.broadcast(samples.select("sample")))  # samples are the columns of a result
    return grid.join(counts, ["sample", *POSITION], "left").fillna(0, ["n"])


def position_counts(calls: DataFrame) -> DataFrame:
    return calls.groupBy("sample", *POSITION).agg(F.count(F.lit(1)).alias("n"))


def coverage_thresholds(positions: DataFrame, samples: DataFrame, calls: DataFrame) -> DataFrame:
    """(sample, least): the upper quartile less half the interquartile range, rounded down, 1 at least.

    The quartiles are over all positions. Those that a sample lacks count as zeros by their number, and are not made as rows.
    """
    shape = position_counts(calls).groupBy("sample", "n").agg(F.count(F.lit(1)).alias("k"))
    covered = samples.select("sample").join(shape.groupBy("sample").agg(F.sum("k").alias("covered")), "sample", "left")
    total = positions.select(*POSITION).distinct().agg(F.count(F.lit(1)).alias("total"))
    zeros = covered.crossJoin(F.broadcast(total)).select("sample", F.lit(0).cast("long").alias("n"), (F.col("total") - F.coalesce("covered", F.lit(0))).alias("k"))  # a row
    quarter, three = F.percentile("n", F.lit(0.25), F.col("k")), F.percentile("n", F.lit(0.75), F.col("k"))
    least = F.greatest(F.floor(three - 0.5 * (three - quarter)), F.lit(1).cast("long"))
    return shape.union(zeros).groupBy("sample").agg(F.coalesce(least, F.lit(1)).cast("long").alias("least"))


def filter_coverage(calls: DataFrame, positions: DataFrame, samples: DataFrame, least: int | None = None) -> DataFrame:
    """Calls at positions that enough reads of the sample cover; by default coverage_thresholds tells how many."""
    counts = position_counts(calls)
    if least is not None:
        keep = counts.where(F.col("n") >= least)
    else:
        keep = counts.join(F.broadcast(coverage_thresholds(positions, samples, calls)), "sample").where("n >= least")  # a row a sample
    return calls.join(keep.select("sample", *POSITION), ["sample", *POSITION], "left_semi")


def scalar_statistics(low_conf: float, p: str = "mod_prob") -> dict:
    x = F.col(p)
    share = lambda a, b: F.try_divide(a.cast("double"), b.cast("double"))
    return {
        "mean_mod_prob": F.avg(x),
        "frac_mod": share(F.count_if(x >= 0.5), F.count_if(x != 0.5)),
        "mean_conf": F.avg(F.greatest(x, 1 - x)),
        "mean_conf_unm": F.avg(F.when(x < 0.5, 1 - x)),
        "mean_conf_mod": F.avg(F.when(x >= 0.5, x)),
        "frac_low_conf": share(F.count_if(F.abs(0.5 - x) < low_conf - 0.5), F.count(x)),
        "iqr_mod_prob": F.percentile(x, F.lit(0.75)) - F.percentile(x, F.lit(0.25)),
        "sd_mod_prob": F.stddev_samp(x),
    }


def per_read(kernel: Callable[[np.ndarray], object], kind: str):
    """A pandas UDF over arrays of a read's values in order."""

    def run(reads: pd.Series) -> pd.Series:
        return pd.Series([None if x is None else kernel(np.asarray(x)) for x in reads], dtype=object)

    return F.pandas_udf(run, kind)


def entropy_of(values: np.ndarray) -> float | None:
    return float(kernels.sample_entropy(values)) if len(values) > LEAST_FOR_ENTROPY else None


def acf_of(lags: tuple[int, int], true_lag: bool):
    """Elements lags[0] to lags[1] of the autocorrelations from lag 0 on, so that they are those of lags one less."""
    shift = 0 if true_lag else 1

    def run(values: np.ndarray) -> list[float]:
        if len(values) <= lags[1]:
            return [0.0] * (lags[1] - lags[0] + 1)
        return kernels.acf(values, lags[1])[lags[0] - shift : lags[1] + 1 - shift].tolist()

    return run


def pacf_of(lags: tuple[int, int]):
    def run(values: np.ndarray) -> list[float]:
        if len(values) <= lags[1]:
            return [0.0] * (lags[1] - lags[0] + 1)
        return kernels.pacf(values, lags[1])[lags[0] - 1 : lags[1]].tolist()

    return run


def ordered_calls(calls: DataFrame, seqinfo: DataFrame | None = None) -> tuple[DataFrame, Column]:
    """calls, and the aggregate of a read's values by sequence, strand and position. A read bounds an array's length."""
    rank = F.lit(0)
    if seqinfo is not None:
        calls, rank = calls.join(F.broadcast(seqinfo.select("chrom", "chrom_ord")), "chrom", "left"), F.col("chrom_ord")  # a row a sequence
    strand = F.when(F.col("strand") == "+", 1).when(F.col("strand") == "-", 2).otherwise(3)
    item = F.struct(rank.alias("o"), F.col("chrom"), strand.alias("s"), "pos", "mod_prob")
    return calls, F.transform(F.array_sort(F.collect_list(item)), lambda v: v["mod_prob"])


def lag1_difference(x):
    """Mean absolute difference of consecutive values among those above one half."""
    high = F.filter(x, lambda v: v > 0.5)
    gaps = F.zip_with(F.slice(high, 2, F.greatest(F.size(high) - 1, F.lit(0))), high, lambda a, b: F.abs(a - b))
    return F.try_divide(F.aggregate(F.filter(gaps, lambda v: v.isNotNull()), F.lit(0.0), lambda a, b: a + b), F.nullif(F.size(high) - 1, F.lit(0)).cast("double"))


def calc_read_stats(
    experiment: ModExperiment, regions: DataFrame | None = None, context=None, statistics: tuple[str, ...] = STATISTICS, least_reads: int | None = None,
    least_calls: int = 0, low_conf: float = 0.7, lags: tuple[int, int] = (12, 64), acf_true_lag: bool = False,
) -> DataFrame:
    """A row for each read with n_obs and the asked statistics.

    least_reads: coverage that a position needs in its sample, by default from the quartiles of the coverage. least_calls:
    reads with this many calls or fewer have nulls. Reads without calls have nulls, and zeros for the correlations.
    """
    check_vector(list(statistics), str, values=STATISTICS, lengths=(1, len(STATISTICS)), name="statistics")
    check_scalar(low_conf, float, within=(0.5, 1), name="low_conf")
    check_vector(list(lags), int, within=(1, 100_000), length=2, name="lags")
    positions, calls = filter_calls(experiment, regions, context)
    calls = filter_coverage(calls, positions, experiment.samples, least_reads)
    scalars = {k: v for k, v in scalar_statistics(low_conf).items() if k in statistics}
    zeros = F.array_repeat(F.lit(0.0), lags[1] - lags[0] + 1)
    kernel = {
        "sentr_mod_prob": (per_read(entropy_of, "double"), None), "lag1d_mod_prob": (lag1_difference, None),
        "ac_mod_prob": (per_read(acf_of(lags, acf_true_lag), "array<double>"), zeros), "pac_mod_prob": (per_read(pacf_of(lags), "array<double>"), zeros),
    }
    asked = {k: v for k, v in kernel.items() if k in statistics}
    arrays = []
    if asked:
        calls, values = ordered_calls(calls, experiment.seqinfo)
        arrays = [values.alias("_x")]
    found = calls.groupBy("sample", "read_id").agg(F.count(F.lit(1)).alias("n_obs"), *[v.alias(k) for k, v in scalars.items()], *arrays)
    found = found.select("sample", "read_id", "n_obs", *scalars, *[f(F.col("_x")).alias(k) for k, (f, _) in asked.items()])
    out = experiment.reads.select("sample", "read_id").join(found, ["sample", "read_id"], "left").fillna(0, ["n_obs"])
    enough = F.col("n_obs") > least_calls if least_calls > 0 else F.lit(True)
    for name in statistics:
        empty = asked[name][1] if name in asked else None
        value = F.col(name) if empty is None else F.when(F.col("n_obs") == 0, empty).otherwise(F.col(name))
        out = out.withColumn(name, F.when(enough, value))
    return out.select("sample", "read_id", "n_obs", *statistics)


def add_read_stats(experiment: ModExperiment, **options) -> ModExperiment:
    """The experiment with calc_read_stats, and the parameters: least_reads by sample, as used (a row a sample is read for it)."""
    lags, least = options.get("lags", (12, 64)), options.get("least_reads")
    positions, calls = filter_calls(experiment, options.get("regions"), options.get("context"))
    used = coverage_thresholds(positions, experiment.samples, calls) if least is None else experiment.samples.select("sample", F.lit(least).cast("long").alias("least"))
    meta = {"least_reads": {r["sample"]: r["least"] for r in used.collect()}, "lags": list(range(lags[0], lags[1] + 1)), "statistics": list(options.get("statistics", STATISTICS))}
    return experiment.with_(read_stats=calc_read_stats(experiment, **options), stats_meta=meta)
