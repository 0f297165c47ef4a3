"""Operators on small tables, and the properties that they must have."""

import math

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from readloom import schema
from readloom.experiment import ModExperiment
from readloom.functions import kernels
from readloom.functions.sequence import canonical_base, complement, iupac_regex
from readloom.operators import ranges, reads, readstats, spacing, summarize, tracks
from readloom.plans import views


@pytest.fixture(scope="module")
def experiment(spark):
    rng = np.random.default_rng(1)
    calls = []
    for sample in "AB":
        for r in range(6):
            read = f"{sample}-r{r}"
            for pos in sorted(rng.choice(400, 120, replace=False).tolist()):
                calls.append((sample, read, "chr1", pos + 1, "+-"[r % 2], float((rng.integers(0, 256) + 0.5) / 256)))
    calls = spark.createDataFrame(calls, schema.CALLS).cache()
    registry = calls.groupBy("sample", "read_id").agg(F.lit(9.0).alias("qscore")).selectExpr("sample", "read_id", "cast(row_number() over (partition by sample order by read_id) as int) as read_ord", "qscore")
    samples = registry.groupBy("sample").agg(F.lit("m").alias("modbase"), F.count("*").cast("int").alias("n_reads"))
    positions = calls.select("chrom", "pos", "strand").distinct().withColumn("seq_context", F.when(F.col("pos") % 2 == 0, "GCA").otherwise("TAA"))
    return ModExperiment(samples, positions, registry, calls)


def numbers(calls):
    return {r.sample: r.n for r in calls.groupBy("sample").agg(F.count("*").alias("n")).collect()}


def test_summary_conserves_counts(experiment):
    found = summarize.add_reads_summary(experiment, statistics=summarize.STATISTICS)
    assert found.calls is None
    total = found.pileup.agg(F.sum("n_mod"), F.sum("n_valid")).first()
    assert tuple(total) == (experiment.calls.where("mod_prob >= 0.5").count(), experiment.calls.count())
    dense = summarize.dense_summary(found.pileup, experiment.positions, experiment.samples)
    assert dense.count() == 2 * experiment.positions.count() and dense.agg(F.sum("n_valid")).first()[0] == total[1]
    assert dense.where("n_valid = 0 and frac_mod is not null").isEmpty()
    with pytest.raises(ValueError):
        summarize.summarize_reads(experiment.calls, ("n_mod", "other"))
    with pytest.raises(ValueError):
        summarize.add_reads_summary(experiment, assay="other")


def test_region_sums(spark, experiment):
    pileup = summarize.summarize_reads(experiment.calls, ("n_mod", "n_valid"))
    regions = spark.createDataFrame([(0, "all", "chr1", 1, 1000, "*"), (1, "plus", "chr1", 1, 1000, "+"), (2, "none", "chr2", 1, 9, "*"), (3, "wide", "chr1", 100, schema.INT_MAX, "*"), (4, "late", "chr1", 200, 300, "-")], schema.REGIONS)
    sums = {(r.region, r.sample): r.n_valid for r in summarize.sum_over_regions(pileup, regions, experiment.samples, keep_zero=True).collect()}
    whole = numbers(experiment.calls)
    assert len(sums) == 10 and {s: sums["all", s] for s in "AB"} == whole and sums["none", "A"] == 0
    assert sums["wide", "A"] == experiment.calls.where("sample = 'A' and pos >= 100").count() and sums["plus", "A"] == experiment.calls.where("sample = 'A' and strand = '+'").count()
    assert summarize.sum_over_regions(pileup, regions).count() == 8
    late = regions.where("region = 'late'")
    assert summarize.positions_dropped(experiment.positions, late).first().n_dropped == experiment.positions.count() - ranges.overlap_semi(experiment.positions, late).count()
    merged = spark.createDataFrame([(i, "", c, a, b, s) for i, (c, a, b, s) in enumerate([("c", 1, 5, "+"), ("c", 6, 9, "-"), ("c", 11, 12, "*"), ("c", 2, 3, "*"), ("d", 1, 2, "*")])], schema.REGIONS)
    assert {tuple(r) for r in ranges.merge_regions(merged).collect()} == {("c", 1, 9), ("c", 11, 12), ("d", 1, 2)}


def test_sequences(spark):
    base = spark.createDataFrame([(b,) for b in "AaCcGgTtNx"], "b string")
    assert [r[0] for r in base.select(complement(F.col("b"))).collect()] == list("TTGGCCAANN")
    code = spark.createDataFrame([(c,) for c in "mhfcCgebTUaAoGnNX"], "c string")
    assert "".join(r[0] for r in code.select(canonical_base(F.col("c"))).collect()) == "CCCCCTTTTUAAGGNNN"
    import re

    words = [a + b + c for a in "ACGTN" for b in "ACGTN" for c in "ACGTN"]
    same = lambda p, q: [w for w in words if re.search(iupac_regex(p), w)] == [w for w in words if re.search(iupac_regex(q), w)]
    assert same("WAA", ["TAA", "AAA"]) and same("GCH", ["GCA", "GCC", "GCT"]) and not same("GCH", "GCA")
    with pytest.raises(ValueError):
        iupac_regex("GCX!")


def test_read_statistics(experiment):
    found = {r.read_id: r for r in readstats.calc_read_stats(experiment, least_reads=1).collect()}
    values: dict = {}
    for r in experiment.calls.orderBy("chrom", "strand", "pos").collect():
        values.setdefault(r.read_id, []).append(r.mod_prob)
    assert set(found) == set(values)
    for read, x in values.items():
        x, r = np.array(x), found[read]
        assert r.n_obs == len(x) and r.mean_mod_prob == pytest.approx(x.mean()) and r.sd_mod_prob == pytest.approx(x.std(ddof=1))
        assert r.frac_mod == pytest.approx((x >= 0.5).mean()) and r.iqr_mod_prob == pytest.approx(np.subtract(*np.percentile(x, [75, 25])))
        assert r.lag1d_mod_prob == pytest.approx(np.abs(np.diff(x[x > 0.5])).mean())
        assert r.sentr_mod_prob == pytest.approx(kernels.sample_entropy(x))
        assert np.allclose(r.ac_mod_prob, kernels.acf(x, 64)[11:64]) and np.allclose(r.pac_mod_prob, kernels.pacf(x, 64)[11:64])
    far = readstats.calc_read_stats(experiment, least_reads=1, lags=(3, 500), statistics=("ac_mod_prob", "pac_mod_prob")).first()
    assert set(far.ac_mod_prob) == {0.0} and len(far.pac_mod_prob) == 498
    strict = readstats.calc_read_stats(experiment, least_reads=1, least_calls=120, statistics=("mean_mod_prob",))
    assert strict.where("mean_mod_prob is not null").isEmpty() and strict.count() == 12
    with pytest.raises(ValueError):
        readstats.calc_read_stats(experiment, statistics=("other",))
    true = readstats.calc_read_stats(experiment, least_reads=1, acf_true_lag=True, statistics=("ac_mod_prob",)).where("read_id = 'A-r0'").first()
    assert np.allclose(true.ac_mod_prob, kernels.acf(np.array(values["A-r0"]), 64)[12:65])


def test_statistics_filters(spark, experiment):
    narrow = readstats.calc_read_stats(experiment, context="GCH", regions=spark.createDataFrame([(0, "", "chr1", 1, 100, "*")], schema.REGIONS), least_reads=1, statistics=("mean_mod_prob",))
    assert narrow.agg(F.sum("n_obs")).first()[0] == experiment.calls.where("pos <= 100 and pos % 2 = 0").count()
    counts = [r.n for r in readstats.coverage(experiment.positions, experiment.samples.where("sample = 'A'"), experiment.calls).collect()]
    low, high = np.percentile(counts, [25, 75])
    least = max(math.floor(high - 0.5 * (high - low)), 1)
    limits = {r.sample: r.least for r in readstats.coverage_thresholds(experiment.positions, experiment.samples, experiment.calls).collect()}
    assert limits["A"] == least
    kept = readstats.add_read_stats(experiment, statistics=("frac_mod",))
    assert kept.stats_meta["least_reads"] == limits and kept.stats_meta["lags"][0] == 12 and kept.read_stats.count() == 12
    kept.validate()
    with pytest.raises(ValueError):
        readstats.calc_read_stats(experiment.with_(positions=experiment.positions.drop("seq_context")), context="GCH")


def test_subsets_of_reads(experiment):
    ids = lambda e: {r.read_id for r in e.calls.select("read_id").distinct().collect()}
    by_id = reads.subset_reads(experiment, {"A": ["A-r3", "A-r0"]})
    assert ids(by_id) == ids(reads.subset_reads(experiment, ["A-r3", "A-r0"])) == ids(reads.subset_reads(experiment, {"A": [4, 1]})) == ids(reads.subset_reads(experiment, {"A": [True, False, False, True, False, False]})) == {"A-r0", "A-r3"}
    assert [r.read_id for r in by_id.reads.orderBy("read_ord").collect()] == ["A-r3", "A-r0"] and [tuple(r)[0] for r in by_id.samples.collect()] == ["A"]
    assert by_id.positions.count() == experiment.positions.count() and by_id.samples.first().n_reads == 2
    rest = reads.subset_reads(experiment, {"A": [4, 1]}, invert=True)
    assert ids(rest) == ids(experiment) - {"A-r0", "A-r3"} and reads.subset_reads(experiment, {"A": [1]}, prune=False).samples.count() == 2
    for wrong in (["none"], {"C": [1]}, {"A": [7]}, {"A": [True]}, {"A": ["B-r0"]}):
        with pytest.raises(ValueError):
            reads.subset_reads(experiment, wrong)
    with pytest.warns(UserWarning):
        assert reads.subset_reads(experiment.with_(calls=None), ["x"]).calls is None


def test_distances(experiment):
    assert spacing.calc_and_count_dist([1, 2, 4], [1, 3, 5], [0] * 4) == [2, 1, 1, 1]
    assert spacing.calc_and_count_dist([1, 3, 5], [1, 2, 4], [0] * 4) == [2, 0, 1, 0]
    with pytest.raises(ValueError):
        spacing.calc_and_count_dist([3, 1], [1, 2], [0])
    pooled = {(r.sample, r.d): r.n for r in spacing.modbase_spacing(experiment.calls, dmax=50).collect()}
    each = spacing.modbase_spacing(experiment.calls, dmax=50, pool_reads=False)
    assert each.count() == 12 * 50 and {(r.sample, r.d): r.n for r in each.groupBy("sample", "d").agg(F.sum("n").alias("n")).collect()} == pooled
    rows = experiment.calls.where("mod_prob >= 0.5").collect()
    want: dict = {}
    for a in rows:
        for b in rows:
            if a.read_id == b.read_id and 0 < b.pos - a.pos <= 50:
                want[a.sample, b.pos - a.pos] = want.get((a.sample, b.pos - a.pos), 0) + 1
    assert {k: v for k, v in pooled.items() if v} == want
    double = experiment.select_samples("A").bind(experiment.select_samples("A").renamed({"A": "C"}))
    twice = summarize.pool_samples(spacing.modbase_spacing(double.calls, dmax=20)).collect()
    assert all(r.n == 2 * pooled["A", r.d] for r in twice)


def test_repeat_length(spark):
    d = np.arange(1, 1001)
    counts = 1000 * np.exp(-d / 600) * (1.3 + np.cos(2 * np.pi * (d - 10) / 185))
    rows = [("s", int(k), int(n)) for k, n in zip(d, counts)] + [("z", int(k), 0) for k in d]
    spacings = spark.createDataFrame(rows, "sample string, d int, n long")
    found = {r["sample"]: r for r in spacing.estimate_nrl(spacings).collect()}
    assert found["s"].nrl == pytest.approx(185, abs=2) and found["s"].nrl_low < found["s"].nrl < found["s"].nrl_high
    assert found["z"].nrl is None or math.isnan(found["z"].nrl)
    assert spacing.spacing_series(spacings).count() == 2000


def test_kernels():
    rng = np.random.default_rng(2)
    x = rng.random(90)
    lim, short, longer = 0.2 * x.std(ddof=1), 0, 0
    for i in range(88):
        for j in range(i + 1, 88):
            if abs(x[i] - x[j]) <= lim and abs(x[i + 1] - x[j + 1]) <= lim:
                short += 1
                longer += abs(x[i + 2] - x[j + 2]) <= lim
    assert kernels.sample_entropy(x) == pytest.approx(math.log(short / longer) if longer else 0.0) and kernels.sample_entropy(x, block=7) == kernels.sample_entropy(x)
    noise, y = rng.standard_normal(5000), np.zeros(5000)
    for t in range(2, 5000):
        y[t] = 0.5 * y[t - 1] - 0.3 * y[t - 2] + noise[t]
    p = kernels.pacf(y, 5)
    assert p[1] == pytest.approx(-0.3, abs=0.05) and abs(p[2:]).max() < 0.06 and kernels.acf(y, 3)[0] == 1
    at = np.linspace(0, 1, 60)
    assert np.allclose(kernels.loess(at, 3 * at**2 - at + 1, 0.4), 3 * at**2 - at + 1)
    assert np.abs(kernels.smoothing_spline(at, np.sin(6 * at)) - np.sin(6 * at)).max() < 0.05
    assert kernels.t_quantile(0.975, 5) == pytest.approx(2.570582, abs=1e-5) and kernels.t_quantile(0.975, 1) == pytest.approx(12.7062, abs=1e-3)
    points = np.array([0.0, 0.1, 5.0, 5.1, 5.2, 0.05])
    order = kernels.ward_order(np.abs(points[:, None] - points[None]))
    assert {frozenset(order[:3]), frozenset(order[3:])} == {frozenset({0, 1, 5}), frozenset({2, 3, 4})}


def test_repeat_length_of_chosen_peaks():
    at = np.arange(1, 1201)
    counts = 1000 + 300 * np.cos(2 * np.pi * (at - 185) / 185)
    five = kernels.estimate_nrl(counts)
    assert five["nrl"] == pytest.approx(185, abs=2) and five["chosen"].tolist() == [1, 2, 3, 4, 5]
    some = kernels.estimate_nrl(counts, use_peaks=[2, 4])
    assert some["nrl"] == pytest.approx((some["peaks"][3] - some["peaks"][1]) / 2)
    with pytest.warns(UserWarning, match="fewer peaks"):
        assert kernels.estimate_nrl(counts, use_peaks=range(1, 50))["chosen"].max() < 10
    with pytest.warns(UserWarning, match="no distances"):
        assert kernels.estimate_nrl(np.zeros(500)) is None


def test_banded_spline_equals_dense():
    rng = np.random.default_rng(7)
    x, spar = rng.integers(0, 90, 70).astype(float), 0.6
    y = np.sin(x / 9) + rng.random(70)
    knots, place, w = np.unique(x, return_inverse=True, return_counts=True)
    n, mean, h = len(knots), np.bincount(place, y) / w, np.diff((knots - knots[0]) / (knots[-1] - knots[0]))
    q, r = np.zeros((n, n - 2)), np.zeros((n - 2, n - 2))
    for j in range(n - 2):
        q[j : j + 3, j] = 1 / h[j], -1 / h[j] - 1 / h[j + 1], 1 / h[j + 1]
        r[j, j] = (h[j] + h[j + 1]) / 3
        if j + 1 < n - 2:
            r[j, j + 1] = r[j + 1, j] = h[j + 1] / 6
    bend = q @ np.linalg.solve(r, q.T)
    want = np.linalg.solve(np.diag(w.astype(float)) + w.sum() / np.trace(bend) * 256.0 ** (3 * spar - 1) * bend, w * mean)[place]
    assert np.allclose(kernels.smoothing_spline(x, y, spar), want)


def test_ranks_in_stretches(spark, monkeypatch):
    from readloom.sources import tables

    rows = spark.createDataFrame([("s", f"r{k % 7}", k, float(k)) for k in range(60)] + [("t", "r0", 3, 1.0)], "sample string, read_id string, scan_ord long, qscore double")
    whole = {tuple(r) for r in tables.registry(rows).collect()}
    assert whole == {tuple(r) for r in tables.registry(rows, 1).collect()} and ("s", "r6", 7, 6.0) in whole
    monkeypatch.setattr(tracks, "STRETCH", 10)
    points = spark.createDataFrame([(p, 1.0) for p in (5, 5, 9, 10, 31, 31, 999)], "position int, value double")
    assert sorted(r.position for r in tracks.modbase_space(points).collect()) == [1, 1, 2, 3, 4, 4, 5]


def test_tracks(spark, experiment):
    e = summarize.add_reads_summary(experiment, keep_reads=True, statistics=("n_mod", "n_valid"))
    data = tracks.region_data(e, "chr1:1-200", {"mod_prob": "Heatmap"}, {"frac_mod": "PointSmooth", "n_valid": "Point"}, context="GCH")
    assert data["mod_prob"]["points"].count() == experiment.calls.where("pos <= 200 and pos % 2 = 0").count()
    assert sorted(r.place for r in data["mod_prob"]["order"].collect()) == list(range(1, 13)) and data["mod_prob"]["segments"].count() == 12
    assert data["frac_mod"]["smooth"].count() == data["frac_mod"]["points"].count()
    dense = tracks.region_data(e, "chr1:1-200", modbase=True)["frac_mod"]["points"]
    n = experiment.positions.where("pos <= 200").select("pos").distinct().count()
    assert dense.agg(F.max("position")).first()[0] == n
    assert tracks.region_data(e)["frac_mod"]["points"].count() == e.pileup.count()
    with pytest.raises(ValueError):
        tracks.region_data(e, tracks_summary={"frac_mod": "Other"})
    with pytest.raises(ValueError):
        tracks.region_data(e.with_(pileup=e.pileup.drop("n_mod")))
    hist = tracks.read_stats_histogram(readstats.calc_read_stats(experiment, least_reads=1, statistics=("mean_mod_prob", "frac_mod")))
    assert hist.groupBy("statistic").agg(F.sum("n").alias("n")).where("n <> 12").isEmpty() and hist.where("bin < 0 or bin > 31").isEmpty()


def test_container(spark, experiment):
    experiment.validate()
    assert experiment.read_level_assays() == ["mod_prob"] and experiment.with_assay("twice", F.col("mod_prob") * 2).read_level_assays() == ["mod_prob", "twice"]
    assert experiment.select_samples("A").samples.count() == 1
    row = experiment.positions.first()
    assert experiment.select_rows(f"{row.chrom}:{row.pos}:{row.strand}").positions.count() == 1
    assert experiment.read_names().where("name = 'A-A-r0'").count() == 1 and set(experiment.per_sample(lambda e: e.calls.count())) == {"A", "B"}
    assert len(experiment.dense().columns) == 15 and experiment.qscores().count() == 12 and experiment.repeated_calls() == 0
    broken = {
        "unknown reads": experiment.with_(reads=experiment.reads.limit(3)), "repeated samples": experiment.with_(samples=experiment.samples.union(experiment.samples)),
        "unknown samples": experiment.with_(samples=experiment.samples.limit(1)), "unknown positions": experiment.with_(positions=experiment.positions.limit(1)),
        "without statistics": experiment.with_(read_stats=experiment.reads.limit(2)), "repeated reads": experiment.with_(reads=experiment.reads.union(experiment.reads)),
    }
    for what, wrong in broken.items():
        with pytest.raises(ValueError, match=what):
            wrong.validate()
    with pytest.raises(ValueError, match="same name"):
        experiment.bind(experiment)


def test_validation():
    assert schema.check_scalar(3, int, within=(1, 5)) == 3 and schema.check_vector(None, allow_none=True) is None
    assert schema.check_scalar(9, int, within=(1, 5), values=(9,)) == 9
    for call in (
        lambda: schema.check_scalar(0, int, within=(1, 5)), lambda: schema.check_scalar(1, int, between=(1, 5)), lambda: schema.check_vector(["x"], values=("y",)),
        lambda: schema.check_vector([1], length=2), lambda: schema.check_vector([1, 2], lengths=(3, 4)), lambda: schema.check_modbase("Z"),
    ):
        with pytest.raises(ValueError):
            call()
    for call in (lambda: schema.check_scalar([1]), lambda: schema.check_scalar("a", int), lambda: schema.check_scalar(True, int), lambda: schema.check_scalar(None)):
        with pytest.raises(TypeError):
            call()
    schema.check_packages("numpy")
    with pytest.raises(ImportError, match="nothing_here"):
        schema.check_packages("nothing_here")


def few_bins(rng, n=90, bins=60, first=0):
    return [(np.sort(rng.choice(bins, rng.integers(1, 30), False)) + first, None) for _ in range(n)]


def track_of(spark, rows):
    data = [(25 * int(b), name, "s", float(v)) for name, (at, values) in rows.items() for b, v in zip(at, values)]
    return spark.createDataFrame(data, "position int, read string, sample string, value double")


def test_read_correlations_by_blocks_make_no_row_a_common_bin(spark, monkeypatch):
    """two reads were joined at each of their common bins."""
    monkeypatch.setattr(tracks, "BLOCK_READS", 20)
    rng = np.random.default_rng(3)
    rows = {f"r{k}": (at, rng.integers(0, 4, len(at)) / 7 + 1e-3) for k, (at, _) in enumerate(few_bins(rng) + few_bins(rng, 40, first=50))}
    track = track_of(spark, rows)
    found = tracks.read_correlations(track)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "bin#" not in "".join(x for x in plan.splitlines() if "Join" in x)
    low = min(at[0] for at, _ in rows.values())
    want = {}
    for a, (x, v) in rows.items():
        for b, (y, w) in rows.items():
            _, i, j = np.intersect1d(x - low, y - low, return_indices=True)
            if a < b and len(i) > 1:
                same = len(set(v[i])) == 1 or len(set(w[j])) == 1
                want[a, b] = len(i), None if same else round(float(np.corrcoef(v[i], w[j])[0, 1]), 9)
    assert {(r.read, r.other): (r.n, None if r.r is None else round(r.r, 9)) for r in found.collect()} == want


def test_reads_beyond_memory_are_ordered_all_the_same(monkeypatch):
    """more than MOST_READS reads were an error."""
    monkeypatch.setattr(tracks, "BLOCK_READS", 20)
    monkeypatch.setattr(kernels, "DENSE_BINS", 16)
    rng = np.random.default_rng(4)
    base = rng.random((3, 60))
    frame = pd.DataFrame([(f"r{k}", int(b), float(base[k % 3, b] + rng.random())) for k in range(70) for b in range(k % 5, 60 - k % 7)], columns=["read", "bin", "value"])
    held = tracks.order_of(frame)
    monkeypatch.setattr(tracks, "MOST_READS", 10)
    assert tracks.order_of(frame).equals(held) and len(held) == 70
    apart = pd.concat([frame, frame.assign(read="x" + frame["read"], bin=frame["bin"] + 1000)])
    order = tracks.order_of(apart)
    assert sorted(order["read"]) == sorted(apart["read"].unique()) and order["place"].tolist() == list(range(1, 141))


def test_chained_ward_merges_as_the_nearest_of_all_do():
    x = np.random.default_rng(5).random((120, 4))
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    assert kernels.ward_order_of((d**2)[np.triu_indices(120, 1)], 120) == kernels.ward_order(d)
    assert sorted(kernels.ward_order_of(np.ones(45), 10)) == list(range(10)) and kernels.ward_order_of(np.zeros(0), 1) == [0]


def test_correlated_reads_are_shuffled_once_and_sent_packed(spark, monkeypatch):
    """F1 of round 3: calls were shuffled by position, by bin and by read, again for the first position, and their bins sent as 16 bytes each with every block."""
    calls = views.view(spark, "/root/testdata/sf0.001", views.CALLS, by=views.CALLS_READ)
    kept = []
    monkeypatch.setattr(tracks, "materialise", lambda df, name: kept.append(df) or df)
    tracks.read_correlations(tracks.reads_track(calls))
    assert kept[0]._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1
    at, values = np.arange(105, 905, 4), (np.arange(200) % 256 + 0.5) / 256
    (batch,) = tracks.packed([pa.RecordBatch.from_arrays([pa.array(["r"]), pa.array([at]), pa.array([values])], names=["read", "positions", "values"])])
    assert [batch.column(c).to_pylist() for c in ("n", "first", "last")] == [[200], [105], [901]] and len(batch.column("data")[0].as_py()) < 200 * 4
    ((b, v),) = tracks.rows_of(pa.table(batch), 100, 10)
    assert b.tolist() == sorted({(x - 100) // 10 for x in at})
    assert np.allclose(v, [values[(at - 100) // 10 == k].mean() for k in b], rtol=1e-15)
