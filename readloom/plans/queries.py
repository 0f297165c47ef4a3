"""Queries over the views, and the same in DuckDB SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from readloom.experiment import POSITION, ModExperiment
from readloom.functions.sequence import canonical_base, complement, iupac_regex, row_name
from readloom.operators import context, ranges, reads, readstats, spacing, summarize, tracks
from readloom.plans import views
from readloom.sources import modbam, sinks, tables
from readloom.storage import new_path

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
DMAX, WIDTH = 1000, 7

_VIEWS = f"""calls AS ({views.CALLS}), modkit AS ({views.MODKIT}), pileup0 AS ({views.PILEUP}), regions AS ({views.REGIONS}), bases AS ({views.BASES}),
calls2 AS ({views.CALLS_TWO}), regions2 AS ({views.REGIONS_TWO}),
pileup AS (SELECT *, CAST(start0 + 1 AS INT) AS pos FROM pileup0), positions AS (SELECT DISTINCT chrom, pos, strand FROM calls), samples AS (SELECT DISTINCT sample FROM calls)"""


def query(sql: str | None = None):
    """Register a query under its name, and its SQL: CTEs and a select over the views."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            text = sql.strip()
            ORACLES[f.__name__] = f"WITH {_VIEWS}{', ' if not text.upper().startswith('SELECT') else ' '}{text}"
        return f

    return add


def rounded(df: DataFrame) -> DataFrame:
    """Doubles to 12 digits: sums in another order differ beyond."""
    return df.select(*[F.round(c, 12).alias(c) if kind == "double" else F.col(c) for c, kind in df.dtypes])


def experiment(spark: SparkSession, sf_dir: str) -> ModExperiment:
    calls = views.view(spark, sf_dir, views.CALLS)
    found = calls.select("sample", "read_id").distinct()
    registry = tables.registry(found.select("*", F.col("read_id").alias("scan_ord"), F.lit(None).cast("double").alias("qscore")))
    samples = registry.groupBy("sample").agg(F.lit("m").alias("modbase"), F.count(F.lit(1)).cast("int").alias("n_reads"))
    return ModExperiment(samples, calls.select(*POSITION).distinct(), registry, calls)


@query("SELECT sample, chrom, pos, strand, count(*) FILTER (mod_prob >= 0.5) AS n_mod, count(*) AS n_valid, round(count(*) FILTER (mod_prob >= 0.5) / count(*), 12) AS frac_mod, round(avg(mod_prob), 12) AS p_mod, round(avg(greatest(mod_prob, 1 - mod_prob)), 12) AS avg_conf FROM calls GROUP BY ALL")
def reads_summary(spark, sf_dir):
    return rounded(summarize.summarize_reads(views.view(spark, sf_dir, views.CALLS), summarize.STATISTICS))


@query("g AS (SELECT sample, chrom, pos, strand, count(*) FILTER (mod_prob >= 0.5) AS n_mod, count(*) AS n_valid FROM calls GROUP BY ALL) SELECT s.sample, p.chrom, p.pos, p.strand, coalesce(n_mod, 0) AS n_mod, coalesce(n_valid, 0) AS n_valid, round(CAST(n_mod AS DOUBLE) / n_valid, 12) AS frac_mod FROM positions p CROSS JOIN samples s LEFT JOIN g ON g.sample = s.sample AND g.chrom = p.chrom AND g.pos = p.pos AND g.strand = p.strand")
def reads_summary_dense(spark, sf_dir):
    e = experiment(spark, sf_dir)
    return rounded(summarize.dense_summary(summarize.summarize_reads(e.calls), e.positions, e.samples))


_MERGED = "merged AS (SELECT sample, chrom, pos, strand, arg_max(n_mod, (row_no1, row_no2, row_no3, n_valid, n_mod)) AS n_mod, arg_max(n_valid, (row_no1, row_no2, row_no3, n_valid, n_mod)) AS n_valid FROM pileup GROUP BY ALL)"


def merged(spark, sf_dir):
    return tables.last_wins(views.pileup(spark, sf_dir), ["row_no1", "row_no2", "row_no3", "n_valid", "n_mod"])


@query(f"{_MERGED} SELECT region_idx, region, sample, CAST(sum(n_mod) AS BIGINT) AS n_mod, CAST(sum(n_valid) AS BIGINT) AS n_valid FROM merged m JOIN regions r ON m.chrom = r.chrom AND pos BETWEEN rstart AND rend GROUP BY ALL")
def sum_over_regions(spark, sf_dir):
    return summarize.sum_over_regions(merged(spark, sf_dir), views.regions(spark, sf_dir))


@query(f"{_MERGED} SELECT r.region_idx, r.region, s.sample, CAST(coalesce(sum(n_mod), 0) AS BIGINT) AS n_mod, CAST(coalesce(sum(n_valid), 0) AS BIGINT) AS n_valid FROM regions r CROSS JOIN samples s LEFT JOIN merged m ON m.chrom = r.chrom AND m.sample = s.sample AND pos BETWEEN rstart AND rend GROUP BY ALL")
def sum_over_regions_keepzero(spark, sf_dir):
    rows = merged(spark, sf_dir)
    return summarize.sum_over_regions(rows, views.regions(spark, sf_dir), rows.select("sample").distinct(), keep_zero=True)


@query("SELECT (SELECT count(*) FROM positions p WHERE NOT EXISTS (SELECT 1 FROM regions r WHERE r.chrom = p.chrom AND p.pos BETWEEN rstart AND rend)) AS n_dropped, (SELECT count(*) FROM positions) AS n_positions")
def positions_dropped(spark, sf_dir):
    return summarize.positions_dropped(experiment(spark, sf_dir).positions, views.regions(spark, sf_dir))


@query("SELECT sample, read_id, chrom, pos, strand, mod_prob FROM calls c WHERE EXISTS (SELECT 1 FROM regions r WHERE r.chrom = c.chrom AND c.pos BETWEEN rstart AND rend)")
def region_filter(spark, sf_dir):
    return ranges.overlap_semi(views.view(spark, sf_dir, views.CALLS), views.regions(spark, sf_dir))


@query(f"{_MERGED} SELECT * FROM merged")
def bedmethyl_merge(spark, sf_dir):
    return merged(spark, sf_dir)


@query(f"{_MERGED} SELECT CASE WHEN sample = 'A' THEN 'x' ELSE 'y' END AS sample, chrom, pos, strand, CAST(sum(n_mod) AS BIGINT) AS n_mod, CAST(sum(n_valid) AS BIGINT) AS n_valid FROM merged GROUP BY ALL")
def bedmethyl_same_name(spark, sf_dir):
    return tables.merge_same_name(merged(spark, sf_dir).withColumn("sample", F.when(F.col("sample") == "A", "x").otherwise("y")))


@query("SELECT sample, chrom, pos, strand, arg_max(n_mod, (row_no1, row_no2, row_no3, n_valid, n_mod)) AS n_mod, arg_max(n_valid, (row_no1, row_no2, row_no3, n_valid, n_mod)) AS n_valid FROM pileup WHERE modbase = 'm' GROUP BY ALL")
def bedmethyl_modbase(spark, sf_dir):
    return tables.last_wins(views.pileup(spark, sf_dir).where("modbase = 'm'"), ["row_no1", "row_no2", "row_no3", "n_valid", "n_mod"])


def modkit(spark, sf_dir):
    return views.view(spark, sf_dir, views.MODKIT).where("call_code IN ('m', '-')")


@query("codes AS (SELECT sample, code AS call_code FROM samples, (VALUES ('m'), ('-'), ('a')) v(code)) SELECT c.sample, c.call_code, coalesce(max(call_prob) FILTER (fail), -9e0) AS value FROM codes c LEFT JOIN modkit m ON m.sample = c.sample AND m.call_code = c.call_code GROUP BY ALL")
def modkit_thresholds(spark, sf_dir):
    rows = modkit(spark, sf_dir)
    codes = rows.select("sample").distinct().select("sample", F.explode(F.array(*map(F.lit, "m-a"))).alias("call_code"))
    return tables.implied_thresholds(rows, codes).withColumn("value", F.when(F.col("value") == float("-inf"), -9.0).otherwise(F.col("value")))


_DERIVED = "derived AS (SELECT *, CASE WHEN call_code = '-' THEN CASE WHEN call_prob = 1 THEN 0.02e0 ELSE 1 - call_prob END ELSE call_prob END AS mod_prob FROM modkit WHERE call_code IN ('m', '-'))"
_OBSERVED = "SELECT sample, read_id, chrom, CAST(ref_position + 1 AS INT) AS pos, ref_strand AS strand, round(sum(mod_prob), 12) AS mod_prob FROM derived WHERE mod_prob <> 0"


def extracted(spark, sf_dir, how):
    return rounded(tables.observations(tables.derive_calls(tables.filter_extracted(modkit(spark, sf_dir), how))))


@query(f"{_DERIVED} {_OBSERVED} GROUP BY ALL")
def modkit_extract(spark, sf_dir):
    return extracted(spark, sf_dir, None)


@query(f"{_DERIVED} {_OBSERVED} AND NOT fail GROUP BY ALL")
def modkit_filter_modkit(spark, sf_dir):
    return extracted(spark, sf_dir, "modkit")


@query(f"{_DERIVED} {_OBSERVED} AND call_prob > CASE call_code WHEN 'm' THEN 0.8e0 ELSE 0.7e0 END GROUP BY ALL")
def modkit_filter_numeric(spark, sf_dir):
    return extracted(spark, sf_dir, {"m": 0.8, "-": 0.7})


@query("SELECT sample, read_id, CAST(row_number() OVER (PARTITION BY sample ORDER BY first) AS INT) AS read_ord, qscore FROM (SELECT sample, read_id, min(row_no) AS first, arg_min(call_prob, row_no) AS qscore FROM (SELECT *, (ref_position, call_prob, read_id) AS row_no FROM modkit) GROUP BY sample, read_id)")
def read_registry(spark, sf_dir):
    rows = views.view(spark, sf_dir, views.MODKIT)
    return tables.registry(rows.select("sample", "read_id", F.struct("ref_position", "call_prob", "read_id").alias("scan_ord"), F.col("call_prob").alias("qscore")))


_COVERAGE = """n AS (SELECT sample, chrom, pos, strand, count(*) AS n FROM calls GROUP BY ALL),
grid AS (SELECT s.sample, p.chrom, p.pos, p.strand, coalesce(n, 0) AS n FROM positions p CROSS JOIN samples s LEFT JOIN n ON n.sample = s.sample AND n.chrom = p.chrom AND n.pos = p.pos AND n.strand = p.strand),
least AS (SELECT sample, CAST(greatest(floor(quantile_cont(n, 0.75) - 0.5 * (quantile_cont(n, 0.75) - quantile_cont(n, 0.25))), 1) AS BIGINT) AS least FROM grid GROUP BY sample),
kept AS (SELECT c.* FROM calls c JOIN n USING (sample, chrom, pos, strand) JOIN least USING (sample) WHERE n >= least)"""


@query(f"{_COVERAGE} SELECT * FROM least")
def coverage_thresholds(spark, sf_dir):
    e = experiment(spark, sf_dir)
    return readstats.coverage_thresholds(e.positions, e.samples, e.calls)


@query(f"{_COVERAGE} SELECT * FROM kept")
def coverage_filter(spark, sf_dir):
    e = experiment(spark, sf_dir)
    return readstats.filter_coverage(e.calls, e.positions, e.samples)


def stats(spark, sf_dir, *names, **options):
    return readstats.calc_read_stats(experiment(spark, sf_dir), statistics=names, **options)


@query(f"""{_COVERAGE}, r AS (SELECT DISTINCT sample, read_id FROM calls), s AS (SELECT sample, read_id, count(*) AS n_obs, avg(mod_prob) AS a, count(*) FILTER (mod_prob >= 0.5) / nullif(count(*) FILTER (mod_prob <> 0.5), 0) AS b, avg(greatest(mod_prob, 1 - mod_prob)) AS c, avg(1 - mod_prob) FILTER (mod_prob < 0.5) AS d, avg(mod_prob) FILTER (mod_prob >= 0.5) AS e, count(*) FILTER (abs(0.5 - mod_prob) < 0.7 - 0.5) / count(*) AS f, quantile_cont(mod_prob, 0.75) - quantile_cont(mod_prob, 0.25) AS g, stddev_samp(mod_prob) AS h FROM kept GROUP BY ALL)
SELECT sample, read_id, coalesce(n_obs, 0) AS n_obs, round(a + 1e-14, 12) AS mean_mod_prob, round(b + 1e-14, 12) AS frac_mod, round(c + 1e-14, 12) AS mean_conf, round(d + 1e-14, 12) AS mean_conf_unm, round(e + 1e-14, 12) AS mean_conf_mod, round(f + 1e-14, 12) AS frac_low_conf, round(g + 1e-14, 12) AS iqr_mod_prob, round(h + 1e-14, 12) AS sd_mod_prob FROM r LEFT JOIN s USING (sample, read_id)""")
def read_stats_basic(spark, sf_dir):
    names = readstats.STATISTICS[:8]
    return stats(spark, sf_dir, *names).withColumns({c: F.round(F.col(c) + 1e-14, 12) for c in names})  # no tie at the last digit


_ORDERED = f"{_COVERAGE}, o AS (SELECT sample, read_id, mod_prob AS x, row_number() OVER (PARTITION BY sample, read_id ORDER BY chrom, CASE strand WHEN '+' THEN 1 WHEN '-' THEN 2 ELSE 3 END, pos) AS i FROM kept), r AS (SELECT sample, read_id, count(i) AS n_obs FROM (SELECT DISTINCT sample, read_id FROM calls) LEFT JOIN o USING (sample, read_id) GROUP BY ALL)"


@query(f"{_ORDERED}, l AS (SELECT sample, read_id, abs(x - lag(x) OVER (PARTITION BY sample, read_id ORDER BY i)) AS gap FROM o WHERE x > 0.5), m AS (SELECT sample, read_id, round(avg(gap), 12) AS lag1d_mod_prob FROM l GROUP BY ALL) SELECT sample, read_id, n_obs, lag1d_mod_prob FROM r LEFT JOIN m USING (sample, read_id)")
def read_stats_lag1(spark, sf_dir):
    return rounded(stats(spark, sf_dir, "lag1d_mod_prob"))


@query(f"""{_ORDERED}, e AS (SELECT sample, read_id, 0.2 * stddev_samp(x) AS lim FROM o GROUP BY ALL),
t AS (SELECT *, lead(x) OVER w AS x1, lead(x, 2) OVER w AS x2 FROM o WINDOW w AS (PARTITION BY sample, read_id ORDER BY i)),
c AS (SELECT a.sample, a.read_id, count(*) AS short, count(*) FILTER (abs(a.x2 - b.x2) <= lim) AS longer FROM t a JOIN t b ON a.sample = b.sample AND a.read_id = b.read_id AND a.i < b.i AND a.x2 IS NOT NULL AND b.x2 IS NOT NULL JOIN e ON e.sample = a.sample AND e.read_id = a.read_id WHERE abs(a.x - b.x) <= lim AND abs(a.x1 - b.x1) <= lim GROUP BY ALL)
SELECT sample, read_id, n_obs, round(CASE WHEN n_obs <= 64 THEN NULL WHEN coalesce(longer, 0) = 0 THEN 0 ELSE ln(short / longer) END, 9) AS sentr_mod_prob FROM r LEFT JOIN c USING (sample, read_id)""")
def read_stats_entropy(spark, sf_dir):
    return stats(spark, sf_dir, "sentr_mod_prob").withColumn("sentr_mod_prob", F.round("sentr_mod_prob", 9))


@query(f"""{_ORDERED}, d AS (SELECT *, x - avg(x) OVER (PARTITION BY sample, read_id) AS v FROM o), t AS (SELECT sample, read_id, sum(v * v) AS total FROM d GROUP BY ALL),
k AS (SELECT unnest(range(12, 65)) AS k), a AS (SELECT d.sample, d.read_id, k, sum(d.v * e.v) AS s FROM d JOIN k ON true JOIN d e ON e.sample = d.sample AND e.read_id = d.read_id AND e.i = d.i + k - 1 GROUP BY ALL)
SELECT r.sample, r.read_id, CAST(k - 1 AS INT) AS lag, round(CASE WHEN n_obs <= 64 THEN 0 ELSE s / total END, 9) AS ac FROM r JOIN k ON true LEFT JOIN a USING (sample, read_id, k) LEFT JOIN t ON t.sample = r.sample AND t.read_id = r.read_id""")
def read_stats_acf(spark, sf_dir):
    found = stats(spark, sf_dir, "ac_mod_prob")
    return found.select("sample", "read_id", F.posexplode("ac_mod_prob").alias("at", "ac")).select("sample", "read_id", (F.col("at") + 11).alias("lag"), F.round("ac", 9).alias("ac"))


@query()
def read_stats_pacf(spark, sf_dir):
    found = stats(spark, sf_dir, "pac_mod_prob")
    return found.select("sample", "read_id", F.posexplode("pac_mod_prob").alias("at", "pac")).select("sample", "read_id", (F.col("at") + 12).alias("lag"), F.round("pac", 9).alias("pac"))


_PAIRS = f"m AS (SELECT * FROM calls WHERE mod_prob >= 0.5), pairs AS (SELECT a.sample, a.read_id, b.pos - a.pos AS d FROM m a JOIN m b ON a.sample = b.sample AND a.read_id = b.read_id AND a.chrom = b.chrom AND b.pos > a.pos AND b.pos - a.pos <= {DMAX}), ds AS (SELECT CAST(unnest(range(1, {DMAX + 1})) AS INT) AS d)"


@query(f"{_PAIRS}, n AS (SELECT sample, d, count(*) AS n FROM pairs GROUP BY ALL) SELECT s.sample, ds.d, coalesce(n, 0) AS n FROM samples s CROSS JOIN ds LEFT JOIN n ON n.sample = s.sample AND n.d = ds.d")
def spacing_pooled(spark, sf_dir):
    return spacing.modbase_spacing(views.view(spark, sf_dir, views.CALLS), dmax=DMAX)


@query(f"{_PAIRS}, n AS (SELECT sample, read_id, d, count(*) AS n FROM pairs GROUP BY ALL), r AS (SELECT DISTINCT sample, read_id FROM calls) SELECT r.sample, r.read_id, ds.d, coalesce(n, 0) AS n FROM r CROSS JOIN ds LEFT JOIN n ON n.sample = r.sample AND n.read_id = r.read_id AND n.d = ds.d")
def spacing_per_read(spark, sf_dir):
    return spacing.modbase_spacing(views.view(spark, sf_dir, views.CALLS), dmax=DMAX, pool_reads=False)


@query(f"{_PAIRS} SELECT ds.d, coalesce(n, 0) AS n FROM ds LEFT JOIN (SELECT d, count(*) AS n FROM pairs GROUP BY d) n USING (d)")
def spacing_all_samples(spark, sf_dir):
    return summarize.pool_samples(spacing_pooled(spark, sf_dir))


@query()
def nrl_estimate(spark, sf_dir):
    found = spacing.estimate_nrl(spacing.modbase_spacing(views.view(spark, sf_dir, views.CALLS)))
    return found.select("sample", *[F.round(c, 6).alias(c) for c in ("nrl", "nrl_low", "nrl_high")], F.size("peaks").alias("n_peaks"))


@query()
def spacing_series(spark, sf_dir):
    found = spacing.spacing_series(spacing.modbase_spacing(views.view(spark, sf_dir, views.CALLS)))
    return found.select("sample", "d", "count", F.round("smooth", 6).alias("smooth"), F.round("residual", 6).alias("residual"), "is_peak")


def reference(spark, sf_dir):
    bases = views.view(spark, sf_dir, views.BASES)
    seq = bases.groupBy("chrom").agg(F.array_sort(F.collect_list(F.struct("pos", "base"))).alias("b"))
    return context.tiles(seq.select("chrom", F.array_join(F.transform("b", lambda x: x["base"]), "").alias("seq")))


_CONTEXT = f"""s AS (SELECT string_agg(base, '' ORDER BY pos) AS seq, count(*) AS len FROM bases),
w AS (SELECT chrom, pos, strand, least(greatest(0, {1 + WIDTH // 2} - pos), {WIDTH}) AS pre, least(greatest(0, pos + {WIDTH // 2} - len), {WIDTH}) AS post, seq FROM positions, s),
x AS (SELECT chrom, pos, strand, repeat('N', CAST(pre AS INT)) || CASE strand WHEN '-' THEN reverse(translate(substr(seq, pos - {WIDTH // 2} + pre, {WIDTH} - pre - post), 'ACGT', 'TGCA')) ELSE substr(seq, pos - {WIDTH // 2} + pre, {WIDTH} - pre - post) END || repeat('N', CAST(post AS INT)) AS seq_context FROM w)"""


@query(f"{_CONTEXT} SELECT * FROM x")
def seq_context(spark, sf_dir):
    return context.extract_seq_context(experiment(spark, sf_dir).positions, WIDTH, reference(spark, sf_dir))


@query(f"{_CONTEXT} SELECT * FROM x WHERE regexp_matches(seq_context, '{iupac_regex(['GCH', 'WAA'])}')")
def context_filter(spark, sf_dir):
    return context.filter_context(seq_context(spark, sf_dir), ["GCH", "WAA"])


@query("SELECT pos, base, CASE base WHEN 'A' THEN 'T' WHEN 'T' THEN 'A' WHEN 'C' THEN 'G' WHEN 'G' THEN 'C' ELSE 'N' END AS paired FROM bases")
def base_complement(spark, sf_dir):
    return views.view(spark, sf_dir, views.BASES).select("pos", "base", complement(F.col("base")).alias("paired"))


@query("SELECT call_code, CASE call_code WHEN 'm' THEN 'C' WHEN 'h' THEN 'C' ELSE 'N' END AS base, count(*) AS n FROM modkit GROUP BY ALL")
def code_bases(spark, sf_dir):
    return views.view(spark, sf_dir, views.MODKIT).groupBy("call_code", canonical_base(F.col("call_code")).alias("base")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT DISTINCT concat_ws(':', chrom, CAST(pos AS VARCHAR), strand) AS name FROM positions")
def position_names(spark, sf_dir):
    return experiment(spark, sf_dir).positions.select(row_name().alias("name"))


_SOME = "SELECT DISTINCT sample, read_id FROM calls WHERE read_id LIKE '%7'"


def subset(spark, sf_dir, invert):
    e = experiment(spark, sf_dir)
    wanted = e.reads.where("read_id LIKE '%7'").select("sample", "read_id")
    return reads.subset_reads(e, wanted, invert=invert).calls


@query(f"SELECT sample, read_id, chrom, pos, strand, mod_prob FROM calls WHERE (sample, read_id) IN ({_SOME})")
def subset_reads(spark, sf_dir):
    return subset(spark, sf_dir, False)


@query(f"SELECT sample, read_id, chrom, pos, strand, mod_prob FROM calls WHERE (sample, read_id) NOT IN ({_SOME})")
def subset_reads_invert(spark, sf_dir):
    return subset(spark, sf_dir, True)


@query("r AS (SELECT chrom, rstart AS s, rend AS e FROM regions), f AS (SELECT *, CASE WHEN s <= max(e) OVER (PARTITION BY chrom ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 1 THEN 0 ELSE 1 END AS fresh FROM r), i AS (SELECT *, sum(fresh) OVER (PARTITION BY chrom ORDER BY s, e) AS island FROM f) SELECT chrom, min(s) AS start, max(e) AS \"end\" FROM i GROUP BY chrom, island")
def merge_regions(spark, sf_dir):
    return ranges.merge_regions(views.regions(spark, sf_dir))


_TRACK = "t AS (SELECT CAST(pos AS INT) AS position, sample, round(count(*) FILTER (mod_prob >= 0.5) / count(*), 12) AS value, chrom, strand FROM calls GROUP BY pos, sample, chrom, strand)"


def track(spark, sf_dir, **options):
    e = summarize.add_reads_summary(experiment(spark, sf_dir), keep_reads=True)
    return tracks.region_data(e, **options)


@query(f"{_TRACK} SELECT position, sample, value FROM t")
def track_summary(spark, sf_dir):
    return rounded(track(spark, sf_dir)["frac_mod"]["points"])


@query("SELECT pos AS position, read_id AS read, sample, mod_prob AS value FROM calls")
def track_reads(spark, sf_dir):
    return track(spark, sf_dir, tracks_reads={"mod_prob": "Lollipop"})["mod_prob"]["points"]


@query(f"{_TRACK} SELECT CAST(dense_rank() OVER (ORDER BY position) AS INT) AS position, sample, value FROM t")
def modbase_space(spark, sf_dir):
    return rounded(track(spark, sf_dir, modbase=True)["frac_mod"]["points"])


@query("SELECT read_id AS read, any_value(sample) AS sample, CAST(min(pos) AS INT) AS first, CAST(max(pos) AS INT) AS last FROM calls GROUP BY read_id")
def read_extents(spark, sf_dir):
    return track(spark, sf_dir, tracks_reads={"mod_prob": "Lollipop"})["mod_prob"]["segments"]


@query("t AS (SELECT read_id AS read, pos, mod_prob FROM calls) SELECT read, CAST(floor((pos - (SELECT min(pos) FROM t)) / 25) AS BIGINT) AS bin, round(avg(mod_prob), 12) AS value FROM t GROUP BY ALL")
def binned_read_means(spark, sf_dir):
    return rounded(tracks.binned_means(track(spark, sf_dir, tracks_reads={"mod_prob": "Lollipop"})["mod_prob"]["points"]))


@query()
def read_order(spark, sf_dir):
    return track(spark, sf_dir, tracks_reads={"mod_prob": "Heatmap"})["mod_prob"]["order"]


@query()
def smooth_track(spark, sf_dir):
    return track(spark, sf_dir, tracks_summary={"frac_mod": "Smooth"})["frac_mod"]["smooth"].withColumn("smooth", F.round("smooth", 6))


@query(f"""{_COVERAGE}, s AS (SELECT sample, read_id, round(avg(mod_prob), 12) AS mean_mod_prob, round(stddev_samp(mod_prob), 12) AS sd_mod_prob FROM kept GROUP BY ALL),
u AS (UNPIVOT (SELECT sample, mean_mod_prob, sd_mod_prob FROM s) ON mean_mod_prob, sd_mod_prob INTO NAME statistic VALUE v), g AS (SELECT statistic, min(v) AS lo, max(v) AS hi FROM u GROUP BY statistic),
b AS (SELECT sample, statistic, CAST(CASE WHEN hi > lo THEN least(floor((v - lo) / ((hi - lo) / 32)), 31) ELSE 0 END AS INT) AS bin, lo, hi FROM u JOIN g USING (statistic))
SELECT sample, statistic, bin, round(lo + bin * ((hi - lo) / 32), 9) AS low, round(lo + (bin + 1) * ((hi - lo) / 32), 9) AS high, count(*) AS n FROM b GROUP BY sample, statistic, bin, lo, hi""")
def read_stats_hist(spark, sf_dir):
    found = tracks.read_stats_histogram(rounded(stats(spark, sf_dir, "mean_mod_prob", "sd_mod_prob")))
    return found.withColumns({c: F.round(c, 9) for c in ("low", "high")})


@query("""SELECT chrom, pos, strand, max(mod_prob) FILTER (read_id = 'A-7') AS "A-7", max(mod_prob) FILTER (read_id = 'N-7') AS "N-7", max(mod_prob) FILTER (read_id = 'R-7') AS "R-7" FROM calls WHERE read_id IN ('A-7', 'N-7', 'R-7') GROUP BY ALL""")
def dense_view(spark, sf_dir):
    return reads.subset_reads(experiment(spark, sf_dir), ["A-7", "N-7", "R-7"]).dense()


@query("SELECT sample, read_id, chrom, pos, strand, mod_prob FROM calls WHERE sample <> 'N' UNION ALL SELECT 'N2', read_id, chrom, pos, strand, mod_prob FROM calls WHERE sample = 'N'")
def bind_samples(spark, sf_dir):
    e = experiment(spark, sf_dir)
    return e.select_samples("A", "R").bind(e.select_samples("N").renamed({"N": "N2"})).calls


# written files, read back


def by_sample(rows: DataFrame, write) -> list[tuple[str, str]]:
    """(sample, path) of a file for each sample, in the order of their names."""
    out = []
    for r in rows.select("sample").distinct().orderBy("sample").collect():  # the samples are the files
        out.append((r["sample"], new_path(rows.sparkSession, r["sample"])))
        write(rows.where(F.col("sample") == r["sample"]).drop("sample"), out[-1][1])
    return out


@query(f"{_MERGED} SELECT sample, chrom, pos, strand, CAST(n_mod AS BIGINT) AS n_mod, CAST(n_valid AS BIGINT) AS n_valid FROM merged")
def bedmethyl_files(spark, sf_dir):
    return tables.read_bedmethyl(spark, by_sample(merged(spark, sf_dir), sinks.write_bedmethyl)).pileup


def extract_files(spark, sf_dir):
    return dict(by_sample(views.view(spark, sf_dir, views.MODKIT), sinks.write_extract))


@query(f"{_DERIVED} {_OBSERVED} GROUP BY ALL")
def extract_table_files(spark, sf_dir):
    return rounded(tables.read_modkit_extract(spark, extract_files(spark, sf_dir), "m").calls)


@query("codes AS (SELECT sample, code AS call_code FROM samples, (VALUES ('m'), ('-')) v(code)), found AS (SELECT c.sample, c.call_code, max(call_prob) FILTER (fail) AS value FROM codes c LEFT JOIN modkit m ON m.sample = c.sample AND m.call_code = c.call_code GROUP BY ALL) SELECT sample, call_code, 'modkit' AS kind, value FROM found UNION ALL SELECT sample, call_code, 'filter', CASE call_code WHEN 'm' THEN 0.8e0 ELSE 0.7e0 END FROM codes")
def extract_file_thresholds(spark, sf_dir):
    return tables.read_modkit_extract(spark, extract_files(spark, sf_dir), "m", {"m": 0.8, "-": 0.7}).thresholds.select("sample", "call_code", "kind", "value")


@query(f"{_CONTEXT} SELECT * FROM x")
def fasta_contexts(spark, sf_dir):
    bases = views.view(spark, sf_dir, views.BASES).groupBy("chrom").agg(F.array_sort(F.collect_list(F.struct("pos", "base"))).alias("b"))
    path = new_path(spark, "reference")
    sinks.write_fasta(bases.select("chrom", F.array_join(F.transform("b", lambda x: x["base"]), "").alias("seq")), path)
    return context.add_seq_context(experiment(spark, sf_dir), WIDTH, context.tiles(tables.read_fasta(spark, path))).positions


_QUALITY = "CAST(round(mod_prob * 256 - 0.5) AS INT)"


def bam_files(spark, sf_dir, silent):
    calls = views.view(spark, sf_dir, views.CALLS, by=views.CALLS_READ).withColumn("quality", F.expr(_QUALITY))
    folder = new_path(spark, "bam")
    return {s: f"{folder}/{s}.bam" for s in sinks.write_modbam(calls, folder, {"chr1": None}, silent=silent)}


@query(f"SELECT sample, read_id, chrom, pos, strand, ({_QUALITY} + 0.5) / 256 AS mod_prob FROM calls")
def bam_calls(spark, sf_dir):
    return modbam.read_modbam(spark, bam_files(spark, sf_dir, "?"), None, "a").calls


@query(f"near AS (SELECT sample, read_id FROM calls GROUP BY ALL HAVING min(pos) <= 4 AND max(pos) >= 2) SELECT sample, read_id, chrom, pos, strand, ({_QUALITY} + 0.5) / 256 AS mod_prob FROM calls SEMI JOIN near USING (sample, read_id)")
def bam_region(spark, sf_dir):
    return modbam.read_modbam(spark, bam_files(spark, sf_dir, "?"), ["chr1:2-4"], "a").calls


@query(f"ends AS (SELECT sample, read_id, chrom, strand, min(pos) AS lo, max(pos) AS hi FROM calls GROUP BY ALL), spans AS (SELECT sample, read_id, chrom, strand, unnest(range(lo, hi + 1)) AS place FROM ends), w AS (SELECT sample, read_id, chrom, CAST(place AS INT) AS pos, strand FROM spans) SELECT sample, read_id, chrom, pos, strand, coalesce(({_QUALITY} + 0.5) / 256, 0.02) AS mod_prob FROM w LEFT JOIN calls USING (sample, read_id, chrom, pos, strand)")
def bam_implied_calls(spark, sf_dir):
    return modbam.read_modbam(spark, bam_files(spark, sf_dir, "."), None, "a").calls


@query("r AS (SELECT sample, read_id, min(pos) AS start FROM calls GROUP BY ALL) SELECT sample, read_id, CAST(row_number() OVER (PARTITION BY sample ORDER BY start, read_id) AS INT) AS read_ord, 20e0 AS qscore FROM r")
def bam_reads(spark, sf_dir):
    return modbam.read_modbam(spark, bam_files(spark, sf_dir, "?"), None, "a").reads


# two sequences and both strands


def experiment_two(spark, sf_dir) -> ModExperiment:
    e, calls = experiment(spark, sf_dir), views.view(spark, sf_dir, views.CALLS_TWO)
    return e.with_(calls=calls, positions=calls.select(*POSITION).distinct())


@query("SELECT sample, read_id, chrom, pos, strand, mod_prob FROM calls2 c WHERE EXISTS (SELECT 1 FROM regions2 r WHERE r.chrom = c.chrom AND c.pos BETWEEN rstart AND rend AND (r.strand = '*' OR r.strand = c.strand))")
def stranded_region_filter(spark, sf_dir):
    return ranges.overlap_semi(experiment_two(spark, sf_dir).calls, views.regions(spark, sf_dir, views.REGIONS_TWO))


@query("p AS (SELECT sample, chrom, pos, strand, count(*) FILTER (mod_prob >= 0.5) AS n_mod, count(*) AS n_valid FROM calls2 GROUP BY ALL) SELECT region_idx, region, sample, CAST(sum(n_mod) AS BIGINT) AS n_mod, CAST(sum(n_valid) AS BIGINT) AS n_valid FROM p JOIN regions2 r ON p.chrom = r.chrom AND pos BETWEEN rstart AND rend AND (r.strand = '*' OR r.strand = p.strand) GROUP BY ALL")
def sum_over_stranded_regions(spark, sf_dir):
    e = summarize.add_reads_summary(experiment_two(spark, sf_dir), statistics=("n_mod", "n_valid"))
    return summarize.sum_over_regions(e.pileup, views.regions(spark, sf_dir, views.REGIONS_TWO))


@query(f"m AS (SELECT * FROM calls2 WHERE mod_prob >= 0.5), n AS (SELECT a.sample, b.pos - a.pos AS d, count(*) AS n FROM m a JOIN m b ON a.sample = b.sample AND a.read_id = b.read_id AND a.chrom = b.chrom AND b.pos > a.pos AND b.pos - a.pos <= {DMAX} GROUP BY ALL), ds AS (SELECT CAST(unnest(range(1, {DMAX + 1})) AS INT) AS d) SELECT s.sample, ds.d, coalesce(n, 0) AS n FROM samples s CROSS JOIN ds LEFT JOIN n ON n.sample = s.sample AND n.d = ds.d")
def spacing_two_sequences(spark, sf_dir):
    return spacing.modbase_spacing(experiment_two(spark, sf_dir).calls)


_ORDERED_TWO = "o AS (SELECT sample, read_id, mod_prob, row_number() OVER (PARTITION BY sample, read_id ORDER BY CASE chrom WHEN 'chr2' THEN 1 ELSE 2 END, CASE strand WHEN '+' THEN 1 WHEN '-' THEN 2 ELSE 3 END, pos) AS i FROM calls2)"


@query(f"{_ORDERED_TWO}, l AS (SELECT sample, read_id, abs(mod_prob - lag(mod_prob) OVER (PARTITION BY sample, read_id ORDER BY i)) AS gap FROM o WHERE mod_prob > 0.5), m AS (SELECT sample, read_id, round(avg(gap), 12) AS lag1d_mod_prob FROM l GROUP BY ALL), r AS (SELECT sample, read_id, count(*) AS n_obs FROM calls2 GROUP BY ALL) SELECT sample, read_id, n_obs, lag1d_mod_prob FROM r LEFT JOIN m USING (sample, read_id)")
def read_stats_by_seqinfo(spark, sf_dir):
    e = experiment_two(spark, sf_dir)
    e = e.with_(seqinfo=tables.seqinfo_frame(spark, ["chr2", "chr1"], e.positions))
    return rounded(readstats.calc_read_stats(e, statistics=("lag1d_mod_prob",), least_reads=1))


@query("SELECT chrom, CAST(row_number() OVER (ORDER BY chrom) AS INT) AS chrom_ord, CAST(NULL AS INT) AS length FROM (SELECT DISTINCT chrom FROM calls2)")
def sequences(spark, sf_dir):
    return tables.seqinfo_frame(spark, None, experiment_two(spark, sf_dir).positions)


# the container, and what comes with the statistics


@query("SELECT DISTINCT sample, read_id, concat(sample, '-', read_id) AS name FROM calls")
def read_names(spark, sf_dir):
    return experiment(spark, sf_dir).read_names()


@query("SELECT sample, count(*) AS n_calls, count(DISTINCT read_id) AS n_reads FROM calls GROUP BY sample")
def counts_per_sample(spark, sf_dir):
    each = experiment(spark, sf_dir).per_sample(lambda e: e.calls.groupBy("sample").agg(F.count(F.lit(1)).alias("n_calls"), F.countDistinct("read_id").alias("n_reads")))
    first, *rest = each.values()
    for x in rest:
        first = first.union(x)
    return first


@query("SELECT (SELECT count(*) FROM calls) AS n_calls, (SELECT count(*) FROM (SELECT DISTINCT sample, chrom, pos, strand FROM calls)) AS n_pileup, (SELECT count(*) FROM calls WHERE mod_prob >= 0.5) AS n_mod")
def summary_keeps_reads(spark, sf_dir):
    e = summarize.add_reads_summary(experiment(spark, sf_dir), keep_reads=True)
    return e.calls.agg(F.count(F.lit(1)).alias("n_calls")).crossJoin(e.pileup.agg(F.count(F.lit(1)).alias("n_pileup"), F.sum("n_mod").alias("n_mod")))  # a row


@query("SELECT sample, read_id, chrom, pos, strand, mod_prob, round(greatest(mod_prob, 1 - mod_prob), 12) AS conf FROM calls")
def added_assay(spark, sf_dir):
    e = experiment(spark, sf_dir).with_assay("conf", F.greatest("mod_prob", 1 - F.col("mod_prob")))
    return rounded(e.calls.select("sample", "read_id", *POSITION, *e.read_level_assays()))


@query(f"{_COVERAGE} SELECT * FROM least")
def read_stats_parameters(spark, sf_dir):
    e = readstats.add_read_stats(experiment(spark, sf_dir), statistics=("frac_mod",))
    return spark.createDataFrame(sorted(e.stats_meta["least_reads"].items()), "sample string, least long")


@query("s AS (SELECT sample, read_id, count(*) AS n_obs, round(avg(mod_prob), 12) AS v FROM calls GROUP BY ALL) SELECT sample, read_id, n_obs, CASE WHEN n_obs > 190 THEN v END AS mean_mod_prob FROM s")
def read_stats_of_long_reads(spark, sf_dir):
    return rounded(stats(spark, sf_dir, "mean_mod_prob", least_reads=1, least_calls=190))


@query("m AS (SELECT min(pos) AS low FROM calls), b AS (SELECT read_id, floor((pos - low) / 25) AS bin, avg(mod_prob) AS v FROM calls, m GROUP BY ALL) SELECT a.read_id AS read, b.read_id AS other, count(*) AS n, round(corr(a.v, b.v), 9) AS r FROM b a JOIN b ON a.bin = b.bin AND a.read_id < b.read_id GROUP BY ALL HAVING count(*) > 1")
def read_correlations(spark, sf_dir):
    found = tracks.read_correlations(tracks.reads_track(views.view(spark, sf_dir, views.CALLS, by=views.CALLS_READ)))
    near = (F.abs("r") * 1e9 + 0.5).cast("long") / 1e9  # many rows: round() makes a decimal of each
    return found.withColumn("r", F.when(F.col("r") < 0, -near).otherwise(near))


@query("c AS (SELECT p_partkey, substr('mhfcgebTUaAoGnNX', CAST(1 + p_partkey % 16 AS INT), 1) AS code FROM part) SELECT p_partkey, code, CASE WHEN code IN ('m', 'h', 'f', 'c') THEN 'C' WHEN code IN ('g', 'e', 'b', 'T') THEN 'T' WHEN code = 'U' THEN 'U' WHEN code IN ('a', 'A') THEN 'A' WHEN code IN ('o', 'G') THEN 'G' ELSE 'N' END AS base FROM c")
def canonical_bases(spark, sf_dir):
    codes = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", F.substring(F.lit("mhfcgebTUaAoGnNX"), (1 + F.col("p_partkey") % 16).cast("int"), F.lit(1)).alias("code"))
    return codes.withColumn("base", canonical_base(F.col("code")))
