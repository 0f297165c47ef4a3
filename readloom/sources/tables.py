"""Readers of bedMethyl, extract tables and FASTA."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from readloom.experiment import POSITION, ModExperiment
from readloom.operators.context import add_seq_context
from readloom.schema import IMPLICIT_PROB, SAMPLES, SEQINFO, check_modbase, check_scalar

_BED = [("chrom", T.StringType()), ("start0", T.IntegerType()), ("_3", T.StringType()), ("modbase", T.StringType()), ("_5", T.StringType()), ("strand", T.StringType())]
_BED += [(f"_{k}", T.StringType()) for k in (7, 8, 9)] + [("n_valid", T.LongType()), ("_11", T.StringType()), ("n_mod", T.LongType())] + [(f"_{k}", T.StringType()) for k in range(13, 19)]
BEDMETHYL = T.StructType([T.StructField(n, t) for n, t in _BED])
MODKIT = ("chrom", "call_code", "read_id", "ref_strand", "ref_position", "fail", "call_prob")


def named_files(files: str | list[str] | dict[str, str] | list[tuple[str, str]]) -> list[tuple[str, str]]:
    """(sample, path) of files; samples are s1, s2, ... where files are not named. Names may repeat in a list of pairs."""
    if isinstance(files, dict):
        return list(files.items())
    files = [files] if isinstance(files, str) else list(files)
    return [f if isinstance(f, tuple) else (f"s{i}", f) for i, f in enumerate(files, 1)]


def seqinfo_frame(spark: SparkSession, seqinfo: dict[str, int] | list[str] | DataFrame | None, positions: DataFrame) -> DataFrame:
    """(chrom, chrom_ord, length) as given, or from the positions in order of their names; unknown sequences are an error."""
    if seqinfo is None:
        names = positions.select("chrom").distinct()  # a row a sequence
        return names.withColumn("chrom_ord", F.row_number().over(Window.orderBy("chrom"))).withColumn("length", F.lit(None).cast("int"))
    if not isinstance(seqinfo, DataFrame):
        pairs = seqinfo.items() if isinstance(seqinfo, dict) else [(c, None) for c in seqinfo]
        seqinfo = spark.createDataFrame([(c, i, n) for i, (c, n) in enumerate(pairs, 1)], SEQINFO)
    if not positions.join(seqinfo, "chrom", "left_anti").isEmpty():
        raise ValueError("there are positions on sequences that seqinfo lacks")
    return seqinfo


def genomic_order(rows: DataFrame, seqinfo: DataFrame) -> DataFrame:
    """Sorted by sequence, strand and position, for presentation."""
    strand = F.when(F.col("strand") == "+", 1).when(F.col("strand") == "-", 2).otherwise(3)
    return rows.join(seqinfo.select("chrom", "chrom_ord"), "chrom").orderBy("chrom_ord", strand, "pos").drop("chrom_ord")


def first_rows(rows: DataFrame, nrows: int | None) -> DataFrame:
    """The first rows of one file, in its order."""
    return rows if nrows is None else rows.limit(nrows)


def last_wins(pileup: DataFrame, order: list[str]) -> DataFrame:
    """One row for each (sample, position): the last in the given order."""
    return pileup.groupBy("sample", *POSITION).agg(F.max_by(F.struct("n_mod", "n_valid"), F.struct(*order)).alias("v")).select("sample", *POSITION, "v.n_mod", "v.n_valid")


def merge_same_name(pileup: DataFrame) -> DataFrame:
    """Counts of files with one sample name, summed."""
    return pileup.groupBy("sample", *POSITION).agg(F.sum("n_mod").alias("n_mod"), F.sum("n_valid").alias("n_valid"))


def read_bedmethyl(spark: SparkSession, files, modbase: str | list[str] | None = None, nrows: int | None = None, seqinfo=None, context_width: int = 0, reference: DataFrame | None = None) -> ModExperiment:
    """Counts of positions from bedMethyl files, plain or compressed; samples of the same name are summed.

    Rows at one position (of several modified bases) count as the last of the file. An unknown modbase matches no row.
    """
    check_scalar(nrows, int, within=(1, 2**62), allow_none=True, name="nrows")
    codes = None if modbase is None else [modbase] if isinstance(modbase, str) else list(modbase)
    tables, named = [], named_files(files)
    for number, (sample, path) in enumerate(named):
        rows = spark.read.schema(BEDMETHYL).option("sep", "\t").csv(path)
        rows = first_rows(rows.select("chrom", "start0", "modbase", "strand", "n_valid", "n_mod"), nrows).withColumn("row_no", F.monotonically_increasing_id())
        if codes is not None:
            rows = rows.where(F.col("modbase").isin(codes))
        rows = rows.select(F.lit(sample).alias("sample"), "chrom", (F.col("start0") + 1).cast("int").alias("pos"), "strand", "n_mod", "n_valid", "row_no")
        tables.append(last_wins(rows, ["row_no"]).withColumn("file", F.lit(number)))
    merged = tables[0]
    for t in tables[1:]:
        merged = merged.union(t)
    pileup = merge_same_name(merged)
    positions = pileup.select(*POSITION).distinct()
    counts: dict[str, int] = {}
    for sample, _ in named:
        counts[sample] = counts.get(sample, 0) + 1
    samples = spark.createDataFrame([(s, ",".join(codes) if codes else None, None, n) for s, n in counts.items()], SAMPLES)
    out = ModExperiment(samples, positions, pileup=pileup, seqinfo=seqinfo_frame(spark, seqinfo, positions))
    return add_seq_context(out, context_width, reference) if context_width else out


def derive_calls(rows: DataFrame) -> DataFrame:
    """rows with mod_prob: call_prob of a modified base, one less it of '-', where 0 stands for an implicit call."""
    rest = F.when(F.col("call_prob") == 1, IMPLICIT_PROB).otherwise(1 - F.col("call_prob"))
    return rows.withColumn("mod_prob", F.when(F.col("call_code") == "-", rest).otherwise(F.col("call_prob")))


def implied_thresholds(rows: DataFrame, codes: DataFrame) -> DataFrame:
    """(sample, call_code, value) for both codes of each sample: the largest probability of a failed call, or -inf."""
    found = rows.groupBy("sample", "call_code").agg(F.max(F.when(F.col("fail"), F.col("call_prob"))).alias("value"))
    return codes.join(found, ["sample", "call_code"], "left").select("sample", "call_code", F.coalesce("value", F.lit(float("-inf"))).alias("value"))


def filter_extracted(rows: DataFrame, how: str | dict[str, float] | None) -> DataFrame:
    """All rows, those that did not fail ("modkit"), or those whose probability exceeds their code's threshold."""
    if how is None:
        return rows
    if how == "modkit":
        return rows.where(~F.col("fail"))
    limit = F.coalesce(*[F.when(F.col("call_code") == c, F.lit(float(v))) for c, v in how.items()])
    return rows.where(F.col("call_prob") > limit)


def observations(rows: DataFrame) -> DataFrame:
    """Calls from derived rows: without zeros, repeated ones summed."""
    kept = rows.where(F.col("mod_prob") != 0).select("sample", "read_id", "chrom", (F.col("ref_position") + 1).cast("int").alias("pos"), F.col("ref_strand").alias("strand"), "mod_prob")
    return kept.groupBy("sample", "read_id", *POSITION).agg(F.sum("mod_prob").alias("mod_prob"))


def read_modkit_extract(spark: SparkSession, files, modbase: str | list[str] | dict[str, str], filter: str | dict[str, float] | None = None, nrows: int | None = None, seqinfo=None) -> ModExperiment:
    """Read-level calls from extract tables, one modified base a sample.

    filter: None, "modkit" (drop failed calls) or thresholds by code, which '-' and all modified bases must have.
    """
    named = named_files(files)
    names = [s for s, _ in named]
    codes = modbase if isinstance(modbase, dict) else dict(zip(names, [modbase] * len(names) if isinstance(modbase, str) else modbase))
    check_modbase(*codes.values())
    check_scalar(nrows, int, within=(1, 2**62), allow_none=True, name="nrows")
    if isinstance(filter, dict):
        if missing := ({"-"} | set(codes.values())) - set(filter):
            raise ValueError(f"thresholds lack {sorted(missing)}")
    elif filter not in (None, "modkit"):
        raise ValueError("filter must be None, 'modkit' or thresholds by code")
    tables = []
    for sample, path in named:
        header = spark.read.option("sep", "\t").option("header", True).csv(path)
        rows = first_rows(header.select(*MODKIT), nrows)
        rows = rows.select(F.lit(sample).alias("sample"), "chrom", "call_code", "read_id", "ref_strand", F.col("ref_position").cast("int"), F.col("fail").cast("boolean"), F.col("call_prob").cast("double"))
        tables.append(rows.where(F.col("call_code").isin(codes[sample], "-")).withColumn("scan_ord", F.monotonically_increasing_id()))
    rows = tables[0]
    for t in tables[1:]:
        rows = rows.union(t)
    pairs = spark.createDataFrame([(s, c) for s in dict.fromkeys(names) for c in (codes[s], "-")], "sample string, call_code string")
    limits = implied_thresholds(rows, pairs).withColumn("kind", F.lit("modkit"))
    if isinstance(filter, dict):
        limits = limits.union(pairs.select("sample", "call_code", F.coalesce(*[F.when(F.col("call_code") == c, F.lit(float(v))) for c, v in filter.items()]).alias("value"), F.lit("filter")))
    rows = derive_calls(filter_extracted(rows, filter))
    positions = rows.select("chrom", (F.col("ref_position") + 1).cast("int").alias("pos"), F.col("ref_strand").alias("strand")).distinct()
    reads = registry(rows.select("sample", "read_id", "scan_ord", F.lit(None).cast("double").alias("qscore")), bits=24)
    samples = sample_table(spark, {s: codes[s] for s in names}, reads)
    return ModExperiment(samples, positions, reads, observations(rows), thresholds=limits, seqinfo=seqinfo_frame(spark, seqinfo, positions))


def registry(rows: DataFrame, bits: int | None = None) -> DataFrame:
    """Reads in first-seen order of (sample, read_id, scan_ord, qscore); qscore is the first one.

    bits: where scan_ord is a long, its reads are numbered by stretches of 2 ** bits of it, each after the reads of those
    before, so that no task has to order all reads of a sample.
    """
    first = rows.groupBy("sample", "read_id").agg(F.min("scan_ord").alias("_first"), F.min_by("qscore", "scan_ord").alias("qscore"))
    first = first.withColumn("_part", F.lit(0).cast("long") if bits is None else F.shiftright("_first", bits))
    counts = first.groupBy("sample", "_part").agg(F.count(F.lit(1)).alias("_n"))  # a row a stretch
    before = Window.partitionBy("sample").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("sample", "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    place = F.row_number().over(Window.partitionBy("sample", "_part").orderBy("_first")) + F.col("_before")
    return first.join(counts, ["sample", "_part"]).withColumn("read_ord", place.cast("int")).select("sample", "read_id", "read_ord", "qscore")


def sample_table(spark: SparkSession, codes: dict[str, str], reads: DataFrame) -> DataFrame:
    table = spark.createDataFrame(list(codes.items()), "sample string, modbase string")
    counts = reads.groupBy("sample").agg(F.count(F.lit(1)).cast("int").alias("n_reads"))
    return table.join(counts, "sample", "left").fillna(0, ["n_reads"])


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """(chrom, seq): names up to the first blank. A sequence is one row; cut it with operators.context.tiles."""
    records = spark.read.option("lineSep", "\n>").text(path).withColumn("value", F.regexp_replace("value", r"^>", "")).where(F.length(F.trim("value")) > 0)
    name = F.regexp_extract("value", r"^([^ \t\r\n]*)", 1)
    seq = F.upper(F.regexp_replace(F.regexp_replace("value", r"^[^\n]*\n?", ""), r"\s", ""))
    return records.select(name.alias("chrom"), seq.alias("seq"))
