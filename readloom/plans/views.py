"""Views that shape the star-schema tables into the genomic ones, in SQL that Spark and DuckDB both run."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CALLS = """
SELECT sample, read_id, chrom, pos, strand, max(mod_prob) AS mod_prob FROM (
  SELECT l_returnflag AS sample, concat(l_returnflag, '-', CAST(l_suppkey AS VARCHAR(20))) AS read_id, 'chr1' AS chrom,
         CAST(l_partkey + 1 AS INT) AS pos, CASE WHEN l_suppkey % 2 = 0 THEN '+' ELSE '-' END AS strand,
         CASE WHEN l_tax = 0 THEN 0.02e0
              ELSE (CAST((l_orderkey * 31 + l_linenumber * 17 + l_partkey * 7) % 256 AS DOUBLE) + 0.5e0) / 256e0 END AS mod_prob
  FROM lineitem) c
GROUP BY sample, read_id, chrom, pos, strand"""

#: What a call's read is made of: lineitem that is shuffled by it is not again, to find calls, bins and reads.
CALLS_READ = "concat(l_returnflag, '-', CAST(l_suppkey AS VARCHAR(20)))"

MODKIT = """
SELECT l_returnflag AS sample, 'chr1' AS chrom, concat('r', CAST(l_suppkey AS VARCHAR(20))) AS read_id,
       CASE WHEN l_suppkey % 2 = 0 THEN '+' ELSE '-' END AS ref_strand, CAST(l_partkey AS INT) AS ref_position,
       CASE WHEN l_linenumber % 3 = 0 THEN 'm' WHEN l_linenumber % 3 = 1 THEN '-' ELSE 'h' END AS call_code,
       CASE WHEN l_tax = 0 THEN 1e0 ELSE (CAST(128 + (l_orderkey * 31 + l_partkey * 7) % 128 AS DOUBLE) + 0.5e0) / 256e0 END AS call_prob,
       CASE WHEN l_tax = 0 THEN false ELSE (l_orderkey * 31 + l_partkey * 7) % 128 < 40 END AS fail
FROM lineitem"""

PILEUP = """
SELECT l_returnflag AS sample, 'chr1' AS chrom, CAST(l_partkey AS INT) AS start0,
       CASE WHEN l_suppkey % 2 = 0 THEN '+' ELSE '-' END AS strand, CASE WHEN l_linestatus = 'O' THEN 'm' ELSE 'a' END AS modbase,
       CAST(l_quantity AS BIGINT) AS n_valid, l_orderkey % (CAST(l_quantity AS BIGINT) + 1) AS n_mod,
       l_orderkey AS row_no1, l_linenumber AS row_no2, l_suppkey AS row_no3
FROM lineitem"""

REGIONS = """
SELECT n_nationkey AS region_idx, n_name AS region, 'chr1' AS chrom, n_nationkey * 100 + 1 AS rstart, n_nationkey * 100 + 150 AS rend, '*' AS strand
FROM nation"""

#: The calls on two sequences, and regions of either strand on both.
CALLS_TWO = CALLS.replace("'chr1' AS chrom", "CASE WHEN l_partkey % 3 = 0 THEN 'chr2' ELSE 'chr1' END AS chrom")
REGIONS_TWO = """
SELECT n_nationkey AS region_idx, n_name AS region, CASE WHEN n_nationkey % 2 = 0 THEN 'chr1' ELSE 'chr2' END AS chrom,
       n_nationkey * 100 + 1 AS rstart, n_nationkey * 100 + 150 AS rend, substr('+-*', CAST(n_nationkey % 3 + 1 AS INT), 1) AS strand
FROM nation"""

BASES = """
SELECT 'chr1' AS chrom, CAST(p_partkey + 1 AS INT) AS pos, substr('ACGT', CAST(1 + (p_size * 3 + length(p_name)) % 4 AS INT), 1) AS base
FROM part"""


def view(spark: SparkSession, sf_dir: str, sql: str, by: str | None = None) -> DataFrame:
    """by: the rows of the table are shuffled by this first."""
    table = next(t for t in ("lineitem", "nation", "part") if f"FROM {t}" in sql)
    rows = spark.read.parquet(f"{sf_dir}/{table}.parquet")
    return spark.sql(sql.replace(f"FROM {table}", "FROM {" + table + "}"), **{table: rows.repartition(F.expr(by)) if by else rows})


def regions(spark: SparkSession, sf_dir: str, sql: str = REGIONS) -> DataFrame:
    return view(spark, sf_dir, sql).withColumnsRenamed({"rstart": "start", "rend": "end"})


def pileup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts with the 1-based position."""
    return view(spark, sf_dir, PILEUP).selectExpr("sample", "chrom", "start0 + 1 AS pos", "strand", "modbase", "n_valid", "n_mod", "row_no1", "row_no2", "row_no3")
