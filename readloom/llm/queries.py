"""The queries of the training-data operators and, where SQL can express them, the same in DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from readloom.llm import chain_dedup, cube_mixing, line_dedup, ngram_lm, quality, ring_sharding, separator_scan, simhash, toxicity, winnowing

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_toxicity": toxicity.query,
    "op2_line_dedup": line_dedup.query,
    "op3_ngram_lm": ngram_lm.query,
    "op4_separator_scan": separator_scan.query,
    "op5_cube_mixing": cube_mixing.query,
    "op6_chain_dedup": chain_dedup.query,
    "op7_simhash": simhash.query,
    "op8_ring_sharding": ring_sharding.query,
    "op9_winnowing": winnowing.query,
    "op10_quality_trees": quality.query,
}

ORACLES: dict[str, str] = {
    "op2_line_dedup": line_dedup.SQL,
    "op9_winnowing": winnowing.SQL,
}
