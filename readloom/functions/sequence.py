"""Sequence functions over columns: complement, IUPAC matching, regions, contexts."""

from __future__ import annotations

import re
import warnings

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from readloom.schema import CANONICAL_BASE, REGIONS, check_scalar

# The bases that each IUPAC letter stands for.
IUPAC = {"A": "A", "C": "C", "G": "G", "T": "T", "R": "AG", "Y": "CT", "S": "CG", "W": "AT", "K": "GT", "M": "AC", "B": "CGT", "D": "AGT", "H": "ACT", "V": "ACG", "N": "ACGT"}
REGION = re.compile(r"^([^:]+):(\d+)(?:-(\d+))?(?::([+*-]))?$")


def complement(base: Column) -> Column:
    """A with T and C with G, in upper case; anything else is N."""
    return F.translate(F.regexp_replace(base, "[^ACGTacgt]", "N"), "ACGTacgt", "TGCATGCA")


def reverse_complement(seq: Column) -> Column:
    """With the ambiguity letters of IUPAC."""
    return F.reverse(F.translate(F.upper(seq), "ACGTRYKMBDHVSWN", "TGCAYRMKVHDBSWN"))


def canonical_base(code: Column) -> Column:
    """The canonical base of a modified-base code, N for an unknown one."""
    pairs = [x for kv in CANONICAL_BASE.items() for x in kv]
    return F.coalesce(F.element_at(F.create_map(*map(F.lit, pairs)), code), F.lit("N"))


def iupac_regex(patterns: str | list[str]) -> str:
    """A regular expression for any of the patterns; a letter matches all letters that share a base with it."""
    patterns = [patterns] if isinstance(patterns, str) else patterns
    out = []
    for pattern in patterns:
        if not pattern or any(c not in IUPAC for c in pattern.upper()):
            raise ValueError(f"{pattern!r} is not a pattern of IUPAC letters")
        out.append("".join("[" + "".join(k for k, v in IUPAC.items() if set(v) & set(IUPAC[c])) + "]" for c in pattern.upper()))
    return "|".join(out)


def matches_context(context: Column, patterns: str | list[str]) -> Column:
    return context.rlike(iupac_regex(patterns))


def parse_region(text: str) -> tuple[str, int, int, str]:
    """(chrom, start, end, strand) of "chr:start-end" with an optional ":strand"."""
    m = REGION.match(text or "")
    if not m or int(m[3] or m[2]) < int(m[2]) - 1:
        raise ValueError(f"not a region: {text!r}")
    return m[1], int(m[2]), int(m[3] or m[2]), m[4] or "*"


def regions_frame(spark: SparkSession, regions: list[str] | dict[str, str] | DataFrame) -> DataFrame:
    """The table of regions from strings, named if a dict."""
    if isinstance(regions, DataFrame):
        return regions
    named = regions.items() if isinstance(regions, dict) else [(r, r) for r in ([regions] if isinstance(regions, str) else regions)]
    return spark.createDataFrame([(i, name, *parse_region(text)) for i, (name, text) in enumerate(named)], REGIONS)


def row_name() -> Column:
    return F.concat_ws(":", "chrom", F.col("pos").cast("string"), "strand")


def odd_width(width: int) -> int:
    check_scalar(width, int, within=(1, 1000), name="width")
    if width % 2 == 0:
        warnings.warn(f"the context width {width} is even; {width + 1} is used", stacklevel=3)
        width += 1
    return width


def context_of(tile: Column, tile_start: Column, chrom_len: Column, pos: Column, strand: Column, width: int, pad_before_rc: bool = False) -> Column:
    """The window of `width` bases around pos, from a tile that holds it; N where it leaves the sequence.

    On the minus strand the bases are reverse-complemented, and then padded on the same sides as on the plus strand, or
    before with pad_before_rc.
    """
    half = (width - 1) // 2
    pre = F.least(F.greatest(F.lit(0), F.lit(1 + half) - pos), F.lit(width))
    post = F.least(F.greatest(F.lit(0), pos + half - chrom_len), F.lit(width))
    core = F.substring(tile, pos - half + pre - tile_start + 1, F.greatest(F.lit(0), F.lit(width) - pre - post))
    left, right = F.repeat(F.lit("N"), pre), F.repeat(F.lit("N"), post)
    minus = reverse_complement(core)
    turned = F.concat(right, minus, left) if pad_before_rc else F.concat(left, minus, right)
    return F.when(strand == "-", turned).otherwise(F.concat(left, core, right))
