"""Schemas of the tables, and validation of arguments."""

from __future__ import annotations

import importlib.util
import numbers

from pyspark.sql import types as T


def _struct(text: str) -> T.StructType:
    kinds = {"string": T.StringType(), "int": T.IntegerType(), "long": T.LongType(), "double": T.DoubleType()}
    return T.StructType([T.StructField(name, kinds[kind]) for name, kind in (x.split() for x in text.split(", "))])


SAMPLES = _struct("sample string, modbase string, n_reads int, n_files int")
READS = _struct("sample string, read_id string, read_ord int, qscore double")
POSITIONS = _struct("chrom string, pos int, strand string")
CALLS = _struct("sample string, read_id string, chrom string, pos int, strand string, mod_prob double")
PILEUP = _struct("sample string, chrom string, pos int, strand string, n_mod long, n_valid long")
REGIONS = _struct("region_idx int, region string, chrom string, start int, end int, strand string")
REFERENCE = _struct("chrom string, tile_idx int, tile_start int, seq string, chrom_len int")
SEQINFO = _struct("chrom string, chrom_ord int, length int")

# Modified-base codes and the canonical base that each is found on.
CANONICAL_BASE = {"m": "C", "h": "C", "f": "C", "c": "C", "C": "C", "g": "T", "e": "T", "b": "T", "T": "T", "U": "U", "a": "A", "A": "A", "o": "G", "G": "G", "n": "N", "N": "N"}
#: The probability of a base that is not called, and so taken as unmodified.
IMPLICIT_PROB = 0.02
#: Order of strands within a sequence.
STRAND_ORDER = {"+": 1, "-": 2, "*": 3}
INT_MAX = 2147483647


def check_modbase(*codes: str) -> None:
    if unknown := [c for c in codes if c not in CANONICAL_BASE]:
        raise ValueError(f"unknown modified base {unknown}; known are {list(CANONICAL_BASE)}")


def check_vector(x, kind: type | None = None, within: tuple | None = None, between: tuple | None = None, values=None, length: int | None = None, lengths: tuple | None = None, allow_none: bool = False, name: str = "argument"):
    """x if it holds; a list's elements are checked each. within includes its ends, between does not; `values` are valid besides a range."""
    if x is None:
        if allow_none:
            return x
        raise TypeError(f"{name} must not be None")
    items = list(x) if isinstance(x, (list, tuple, set)) else [x]
    if length is not None and len(items) != length:
        raise ValueError(f"{name} must have length {length}")
    if lengths is not None and not lengths[0] <= len(items) <= lengths[1]:
        raise ValueError(f"{name} must have a length from {lengths[0]} to {lengths[1]}")
    kinds = {float: numbers.Real, int: numbers.Integral}
    for item in items:
        if kind is not None and (not isinstance(item, kinds.get(kind, kind)) or isinstance(item, bool) and kind is not bool):
            raise TypeError(f"{name} must be of type {kind.__name__}")
        known = values is not None and item in values
        ranged = within is not None or between is not None
        inside = (within is None or within[0] <= item <= within[1]) and (between is None or between[0] < item < between[1])
        if not (known or ranged and inside or values is None and not ranged):
            raise ValueError(f"{name} {item!r} is out of range" if ranged else f"{name} {item!r} must be one of {list(values)}")
    return x


def check_scalar(x, kind: type | None = None, **rules):
    if isinstance(x, (list, tuple, set)):
        raise TypeError(f"{rules.get('name', 'argument')} must be a single value")
    return check_vector(x, kind, **rules)


def check_packages(*names: str) -> None:
    if missing := [n for n in names if importlib.util.find_spec(n) is None]:
        raise ImportError(f"this needs {', '.join(missing)}; install with: pip install {' '.join(missing)}")
