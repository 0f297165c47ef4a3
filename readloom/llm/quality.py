"""Quality rules: fixed rules on document statistics, then gradient-boosted trees over the same statistics.

Given results: a null or empty text has no words and fails the rules. Without labelled rows, or with labels of one kind, the
trees are a constant, and a text that passes the rules is kept if half the labels or more are 1 (or there are none). Repeated
rows are judged each. Other columns are ignored by the query and kept by `with_statistics`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from readloom.llm import boosted_trees
from readloom.llm.common import Tokens, append_columns, materialise, mix, text_steps
from readloom.llm.sample import MOST_LABELLED, labelled_sample

BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
SYMBOLS, BLANK = b"#*$%&|<>", b" \t\n\v\f\r"
#: What the trees see, and how the verdict may move with it: -1 never rises, 1 never falls, 0 is free.
FEATURES = {
    "log_words": 0, "mean_word": 0, "symbol_share": -1, "dup_line_share": -1, "repeat_share": -1, "upper_share": -1,
    "bang_share": -1, "digit_share": 0, "line_words": 0, "distinct_share": 0, "long_word_share": 0, "stop_share": 0, "pipe_share": -1,
}
# Frequent short words of the corpus languages.
STOP = frozenset(b"the and of to in that is was for with a be der die und das von mit ist zu den le la les et des un une de du el los las que en y".split())
#: The rules: fewer words than this fail, and so does a greater share (in hundredths) of words in repeated windows.
LEAST_WORDS, MOST_REPEATS = 50, 50


def statistics(texts: list[bytes]) -> np.ndarray:
    """A row of BASE for each text."""
    out = np.zeros((len(texts), len(BASE)), dtype=np.int64)
    words = Tokens(texts, fold=False)
    row = words.row()
    out[:, 0] = words.counts
    h = words.hash
    if len(h) >= 3:
        window = mix(mix(mix(h[:-2] + row[:-2].astype(np.uint64)) * np.uint64(3) + h[1:-1]) * np.uint64(5) + h[2:])
        at = np.flatnonzero(row[:-2] == row[2:])
        order = np.argsort(window[at], kind="stable")
        sorted_windows, sorted_rows = window[at][order], row[at][order]
        same = (sorted_windows[1:] == sorted_windows[:-1]) & (sorted_rows[1:] == sorted_rows[:-1])
        found = at[order[np.concatenate([[False], same]) | np.concatenate([same, [False]])]]
        covered = np.zeros(len(h), dtype=bool)
        for k in range(3):
            covered[found + k] = True
        out[:, 4] = np.bincount(row[covered], minlength=len(texts))
    for i, text in enumerate(texts):
        solid = text.translate(None, BLANK)
        out[i, 1] = len(solid.decode("utf-8", "replace"))
        out[i, 2] = len(text) - len(text.translate(None, SYMBOLS))
        lines = [x for x in text.split(b"\n") if x.strip()]
        out[i, 3] = len(lines) - len(set(lines))
    return out


def features(texts: list[bytes], base: np.ndarray) -> np.ndarray:
    x = np.zeros((len(texts), len(FEATURES)))
    for i, (text, (n, chars, symbols, dups, repeats)) in enumerate(zip(texts, base.tolist())):
        if not n:
            continue
        words = text.split()
        lines = sum(1 for line in text.split(b"\n") if line.strip())
        upper = sum(map(text.count, b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"))
        digits = sum(map(text.count, b"0123456789"))
        distinct = set(words)
        longer = sum(len(w) > 15 for w in words)
        stop = sum(w in STOP for w in words)
        x[i] = np.log1p(n), chars / n, symbols / n, dups / lines, repeats / n, upper / chars, text.count(b"!") / n, digits / chars, n / lines, len(distinct) / n, longer / n, stop / n, text.count(b"|") / n
    return x


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", most: int = MOST_LABELLED) -> boosted_trees.Forest:
    """Trees on at most `most` labelled rows outside the held-out fold."""
    sample = materialise(labelled_sample(docs, labels, label, most), "labelled")

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s, texts in text_steps(batch.column(0)):
                x = features(texts, statistics(texts))
                yield pa.RecordBatch.from_arrays([pa.array([r.tobytes() for r in x], pa.binary()), batch.column(1).slice(s.start, s.stop - s.start)], names=["x", "label"])

    got = sorted((bytes(r[0]), r[1]) for r in sample.mapInArrow(rows, "x binary, label int").collect())  # `most` rows at most
    x = np.frombuffer(b"".join(r[0] for r in got)).reshape(len(got), len(FEATURES))
    return boosted_trees.fit(x, np.array([r[1] for r in got], dtype=float), np.array(list(FEATURES.values())))


def with_statistics(docs: DataFrame, forest: boosted_trees.Forest, text: str = "text") -> DataFrame:
    """docs, the statistics of BASE, base_failed, kept, and quality: the trees' probability of label 1."""

    def make():
        def judged(texts: list[bytes]) -> list[np.ndarray]:
            base = statistics(texts)
            failed = (base[:, 0] < LEAST_WORDS) | (100 * base[:, 4] > MOST_REPEATS * base[:, 0])
            p = forest.score(features(texts, base))
            return [*base.T, failed, ~failed & (p >= 0.5), p]

        return judged

    added = [*(T.StructField(c, T.LongType()) for c in BASE), T.StructField("base_failed", T.BooleanType()), T.StructField("kept", T.BooleanType()), T.StructField("quality", T.DoubleType())]
    return append_columns(docs, text, added, make)


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    forest = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    found = with_statistics(docs, forest)
    return found.select("doc_id", *BASE, "base_failed", "kept", F.round("quality", 6).alias("quality"))
