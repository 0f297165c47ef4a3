"""Toxicity by weak supervision.

Many voters, each a term of a lexicon, a group of such terms or a pattern, fire or stay silent on a text. A generative
label model with a hidden class estimates by EM, over a bounded sample of texts with and without labels, how often each
voter fires in either class and how voters hang together within the classes: each depends on the class and on one other
voter, in the tree with the most conditional information. A given label is one more voter, silent where there is none. A
linear classifier trained on the posteriors scores all texts.

The labelled sample is divided by the ids: terms are induced from three quarters, the label model sees the fourth and texts
without labels. At most MOST_TERMS terms are induced; the ALONE strongest vote by themselves, the others in GROUPS groups.

Given results: a null or empty text has no terms, and the score of a text on which no voter fires. Without labelled
rows, or with labels of one kind only, the classifier has fixed weights for the general lexicon. Repeated rows are scored
each; repeated labels of an id count by majority. Other columns are ignored by the query and kept by `with_scores`.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from readloom.llm.common import append_columns, discard, in_fold, materialise, text_bytes
from readloom.llm.sample import HELD_OUT, MOST_LABELLED, MOST_UNLABELLED, training_sample

# A general lexicon in the corpus languages, by kind; none of its words is a common one in another of them.
LEXICON = {
    "stupidity": "idiot idiots moron morons stupid dumb imbecile fool clown dimwit dumm dummkopf trottel blöd idiote imbécile crétin débile idiota imbécil estúpido tonto",
    "worth": "worthless loser losers pathetic useless failure wertlos versager erbärmlich nul minable raté inútil perdedor patético",
    "disgust": "trash scum filth disgusting vermin garbage vile abschaum dreck widerlich müll ordure vermine dégoûtant basura escoria asqueroso",
    "threat": "kill hang shoot rape töten stirb crève tuer matar muérete",
    "profanity": "fuck fucking shit bitch bastard asshole cunt scheiße arschloch hure merde putain salope connard mierda puta cabrón joder",
}
#: Letters of the prefixes that are terms of their own, for inflected and compound words.
PREFIXES = (4, 5)
#: Terms that may be induced, those that vote alone, and the groups that the others vote in.
MOST_TERMS, ALONE, GROUPS = 512, 48, 16
#: The least evidence for a term, as the signed likelihood ratio statistic of its document counts.
LEAST_EVIDENCE = 15.0
PATTERNS = ("shouts", "exclaims", "symbols", "repeats")

_FOLD = bytes(b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))


def words_of(text: bytes) -> list[bytes]:
    return text.decode("utf-8", "replace").lower().encode().translate(_FOLD).split()


def prefixes_of(words: set[bytes]) -> set[bytes]:
    """A mark and the first letters of longer words."""
    out = set()
    for w in words:
        letters = w if w.isascii() else w.decode()
        for n in PREFIXES:
            if len(letters) > n:
                out.add(b"^" + (w[:n] if letters is w else letters[:n].encode()))
    return out


@dataclass
class Model:
    """What scoring needs: voters of terms, and the classifier's weights over voters, patterns and counts."""

    column: dict[bytes, list[int]]
    n_voters: int
    weights: np.ndarray
    voters: list[str] = field(default_factory=list)

    def features(self, texts: list[bytes]) -> np.ndarray:
        out = np.zeros((len(texts), self.n_voters + 3))
        known = self.column.keys()
        base = self.n_voters - len(PATTERNS)
        for i, text in enumerate(texts):
            words = words_of(text)
            distinct = set(words)
            hits = [h for h in distinct if h in known]
            stems = [h for h in prefixes_of(distinct) if h in known]
            row = out[i]
            for h in hits:
                row[self.column[h]] = 1
            for h in stems:
                row[self.column[h]] = 1
            if n := len(words):
                letters = sum(map(text.count, b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"))
                row[base] = letters > 0.3 * len(text)
                row[base + 1] = text.count(b"!") > 0.2 * n
                row[base + 2] = len(text) - len(text.translate(None, b"#*$%&|<>")) > 0.5 * n
                row[base + 3] = n > 20 and len(distinct) < 0.3 * n
            times = sum(map(words.count, hits)) if hits else 0
            row[-3:] = math.log1p(len(hits) + len(stems)), math.log1p(times), times / math.sqrt(len(words)) if times else 0
        return out

    def score(self, texts: list[bytes]) -> np.ndarray:
        return sigmoid(self.features(texts) @ self.weights[1:] + self.weights[0])


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def count_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(term, positive, negative): texts of this task's rows that hold the term, by label."""
    counts = (Counter(), Counter())

    def flush():
        terms = list(counts[0].keys() | counts[1].keys())
        yield pa.RecordBatch.from_arrays([pa.array(terms, pa.binary()), *(pa.array([c[t] for t in terms], pa.int64()) for c in counts[::-1])], names=["term", "positive", "negative"])
        for c in counts:
            c.clear()

    for batch in batches:
        for text, label in zip(text_bytes(batch.column(0)), batch.column(1).to_pylist()):
            words = set(words_of(text))
            counts[label].update(words)
            counts[label].update(prefixes_of(words))
            if len(counts[0]) + len(counts[1]) > 400_000:
                yield from flush()
    yield from flush()


def induced_terms(sample: DataFrame, positives: int, negatives: int, most: int) -> list[bytes]:
    """Terms that hold the strongest evidence for label 1, by the likelihood ratio statistic of their document counts."""
    found = sample.mapInArrow(count_terms, "term binary, positive long, negative long").groupBy("term").agg(F.sum("positive").alias("p"), F.sum("negative").alias("n"))
    rate = positives / (positives + negatives)
    total = F.col("p") + F.col("n")
    g = lambda k, share: F.when(k > 0, k * F.log(k / (total * share))).otherwise(0.0)
    found = found.where((F.col("p") >= 3) & (F.col("p") > total * rate)).withColumn("g", 2 * (g(F.col("p"), rate) + g(F.col("n"), 1 - rate)))
    # a term in a fifth of the negative texts' share or more says little, however frequent
    found = found.where((F.col("g") >= LEAST_EVIDENCE) & (F.col("p") / positives > 10 * F.col("n") / negatives))
    return [bytes(r[0]) for r in found.orderBy(F.desc("g"), "term").limit(most).select("term").collect()]


def voters_of(terms: list[bytes]) -> tuple[dict[bytes, list[int]], int, list[str]]:
    """Voters: general lexicons by kind, the strongest induced terms alone, the others in groups, and patterns."""
    column: dict[bytes, list[int]] = {}
    names = list(LEXICON)
    for k, words in enumerate(LEXICON.values()):
        for w in words.split():
            column.setdefault(w.encode(), []).append(k)
    for k, t in enumerate(terms):
        group = k if k < ALONE else ALONE + zlib.crc32(t) % GROUPS
        column.setdefault(t, []).append(len(LEXICON) + group)
    names += [f"term {t.decode('utf-8', 'replace')}" for t in terms[:ALONE]] + ["-"] * (ALONE - len(terms[:ALONE])) + [f"group {k}" for k in range(GROUPS)]
    names += PATTERNS
    return column, len(names), names


def tree_of(votes: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Each voter's parent, itself for the first: the spanning tree with the most information between voters given the class."""
    n, m = votes.shape
    both = np.zeros((m, m))
    for weight in (q, 1 - q):
        total = weight.sum() + 1e-9
        one = (weight @ votes) / total
        joint = (votes.T * weight) @ votes / total
        for a, pa_ in ((1, one), (0, 1 - one)):
            for b, pb in ((1, one), (0, 1 - one)):
                p = joint if a and b else (one[:, None] - joint if a else one[None, :] - joint if b else 1 - one[:, None] - one[None, :] + joint)
                p = np.maximum(p, 1e-12)
                both += total / n * p * np.log(p / np.maximum(np.outer(pa_, pb), 1e-12))
    parent, best = np.zeros(m, dtype=int), both[0].copy()
    left = np.ones(m, dtype=bool)
    left[0] = False
    for _ in range(m - 1):
        k = int(np.argmax(np.where(left, best, -np.inf)))
        left[k] = False
        closer = left & (both[k] > best)
        best[closer], parent[closer] = both[k][closer], k
    return parent


def fires(votes: np.ndarray, weight: np.ndarray, parent: np.ndarray) -> np.ndarray:
    """How often each voter fires where its parent is silent, and where it fires, among rows of these weights; drawn a little to its mean rate."""
    own = (weight @ votes + 0.01) / (weight.sum() + 1)
    up = votes[:, parent]
    there, joint = weight @ up, weight @ (votes * up)
    with_it = (joint + 2 * own) / (there + 2)
    without = (weight @ votes - joint + 2 * own) / (weight.sum() - there + 2)
    top = parent == np.arange(len(parent))
    return np.clip(np.where(top, own, np.stack([without, with_it])), 1e-6, 1 - 1e-6)


def label_posteriors(votes: np.ndarray, gold: np.ndarray, lexicon: np.ndarray, rounds: int = 30) -> tuple[np.ndarray, dict]:
    """Posterior of class 1 for each row, from firing voters and given labels (nan: none), by EM over the hidden class.

    lexicon: which voters stand for class 1; where one fires is where the hidden class begins, which orients the model. The
    tree is drawn anew in the first rounds, and stays. The given label is a voter with error rates of its own.
    """
    q = np.where(votes[:, lexicon].any(1), 0.9, 0.02)
    known, ones = ~np.isnan(gold), np.nan_to_num(gold)
    for turn in range(rounds):
        prior = np.clip(q.mean(), 1e-4, 1 - 1e-4)
        if turn < 3:
            parent = tree_of(votes, q)
        p1, p0 = fires(votes, q, parent), fires(votes, 1 - q, parent)
        up = votes[:, parent].astype(int)
        at = np.arange(votes.shape[1])
        r1, r0 = p1[up, at], p0[up, at]
        ratio = np.where(votes > 0, np.log(r1 / r0), np.log((1 - r1) / (1 - r0))).sum(1)
        g1 = np.clip((q[known] @ ones[known] + 8) / (q[known].sum() + 10), 0.5, 0.99)
        g0 = np.clip(((1 - q[known]) @ ones[known] + 2) / ((1 - q[known]).sum() + 10), 0.002, 0.5)
        given = known * np.where(ones == 1, np.log(g1 / g0), np.log((1 - g1) / (1 - g0)))
        q = sigmoid(np.log(prior / (1 - prior)) + ratio + given)
    return q, {"fires_1": p1, "fires_0": p0, "parent": parent, "label_1": g1, "label_0": g0, "prior": prior}


def logistic(x: np.ndarray, target: np.ndarray, ridge: float = 2.0, rounds: int = 30) -> np.ndarray:
    """Weights, the constant first, of a logistic regression on soft targets by Newton's method."""
    x = np.hstack([np.ones((len(x), 1)), x])
    w = np.zeros(x.shape[1])
    penalty = np.full(x.shape[1], ridge)
    penalty[0] = 1e-6
    for _ in range(rounds):
        p = sigmoid(x @ w)
        slope = x.T @ (p - target) + penalty * w
        bend = (x * np.maximum(p * (1 - p), 1e-6)[:, None]).T @ x + np.diag(penalty)
        step = np.linalg.solve(bend, slope)
        size = np.abs(step).max()
        w -= step * min(1, 2 / max(size, 1e-12))
        if size < 1e-6:
            break
    return w


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", most: int = MOST_LABELLED, most_unlabelled: int = MOST_UNLABELLED) -> Model:
    """Learn voters, label model and classifier from at most `most` labelled rows and `most_unlabelled` others, outside the held-out fold."""
    sample = materialise(training_sample(docs, labels, label, most, most_unlabelled), "sample")
    kinds = dict(sample.where("part = 0").groupBy("label").count().collect())
    positives, negatives = kinds.get(1, 0), kinds.get(0, 0)
    if not positives or not negatives:
        discard(sample)
        column, n, names = voters_of([])
        weights = np.zeros(n + 4)
        weights[0] = -3
        weights[1 : 1 + len(LEXICON)] = 4
        return Model(column, n, weights, names)
    column, n, names = voters_of(induced_terms(sample.where("part = 0").select("text", "label"), positives, negatives, MOST_TERMS))
    model = Model(column, n, np.zeros(n + 4), names)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = model.features(text_bytes(batch.column(0))).astype(np.float32)
            yield pa.RecordBatch.from_arrays([pa.array([r.tobytes() for r in x], pa.binary()), batch.column(1)], names=["x", "label"])

    # `most` + `most_unlabelled` rows at most
    got = sorted((bytes(r[0]), -1 if r[1] is None else r[1]) for r in sample.where("part > 0").select("text", "label").mapInArrow(rows, "x binary, label int").collect())
    discard(sample)
    x = np.frombuffer(b"".join(r[0] for r in got), dtype=np.float32).reshape(len(got), n + 3).astype(float)
    gold = np.array([r[1] for r in got], dtype=float)
    gold[gold < 0] = np.nan
    lexicon = np.arange(n) < n - len(PATTERNS)
    target, _ = label_posteriors(x[:, :n], gold, lexicon)
    model.weights = logistic(x, target)
    return model


def with_scores(docs: DataFrame, model: Model, text: str = "text", name: str = "score") -> DataFrame:
    """docs and the score of each row's whole text, 0 to 1, without a shuffle."""
    return append_columns(docs, text, [T.StructField(name, T.DoubleType())], lambda: lambda texts: [model.score(texts)])


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scored = with_scores(docs, model)
    return scored.select("doc_id", in_fold(F.col("doc_id"), HELD_OUT).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
