"""Toxicity by a classifier chain over hashed word features.

Features are 64-bit hashes, so that no two words of any corpus share one; a model
holds those that have a weight.

Categories are predicted one after another. Each linear model sees the document's
words, word beginnings, and the probabilities of the categories before it; while
training, those are out-of-fold predictions, so a model never learns from
probabilities that its own rows shaped. Models are sparse logistic regressions (an
L1 penalty keeps words that tell nothing at exactly zero, so long clean documents
do not add up noise), fitted on the driver from at most ``SAMPLE`` labelled
documents; every document is scored, over its whole text, in Arrow batches.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, text

#: Labelled documents that the models are fitted on at most, those of the lowest id hashes, and
#: the bytes of text that these may have together (the first one always counts).
SAMPLE, SAMPLE_BYTES = 4000, 128 << 20
FOLDS = 3
ROUNDS = 100
PENALTY = 0.001
#: A feature must occur in this many sample documents, and in this share at most ...
RARE, COMMON = 4, 0.05
#: ... unless it goes this far from a category's overall share towards certainty.
TELLING = 0.5
#: Word beginnings, in bytes, that are features beside the word.
BEGINNINGS = (4, 6)


def features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashed features of the words of all texts, repeats included, and the text of each."""
    hashes, rows, starts, ends = text.words(texts, letters_only=True)
    if not len(starts):
        return hashes, rows
    raw, _ = text.flat(texts)
    raw = text._LOWER[raw]
    parts = [hashes]
    code = np.zeros(len(starts), np.uint64)
    for j in range(max(BEGINNINGS)):
        inside = starts + j < ends
        code = np.where(inside, code * np.uint64(257) + raw[np.minimum(starts + j, len(raw) - 1)] + np.uint64(1), code)
        if j + 1 in BEGINNINGS:
            parts.append(text.mix(code, 900 + j))
    return np.concatenate(parts), np.tile(rows, len(parts))


def distinct(found: np.ndarray, rows: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Each text's features once, with text bounds."""
    order = np.lexsort((found, rows))
    found, rows = found[order], rows[order]
    keep = np.ones(len(found), bool)
    keep[1:] = (found[1:] != found[:-1]) | (rows[1:] != rows[:-1])
    return found[keep], np.searchsorted(rows[keep], np.arange(n + 1))


@dataclass
class Linear:
    """Weights of the features of a vocabulary (by number), a constant, and weights of earlier categories."""

    weights: np.ndarray
    bias: float
    chained: np.ndarray

    def logits(self, place: np.ndarray, bounds: np.ndarray, before: np.ndarray) -> np.ndarray:
        sums = np.concatenate([[0.0], np.cumsum(self.weights[place])])
        return sums[bounds[1:]] - sums[bounds[:-1]] + self.bias + before @ self.chained


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


def fit_linear(place: np.ndarray, bounds: np.ndarray, before: np.ndarray, truth: np.ndarray, size: int) -> Linear:
    """L1-penalised logistic regression by proximal adaptive steps; classes weigh alike."""
    n, rate = len(truth), 0.5
    model = Linear(np.zeros(size), 0.0, np.zeros(before.shape[1]))
    share = truth.mean() if n else 0.0
    if share in (0.0, 1.0) or not n:
        model.bias = 20.0 if share else -20.0
        return model
    importance = np.where(truth == 1, 0.5 / share, 0.5 / (1 - share)) / n
    row = np.repeat(np.arange(n), np.diff(bounds))
    past, past_bias, past_chain = np.full(size, 1e-8), 1e-8, np.full(before.shape[1], 1e-8)
    for _ in range(ROUNDS):
        error = (sigmoid(model.logits(place, bounds, before)) - truth) * importance
        slope = np.bincount(place, weights=error[row], minlength=size)
        past += slope**2
        step = rate / np.sqrt(past)
        moved = model.weights - step * slope
        model.weights = np.sign(moved) * np.maximum(np.abs(moved) - step * PENALTY, 0)
        past_bias += error.sum() ** 2
        model.bias -= rate * error.sum() / np.sqrt(past_bias)
        slope = before.T @ error
        past_chain += slope**2
        model.chained = model.chained - rate * slope / np.sqrt(past_chain)
    return model


def threshold(scores: np.ndarray, truth: np.ndarray) -> float:
    """The cut with the highest F1, in the middle between the neighbouring scores."""
    if not len(scores) or not truth.any():
        return 1.0
    order = np.argsort(-scores, kind="stable")
    s, t = scores[order], truth[order]
    hits = np.cumsum(t)
    f1 = 2 * hits / (np.arange(1, len(s) + 1) + t.sum())
    last = np.append(s[1:] != s[:-1], True)
    k = int(np.argmax(np.where(last, f1, -1)))
    return float((s[k] + s[k + 1]) / 2) if k + 1 < len(s) else float(s[k])


@dataclass
class Chain:
    categories: list[str]
    keys: np.ndarray  # ascending hashes of the features that have a weight in any model
    models: list[Linear]
    cuts: list[float]

    def __post_init__(self):
        self.table = np.zeros(1 << 20, bool)
        self.table[(self.keys & np.uint64((1 << 20) - 1)).astype(np.int64)] = True

    def score(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Probabilities, a column per category, and which texts have any word."""
        found, rows = features(texts)
        some = np.bincount(rows, minlength=len(texts)) > 0
        near = np.flatnonzero(self.table[(found & np.uint64((1 << 20) - 1)).astype(np.int64)])
        found, rows = found[near], rows[near]
        at = np.minimum(np.searchsorted(self.keys, found), max(0, len(self.keys) - 1))
        hit = self.keys[at] == found if len(self.keys) else np.zeros(0, bool)
        place, bounds = distinct(at[hit], rows[hit], len(texts))
        out = np.zeros((len(texts), 0))
        for model in self.models:
            out = np.column_stack([out, sigmoid(model.logits(place, bounds, out))])
        return out, some


def fit_chain(found: np.ndarray, bounds: np.ndarray, truth: np.ndarray, categories: list[str], folds: np.ndarray) -> Chain:
    """found: each row's distinct features; truth: a column per category, in the order of the chain; folds: the fold of each row."""
    n = len(bounds) - 1
    keys, place, df = np.unique(found, return_inverse=True, return_counts=True)
    of = np.repeat(np.arange(n), np.diff(bounds))
    telling = np.zeros(len(keys), bool)
    for c in range(truth.shape[1]):
        share = truth[:, c].mean() if n else 0.0
        rate = np.bincount(place, weights=truth[of, c], minlength=len(keys)) / df
        telling |= rate - share >= TELLING * (1 - share)
    use = (df >= RARE) & ((df <= max(RARE, COMMON * n)) | telling)
    number = np.cumsum(use) - 1
    row = of[use[place]]
    place, keys = number[place[use[place]]], keys[use]
    bounds = np.searchsorted(row, np.arange(n + 1))
    models, cuts, before = [], [], np.zeros((n, 0))

    def some(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        sizes = np.diff(bounds)
        return place[np.repeat(mask, sizes)], np.concatenate([[0], np.cumsum(sizes[mask])])

    for c in range(len(categories)):
        out_of_fold = np.zeros(n)
        for f in range(FOLDS):
            mine = folds == f
            model = fit_linear(*some(~mine), before[~mine], truth[~mine, c], len(keys))
            out_of_fold[mine] = sigmoid(model.logits(*some(mine), before[mine]))
        models.append(fit_linear(place, bounds, before, truth[:, c], len(keys)))
        cuts.append(threshold(out_of_fold, truth[:, c]))
        before = np.column_stack([before, out_of_fold])
    live = np.flatnonzero(np.any([m.weights != 0 for m in models], axis=0))
    return Chain(categories, keys[live], [Linear(m.weights[live], m.bias, m.chained) for m in models], cuts)


def train(docs: DataFrame, labels: DataFrame, categories: dict[str, str], sample: int = SAMPLE, sample_bytes: int = SAMPLE_BYTES) -> Chain:
    """Fit the chain on labelled documents.

    categories: name -> SQL condition over the labels' columns, in the order of the
    chain. Labels with a null id or condition are left out. An id counts once: where
    labels repeat, it is in a category if any of them says so; where documents repeat,
    the least text stands for it. The driver sees at most ``sample`` rows, with the
    features of ``sample_bytes`` of text.
    """
    spark = docs.sparkSession
    common.small_batches(spark)
    names = list(categories)
    flags = [F.expr(f"cast(({c}) as int)").alias(f"c{i}") for i, c in enumerate(categories.values())]
    known = labels.select("doc_id", *flags).dropna().groupBy("doc_id").agg(*[F.max(f"c{i}").alias(f"c{i}") for i in range(len(names))])
    sized = docs.select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).alias("n")).join(known, "doc_id")
    once = sized.groupBy("doc_id").agg(F.min("n").alias("n"), *[F.first(f"c{i}").alias(f"c{i}") for i in range(len(names))])
    first = once.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample).collect()
    total = np.cumsum([r["n"] for r in first])
    ids = first[: max(1, int(np.searchsorted(total, sample_bytes, side="right")))] if first else []
    ids = spark.createDataFrame([(r["doc_id"], *(r[f"c{i}"] for i in range(len(names)))) for r in ids], "doc_id long" + "".join(f", c{i} int" for i in range(len(names))))
    rows = docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id")  # of at most ``sample`` rows
    rows = rows.groupBy("doc_id").agg(F.min("text").alias("text"), *[F.first(f"c{i}").alias(f"c{i}") for i in range(len(names))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in common.slices(batch):
                every, bounds = distinct(*features(common.column(part, "text")), part.num_rows)
                found = [every[a:b].astype("<u8").tobytes() for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([common.column(part, "doc_id"), *(common.column(part, f"c{i}") for i in range(len(names))), pa.array(found, pa.binary())], names=["doc_id", *(f"c{i}" for i in range(len(names))), "found"])

    got = rows.mapInArrow(run, "doc_id long, " + "".join(f"c{i} int, " for i in range(len(names))) + "found binary").collect()
    got.sort(key=lambda r: (r["doc_id"], bytes(r["found"]), *(r[f"c{i}"] for i in range(len(names)))))
    parts = [np.frombuffer(r["found"], "<u8") for r in got]
    found = np.concatenate(parts) if parts else np.zeros(0, np.uint64)
    bounds = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int64)
    truth = np.array([[r[f"c{i}"] for i in range(len(names))] for r in got], float).reshape(len(got), len(names))
    folds = (text.mix(np.array([r["doc_id"] for r in got], np.int64).view(np.uint64), 41) % np.uint64(FOLDS)).astype(int)
    return fit_chain(found, bounds, truth, names, folds)


def score(docs: DataFrame, chain: Chain) -> DataFrame:
    """doc_id and p_<category> and the category itself (boolean) of every row.

    A null or empty text has no feature: its scores are those of the models' constants,
    and it is in no category. Repeated rows are scored one by one; an empty table gives
    an empty table; other columns are left out.
    """
    common.small_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(chain)
    names = chain.categories

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chain = sent.value
        for batch in batches:
            for part in common.slices(batch):
                p, some = chain.score(common.column(part, "text"))
                flags = [pa.array((p[:, i] >= cut) & some) for i, cut in enumerate(chain.cuts)]
                yield pa.RecordBatch.from_arrays([common.column(part, "doc_id"), *(pa.array(p[:, i]) for i in range(len(names))), *flags], names=["doc_id", *(f"p_{c}" for c in names), *names])

    schema = "doc_id long" + "".join(f", p_{c} double" for c in names) + "".join(f", {c} boolean" for c in names)
    return docs.select("doc_id", "text").mapInArrow(run, schema)


#: The labels know these two categories; the chain ends in the one that rejects.
CATEGORIES = {"low_quality": "quality = 0", "toxic": "toxic = 1"}


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, p_low_quality, p_toxic, low_quality, toxic and kept (not toxic) of every row; see train() and score().

    Without labels, or without any toxic one, no document is toxic.
    """
    scored = score(docs, train(docs, labels, CATEGORIES))
    return scored.withColumn("kept", ~F.col("toxic"))


def keep_clean(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that are not toxic, row by row, with all columns and no shuffle.

    Null and empty texts stay, as does everything where nothing could be learned.
    """
    common.small_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(train(docs, labels, CATEGORIES))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chain = sent.value
        for batch in batches:
            for part in common.slices(batch):
                p, some = chain.score(common.column(part, "text"))
                toxic = (p[:, -1] >= chain.cuts[-1]) & some
                yield part.filter(pa.array(~toxic))

    return docs.mapInArrow(run, docs.schema)
