"""Language identification: multinomial naive Bayes over hashed character n-grams.

Counts come from all learning documents, summed inside each task before a small
shuffle; the log-probability matrix (dimensions x languages) is broadcast, and its
size does not depend on the corpus. Batches are scored in numpy as sparse rows
times that matrix.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

DIMENSIONS = 1 << 16
ORDERS = (1, 2, 3)
SMOOTHING = 0.1
#: Languages beyond this are refused: the matrix would no longer be small.
MAX_LANGUAGES = 1000
_FACTORS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93], np.uint64)


def grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed n-grams of the lower-cased texts, and the text of each."""
    lowered = [t.lower() for t in texts]
    sizes = np.fromiter(map(len, lowered), np.int64, len(lowered))
    codes = np.frombuffer("".join(lowered).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    row = np.repeat(np.arange(len(texts)), sizes)
    places, rows = [], []
    for n in ORDERS:
        if len(codes) < n:
            continue
        many = len(codes) - n + 1
        h = np.full(many, n, np.uint64)
        for j in range(n):
            h = h + (codes[j : j + many] + np.uint64(1)) * _FACTORS[j]
        h = (h ^ (h >> np.uint64(29))) * _FACTORS[3]
        inside = row[:many] == row[n - 1 :]
        places.append((h >> np.uint64(48)).astype(np.int64)[inside] & (DIMENSIONS - 1))
        rows.append(row[:many][inside])
    if not places:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(places), np.concatenate(rows)


def counts(docs: DataFrame) -> DataFrame:
    """lang, place, n: n-gram counts by language; place -1 counts documents. Needs text and lang, neither null."""
    common.small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for part in common.slices(batch, limit=1 << 20):
                langs = common.column(part, "lang").to_pylist()
                names = sorted(set(langs))
                which = np.array([names.index(x) for x in langs])
                place, row = grams(common.column(part, "text").to_pylist())
                both = np.bincount(which[row] * DIMENSIONS + place, minlength=len(names) * DIMENSIONS).reshape(len(names), DIMENSIONS)
                for i, name in enumerate(names):
                    own = sums.setdefault(name, np.zeros(DIMENSIONS + 1, np.int64))
                    own[:-1] += both[i]
                    own[-1] += int((which == i).sum())
        for name, own in sums.items():
            at = np.flatnonzero(own)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(at)), pa.array(np.where(at == DIMENSIONS, -1, at).astype(np.int32)), pa.array(own[at])], names=["lang", "place", "n"])

    # as many emitters as the cluster has use for, however many input partitions there are
    few = docs.select("text", "lang").coalesce(4 * docs.sparkSession.sparkContext.defaultParallelism)
    return few.mapInArrow(run, "lang string, place int, n long").groupBy("lang", "place").agg(F.sum("n").alias("n"))


def fit(docs: DataFrame) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Languages, log-probability matrix and log priors."""
    learn = docs.filter("text is not null and lang is not null")
    found = counts(learn)
    langs = sorted(r["lang"] for r in learn.select("lang").distinct().limit(MAX_LANGUAGES + 1).collect())
    if len(langs) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    table = found.toArrow()
    n = np.zeros((DIMENSIONS, max(1, len(langs))))
    docs_of = np.ones(max(1, len(langs)))
    place, value = table["place"].to_numpy(), table["n"].to_numpy()
    which = np.searchsorted(np.array(langs, dtype=object), np.array(table["lang"].to_pylist(), dtype=object)) if len(place) else np.zeros(0, int)
    real = place >= 0
    n[place[real], which[real]] = value[real]
    docs_of[which[~real]] = value[~real]
    matrix = np.log(n + SMOOTHING) - np.log((n + SMOOTHING).sum(axis=0))
    return langs, matrix.astype(np.float32), np.log(docs_of / docs_of.sum())


def predict(docs: DataFrame, model: tuple[list[str], np.ndarray, np.ndarray], key: str = "doc_id") -> DataFrame:
    """key, lang_pred and score (the posterior probability of lang_pred, 0 to 1) of every row.

    A null text, or one without a letter, is "und" with score 0, as is every text when
    nothing could be learned. Repeated rows are scored one by one.
    """
    common.small_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        langs, matrix, prior = sent.value
        for batch in batches:
            for part in common.slices(batch, limit=1 << 20):
                texts = [t or "" for t in common.column(part, "text").to_pylist()]
                place, row = grams(texts)
                total = np.tile(prior, (len(texts), 1))
                for j in range(len(prior)):
                    total[:, j] += np.bincount(row, weights=matrix[place, j], minlength=len(texts))
                best = total.argmax(axis=1)
                score = 1 / np.exp(total - total.max(axis=1, keepdims=True)).sum(axis=1)
                ok = np.asarray(common.column(part, "lettered")) & bool(langs)
                names = [langs[b] if o else "und" for b, o in zip(best, ok, strict=True)]
                yield pa.RecordBatch.from_arrays([common.column(part, "key"), pa.array(names, pa.string()), pa.array(np.where(ok, score, 0.0))], names=[key, "lang_pred", "score"])

    lettered = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))
    kind = dict(docs.dtypes)[key]
    return docs.select(F.col(key).alias("key"), "text", lettered.alias("lettered")).mapInArrow(run, f"{key} {kind}, lang_pred string, score double")


def held_out() -> Column:
    """Documents that nothing is learned from: crc32 of the id's digits leaves 1 modulo 3. False without an id."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))


def identify(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred and score of all documents, learned from those not held out.

    Null texts, and those without a letter, are "und". Documents without an id are judged,
    but nothing is learned from them; repeated rows count and are judged one by one. Long
    texts are taken whole. An empty table gives an empty table; other columns are left out.
    """
    model = fit(docs.filter(~held_out() & F.col("doc_id").isNotNull()))
    return predict(docs.select("doc_id", "text"), model).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
