"""Benchmark decontamination with spaced seeds.

Fixed masks take some of the words in a window and ignore the others, so that a
window whose ignored words were replaced still has the benchmark's hash. The hashes
of all windows of all documents meet those of the benchmark; every hit fixes a
diagonal (document, item, offset), and on it the item's words are compared with the
document's, place by place. A diagonal is evidence if any stretch of it has enough
equal words and few enough replaced ones: more overlap around a stretch never hides it.

By this rule a replacement of every fourth word throughout is no evidence for items of
more than 15 words: no stretch of 13 equal words is then 80 % equal.

The benchmark's hashes are broadcast in chunks of at most ``CHUNK_WORDS`` words: one
pass over the documents for each chunk, one for any usual benchmark.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, text
from .text import U

#: Fixed seeds: six words are taken, the places of zeros are free. Together they hit every stretch
#: of at least LEAST_WORDS equal words that is LEAST_SHARE equal, wherever its replaced words are.
MASKS = ("111111", "1110111", "1111011", "1101111", "1111101", "1011111", "11011011")
#: Items of up to SHORT_WORDS words need fewer equal words, which those can miss; they have this seed too.
SHORT_MASK, SHORT_WORDS, FEWEST_WORDS = "111", 12, 6
#: A stretch needs this many equal words (or this share of a shorter item) ...
LEAST_WORDS, LEAST_SHARE = 13, 0.8
#: ... where every replaced word uses up this many equal ones.
COST = round(LEAST_SHARE / (1 - LEAST_SHARE))
CHUNK_WORDS = 1_000_000
#: Hits that are laid out at once; a window that many items share takes several slices.
HITS = 1 << 20


@dataclass
class Seeds:
    ids: np.ndarray  # of items
    words: np.ndarray  # hashes of all items' words
    bounds: np.ndarray
    hashes: np.ndarray  # ascending
    item: np.ndarray
    place: np.ndarray
    table: np.ndarray  # a bit for each low part of a hash
    short: bool  # whether SHORT_MASK has hashes


def windows(hashes: np.ndarray, rows: np.ndarray, mask: str, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all windows inside one row, and their first word."""
    span = len(mask)
    if len(hashes) < span:
        return np.zeros(0, U), np.zeros(0, np.int64)
    many = len(hashes) - span + 1
    h = np.full(many, seed + 1, U)
    for j, c in enumerate(mask):
        if c == "1":
            h = (h ^ hashes[j : j + many]) * U(0x9E3779B97F4A7C15)
            h ^= h >> U(32)
    at = np.flatnonzero(rows[:many] == rows[span - 1 :])
    return h[at], at


def seeds(ids: list[int], texts: list[str | None]) -> Seeds:
    words, rows, _, _ = text.words(pa.array(texts, pa.string()), letters_only=True)
    bounds = np.searchsorted(rows, np.arange(len(texts) + 1))
    every, item, place = [], [], []
    size = np.diff(bounds)
    for k, mask in enumerate((*MASKS, SHORT_MASK)):
        h, at = windows(words, rows, mask, k)
        if mask == SHORT_MASK:
            few = (size[rows[at]] >= FEWEST_WORDS) & (size[rows[at]] <= SHORT_WORDS)
            h, at = h[few], at[few]
        every.append(h)
        item.append(rows[at])
        place.append(at - bounds[rows[at]])
    h, item_, place_ = (np.concatenate(x) for x in (every, item, place))
    order = np.argsort(h, kind="stable")
    bits = max(16, int(64 * max(1, len(h)) - 1).bit_length())
    table = np.zeros(1 << bits, bool)
    table[(h & U((1 << bits) - 1)).astype(np.int64)] = True
    return Seeds(np.array(ids, np.int64), words, bounds, h[order], item_[order], place_[order], table, bool(len(every[-1])))


def stretch(equal: np.ndarray) -> int:
    """The most equal words in any stretch that is at least LEAST_SHARE equal.

    Such a stretch sums to 0 or more if each equal word counts 1 and each other -COST;
    for each end, the first start whose prefix sum is no higher has the most equal words.
    """
    sums = np.concatenate([[0], np.cumsum(np.where(equal, 1, -COST))])
    start = np.searchsorted(-np.minimum.accumulate(sums), -sums)
    count = np.concatenate([[0], np.cumsum(equal)])
    return int((count - count[start]).max())


def overlaps(words: np.ndarray, rows: np.ndarray, n_rows: int, found: Seeds) -> Iterator[tuple[int, int, float]]:
    """Row, item number and share of the item's words, for every verified diagonal."""
    if not len(found.hashes) or not len(words):
        return
    begin = np.searchsorted(rows, np.arange(n_rows + 1))
    low = U(len(found.table) - 1)
    hits = []  # window's word, first seed and number of seeds
    for k, mask in enumerate((*MASKS, SHORT_MASK) if found.short else MASKS):
        h, at = windows(words, rows, mask, k)
        some = np.flatnonzero(found.table[(h & low).astype(np.int64)])
        h, at = h[some], at[some]
        a, b = np.searchsorted(found.hashes, h, "left"), np.searchsorted(found.hashes, h, "right")
        hit = np.flatnonzero(b > a)
        hits.append(np.stack([at[hit], a[hit], (b - a)[hit]]))
    word, first, size = np.concatenate(hits, axis=1)
    order = np.argsort(word, kind="stable")  # so that a document's hits come together
    word, first, size = word[order], first[order], size[order]
    ends = np.cumsum(size)
    last, total = (-1, -1, 0), int(ends[-1]) if len(ends) else 0
    for start in range(0, total, HITS):
        stop = min(total, start + HITS)
        place = np.arange(start, stop)
        of = np.searchsorted(ends, place, side="right")
        post = first[of] + place - (ends[of] - size[of])
        row = rows[word[of]]
        triples = np.unique(np.stack([row, found.item[post], word[of] - begin[row] - found.place[post]]), axis=1)
        for row, item, shift in triples.T.tolist():
            if (row, item, shift) == last:
                continue
            last = (row, item, shift)
            own = found.words[found.bounds[item] : found.bounds[item + 1]]
            head, tail = max(0, -shift), min(len(own), begin[row + 1] - begin[row] - shift)
            base = begin[row] + shift
            same = stretch(own[head:tail] == words[base + head : base + tail])
            if same >= min(LEAST_WORDS, LEAST_SHARE * len(own)):
                yield row, item, same / len(own)


def _chunks(benchmark: DataFrame) -> int:
    size = benchmark.agg(F.sum(F.length("text"))).first()[0] or 0
    return max(1, -(-size // (5 * CHUNK_WORDS)))


def _chunk(benchmark: DataFrame, k: int, n: int) -> Seeds:
    rows = benchmark.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k).filter("text is not null").select("item_id", "text").distinct().collect()
    rows = sorted((-1 if r["item_id"] is None else r["item_id"], r["text"]) for r in rows)
    return seeds([r[0] for r in rows], [r[1] for r in rows])


def inspect(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row per document: doc_id, contaminated, n_items, items (ids, comma-joined, ascending), best_match, kept.

    best_match is the largest share of an item's words that stand in one stretch of the
    document that is evidence. Null and empty texts match nothing; items shorter than a seed (six words)
    are no evidence; an item without an id is named -1. Repeated rows are inspected one
    by one, long texts whole; an empty table gives an empty table, an empty benchmark finds
    nothing, other columns are left out.
    """
    spark = docs.sparkSession
    common.small_batches(spark)
    n = _chunks(benchmark)
    parts = None
    numbered = docs.select("doc_id", "text").withColumn("row", F.monotonically_increasing_id() if n > 1 else F.lit(0).cast("long"))
    for k in range(n):
        sent = spark.sparkContext.broadcast(_chunk(benchmark, k, n))

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            found = sent.value
            for batch in batches:
                for part in common.slices(batch):
                    words, rows, _, _ = text.words(common.column(part, "text"), letters_only=True)
                    items: list[set[int]] = [set() for _ in range(part.num_rows)]
                    best = np.zeros(part.num_rows)
                    for row, item, share in overlaps(words, rows, part.num_rows, found):
                        items[row].add(int(found.ids[item]))
                        best[row] = max(best[row], share)
                    yield pa.RecordBatch.from_arrays(
                        [common.column(part, "doc_id"), common.column(part, "row"), pa.array([sorted(x) for x in items], pa.list_(pa.int64())), pa.array(best)],
                        names=["doc_id", "row", "found", "best_match"],
                    )

        one = numbered.mapInArrow(run, "doc_id long, row long, found array<long>, best_match double")
        parts = one if parts is None else parts.unionByName(one)
    if n > 1:
        parts = parts.groupBy("doc_id", "row").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("found")))).alias("found"), F.max("best_match").alias("best_match"))
    dirty = F.size("found") > 0
    return parts.select("doc_id", dirty.alias("contaminated"), F.size("found").cast("long").alias("n_items"), F.array_join(F.transform("found", lambda x: x.cast("string")), ",").alias("items"), "best_match", (~dirty).alias("kept"))


def keep_clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents without a verified overlap, row by row, with all columns and no shuffle.

    Null and empty texts stay, as does everything where the benchmark is empty.
    """
    spark = docs.sparkSession
    common.small_batches(spark)
    n = _chunks(benchmark)
    for k in range(n):
        sent = spark.sparkContext.broadcast(_chunk(benchmark, k, n))

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part in common.slices(batch):
                    words, rows, _, _ = text.words(common.column(part, "text"), letters_only=True)
                    clean = np.ones(part.num_rows, bool)
                    for row, _, _ in overlaps(words, rows, part.num_rows, sent.value):
                        clean[row] = False
                    yield part.filter(pa.array(clean))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
