"""Document fingerprints: MinHash under universal hash permutations, vectorised in numpy.

A document's fingerprint is the least value of its word shingles under each of
``PERMUTATIONS`` multiply-add hash functions, 16 bits of each written in
hexadecimal. The likeness of two fingerprints is the share of equal values,
corrected for values that agree by chance. near_duplicates() joins documents whose
signatures agree in a band, in Spark, and verifies the Jaccard similarity on full
shingle sets.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, neardup, sketches, text
from .text import U

PERMUTATIONS = 128
WORDS = 5
#: Bytes of text in one range of the ordered exchange, about, and how many ranges there are at most.
RANGE_BYTES, MOST_RANGES = 8 << 20, 10_000
_LOW = -(1 << 63)


def parameters(count: int) -> tuple[np.ndarray, np.ndarray]:
    """Odd factors and offsets of the permutations, fixed for good."""
    k = np.arange(1, count + 1, dtype=U)
    return text.mix(k, 71) | U(1), text.mix(k, 72)


def signatures(texts: pa.Array, words: int = WORDS, count: int = PERMUTATIONS) -> np.ndarray:
    """A row of ``count`` values per text; a text without words has the highest value throughout."""
    hashes, rows, _, _ = text.words(texts)
    sets, bounds = text.shingles(hashes, rows, len(texts), words)
    return sketches.permutation_sketch(sets, bounds, *parameters(count))


def short(signature: np.ndarray) -> np.ndarray:
    """16 bits of each value; the text without words stays apart as zeros."""
    bits = (text.mix(signature, 9) >> U(48)).astype(np.uint16) | np.uint16(1)
    bits[(signature == np.iinfo(np.uint64).max).all(axis=1)] = 0
    return bits


def written(bits: np.ndarray) -> list[str]:
    return [row.astype(">u2").tobytes().hex() for row in bits]


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Estimated similarity of fingerprints, row by row: 0 to 1, and exactly 1 for equal ones."""
    share = (a == b).mean(axis=1)
    chance = 2.0**-15
    return np.clip((share - chance) / (1 - chance), 0.0, 1.0)


def _cut(current: str, following: str) -> str:
    half = len(current) // 2
    return current[: len(current) - half] + following[:half]


def _ranges(docs: DataFrame) -> tuple[list[int], dict[int, int]]:
    """Ascending splitters of doc_id into ranges of near-equal rows, and the highest id of each range that has rows.

    There are as many ranges as the texts' bytes ask for, but no more than MOST_RANGES:
    larger ranges sort on disk.
    """
    sized = docs.agg(F.count("*").alias("n"), F.sum(F.coalesce(F.octet_length("text"), F.lit(0))).alias("bytes")).first()
    ids = docs.select(F.coalesce("doc_id", F.lit(_LOW)).alias("id"))
    many, parts = sized["n"], min(MOST_RANGES, max(1, -(-(sized["bytes"] or 0) // RANGE_BYTES)))
    if parts > 1:
        cuts = ids.agg(F.percentile_approx("id", [k / parts for k in range(1, parts)], 20 * parts)).first()[0]
        cuts = sorted(set(cuts))
    else:
        cuts = []
    if not many:
        return [], {}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = common.column(batch, "id").to_numpy()
            place = np.searchsorted(np.array(cuts, np.int64), own, side="right")
            order = np.lexsort((own, place))
            last = np.append(np.diff(place[order]) != 0, True)
            yield pa.RecordBatch.from_arrays([pa.array(place[order][last]), pa.array(own[order][last])], names=["part", "id"])

    tops = ids.mapInArrow(run, "part long, id long").groupBy("part").agg(F.max("id").alias("id")).collect()
    return cuts, {r["part"]: r["id"] for r in tops}


def ordered(docs: DataFrame) -> DataFrame:
    """part, id, ghost and text: ranges of doc_id in which every document is followed by the next lower one.

    The last document of a range is followed by a ghost of the next range's first (of
    the overall first, in the last range). Rows go through one exchange; the ghosts'
    ids, one per range, are all that the driver sees.
    """
    cuts, tops = _ranges(docs)
    high_to_low = sorted(tops, reverse=True)
    ghost_of: dict[int, list[int]] = {}
    for a, b in zip(high_to_low, [*high_to_low[1:], *high_to_low[:1]], strict=True):
        ghost_of.setdefault(tops[b], []).append(a)
    sent = docs.sparkSession.sparkContext.broadcast((np.array(cuts, np.int64), ghost_of))
    common.small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cuts, ghost_of = sent.value
        for batch in batches:
            ids = common.column(batch, "id").to_numpy()
            place = np.searchsorted(cuts, ids, side="right")
            yield pa.RecordBatch.from_arrays([pa.array(place), pa.array(ids), pa.array(np.zeros(len(ids), bool)), common.column(batch, "named"), common.column(batch, "text")], names=["part", "id", "ghost", "named", "text"])
            again = [(k, p) for k, i in enumerate(ids.tolist()) for p in ghost_of.get(i, ())]
            if again:
                rows = batch.take(pa.array([k for k, _ in again]))
                yield pa.RecordBatch.from_arrays([pa.array([p for _, p in again], pa.int64()), common.column(rows, "id"), pa.array([True] * len(again)), common.column(rows, "named"), common.column(rows, "text")], names=["part", "id", "ghost", "named", "text"])

    rows = docs.select(F.coalesce("doc_id", F.lit(_LOW)).alias("id"), F.col("doc_id").isNotNull().alias("named"), F.coalesce("text", F.lit("")).alias("text"))
    dealt = rows.mapInArrow(run, "part long, id long, ghost boolean, named boolean, text string")
    return dealt.repartition(max(1, len(tops)), "part").sortWithinPartitions("part", "ghost", F.desc("id"), "text")


def fingerprint(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited and near_next of every row.

    The edited text has the last half of the code points (rounded down) replaced by as
    many, or all, first ones of the next document by descending doc_id; the first
    follows the last. Of documents with one id the next is that with the lesser text;
    a missing id is the lowest; a null text is empty. A document alone in its table
    follows itself. Repeated rows stay, long texts are taken whole, an empty table gives
    an empty table, other columns are left out, whatever their names.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict | None = None

        def emit(rows: list[tuple[dict, str, np.ndarray]]) -> pa.RecordBatch:
            edited = [_cut(r["text"], following) for r, following, _ in rows]
            bits = np.stack([r["bits"] for r, _, _ in rows])
            changed = np.concatenate([short(signatures(common.column(part, "text"))) for part in common.slices(pa.RecordBatch.from_arrays([pa.array(edited, pa.string())], names=["text"]))])
            near = likeness(bits, np.stack([b for _, _, b in rows]))
            digests = [hashlib.sha256(t.encode()).hexdigest() for t in edited]
            columns = [
                pa.array([r["id"] if r["named"] else None for r, _, _ in rows], pa.int64()), pa.array([len(r["text"]) for r, _, _ in rows], pa.int64()), pa.array(digests),
                pa.array(written(bits)), pa.array(written(changed)), pa.array(likeness(bits, changed)), pa.array(near),
            ]
            return pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])

        for batch in batches:
            for part in common.slices(batch):
                bits = short(signatures(common.column(part, "text")))
                out = []
                for r, b in zip(part.to_pylist(), bits, strict=True):
                    if held is not None and held["part"] == r["part"] and not held["ghost"]:
                        out.append((held, r["text"], b))
                    held = r | {"bits": b}
                if out:
                    yield emit(out)

    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return ordered(docs).mapInArrow(run, schema)


def near_duplicates(docs: DataFrame, words: int = WORDS, percent: int = 80) -> DataFrame:
    """Documents joined by signature bands and verified on full sets: see neardup.link() for the result and odd inputs.

    The contract of the query ``op7`` asks for fingerprints and likenesses alone, so this
    join is not on its path.
    """
    a, b = parameters(neardup.SKETCH)
    return neardup.link(docs, words, percent, lambda sets, bounds: sketches.permutation_sketch(sets, bounds, a, b))
