"""Best-fit packing of token pieces into fixed-length sequences by swap-based local search.

Documents are tokenised once, without a shuffle; only documents longer than a
sequence are cut. Pieces go to blocks of bounded size, and each block is packed
by itself: full pieces stand alone, the rest are placed best fit, longest first,
and then the least filled bin is emptied by moving one of its pieces, or
exchanging one or two of them for one smaller or two of another bin, whenever
that raises the sum of squared fills. Bins still open after the first round are
dealt into new blocks and packed again, so the loss of a block boundary is paid
on a small remainder only. No task sees more than a block.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, tokens

CAPACITY = 4096
END_ID = 1
#: Pieces that one task packs at a time, on average.
BLOCK_PIECES = 3000
#: The search of a block ends after so many bins that no exchange improves, and after so many
#: exchanges. Every piece is placed before it starts, so these bound time and lose nothing.
FAILURES, EXCHANGES = 8, 4000
#: A bin that lacks more than this share of the capacity is packed again.
OPEN_SHARE = 0.002


def tokenize(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """Pieces of every document: doc_id, piece, start, length and ids (unsigned 32-bit little-endian bytes).

    vocabulary: a file's path, or the name of a public tokenizer that each worker looks up
    itself. Long texts are taken whole, and cut after tokenising. A null or empty text gives one piece with the end id alone; repeated rows give
    repeated pieces; other columns are left out.
    """
    common.small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = tokens.encoder(vocabulary)
        for batch in batches:
            for part in common.slices(batch, limit=4 << 20):
                ids, bounds = encoder.encode(common.column(part, "text"))
                doc, piece, start, length, out = [], [], [], [], []
                for d, a, b in zip(common.column(part, "doc_id").to_pylist(), bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                    own = np.append(ids[a:b], np.uint32(end_id)).astype("<u4")
                    for k, at in enumerate(range(0, len(own), capacity)):
                        cut = own[at : at + capacity]
                        doc.append(d)
                        piece.append(k)
                        start.append(at)
                        length.append(len(cut))
                        out.append(cut.tobytes())
                yield pa.RecordBatch.from_arrays([pa.array(doc, pa.int64()), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(out, pa.binary())], names=["doc_id", "piece", "start", "length", "ids"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, piece int, start long, length long, ids binary")


class Bins:
    """Items of given sizes in bins of one capacity."""

    def __init__(self, sizes: np.ndarray, capacity: int):
        self.sizes, self.capacity = sizes.astype(np.int64), capacity
        self.bin = np.full(len(sizes), -1, np.int64)
        self.fill: np.ndarray = np.zeros(0, np.int64)

    def best_fit(self) -> None:
        """Longest first, each into the fullest bin that takes it."""
        free: list[list[int]] = [[] for _ in range(self.capacity + 1)]  # bins by what they lack
        some = np.zeros(self.capacity + 1, bool)
        fills: list[int] = []
        for i in np.argsort(-self.sizes, kind="stable"):
            s = int(self.sizes[i])
            gap = s + int(np.argmax(some[s:]))
            if some[gap]:
                b = free[gap].pop()
                some[gap] = bool(free[gap])
            else:
                b, gap = len(fills), self.capacity
                fills.append(0)
            fills[b] += s
            self.bin[i] = b
            free[gap - s].append(b)
            some[gap - s] = gap > s
        self.fill = np.array(fills, np.int64)

    def least(self) -> int:
        return -(-int(self.sizes.sum()) // self.capacity)

    def swap(self, down: list[int], up: list[int], low: int, high: int) -> None:
        """Items ``down`` leave bin ``low`` for ``high``; items ``up`` go the other way."""
        move = int(self.sizes[down].sum() - self.sizes[up].sum())
        self.bin[down], self.bin[up] = high, low
        self.fill[low] -= move
        self.fill[high] += move

    def exchange(self, low: int) -> bool:
        """One step that takes tokens out of ``low``, the least filled bin, so squared fill rises."""
        gap = self.capacity - self.fill
        gap[low] = 0
        gap[self.fill == 0] = 0  # emptied bins stay so
        others = np.flatnonzero((gap[self.bin] > 0) & (self.bin != low))
        if not len(others):
            return False
        mine = np.flatnonzero(self.bin == low)
        mine = mine[np.argsort(-self.sizes[mine], kind="stable")]
        for i in mine:  # a move
            fits = np.flatnonzero(gap >= self.sizes[i])
            if len(fits):
                self.swap([i], [], low, int(fits[np.argmin(gap[fits])]))
                return True
        # all sums of one or two own items; a bin's distinct sizes add up to its fill, so they are few
        size, room = self.sizes[others], gap[self.bin[others]]
        distinct = mine[np.unique(self.sizes[mine], return_index=True)[1]]
        twice = mine[_twice(self.sizes[mine])]
        i, j = np.triu_indices(len(twice), 1)
        outs, which = np.unique(np.concatenate([self.sizes[distinct], self.sizes[twice[i]] + self.sizes[twice[j]]]), return_index=True)
        # for one item of another bin: the largest sum that still fits there
        at = np.searchsorted(outs, size + room, side="right") - 1
        gain = np.where(at >= 0, outs[np.maximum(at, 0)] - size, 0)
        k = int(np.argmax(gain))
        if gain[k] > 0:
            n = int(which[at[k]])
            down = [int(distinct[n])] if n < len(distinct) else [int(twice[x[n - len(distinct)]]) for x in (i, j)]
            self.swap(down, [int(others[k])], low, int(self.bin[others[k]]))
            return True
        # for two items of another bin: of every bin the pair that one own item replaces with the greatest gain
        best, plan = 0, None
        want = self.sizes[distinct]
        for b in np.argsort(-gap, kind="stable"):
            if gap[b] <= best:  # a gain is no more than the other bin's gap
                break
            own = np.flatnonzero(self.bin == b)
            own = own[_twice(self.sizes[own])]
            if len(own) < 2:
                continue
            i, j = np.triu_indices(len(own), 1)
            both, pair = np.unique(self.sizes[own[i]] + self.sizes[own[j]], return_index=True)
            at = np.searchsorted(both, want - gap[b])  # the least sum that leaves the bin room for the item
            gain = np.where(at < len(both), want - both[np.minimum(at, len(both) - 1)], 0)
            k = int(np.argmax(gain))
            if gain[k] > best:
                p = pair[at[k]]
                best, plan = int(gain[k]), ([int(distinct[k])], [int(own[i[p]]), int(own[j[p]])], int(b))
        if plan is None:
            return False
        self.swap(*plan[:2], low, plan[2])
        return True

    def improve(self, steps: int = EXCHANGES, failures: int = FAILURES) -> None:
        """Empty the least filled bins until the lower bound is met or ``failures`` of them are stuck."""
        stuck = np.zeros(len(self.fill), bool)
        least = self.least()
        for _ in range(steps):
            live = np.flatnonzero((self.fill > 0) & ~stuck)
            if not len(live) or np.count_nonzero(self.fill) <= least:
                return
            low = int(live[np.argmin(self.fill[live])])
            if not self.exchange(low):
                stuck[low] = True
                if stuck.sum() > failures:
                    return


def _twice(sizes: np.ndarray) -> np.ndarray:
    """Places of two items at most of each size, smallest first."""
    order = np.argsort(sizes, kind="stable")
    held = sizes[order]
    third = np.zeros(len(held), bool)
    third[2:] = held[2:] == held[:-2]
    return order[~third]


def pack_block(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bin and offset of each piece, and each piece's bin fill."""
    bins = Bins(lengths, capacity)
    bins.best_fit()
    bins.improve()
    order = np.lexsort((np.arange(len(lengths)), bins.bin))
    ends = np.cumsum(lengths[order])
    begin = ends - lengths[order]
    opens = np.concatenate([[True], np.diff(bins.bin[order]) != 0]) if len(order) else np.zeros(0, bool)
    base = np.maximum.accumulate(np.where(opens, begin, 0)) if len(order) else begin
    offset = np.empty(len(lengths), np.int64)
    offset[order] = begin - base
    return bins.bin, offset, bins.fill[bins.bin]


def _round(pieces: DataFrame, blocks: int, number: int, capacity: int) -> DataFrame:
    """Pack the pieces of each block; ``number`` keeps the sequence ids of rounds apart."""
    schema = pieces.drop("salt").schema.add("sequence_id", "long").add("offset", "long").add("fill", "long")

    def run(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["length", "doc_id", "piece", "salt"], kind="stable")
        block = part.pop("block").iloc[0]
        del part["salt"]
        number_of, offset, fill = pack_block(part["length"].to_numpy(np.int64), capacity)
        return part.assign(sequence_id=(np.int64(number) << 60) + (np.int64(block) << 32) + number_of, offset=offset, fill=fill)

    block = F.pmod(F.xxhash64("doc_id", "piece", "salt", F.lit(number)), F.lit(blocks)).cast("int")
    dealt = pieces.withColumn("block", block)
    return dealt.groupBy("block").applyInPandas(run, schema)


def pack(pieces: DataFrame, spark: SparkSession, capacity: int = CAPACITY, work: common.Workspace | None = None) -> DataFrame:
    """Add sequence_id and offset to pieces that have doc_id, piece and length (small columns only).

    Every piece is placed; sequences are filled without gaps from offset 0. Ties are
    broken by doc_id and piece, repeated rows are packed one by one, an empty table
    gives an empty table.
    """
    work = work or common.Workspace(spark)
    nameless = F.col("doc_id").isNull()  # pandas has no null among whole numbers
    rows = work.save(pieces.withColumns({"nameless": nameless, "doc_id": F.coalesce("doc_id", F.lit(0)), "salt": F.monotonically_increasing_id()}), "pieces")
    whole = rows.filter(F.col("length") == capacity).drop("salt")
    whole = whole.select("*", (F.monotonically_increasing_id() + F.lit(3 << 60)).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    rest = rows.filter(F.col("length") < capacity)
    count = rest.count()
    first = work.save(_round(rest, max(1, count // BLOCK_PIECES), 1, capacity), "packed")
    closed = F.col("fill") >= int(capacity * (1 - OPEN_SHARE))
    left = first.filter(~closed)
    left_count = left.count()
    again = left.drop("sequence_id", "offset", "fill").withColumn("salt", F.lit(0).cast("long"))
    second = work.save(_round(again, max(1, left_count // (2 * BLOCK_PIECES)), 2, capacity), "repacked")
    work.keep(rows, first, second)
    placed = whole.unionByName(first.filter(closed).drop("fill")).unionByName(second.drop("fill"))
    return placed.withColumn("doc_id", F.when(~F.col("nameless"), F.col("doc_id"))).drop("nameless")


def sequences(placed: DataFrame, pieces: DataFrame) -> DataFrame:
    """The packed sequences themselves: sequence_id, ids (bytes), and the doc_ids in order."""
    joined = placed.select("doc_id", "piece", "sequence_id", "offset").join(pieces.select("doc_id", "piece", "ids"), ["doc_id", "piece"])
    parts = F.array_sort(F.collect_list(F.struct("offset", "doc_id", "ids")))
    grouped = joined.groupBy("sequence_id").agg(parts.alias("parts"))
    ids = F.aggregate("parts", F.lit(b""), lambda acc, x: F.concat(acc, x["ids"]))
    return grouped.select("sequence_id", ids.alias("ids"), F.transform("parts", lambda x: x["doc_id"]).alias("doc_ids"))


def pack_documents(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY) -> DataFrame:
    """Tokenise and pack documents: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    See tokenize() and pack() for null, empty and long texts, ties, repeated rows and
    missing ids. An empty table gives an empty table; other columns are left out, whatever
    their names.
    """
    cut = tokenize(docs, vocabulary, capacity)
    light = cut.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"))
    return pack(light, docs.sparkSession, capacity)
