"""Bloom filters over 64-bit keys: built in numpy, or on the executors from a column of keys."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from math import ceil, log, log2

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .text import U, mix

#: Bits that a filter of a column may have: 64 MB. With more keys it lets more others pass, and stays right.
MAX_BITS = 1 << 29
#: Bits for each key below that: about one in a hundred other keys passes.
KEY_BITS = 10


@dataclass
class Bloom:
    words: np.ndarray
    bits: int
    probes: int
    level: int

    def places(self, one: np.ndarray, two: np.ndarray) -> Iterator[np.ndarray]:
        step = mix(two, self.level) | U(1)
        at = mix(one, self.level)
        for _ in range(self.probes):
            yield at % U(self.bits)
            at = at + step

    def has(self, one: np.ndarray, two: np.ndarray) -> np.ndarray:
        out = np.ones(len(one), bool)
        for at in self.places(one, two):
            out &= (self.words[(at >> U(6)).astype(np.int64)] >> (at & U(63)) & U(1)).astype(bool)
        return out

    def has_key(self, key: np.ndarray) -> np.ndarray:
        return self.has(key, mix(key, 6))


def bloom(one: np.ndarray, two: np.ndarray, error: float, level: int) -> Bloom:
    bits = max(64, ceil(len(one) * log(1 / error) / log(2) ** 2))
    made = Bloom(np.zeros(-(-bits // 64), U), bits, max(1, round(log2(1 / error))), level)
    for at in made.places(one, two):
        np.bitwise_or.at(made.words, (at >> U(6)).astype(np.int64), U(1) << (at & U(63)))
    return made


def of_column(keys: DataFrame, column: str) -> Bloom:
    """A filter of a long column without nulls. Its words are combined on the executors; the driver sees MAX_BITS at most."""
    n = keys.count()
    bits = min(MAX_BITS, max(64, KEY_BITS * n))
    made = Bloom(np.zeros(-(-bits // 64), U), bits, max(1, min(7, round(bits / max(1, n) * log(2)))), 0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = common.column(batch, "key").to_numpy().view(U)
            if not len(own):
                continue
            at = np.concatenate(list(made.places(own, mix(own, 6))))
            word, bit = (at >> U(6)).astype(np.int64), (U(1) << (at & U(63))).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(word), pa.array(bit)], names=["word", "bits"])

    empty, made.words = made.words, np.zeros(0, U)  # the closure needs no words
    words = keys.select(F.col(column).alias("key")).mapInArrow(run, "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
    empty[words["word"].to_numpy()] = words["bits"].to_numpy().view(U)
    made.words = empty
    return made
