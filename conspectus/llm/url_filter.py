"""URL filters by a cascade of Bloom filters with exact answers over the corpus's own keys.

A URL's keys are its host's suffixes joined with its path's prefixes, in the label
counts and path lengths that rules have. Level 1 encodes the listed keys; level 2
the false positives of level 1 among all keys of the corpus; level 3 the listed
keys that level 2 passes; and so on until a level has none. Over that universe the
parity of the first level a key fails is exact membership, so no URL is joined with
the list. A second cascade, over the listed keys themselves, tells blocking rules
from allowing ones. Level 1's error is chosen so that its false positives are about
as many as the listed keys: what is broadcast follows the list, not the corpus.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common
from .bloom import Bloom, bloom
from .text import U

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def member(levels: list[Bloom], one: np.ndarray, two: np.ndarray) -> np.ndarray:
    """Exact membership for keys of the universe the levels were made for."""
    out = np.full(len(one), len(levels) % 2 == 1)
    live = np.arange(len(one))
    for i, level in enumerate(levels):
        ok = level.has(one[live], two[live])
        out[live[~ok]] = i % 2 == 1
        live = live[ok]
    return out


def further_levels(listed: np.ndarray, wrong: np.ndarray, first: int = 2) -> list[Bloom]:
    """Levels after the one whose false positives are ``wrong``; both are (n, 2) hash arrays."""
    levels, encode, against = [], wrong, listed
    while len(encode):
        if len(levels) > 200:
            raise ValueError("two keys have the same hashes")
        levels.append(bloom(encode[:, 0], encode[:, 1], 0.5, first + len(levels)))
        passed = against[levels[-1].has(against[:, 0], against[:, 1])]
        encode, against = passed, encode
    return levels


def hashed(keys: Column) -> tuple[Column, Column]:
    """Two hashes of each key of an array."""
    return F.transform(keys, lambda k: F.xxhash64(k)), F.transform(keys, lambda k: F.xxhash64(k, F.lit("second")))


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.coalesce(F.instr(url, "://"), F.lit(0))
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    host = F.regexp_extract(rest, "^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), "^[^?#]*", 0)
    return F.translate(host, UPPER, LOWER), path


def url_keys(host: Column, path: Column, labels: list[int], lengths: list[int]) -> Column:
    """All keys of a URL that a rule of these label counts and path lengths could equal."""
    parts = F.split(host, r"\.", -1)
    suffixes = F.filter(
        F.array(*[F.when(F.size(parts) >= n, F.array_join(F.slice(parts, F.size(parts) - n + 1, n), ".")) for n in labels]), lambda x: x.isNotNull()
    )
    prefixes = F.filter(F.array(*[F.when(F.length(path) >= n, F.substring(path, 1, n)) for n in lengths]), lambda x: x.isNotNull())
    return F.flatten(F.transform(suffixes, lambda s: F.transform(prefixes, lambda p: F.concat(s, p))))


def _pairs(rows: list) -> np.ndarray:
    return np.array([(r[0], r[1]) for r in rows], np.int64).reshape(-1, 2).view(U)


def judge(pages: DataFrame, rules: list[tuple[str, str, str]], default: str = "allow", key: str = "page_id", url: str = "url") -> DataFrame:
    """key, host, path, rule and verdict of every row.

    rules: (host, path, "allow" or "block"); of equal hosts and paths the last counts. A
    rule fits its host and all subdomains if the URL's path starts with the rule's; the
    longest rule wins, of equally long ones the greater text. Without a fitting rule,
    ``rule`` is null and the verdict is ``default``. A null URL, or one without "://",
    has an empty host and path. Rows that repeat are judged one by one, an empty table
    gives an empty table, other columns are left out. What is broadcast is a few bytes
    for each rule, and so smaller than the list that the caller holds.
    """
    spark = pages.sparkSession
    final = {h.translate(str.maketrans(UPPER, LOWER)) + p: v for h, p, v in rules}
    lengths = sorted({len(p) for _, p, _ in rules}) or [0]
    labels = sorted({h.count(".") + 1 for h, _, _ in rules}) or [1]
    host, path = host_and_path(F.col(url))
    split = pages.select(F.col(key).alias("page_id"), host.alias("host"), path.alias("path"))
    keyed = split.withColumn("keys", url_keys(F.col("host"), F.col("path"), labels, lengths))
    longest = lambda some: F.array_max(F.transform(some, lambda k: F.struct(F.length(k).alias("n"), k.alias("k"))))["k"]
    names = spark.createDataFrame([(k, v) for k, v in final.items()], "key string, said string") if final else spark.createDataFrame([], "key string, said string")
    one, two = hashed(F.array("key"))
    listed = names.select(one[0].alias("one"), two[0].alias("two"), "said").collect()
    wanted = _pairs(listed)
    blocked = _pairs([r for r in listed if r["said"] == "block"])
    allowed = _pairs([r for r in listed if r["said"] != "block"])
    one, two = hashed(F.col("keys"))
    probes = keyed.select("page_id", "host", "path", "keys", one.alias("one"), two.alias("two"))
    levels: list[Bloom] = []
    if len(wanted):
        universe = probes.select(F.explode(F.arrays_zip("one", "two")).alias("k")).select("k.one", "k.two")
        many = universe.agg(F.approx_count_distinct("one")).first()[0]
        first = bloom(wanted[:, 0], wanted[:, 1], min(0.5, len(wanted) / (sqrt(2) * max(many, 1))), 1)
        shared = spark.sparkContext.broadcast(first)

        def passing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                a, b = (common.column(batch, c).to_numpy().view(U) for c in ("one", "two"))
                ok = np.flatnonzero(shared.value.has(a, b))
                found = np.unique(np.stack([a[ok], b[ok]], axis=1), axis=0)
                yield pa.RecordBatch.from_arrays([pa.array(found[:, i].view(np.int64) if len(found) else [], pa.int64()) for i in (0, 1)], names=["one", "two"])

        passed = {(r[0], r[1]) for r in universe.mapInArrow(passing, "one long, two long").distinct().collect()}
        wrong = sorted(passed - {(r["one"], r["two"]) for r in listed})
        levels = [first, *further_levels(wanted, _pairs(wrong))]
    verdicts: list[Bloom] = []
    if len(blocked):
        verdicts = [bloom(blocked[:, 0], blocked[:, 1], 0.5, 301)]
        verdicts += further_levels(blocked, allowed[verdicts[0].has(allowed[:, 0], allowed[:, 1])], 302)
    sent = spark.sparkContext.broadcast((levels, verdicts))

    def test(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        levels, verdicts = sent.value
        for batch in batches:
            lists = common.column(batch, "one")
            a, b = (common.column(batch, c).flatten().to_numpy(zero_copy_only=False).astype(np.int64).view(U) for c in ("one", "two"))
            is_listed = member(levels, a, b) if levels else np.zeros(len(a), bool)
            is_blocked = member(verdicts, a, b) if verdicts else np.zeros(len(a), bool)
            bounds = np.asarray(lists.offsets).astype(np.int64)
            bounds = bounds - bounds[0]
            flags = [common.list_array(x, bounds, pa.bool_()) for x in (is_listed, is_listed & is_blocked)]
            yield pa.RecordBatch.from_arrays([*(common.column(batch, c) for c in ("page_id", "host", "path", "keys")), *flags], names=["page_id", "host", "path", "keys", "listed", "blocked"])

    kind = dict(split.dtypes)["page_id"]
    tested = probes.mapInArrow(test, f"page_id {kind}, host string, path string, keys array<string>, listed array<boolean>, blocked array<boolean>")
    hits = F.transform(F.filter(F.arrays_zip("keys", "listed"), lambda x: x["listed"]), lambda x: x["keys"])
    bad = F.transform(F.filter(F.arrays_zip("keys", "blocked"), lambda x: x["blocked"]), lambda x: x["keys"])
    rule = longest(hits)
    out = tested.select("page_id", "host", "path", rule.alias("rule"), bad.alias("bad"))
    verdict = F.when(F.col("rule").isNull(), default).when(F.array_contains("bad", F.col("rule")), "block").otherwise("allow")
    return out.select("page_id", "host", "path", "rule", verdict.alias("verdict"))
