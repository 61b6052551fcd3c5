"""Time-window state: anchored rate limits and caches with age and size bounds.

One event sequence per client or cache decides its own outcome. In batch the events
are dealt by key and sorted inside their partition, and one pass carries the state of
the key at hand from batch to batch: no key's events are ever held together. In
streams the state is kept by applyInPandasWithState, and ends when it no longer counts.
"""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import lexicons as L

RATE_SCHEMA = "client long, event_id long, allowed boolean"


def _sequenced(rows: DataFrame, key: str, order: list[str], state: Callable[[], Callable], result: str, schema: str) -> DataFrame:
    """Rows dealt by key and passed in order through a fresh state() of each key; its results are added as a column."""
    spark = rows.sparkSession
    names = rows.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, step = object(), None
        for batch in batches:
            t = batch.to_pydict()
            out = []
            for k in range(batch.num_rows):
                row = {c: t[c][k] for c in names}
                if row[key] != current:
                    current, step = row[key], state()
                out.append(step(row))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out)], names=[*names, result])

    kinds = ", ".join(f"{c} {t}" for c, t in rows.dtypes)
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(n, key).sortWithinPartitions(key, *order).mapInArrow(run, f"{kinds}, {result} {schema}")


def rate_limit(events: DataFrame, window_seconds: int = 60, limit: int = 60) -> DataFrame:
    """client, event_id and allowed: a window is anchored at its first request and ends after ``window_seconds``.

    events: client, event_id, seconds (numbers). Anchors depend on each other, so a
    client's events go through one pass in order of time.
    """

    def state() -> Callable:
        anchor, used = None, 0

        def step(row: dict) -> bool:
            nonlocal anchor, used
            if anchor is None or row["seconds"] - anchor > window_seconds:
                anchor, used = row["seconds"], 0
            used += 1
            return used <= limit

        return step

    rows = events.select("client", "event_id", "seconds")
    return _sequenced(rows, "client", ["seconds", "event_id"], state, "allowed", "boolean").select("client", "event_id", "allowed")


def rate_limit_stream(events: DataFrame, window_seconds: int = 60, limit: int = 60) -> DataFrame:
    """The same over a stream: anchor and count are the state of a client, which ends a window after its last batch."""

    def run(key: tuple, parts: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        anchor, used = state.get if state.exists else (None, 0)
        rows = pd.concat(list(parts)).sort_values(["seconds", "event_id"])
        allowed = []
        for s in rows["seconds"]:
            if anchor is None or s - anchor > window_seconds:
                anchor, used = float(s), 0
            used += 1
            allowed.append(used <= limit)
        state.update((anchor, used))
        state.setTimeoutDuration((window_seconds + 1) * 1000)
        yield pd.DataFrame({"client": rows["client"], "event_id": rows["event_id"], "allowed": allowed})

    return events.groupBy("client").applyInPandasWithState(run, RATE_SCHEMA, "anchor double, used long", "append", "ProcessingTimeTimeout")


class Cache:
    """Entries with an age and a size bound; the longest unused goes first."""

    def __init__(self, size: int = 200, ttl_seconds: float = 3600):
        self.size, self.ttl, self.held = size, ttl_seconds, OrderedDict()

    def get(self, key: str, now: float) -> bool:
        """Whether an entry is there and still valid; one that is not is dropped."""
        if key in self.held and self.held[key] > now:
            self.held.move_to_end(key)
            return True
        self.held.pop(key, None)
        return False

    def put(self, key: str, now: float) -> None:
        self.held.pop(key, None)
        while len(self.held) >= self.size:
            self.held.popitem(last=False)
        self.held[key] = now + self.ttl

    def delete(self, key: str) -> bool:
        return self.held.pop(key, None) is not None

    def clear(self) -> None:
        self.held.clear()

    def sweep(self, now: float) -> int:
        """Drop what is no longer valid; returns how many."""
        old = [k for k, e in self.held.items() if e <= now]
        for k in old:
            del self.held[k]
        return len(old)


def configured(kind: str, settings: dict[str, tuple[int, int]] | None = None) -> Cache:
    """The cache of a kind by its settings; an unknown kind has that of videos."""
    settings = settings or L.CACHES
    return Cache(*settings.get(kind, settings["video"]))


def cache_replay(requests: DataFrame, size: int = 200, ttl_seconds: int = 3600) -> DataFrame:
    """cache, event_id and hit for get-or-put requests. requests: cache, key, event_id, seconds."""

    def state() -> Callable:
        cache = Cache(size, ttl_seconds)

        def step(row: dict) -> bool:
            hit = cache.get(row["key"], row["seconds"])
            if not hit:
                cache.put(row["key"], row["seconds"])
            return hit

        return step

    rows = requests.select("cache", "key", "event_id", "seconds")
    return _sequenced(rows, "cache", ["seconds", "event_id"], state, "hit", "boolean").select("cache", "event_id", "hit")


def cache_log(log: DataFrame, settings: dict[str, tuple[int, int]] | None = None) -> DataFrame:
    """cache, event_id, op and result of every operation. log: cache, key, op, event_id, seconds.

    get: 1 for a hit; set: 1; delete: 1 where there was an entry; clear: the entries that
    went; sweep: those that were too old; size: the entries held. A set sweeps first.
    """

    def state() -> Callable:
        cache: Cache | None = None

        def step(row: dict) -> int:
            nonlocal cache
            cache = cache or configured(row["cache"], settings)
            now, op = row["seconds"], row["op"]
            if op == "get":
                return int(cache.get(row["key"], now))
            if op == "set":
                cache.sweep(now)
                cache.put(row["key"], now)
                return 1
            if op == "delete":
                return int(cache.delete(row["key"]))
            if op == "sweep":
                return cache.sweep(now)
            n = len(cache.held)
            if op == "clear":
                cache.clear()
            return n

        return step

    rows = log.select("cache", "key", "op", "event_id", "seconds")
    return _sequenced(rows, "cache", ["seconds", "event_id"], state, "result", "long").select("cache", "event_id", "op", "result")


def cache_stats(replayed: DataFrame) -> DataFrame:
    return replayed.groupBy("cache").agg(F.count_if("hit").alias("hits"), F.count_if(~F.col("hit")).alias("misses"), F.round(F.avg(F.col("hit").cast("int")), 6).alias("hit_rate"))


def log_stats(results: DataFrame) -> DataFrame:
    """Per cache: hits, misses, hit rate of the gets, and sets."""
    get = F.col("op") == "get"
    hits, gets = F.count_if(get & (F.col("result") == 1)), F.count_if(get)
    return results.groupBy("cache").agg(hits.alias("hits"), (gets - hits).alias("misses"), F.round(hits / F.greatest(gets, F.lit(1)), 6).alias("hit_rate"), F.count_if(F.col("op") == "set").alias("sets"))


def expire(entries: DataFrame, now: float) -> DataFrame:
    """Entries that are still valid."""
    return entries.filter(F.col("expires") > now)


def event_windows(events: DataFrame, size: str = "1 hour") -> DataFrame:
    """Events by type and tumbling window; the same plan serves streams after withWatermark."""
    return events.groupBy("event_type", F.window("ts", size).alias("w")).agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("value")).select("event_type", F.col("w.start").alias("begin"), "n", "value")
