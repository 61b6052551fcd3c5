"""Sharding by histogram sort: near-equal bytes from exact counts, and one exchange.

Rows are ordered by a hash of their text and then by doc_id. Splitters are found
without sorting: each round lays probes into the intervals that still hold a
splitter, counts the exact bytes below every probe over all partitions, and narrows
the interval, until what an interval holds is within tolerance or a single key. A
hot text's interval is narrowed by doc_id; rows that repeat both text and id, where
a splitter falls among them, are numbered and split by number. Then rows are
exchanged once: to sub-ranges of their shard that are fine enough to sort in
memory. A slot is the exact count of the shard's rows in lower sub-ranges plus the
row's place in its own. The driver and the plan hold numbers for each shard only.
DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common

#: Probes of the first round, and in each interval of later ones.
FIRST_PROBES, PROBES = 4096, 128
#: Bytes by which a shard may miss its equal part, as a share of the part.
TOLERANCE = 0.001
#: Bytes that one sub-range of the exchange should hold at most.
RANGE_BYTES = 128 << 20
#: Bits of the text hash that order rows; exact in a double.
HASH_BITS = 48
_LOW = -(1 << 63)

#: A splitter: text hash, id, and how many rows of exactly this key lie below it.
Splitter = tuple[int, int, int]


def _long(x: int) -> Column:
    return F.lit(x).cast("long")


def _pick(values: list[int], at: Column) -> Column:
    """values[at], from one constant array."""
    return F.element_at(F.array(*[_long(v) for v in values]), at + 1)


def _below(splitters: list[Splitter], h: Column, id_: Column, number: Column | None = None) -> Column:
    """How many splitters are at or below the row; number is its place among the rows of its key."""
    if not splitters:
        return F.lit(0)
    number = _long(0) if number is None else number
    rows = F.array(*[F.struct(_long(a).alias("a"), _long(b).alias("b"), _long(n).alias("n")) for a, b, n in splitters])
    same = lambda s: (s["b"] < id_) | ((s["b"] == id_) & (s["n"] <= number))
    return F.size(F.filter(rows, lambda s: (s["a"] < h) | ((s["a"] == h) & same(s))))


def splitters(keyed: DataFrame, parts: int, tolerance: float = TOLERANCE) -> list[Splitter]:
    """Keys (h, id, n) that cut the rows into ``parts`` ranges of near-equal bytes.

    keyed: h (0 to 2**48), id, size. n is above 0 only where a splitter falls among the
    rows of one key. The driver sees counts of probes only: at most FIRST_PROBES, and
    then PROBES for each splitter and round.
    """
    total = keyed.agg(F.sum("size")).first()[0] or 0
    if not total or parts < 2:
        return []
    goal = [total * (k + 1) // parts for k in range(parts - 1)]
    slack = max(1, int(tolerance * total / parts))

    def histogram(column: str, spans: list[tuple[int, int, int]]) -> dict[int, list[tuple[int, int, int, int]]]:
        """For each span (h or -1, from, to) its probe intervals with rows: exact bytes, least and greatest key, rows."""
        probes = FIRST_PROBES if len(spans) == 1 else PROBES
        ends = [(a, _LOW, 0) if column == "h" else (h, a, 0) for h, a, _ in spans]
        tagged = keyed.withColumn("span", _below(ends, F.col("h"), F.col("id")) - 1).filter("span >= 0")
        a, b = (_pick([s[i] for s in spans], F.col("span")) for i in (1, 2))
        tagged = tagged.filter((F.col(column) >= a) & (F.col(column) < b))
        if column == "id":
            tagged = tagged.filter(F.col("h") == _pick([s[0] for s in spans], F.col("span")))
        step = _pick([max(1, -(-(s[2] - s[1]) // probes)) for s in spans], F.col("span"))
        # the offset is taken in decimals, since ids may span all 64 bits
        offset = (F.col(column).cast("decimal(20,0)") - a.cast("decimal(20,0)")) if column == "id" else F.col(column) - a
        cell = F.floor(offset / step).cast("long")
        got = tagged.groupBy("span", cell.alias("cell")).agg(F.sum("size").alias("bytes"), F.min(column).alias("lo"), F.max(column).alias("hi"), F.count("*").alias("n")).collect()
        out: dict[int, list] = {}
        for r in sorted(got, key=lambda r: (r["span"], r["cell"])):
            out.setdefault(r["span"], []).append((r["bytes"], r["lo"], r["hi"], r["n"]))
        return out

    def search(column: str, wanted: dict[int, tuple[int, int, int, int]]) -> tuple[dict[int, Splitter], dict[int, tuple[int, int]]]:
        """Splitters by number, and for texts that one stands in: number -> (h, bytes below h).

        wanted: number -> (h, from, to, bytes below from).
        """
        cuts: dict[int, Splitter] = {}
        inside: dict[int, tuple[int, int]] = {}
        key = lambda h, x: (x, _LOW, 0) if column == "h" else (h, x, 0)
        while wanted:
            spans = sorted({(h, a, b) for h, a, b, _ in wanted.values()})
            cells, following = histogram(column, spans), {}
            for k, (h, a, b, under) in wanted.items():
                done = under
                for size, lo, hi, n in cells.get(spans.index((h, a, b)), []):
                    if done + size < goal[k] - slack:
                        done += size
                        continue
                    if abs(done - goal[k]) <= slack:
                        cuts[k] = key(h, lo)
                    elif abs(done + size - goal[k]) <= slack:
                        cuts[k] = key(h, hi + 1)
                    elif lo < hi:
                        following[k] = (h, lo, hi + 1, done)
                    elif column == "h":
                        inside[k] = (lo, done)
                    else:  # rows of one key are alike, so as many as the goal takes lie below
                        m = round((goal[k] - done) * n / size)
                        cuts[k] = (h, lo, m) if m < n else key(h, hi + 1)
                    break
                else:
                    cuts[k] = key(h, b)
            wanted = following
        return cuts, inside

    cuts, hot = search("h", {k: (-1, 0, (1 << HASH_BITS) + 1, 0) for k in range(len(goal))})
    if hot:
        ends = keyed.filter(F.col("h").isin(sorted({h for h, _ in hot.values()}))).groupBy("h").agg(F.min("id").alias("lo"), F.max("id").alias("hi")).collect()
        ends = {r["h"]: (r["lo"], min(r["hi"], (1 << 63) - 2) + 1) for r in ends}
        cuts |= search("id", {k: (h, *ends[h], under) for k, (h, under) in hot.items()})[0]
    return sorted(cuts.values())


def shard(docs: DataFrame, shards: int, text: str = "text", key: str = "doc_id", extra_bytes: int = 16) -> DataFrame:
    """Add size, shard (0 to shards - 1) and slot (gapless from 0 in each shard) to documents.

    Size is the text's UTF-8 bytes (none for null) plus ``extra_bytes``. Shards have
    near-equal bytes, as far as single rows allow, whatever repeats: a missing key counts
    as the lowest, and rows that repeat text and key are dealt one by one, in any order.
    Very long texts are one row like others. An empty table gives an empty table. Columns
    of the names size, shard and slot are replaced; all others stay, whatever their names.
    """
    work = common.Workspace(docs.sparkSession)
    hash_, id_, sub, row, place, before = (common.free([*docs.columns, "size", "shard", "slot"], f"__{c}") for c in ("h", "id", "sub", "row", "place", "before"))
    value = F.coalesce(F.col(text), F.lit(""))
    own = {
        hash_: F.shiftrightunsigned(F.xxhash64(value), 64 - HASH_BITS),
        id_: F.coalesce(F.col(key), _long(_LOW)).cast("long"),
        "size": (F.octet_length(value) + extra_bytes).cast("long"),
    }
    keyed = docs.withColumns(own)
    light = work.save(keyed.select(F.col(hash_).alias("h"), F.col(id_).alias("id"), "size"), "keys")
    total = light.agg(F.sum("size")).first()[0] or 0
    fine = max(1, -(-total // (shards * RANGE_BYTES)))
    cuts = splitters(light, shards)
    ties = sorted({(a, b) for a, b, n in cuts if n > 0})
    tie_keys = F.array(*[F.struct(_long(a).alias("a"), _long(b).alias("b")) for a, b in ties])
    tied = lambda h, i: F.array_contains(tie_keys, F.struct(h.alias("a"), i.alias("b"))) if ties else F.lit(False)

    def numbered(df: DataFrame, h: str, i: str) -> DataFrame:
        at = _below(cuts, F.col(h), F.col(i)).cast("int")
        return df.withColumns({"shard": at, sub: F.pmod(F.xxhash64(h, i), _long(fine))})

    # rows of lower sub-ranges: a number for each sub-range, joined on the exchange's own key
    counts = numbered(light.filter(~tied(F.col("h"), F.col("id"))), "h", "id").groupBy("shard", sub).agg(F.count("*").alias("n"))
    counts = work.save(counts, "counts")
    lower = F.coalesce(F.sum("n").over(Window.partitionBy("shard").orderBy(sub).rowsBetween(Window.unboundedPreceding, -1)), _long(0))
    lower = counts.select("shard", sub, lower.alias(before))
    plain = numbered(keyed.filter(~tied(F.col(hash_), F.col(id_))), hash_, id_)
    order = Window.partitionBy("shard", sub).orderBy(hash_, id_)
    plain = plain.withColumn(place, F.row_number().over(order) - 1).join(lower, ["shard", sub])
    columns = [*(c for c in docs.columns if c.lower() not in ("size", "shard", "slot")), "size", "shard", "slot"]
    out = plain.withColumn("slot", F.col(place) + F.col(before)).select(columns)
    if not ties:
        work.keep(counts)
        return out

    # rows of the keys that a splitter divides get numbers, which are stored with them
    rows = work.save(keyed.filter(tied(F.col(hash_), F.col(id_))).withColumns({row: F.monotonically_increasing_id(), sub: F.spark_partition_id()}), "ties")
    tie = F.array_position(tie_keys, F.struct(F.col(hash_).alias("a"), F.col(id_).alias("b"))).cast("int") - 1
    rows = rows.withColumn(place, tie)
    by_task = rows.groupBy(place, sub).agg(F.count("*").alias("n"))
    running = F.coalesce(F.sum("n").over(Window.partitionBy(place).orderBy(sub).rowsBetween(Window.unboundedPreceding, -1)), _long(0))
    rows = rows.join(by_task.select(place, sub, running.alias(before)), [place, sub])
    number = F.col(before) + F.row_number().over(Window.partitionBy(place, sub).orderBy(row)) - 1
    rows = rows.withColumn(row, number)
    filled = {r["shard"]: r["n"] for r in counts.groupBy("shard").agg(F.sum("n").alias("n")).collect()}
    many = {r["t"]: r["n"] for r in rows.groupBy(F.col(place).alias("t")).agg(F.count("*").alias("n")).collect()}
    pieces = []  # of each divided key: tie, from, to, shard, slot of the first
    for t, (a, b) in enumerate(ties):
        first = sum(c <= (a, b, 0) for c in cuts)
        ends = [n for h, i, n in cuts if (h, i) == (a, b) and n > 0]
        for at, (start, stop) in enumerate(zip([0, *ends], [*ends, many.get(t, 0)], strict=True)):
            pieces.append((t, start, stop, first + at, filled.get(first + at, 0)))
            filled[first + at] = filled.get(first + at, 0) + stop - start
    known = F.array(*[F.struct(*[_long(v).alias(c) for c, v in zip("tabsf", p, strict=True)]) for p in pieces])
    own_piece = F.filter(known, lambda p: (p["t"] == F.col(place)) & (p["a"] <= F.col(row)) & (p["b"] > F.col(row)))[0]
    rows = rows.withColumn(sub, own_piece)
    rows = rows.withColumns({"shard": F.col(sub)["s"].cast("int"), "slot": F.col(sub)["f"] + F.col(row) - F.col(sub)["a"]})
    work.drop(light)
    return out.unionByName(rows.select(columns))
