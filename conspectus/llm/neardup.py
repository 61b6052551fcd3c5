"""MinHash near-duplicate detection with fast similarity sketches, banding and exact verification.

One Arrow pass turns every whole text into a key of its word sequence, its number
of distinct shingles, a sketch and band hashes. Equal sequences form a class with a
number of its own (ids may repeat or be missing), and only classes take part from
there on. Within a bucket (classes that agree in a
band) the class that meets most others leads. Each class is verified against the
leader of one of its buckets, and then, round by round, one class of each component
of a bucket against the leader of its largest: large groups are joined with about
as many pairs as members. What a bucket still holds apart after that is compared
in cells of bounded size: classes outside the bucket's largest component against
all of its members, first by set sizes and whole sketches, then on full shingle
sets. No bucket is capped and no pair of copies is written out. Components come from alternating large-star and small-star steps.

Joins with hot keys are plain shuffle joins between stored tables, which adaptive
execution splits; aggregates combine before their shuffle.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import bloom, common, sketches, text

SKETCH = 256
#: Coordinates that bands are made of.
BANDED = 128
#: Classes on either side of a cell, on average.
CELL = 512
#: Estimates so many standard deviations below the threshold are not verified.
DEVIATIONS = 5
#: Rounds that join components by their leaders before the rest is compared in cells.
ROUNDS = 3

#: Stands for a missing doc_id.
NO_ID = -(1 << 63)

Sketcher = Callable[[np.ndarray, np.ndarray], np.ndarray]


def _fss(sets: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    return sketches.fast_sketch(sets, bounds, SKETCH)


def profile(docs: DataFrame, words: int, rows: int, count: int, sketcher: Sketcher = _fss) -> DataFrame:
    """doc_id, key1, key2 (equal for equal word sequences), n_shingles, sketch (a byte per coordinate), bands."""
    common.small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in common.slices(batch):
                n = part.num_rows
                hashes, row, _, _ = text.words(common.column(part, "text"))
                one, two = text.sequence_keys(hashes, row, n)
                sets, bounds = text.shingles(hashes, row, n, words)
                full = sketcher(sets, bounds)
                own = sketches.bands(full, rows, count)
                low = np.ascontiguousarray((text.mix(full, 3) & text.U(255)).astype(np.uint8))
                size = np.diff(bounds)
                cuts = np.concatenate([[0], np.cumsum(np.where(size > 0, count, 0))])
                yield pa.RecordBatch.from_arrays(
                    [
                        common.column(part, "doc_id"), pa.array(one.view(np.int64)), pa.array(two.view(np.int64)), pa.array(size),
                        pa.array([x.tobytes() for x in low], pa.binary()), common.list_array(own[size > 0].reshape(-1).view(np.int64), cuts, pa.int64()),
                    ],
                    names=["doc_id", "key1", "key2", "n_shingles", "sketch", "bands"],
                )

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, key1 long, key2 long, n_shingles long, sketch binary, bands array<long>")


def _named(ids: pa.Array) -> np.ndarray:
    return pc.fill_null(ids, NO_ID).to_numpy()


def shingle_sets(docs: DataFrame, wanted: DataFrame, words: int) -> DataFrame:
    """rep and hashed shingles, ascending, of the wanted classes (rep, doc_id of one of its rows, key1, key2).

    A Bloom filter of the ids goes to the texts, so no other text leaves its task; the few
    other documents that it lets pass are dropped by the join on the keys.
    """
    spark = docs.sparkSession
    common.small_batches(spark)
    sent = spark.sparkContext.broadcast(bloom.of_column(wanted.select(F.coalesce("doc_id", F.lit(NO_ID)).alias("id")), "id"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filter_ = sent.value
        for batch in batches:
            batch = batch.filter(pa.array(filter_.has_key(_named(common.column(batch, "doc_id")).view(text.U))))
            for part in common.slices(batch):
                hashes, row, _, _ = text.words(common.column(part, "text"))
                keys = [pa.array(k.view(np.int64)) for k in text.sequence_keys(hashes, row, part.num_rows)]
                sets, bounds = text.shingles(hashes, row, part.num_rows, words)
                ids = pa.array(_named(common.column(part, "doc_id")))
                yield pa.RecordBatch.from_arrays([ids, *keys, common.list_array(sets.view(np.int64), bounds, pa.int64())], names=["id", "key1", "key2", "shingles"])

    found = docs.select("doc_id", "text").mapInArrow(run, "id long, key1 long, key2 long, shingles array<long>")
    own = wanted.select("rep", F.coalesce("doc_id", F.lit(NO_ID)).alias("id"), "key1", "key2")
    # rows that repeat id and text give their class's set more than once
    return found.join(own, ["id", "key1", "key2"]).select("rep", "shingles").dropDuplicates(["rep"])


def components(edges: DataFrame, work: common.Workspace) -> DataFrame:
    """Node and the smallest node of its component, for undirected edges (a, b) with a <> b.

    Isolated nodes are left out. The number of rounds grows with the logarithm of
    the largest component, and the table of edges never grows.
    """
    now = work.save(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    mark = None
    while True:
        both = now.select("u", "v").unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = work.save(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "large")
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        large = work.save(large, "large-star")
        least_of = work.save(large.groupBy("u").agg(F.min("v").alias("m")), "small")
        small = large.join(least_of, "u")
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").unionByName(least_of.select("u", F.col("m").alias("v")))
        after = work.save(small.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "small-star")
        seen = tuple(after.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first())
        for old in (now, least, large, least_of):
            work.drop(old)
        now = after
        if seen == mark:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
        mark = seen


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) whose full sets are similar enough."""
    left = pairs.join(sets.select(F.col("rep").alias("b"), F.col("shingles").alias("sb")), "b")
    both = left.join(sets.select(F.col("rep").alias("a"), F.col("shingles").alias("sa")), "a")
    common_ = F.size(F.array_intersect("sa", "sb"))
    union = F.size("sa") + F.size("sb") - common_
    return both.filter(100 * common_ >= percent * union).select("a", "b")


def _cells(members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Verified links across components, from members of buckets that are still apart.

    members: bucket, rep, comp, size (of its set), sketch, n (bucket size), strays (members outside the
    largest component), stray, band (the bucket's number) and bands. A stray meets every
    member in cells of bounded size; a pair counts in the first band that it shares,
    and so once. Cells whose sketches propose pairs get the full sets of just those
    members; what leaves a cell is a link only where it joins two components.
    """
    share = percent / 100
    least = share - DEVIATIONS * (share * (1 - share) / SKETCH) ** 0.5
    chunk = lambda n, seed: F.pmod(F.xxhash64("rep", F.lit(seed)), n)
    wide = F.greatest(F.lit(1), F.ceil(F.col("n") / CELL)).cast("long")
    high = F.greatest(F.lit(1), F.ceil(F.col("strays") / CELL)).cast("long")
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), n - 1))
    one = members.select("*", chunk(wide, 1).alias("j")).select("*", every(high).alias("i"))
    two = members.filter("stray").select("*", chunk(high, 2).alias("i")).select("*", every(wide).alias("j"))
    columns = ["rep", "comp", "size", "sketch", "band", "bands"]
    cell = F.xxhash64("bucket", "i", "j").alias("cell")
    dealt = one.select(cell, F.lit(False).alias("asks"), *columns).unionByName(two.select(cell, F.lit(True).alias("asks"), *columns))
    dealt = dealt.repartition("cell").sortWithinPartitions("cell", "asks")

    def partners(t: pa.Table) -> pa.RecordBatch | None:
        rep, comp = t["rep"].to_numpy(), t["comp"].to_numpy()
        asks = t["asks"].to_numpy().astype(bool)
        sk = np.frombuffer(b"".join(t["sketch"].to_pylist()), np.uint8).reshape(len(rep), -1)
        size, band = t["size"].to_numpy(), int(t["band"][0].as_py())
        bands = t["bands"].combine_chunks().flatten().to_numpy().reshape(len(rep), -1)
        have, found = np.flatnonzero(~asks), {}
        for x in np.flatnonzero(asks):
            fits = have[(comp[have] != comp[x]) & (100 * np.minimum(size[have], size[x]) >= percent * np.maximum(size[have], size[x]))]
            fits = fits[~(bands[fits, :band] == bands[x, :band]).any(axis=1)]
            hit = fits[(sk[fits] == sk[x]).mean(axis=1) >= least]
            if len(hit):
                found[int(rep[x])] = rep[hit].tolist()
        if not found:
            return None
        names = sorted({*found, *(r for own in found.values() for r in own)})
        lists = [found.get(r, []) for r in names]
        comps = dict(zip(rep.tolist(), comp.tolist(), strict=True))
        cell = pa.array([t["cell"][0].as_py()] * len(names), pa.int64())
        return pa.RecordBatch.from_arrays([cell, pa.array(names, pa.int64()), pa.array([comps[r] for r in names], pa.int64()), pa.array(lists, pa.list_(pa.int64()))], names=["cell", "rep", "comp", "partners"])

    def propose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _groups(batches):
            if (out := partners(t)) is not None:
                yield out

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _groups(batches):
            rep, lists = t["rep"].to_pylist(), t["partners"].to_pylist()
            own = t["shingles"].combine_chunks()
            bounds, flat = np.asarray(own.offsets), own.values.to_numpy()
            sets = {r: flat[bounds[k] : bounds[k + 1]].view(text.U) for k, r in enumerate(rep)}
            root = dict(zip(rep, t["comp"].to_pylist(), strict=True))
            up = {c: c for c in root.values()}

            def find(c: int, up: dict = up) -> int:
                while up[c] != c:
                    c = up[c]
                return c

            edges = []
            for x, others in zip(rep, lists, strict=True):
                for y in others or ():
                    one, two = find(root[x]), find(root[y])
                    if one == two:
                        continue
                    small, large = sorted((sets[x], sets[y]), key=len)
                    at = np.minimum(np.searchsorted(large, small), len(large) - 1)
                    both = int((large[at] == small).sum())
                    if 100 * both >= percent * (len(small) + len(large) - both):
                        up[max(one, two)] = min(one, two)
                        edges.append((min(x, y), max(x, y)))
            if edges:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*edges, strict=True)], names=["a", "b"])

    asked = dealt.mapInArrow(propose, "cell long, rep long, comp long, partners array<long>")
    full = asked.join(sets, "rep")
    return full.repartition("cell").sortWithinPartitions("cell", "rep").mapInArrow(verify, "a long, b long").distinct()


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows of each cell, from batches that are sorted by cell."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        cells = common.column(batch, "cell").to_numpy()
        cuts = [0, *(np.flatnonzero(np.diff(cells)) + 1).tolist(), len(cells)]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            if b <= a:
                continue
            if held and cells[a] != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
            last = cells[a]
    if held:
        yield pa.Table.from_batches(held)


def linked(docs: DataFrame, words: int = 5, percent: int = 80, sketcher: Sketcher = _fss) -> DataFrame:
    """One row per document: doc_id, key1, key2, n_shingles, root (the number of its component) and least (its smallest doc_id).

    key1 and key2 are equal for equal word sequences. root and least are null for a document
    without words, which is linked with nothing.
    """
    spark = docs.sparkSession
    work = common.Workspace(spark)
    rows, count = sketches.banding(percent / 100, BANDED)
    profiled = work.save(profile(docs, words, rows, count, sketcher), "profiles")
    keys = ["key1", "key2"]
    filled = profiled.filter("n_shingles > 0")
    # numbers are stored with the classes, so that all later steps see the same
    grouped = filled.groupBy(*keys).agg(F.min("doc_id").alias("doc_id"), F.first("sketch").alias("sketch"), F.first("n_shingles").alias("n_shingles"), F.first("bands").alias("bands"))
    classes = work.save(grouped.select(F.monotonically_increasing_id().alias("rep"), "*"), "classes")
    exploded = classes.select("rep", F.posexplode("bands").alias("band", "bucket"))
    multi = work.save(exploded.groupBy("bucket").agg(F.count("*").alias("n")).filter("n > 1"), "buckets")
    plain = work.save(exploded.join(multi, "bucket"), "members")
    weight = plain.groupBy("rep").agg(F.sum("n").alias("weight"))
    members = work.save(plain.join(weight, "rep"), "weighed")
    work.drop(multi, plain)
    leaders = work.save(members.groupBy("bucket").agg(F.max(F.struct("weight", "rep")).alias("leader")), "leaders")
    led = members.join(leaders, "bucket").groupBy("rep").agg(F.max("leader")["rep"].alias("leader")).filter("rep <> leader")
    star = work.save(led.select(F.least("rep", "leader").alias("a"), F.greatest("rep", "leader").alias("b")).distinct(), "star")
    work.drop(leaders)
    sketch = classes.select("rep", F.col("n_shingles").alias("size"), "sketch", "bands")
    wanted = work.save(classes.select("rep", "doc_id", *keys).join(members.select("rep").distinct(), "rep", "left_semi"), "wanted")
    sets = work.save(shingle_sets(docs, wanted, words), "sets")
    work.drop(wanted)
    roots = components(_verified(star, sets, percent), work)
    tried = star
    for _ in range(ROUNDS):
        placed = members.join(roots.select(F.col("node").alias("rep"), "root"), "rep", "left")
        placed = work.save(placed.select("bucket", "band", "rep", "weight", F.coalesce("root", "rep").alias("comp")), "placed")
        tops = work.save(placed.groupBy("bucket", "comp").agg(F.count("*").alias("c"), F.max(F.struct("weight", "rep")).alias("top")), "tops")
        mains = tops.groupBy("bucket").agg(F.max(F.struct("c", "top.weight", "top.rep", "comp")).alias("main"), F.sum("c").alias("n"), F.count("*").alias("comps"))
        apart = work.save(mains.filter("comps > 1").select("bucket", F.col("main.comp").alias("main"), F.col("main.rep").alias("leader"), "n", (F.col("n") - F.col("main.c")).alias("strays")), "apart")
        proposed = tops.join(apart.select("bucket", "main", "leader"), "bucket").filter("comp <> main").select(F.least("top.rep", "leader").alias("a"), F.greatest("top.rep", "leader").alias("b"))
        fresh = work.save(proposed.distinct().join(tried, ["a", "b"], "left_anti"), "leader-pairs")
        more = work.save(_verified(fresh, sets, percent), "leader-edges")
        work.drop(tops)
        if more.isEmpty():
            break
        tried = tried.unionByName(fresh)
        roots = components(roots.select(F.col("node").alias("a"), F.col("root").alias("b")).filter("a <> b").unionByName(more), work)
    # what a bucket still holds apart; a component of the last round may have grown since, which costs a comparison at most
    still = placed.select("bucket", "band", "rep", "comp").join(apart.drop("leader"), "bucket")
    still = still.select("bucket", "band", "rep", "comp", "n", "strays", (F.col("comp") != F.col("main")).alias("stray")).join(sketch, "rep")
    extra = work.save(_cells(still, sets, percent), "more-edges")
    final = roots
    if not extra.isEmpty():
        final = components(roots.select(F.col("node").alias("a"), F.col("root").alias("b")).filter("a <> b").unionByName(extra), work)
    rooted = classes.select(*keys, "rep", "doc_id").join(final.select(F.col("node").alias("rep"), "root"), "rep", "left")
    rooted = work.save(rooted.select(*keys, "doc_id", F.coalesce("root", "rep").alias("root")), "roots")
    # smallest ids are found among classes, so documents meet their component in one join on their keys
    least = rooted.groupBy("root").agg(F.min("doc_id").alias("least"))
    named = work.save(rooted.drop("doc_id").join(least, "root").select(*keys, "root", "least"), "components")
    work.keep(profiled, named)
    return profiled.select("doc_id", *keys, "n_shingles").join(named, keys, "left")


def link(docs: DataFrame, words: int = 5, percent: int = 80, sketcher: Sketcher = _fss) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept.

    Links documents whose sets of ``words``-word shingles have 100 * |A n B| >=
    percent * |A u B|. A null or empty text has no shingle and is linked with
    nothing; fewer words than a shingle count as one shingle. component_id is the
    smallest doc_id of the component. Documents without an id take part like others:
    they are kept where their component has no id at all. Different texts under one
    id are different documents, and repeated rows stay repeated; all rows of the
    smallest id are marked as kept (keep_one() keeps one of them). Long texts are
    taken whole. An empty table gives an empty table. Other columns, whatever their
    names, are left out.
    """
    out = linked(docs, words, percent, sketcher)
    component = F.when(F.col("root").isNotNull(), F.col("least")).otherwise(F.col("doc_id"))
    kept = F.coalesce(F.col("doc_id") == component, component.isNull())
    return out.select("doc_id", "n_shingles", component.alias("component_id"), kept.alias("kept"))


def keep_one(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """The documents that stay: one row of each component of near copies, with all columns.

    The row with the smallest id stays (a missing id comes last); of several that with the
    least hash of its words, then of its text, then of its other columns. Null and empty
    texts have no near copies and all stay, in every row. An empty table gives an empty
    table. A Bloom filter tells apart the rows that surely have no near copy: they stay
    where they are, and only the others are shuffled to meet their component's decision.
    """
    spark = docs.sparkSession
    work = common.Workspace(spark)
    found = linked(docs, words, percent).filter("root is not null").withColumn("id", F.coalesce("doc_id", F.lit(NO_ID)))
    row = F.struct(F.col("doc_id").isNull().alias("last"), "id", "key1", "key2")
    many = found.groupBy("root").agg(F.count("*").alias("n"), F.min(row).alias("best")).filter("n > 1").select("root", "best")
    once = found.groupBy("root", "doc_id", "id", "key1", "key2").agg(F.count("*").alias("n"))
    decided = work.save(once.join(many, "root").select("id", "key1", "key2", (row == F.col("best")).alias("wins")), "decided")
    sent = spark.sparkContext.broadcast(bloom.of_column(decided.select("id").distinct(), "id"))
    common.small_batches(spark)
    key1, key2, wins, place = (common.free(docs.columns, f"__{c}") for c in ("key1", "key2", "wins", "place"))

    def split(batch: pa.RecordBatch, touched: bool) -> pa.RecordBatch:
        hit = sent.value.has_key(_named(common.column(batch, "doc_id")).view(text.U))
        return batch.filter(pa.array(hit == touched))

    def untouched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield split(batch, False)

    def touched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in common.slices(split(batch, True)):
                hashes, rows, _, _ = text.words(common.column(part, "text"))
                keys = [pa.array(k.view(np.int64)) for k in text.sequence_keys(hashes, rows, part.num_rows)]
                yield pa.RecordBatch.from_arrays([*part.columns, *keys], names=[*part.schema.names, key1, key2])

    schema = T.StructType([*docs.schema.fields, T.StructField(key1, T.LongType()), T.StructField(key2, T.LongType())])
    rest = docs.mapInArrow(touched, schema)
    verdict = decided.select(F.col("id").alias(place), F.col("key1").alias(key1), F.col("key2").alias(key2), F.col("wins").alias(wins))
    rest = rest.withColumn(place, F.coalesce("doc_id", F.lit(NO_ID))).join(verdict, [place, key1, key2], "left").filter(F.coalesce(wins, F.lit(True)))
    # rows of one id and word sequence: the first stays of those that a decision names
    first = Window.partitionBy(place, key1, key2, wins).orderBy(F.xxhash64("text"), F.xxhash64(*docs.columns))
    number = common.free([*docs.columns, place, key1, key2, wins], "__n")
    rest = rest.withColumn(number, F.row_number().over(first)).filter(F.col(wins).isNull() | (F.col(number) == 1))
    return docs.mapInArrow(untouched, docs.schema).unionByName(rest.select(docs.columns))


def near_duplicates(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """Three-word shingles at a similarity of 0.85."""
    return link(docs, 3, 85)
