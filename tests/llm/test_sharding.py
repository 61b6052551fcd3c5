import zlib

import pytest

from conspectus.llm import queries, sharding

SCHEMA = "doc_id long, text string, shard_note string"


def balanced(spark, rows, shards, within=1):
    """Every row once, slots gapless, and no shard further from its part than the tolerance and ``within`` of the longest rows."""
    out = sharding.shard(spark.createDataFrame(rows, SCHEMA), shards).toPandas()
    assert sorted(map(str, zip(out.doc_id, out.text, out.shard_note, strict=True))) == sorted(map(str, zip(*spark.createDataFrame(rows, SCHEMA).toPandas().to_dict("list").values(), strict=True)))
    size = out["size"].tolist()
    assert sorted(size) == sorted(len((t or "").encode()) + 16 for _, t, _ in rows)
    by = out.groupby("shard").agg(bytes=("size", "sum"), n=("slot", "count"), top=("slot", "max"), distinct=("slot", "nunique"))
    assert (by.n == by.distinct).all() and (by.top + 1 == by.n).all()
    part = sum(size) / shards
    assert (by.bytes - part).abs().max() <= 2 * (0.001 * part + within * max(size) / 2) + 2
    return out


def test_bytes_are_near_equal_with_a_hot_text(spark):
    rows = [(i, "the same text again" if i % 3 == 0 else f"text {i} " * (i % 17), "x") for i in range(4000)]
    rows += [(-(1 << 63), "low", ""), ((1 << 63) - 1, "the same text again", ""), (None, "the same text again", ""), (5, None, "")]
    out = balanced(spark, rows, 40)
    assert out["shard"].nunique() == 40
    groups = out[out.text.notna()].groupby("text")["shard"]
    assert (groups.max() - groups.min()).drop("the same text again").max() <= 1


def test_repeated_rows_spread_over_all_shards(spark):
    out = balanced(spark, [(1, "copy copy copy", "")] * 400, 40)
    assert out.groupby("shard").size().between(9, 11).all() and out["shard"].nunique() == 40
    rows = [(None, "same", "a")] * 300 + [(2, "copy copy copy", "b")] * 500 + [(i, f"text {i}", "c") for i in range(500)] + [(None, None, "d")] * 50
    assert balanced(spark, rows, 7)["shard"].nunique() == 7


def test_few_rows_empty_table_and_clashing_names(spark):
    docs = spark.createDataFrame([(1, "copy", 99, "s", 7, 1.5)] * 10 + [(2, None, 98, "t", 8, 2.5)], "doc_id long, text string, size int, shard string, __h int, __sub double")
    out = sharding.shard(docs, 4).toPandas()
    assert list(out.columns) == ["doc_id", "text", "__h", "__sub", "size", "shard", "slot"]
    assert set(out["size"]) == {20, 16} and set(out["__h"]) == {7, 8} and set(out["__sub"]) == {1.5, 2.5}
    assert sharding.shard(docs.limit(0), 4).count() == 0
    assert sharding.shard(docs.limit(1), 4).toPandas().slot.tolist() == [0]


def test_fine_ranges_give_gapless_slots(spark, monkeypatch):
    monkeypatch.setattr(sharding, "RANGE_BYTES", 2000)
    balanced(spark, [(i, f"text {i % 50} " * (i % 9), "") for i in range(3000)] + [(1, "text 1", "")] * 2000, 5)


def test_a_very_long_text_is_one_row(spark):
    out = balanced(spark, [(i, "x" * (3_000_000 if i == 7 else i), "") for i in range(100)], 4, within=2)
    assert len(out) == 100


@pytest.mark.parametrize("name", ["op9_histogram_sharding"])
def test_the_query_agrees_with_plain_sizes_and_checksums(spark, sf_dir, name):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    got = queries.QUERIES[name](spark, sf_dir).collect()
    assert sorted(r.doc_id for r in got) == sorted(texts)
    for r in got:
        data = (texts[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(data) + 16, zlib.crc32(data), "bytes", None)
    bytes_of = {}
    for r in got:
        bytes_of[r.shard] = bytes_of.get(r.shard, 0) + r.size
    assert max(bytes_of.values()) <= sum(bytes_of.values()) / 40 + 2 * max(r.size for r in got)
