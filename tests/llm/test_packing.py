import zlib

import numpy as np
import pyarrow as pa
import pytest

from conspectus.llm import packing, tokens

P = pytest.importorskip("public_tokenizers")
VOCABULARY = P.path("word_bpe_49k.json")


def test_ids_agree_with_the_library(spark, sf_dir):
    texts = [r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    rng = np.random.default_rng(1)
    texts += ["".join(rng.choice(list("aÀé .,!\n\t'1́AsSt-×ßΣ\x1c　"), 30)) for _ in range(500)]
    texts += ["", None, "<|endoftext|>", "a" * 500, "ªº µ ÿß × ÷", "Ã", "x" * 64 + "y", "don't. i's"]
    e = tokens.encoder(VOCABULARY)
    ids, bounds = e.encode(pa.array(texts, pa.string()))
    want = e.library.encode_batch([t or "" for t in texts], add_special_tokens=False)
    for k, w in enumerate(want):
        assert ids[bounds[k] : bounds[k + 1]].tolist() == w.ids, texts[k]


def test_blocks_reach_the_bound_and_keep_every_piece():
    rng = np.random.default_rng(2)
    for sizes in (rng.integers(1, 4096, 800), rng.integers(1000, 1900, 500), np.full(101, 1366), np.array([1]), np.zeros(0, int)):
        bins, offset, fill = packing.pack_block(np.asarray(sizes, np.int64), 4096)
        order = np.lexsort((offset, bins))
        for b in np.unique(bins):
            own = order[bins[order] == b]
            assert (offset[own] == np.cumsum(sizes[own]) - sizes[own]).all() and sizes[own].sum() == fill[own[0]] <= 4096
    small = packing.Bins(rng.integers(1, 900, 2000), 4096)
    small.best_fit()
    small.improve()
    assert np.count_nonzero(small.fill) == small.least()


def test_exchanges_raise_squared_fill():
    rng = np.random.default_rng(4)
    bins = packing.Bins(rng.integers(1200, 1700, 60), 4096)
    bins.bin = np.arange(60) // 2
    bins.fill = np.bincount(bins.bin, bins.sizes).astype(np.int64)
    last = int((bins.fill**2).sum())
    for _ in range(20):
        low = int(np.flatnonzero(bins.fill)[np.argmin(bins.fill[bins.fill > 0])])
        if not bins.exchange(low):
            break
        now = int((bins.fill**2).sum())
        assert now > last and (np.bincount(bins.bin, bins.sizes, minlength=30) == bins.fill).all()
        last = now


def test_pieces_cover_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    odd = spark.createDataFrame([(None, "no id"), (7, None), (10**15, ""), (10**15, "")], "doc_id long, text string")
    out = packing.pack_documents(docs.union(odd), VOCABULARY).toPandas()
    e = tokens.encoder(VOCABULARY)
    for d, t in [(r.doc_id, r.text) for r in docs.limit(20).collect()]:
        ids = np.append(np.array(e.library.encode(t, add_special_tokens=False).ids, "<u4"), np.uint32(1)).astype("<u4")
        if d == 7:
            continue
        own = out[out.doc_id == d].sort_values("piece")
        assert own.length.sum() == len(ids) and own.start.tolist() == list(range(0, len(ids), 4096))
        assert own.ids_crc32.tolist() == [zlib.crc32(ids[a : a + 4096].tobytes()) for a in own.start]
    g = out.sort_values(["sequence_id", "offset"])
    assert (g.offset == g.groupby("sequence_id").length.cumsum() - g.length).all()
    assert g.groupby("sequence_id").length.sum().max() <= 4096
    assert g.sequence_id.nunique() <= -(-g.length.sum() // 4096) + 1
    assert (out.doc_id == 10**15).sum() == 2 and out.doc_id.isna().sum() == 1


def test_empty_table(spark):
    assert packing.pack_documents(spark.createDataFrame([], "doc_id long, text string"), VOCABULARY).count() == 0


def test_sequences_hold_the_ids(spark):
    docs = spark.createDataFrame([(i, "word " * (i + 1)) for i in range(10)], "doc_id long, text string")
    cut = packing.tokenize(docs, VOCABULARY, capacity=16).cache()
    placed = packing.pack(cut.drop("ids"), spark, capacity=16)
    got = packing.sequences(placed, cut).collect()
    assert sum(len(r.ids) // 4 for r in got) == sum(r.length for r in cut.collect()) and max(len(r.ids) for r in got) <= 64
