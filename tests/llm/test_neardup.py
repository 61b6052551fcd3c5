import re

import numpy as np
import pyarrow as pa
import pytest

from conspectus.llm import common, neardup, sketches, text

LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_set(t, k):
    w = WORD.findall((t or "").translate(LOWER))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def brute_rows(rows, k, percent):
    """(doc_id, n_shingles, component_id, kept) of each row, every pair compared; ids may repeat or be missing."""
    sets = [brute_set(t, k) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if a and b and min(len(a), len(b)) * 100 >= percent * max(len(a), len(b)):
                if 100 * len(a & b) >= percent * len(a | b):
                    root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    out = []
    for i, (d, _) in enumerate(rows):
        c = least.get(find(i)) if sets[i] else d
        out.append((d, len(sets[i]), c, d == c))
    return out


def brute(rows, k, percent):
    return {d: (n, c) for d, n, c, _ in brute_rows(rows, k, percent)}


def test_words_and_shingles_agree_with_python():
    texts = ["The  Cat\tsat\non\x0bthe mat", "", None, "É É é", "one", "a b", "Ünï cödé x", "the cat sat on the mat"]
    hashes, rows, _, _ = text.words(pa.array(texts, pa.string()))
    assert np.bincount(rows, minlength=len(texts)).tolist() == [len(WORD.findall(t or "")) for t in texts]
    sets, bounds = text.shingles(hashes, rows, len(texts), 3)
    assert np.diff(bounds).tolist() == [len(brute_set(t, 3)) for t in texts]
    one, two = text.sequence_keys(hashes, rows, len(texts))
    assert one[0] == one[-1] and two[0] == two[-1] and len(set(one.tolist())) == len(texts) - 2


def test_fast_sketch_fills_every_coordinate_and_estimates():
    rng = np.random.default_rng(7)
    sets = [rng.integers(0, 2**63, n).astype(np.uint64) for n in (1, 2, 50, 1000)]
    a = np.unique(np.concatenate([sets[3], sets[2]]))
    every = [*sets, a, np.zeros(0, np.uint64)]
    sk = sketches.fast_sketch(np.concatenate(every), np.concatenate([[0], np.cumsum([len(x) for x in every])]), 128)
    top = np.iinfo(np.uint64).max
    assert (sk[:5] != top).all() and (sk[5] == top).all()
    assert abs((sk[3] == sk[4]).mean() - 1000 / 1050) < 0.1 and (sk[0] == sk[3]).mean() < 0.1


def test_banding_keeps_pairs_at_the_threshold():
    for threshold in (0.8, 0.85):
        rows, count = sketches.banding(threshold, 128)
        assert rows * count <= 128 and (1 - threshold**rows) ** count <= 1e-6


def mutated(rng, words, n):
    words = list(words)
    for at in rng.choice(len(words), n, replace=False):
        words[at] = f"edit{rng.integers(1 << 30)}"
    return " ".join(words)


def fixture_rows():
    rng = np.random.default_rng(3)
    base = [f"w{rng.integers(4000)}" for _ in range(160)]
    rows = [" ".join(base)] * 5 + [mutated(rng, base, int(rng.integers(1, 5))) for _ in range(150)]
    for k in range(30):
        other = [f"w{rng.integers(4000)}" for _ in range(int(rng.integers(4, 90)))]
        rows += [" ".join(other), mutated(rng, other, 1), " ".join(base[:40] + other)]
    rows += ["", None, " \t", "one", "One", "two words", "Two  words", "a b c", "a b d"]
    order = rng.permutation(len(rows))
    return [(int(i) * 3 + 1, rows[j]) for i, j in enumerate(order)]


@pytest.mark.parametrize(("k", "percent"), [(3, 85), (5, 80)])
def test_links_agree_with_brute_force(spark, k, percent):
    rows = fixture_rows()
    docs = spark.createDataFrame([(d, t, "clash", 1) for d, t in rows], "doc_id long, text string, component_id string, bucket int")
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in neardup.link(docs, k, percent).collect()}
    want = {d: (n, c, c == d) for d, (n, c) in brute(rows, k, percent).items()}
    assert got == want


def test_cells_compare_strays_with_all_members(spark, monkeypatch):
    """Buckets of many cells lose no pair."""
    monkeypatch.setattr(neardup, "CELL", 3)
    rows = fixture_rows()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in neardup.link(docs, 3, 85).collect()}
    assert got == brute(rows, 3, 85)


def test_empty_table_nulls_and_repeats(spark):
    schema = "doc_id long, text string"
    assert neardup.link(spark.createDataFrame([], schema)).count() == 0
    rows = [(4, "a b c d e f"), (4, "a b c d e f"), (None, "a b c d e f"), (None, "x y z q r s"), (7, "a b c d e f"), (8, None)]
    got = sorted(neardup.link(spark.createDataFrame(rows, schema)).collect(), key=str)
    assert sorted((str(r.doc_id), str(r.component_id), r.kept) for r in got) == sorted(
        [("4", "4", True), ("4", "4", True), ("None", "4", False), ("None", "None", True), ("7", "4", False), ("8", "8", True)]
    )
    kept = neardup.keep_one(spark.createDataFrame(rows, schema)).collect()
    assert sorted(str(r.doc_id) for r in kept) == ["4", "8", "None"]  # the copy without an id goes


def test_components_of_long_chains(spark):
    edges = [(i, i + 1) for i in range(1, 60)] + [(100, 101), (102, 101), (500, 499)]
    got = neardup.components(spark.createDataFrame(edges, "a long, b long"), common.Workspace(spark))
    root = {r.node: r.root for r in got.collect()}
    assert all(root[i] == 1 for i in range(2, 61)) and root[101] == root[102] == 100 and root[500] == 499


def odd_rows():
    """Repeated and missing ids over unrelated texts, repeated rows, ties, empty and null texts, one long text."""
    rng = np.random.default_rng(11)
    rows = [(int(i) % 40 if i % 7 else None, t) for i, (_, t) in enumerate(fixture_rows())]
    long_text = " ".join(f"w{rng.integers(90000)}" for _ in range(60000))
    return [*rows, (5, long_text), (6, long_text + " tail"), (5, "alone here 1 2 3"), (5, "alone here 1 2 3"), (5, ""), (None, None)]


@pytest.mark.parametrize(("k", "percent"), [(3, 85), (5, 80)])
def test_repeated_and_missing_ids_agree_with_brute_force(spark, k, percent):
    rows = odd_rows()
    got = neardup.link(spark.createDataFrame(rows, "doc_id long, text string"), k, percent).collect()
    assert sorted(map(tuple, got), key=str) == sorted(brute_rows(rows, k, percent), key=str)


def test_one_row_of_each_component_stays(spark):
    """Unrelated texts under one id are different documents; of every component one row stays, whichever ids it has."""
    a, b = " ".join(f"a{i}" for i in range(30)), " ".join(f"b{i}" for i in range(30))
    rows = [(5, a), (5, b), (6, a + " x"), (7, b + " y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(tuple, neardup.keep_one(docs).collect())) == [(5, a), (5, b)]
    rows = [(d, t, n % 3) for n, (d, t) in enumerate(odd_rows())]
    docs = spark.createDataFrame(rows, "doc_id long, text string, key1 int")
    kept = neardup.keep_one(docs, 5, 80).collect()
    marks = brute_rows([(i, t) for i, (_, t, _) in enumerate(rows)], 5, 80)  # components of rows, under distinct ids
    groups = {c for _, n, c, _ in marks if n}
    blank = sum(1 for _, n, _, _ in marks if not n)
    assert len(kept) == len(groups) + blank
    of_text = {}
    for (_, n, c, _), (_, t, _) in zip(marks, rows, strict=True):
        if n:
            of_text[t] = c
    assert {of_text[r.text] for r in kept if r.text in of_text} == groups
    again = neardup.keep_one(docs.orderBy("text"), 5, 80).collect()
    assert sorted(map(str, kept)) == sorted(map(str, again))


def test_recall_on_the_test_documents(spark):
    """Every pair that brute force finds for the ids divisible by 50, against all documents, is in one component."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    rows = [tuple(r) for r in docs.collect()]
    for k, percent in ((3, 85), (5, 80)):
        of = {r.doc_id: r.component_id for r in neardup.link(docs, k, percent).collect()}
        sets = {d: brute_set(t, k) for d, t in rows}
        for d in (d for d, _ in rows if d % 50 == 0):
            for e, other in sets.items():
                if e != d and sets[d] and other and 100 * len(sets[d] & other) >= percent * len(sets[d] | other):
                    assert of[d] == of[e]
        strays = [c for c in of.values() if of[c] != c]
        assert not strays
