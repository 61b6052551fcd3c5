"""Every stage of the pipeline against a plain version, and the whole run against its stages."""

import numpy as np
import pytest

from conspectus.llm import toxicity

from .test_neardup import brute
from .test_pii import brute as spans

pipeline = pytest.importorskip("corpus_pipeline")
P = pytest.importorskip("public_tokenizers")


def test_stages_and_run(spark, sf_dir):
    from tokenizers import Tokenizer

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, stages = docs.columns, dict(pipeline.STAGES)
    assert list(stages) == ["toxicity", "near_duplicates", "decontamination", "personal_data", "packing"]

    toxic = {r.doc_id for r in toxicity.classify(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")).filter("toxic").collect()}
    one = stages["toxicity"](spark, docs, sf_dir).cache()
    assert one.columns == columns and {r.doc_id for r in one.collect()} == {r.doc_id for r in docs.collect()} - toxic

    two = stages["near_duplicates"](spark, one, sf_dir).cache()
    rows = [(r.doc_id, r.text) for r in one.collect()]
    assert two.columns == columns and {r.doc_id for r in two.collect()} == {c for _, c in brute(rows, 5, 80).values()}

    three = stages["decontamination"](spark, two, sf_dir).cache()
    items = [r.text for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    kept = {r.doc_id for r in three.collect()}
    assert three.columns == columns and kept == {r.doc_id for r in two.collect() if not any(i in r.text for i in items)}

    four = stages["personal_data"](spark, three, sf_dir).cache()
    redacted = {r.doc_id: r for r in four.collect()}
    assert four.columns == columns and set(redacted) == kept
    for r in three.collect():
        assert (redacted[r.doc_id].text == r.text) or spans(r.text) or "<" in redacted[r.doc_id].text
        assert not spans(redacted[r.doc_id].text) and redacted[r.doc_id].n_chars == len(redacted[r.doc_id].text)

    five = stages["packing"](spark, four, sf_dir).toPandas()
    library = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    library.encode_special_tokens = True
    want = {d: len(library.encode(r.text, add_special_tokens=False).ids) + 1 for d, r in redacted.items()}
    assert five.groupby("doc_id").length.sum().to_dict() == want
    assert five.groupby("sequence_id").length.sum().max() <= 4096
    assert five.sequence_id.nunique() <= -(-sum(want.values()) // 4096) + 1

    run = pipeline.run(spark, sf_dir).toPandas()
    key = ["doc_id", "piece", "start", "length", "ids_crc32"]
    assert np.array_equal(run.sort_values(key)[key].to_numpy(), five.sort_values(key)[key].to_numpy())
