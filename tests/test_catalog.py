import json

import pytest

from conspectus.sources import catalog


@pytest.fixture(scope="module")
def concepts(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("catalogue")
    one = [{"concept_id": "a", "representations": {"en": ["Wave", ""]}, "prerequisites": ["b", "gone"]}, {"concept_id": "a", "representations": {"en": ["Wave Function"]}, "prerequisites": ["b", "gone"]}]
    (folder / "physics.jsonl").write_text("# comment\n\n{broken\n" + json.dumps({"representations": {}}) + "\n" + "\n".join(map(json.dumps, one)) + "\n")
    (folder / "mathematics.jsonl").write_text(json.dumps({"concept_id": "b", "representations": {"en": ["Sum"], "ru": ["Сумма"]}, "related": ["a"]}) + "\n")
    return catalog.load(spark, f"file://{folder}/*.jsonl")


def test_load_skips_and_defaults(concepts):
    got = {r.concept_id: r for r in concepts.collect()}
    assert set(got) == {"a", "b"} and got["a"].category == "physics" and got["b"].prerequisites == [] and got["b"].representations["ru"] == ["сумма"]


def test_flattening_drops_unknown_targets(concepts):
    assert sorted(tuple(r) for r in catalog.relationships(concepts).collect()) == [("a", "b", "prerequisite"), ("b", "a", "related")]
    assert {(r.concept_id, r.text) for r in catalog.representations(concepts).collect()} >= {("b", "sum"), ("b", "сумма")}


def test_changes(spark, concepts):
    more = catalog.add_representation(concepts, "b", "en", "Total")
    assert {r.concept_id: r for r in more.collect()}["b"].representations["en"] == ["sum", "total"]
    linked = catalog.add_relationship(concepts, "b", "a", "prerequisite")
    assert {r.concept_id: r for r in linked.collect()}["b"].prerequisites == ["a"]
    assert {r.concept_id: r for r in catalog.remove_relationship(linked, "b", "a", "prerequisite").collect()}["b"].prerequisites == []
    with pytest.raises(ValueError):
        catalog.add_relationship(concepts, "b", "gone", "related")
    new = concepts.filter("concept_id = 'b'").withColumn("category", concepts.concept_id)
    assert catalog.upsert(concepts, new, ["concept_id"]).count() == 2 and catalog.add_concepts(concepts, new).count() == 2
    left, kids = catalog.cascade_delete(concepts, catalog.representations(concepts), "concept_id", ["a"])
    assert left.count() == 1 and {r.concept_id for r in kids.collect()} == {"b"}
