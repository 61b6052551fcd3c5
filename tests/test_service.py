"""The index as a whole: store, service and command line, on the stand-in transcript."""

import json

import pytest

from conspectus import cli
from conspectus.service import Service
from conspectus.sources import captions
from conspectus.sources.store import Store


@pytest.fixture(scope="module")
def service(spark, tmp_path_factory):
    s = Service(Store(spark, f"file://{tmp_path_factory.mktemp('index')}"))
    s.store.bootstrap()
    for name, needs in (("derivative", "limit"), ("limit", "number"), ("number", "limit"), ("integral", "derivative")):
        s.add_concept(f"c-{name}", {"en": [name.title()]}, "mathematics", "mathematics")
    for a, b in (("derivative", "limit"), ("limit", "number"), ("integral", "derivative")):
        s.add_relationship(f"c-{a}", prerequisite=f"c-{b}")
    s.add_relationship("c-integral", related="c-number")
    s.process(captions.mock_metadata(spark, "m1").select("video_id", "title"), captions.mock_transcript(spark, "m1"))
    return s


def test_processing_finds_concepts_in_their_segments(service):
    found = {(r.concept_id, r.segment_id) for r in service.store.read("occurrences").collect()}
    assert found == {("c-derivative", "m1-1"), ("c-derivative", "m1-2"), ("c-derivative", "m1-3"), ("c-derivative", "m1-4"), ("c-limit", "m1-3")}
    best = {r.concept_id: r for r in service.video_concepts("m1").collect()}
    assert best["c-derivative"].n == 4 and best["c-limit"].text == "limit"
    assert service.status("m1") == "completed" and service.status("m2") == "not_found"


def test_processing_again_changes_nothing_and_errors_stay_apart(spark, service):
    before = service.store.read("segments").count()
    two = captions.mock_metadata(spark, "m1").select("video_id", "title").unionByName(captions.mock_metadata(spark, "m9").select("video_id", "title"))
    got = service.process(two, captions.mock_transcript(spark, "m1")).collect()
    assert [(r.video_id, r.status, r.reason) for r in got] == [("m9", "error", "no transcript")]
    assert service.store.read("segments").count() == before


def test_search_ranks_and_pages(service):
    hits = service.search("DERIVATIVE").collect()
    assert hits and [r.place for r in hits] == list(range(1, len(hits) + 1)) and all("erivative" in r.text for r in hits)
    assert [r.score for r in hits] == sorted((r.score for r in hits), reverse=True)
    assert service.search("derivative", page=2, limit=1).collect()[0].id == hits[1].id
    assert service.search('no "such" phrase').count() == 0
    assert service.search("differentiation").count() == 0
    with pytest.raises(ValueError):
        service.search("x", limit=1000)


def test_paths(service):
    path = service.learning_path(["c-integral"]).collect()
    assert [r.id for r in path] == ["c-number", "c-limit", "c-derivative", "c-integral"] and [r.is_target for r in path] == [False, False, False, True]
    assert [r.id for r in service.learning_path(["c-integral"], 2).collect()] == ["c-number", "c-integral"]
    assert service.find_path("c-integral", "c-number") == ["c-integral", "c-number"]
    assert service.find_path("c-derivative", "c-number") == ["c-derivative", "c-limit", "c-number"] and service.find_path("c-number", "c-integral") == []


def test_the_store_changes_as_a_whole(spark, service):
    before = service.store.manifest()
    with pytest.raises(Exception, match="broken"):
        service.store.commit({"videos": service.store.read("videos"), "segments": service.store.read("segments").selectExpr("*", "raise_error('broken') AS x").withColumnRenamed("x", "y").selectExpr("*").filter("y is null")})
    assert service.store.manifest() == before
    rows = service.store.optimise()
    assert rows["concepts"] == 4 and service.store.sweep() > 0 and service.store.read("concepts").count() == 4


def test_command_line(spark, tmp_path):
    store = f"file://{tmp_path}/store"
    call = lambda *a: [json.loads(x) for x in cli.run(spark, [store, *a])]
    assert call("add-concept", "a", "Wave Function") == [True] and call("add-concept", "a", "x") == [False]
    call("add-concept", "b", "Wave")
    call("add-representation", "b", "en", "Waves")
    call("add-relationship", "a", "--prerequisite", "b")
    assert [r["id"] for r in call("path", "a")] == ["b", "a"] and call("find-path", "a", "b") == [["a", "b"]]
    call("edit-concept", "b", "--new-id", "c", "--category", "physics")
    assert [x["id"] for x in call("concept", "a")[0]["links"]] == ["c"] and len(call("list-concepts")) == 2
    lines = [{"video_id": "v", "title": "Waves", "pos": k, "start": k * 5.0, "duration": 5.0, "text": t} for k, t in enumerate(["A wave function is defined as a state.", "Quantum tunnelling of particles.", "Quantum tunnelling again and a wave."])]
    (tmp_path / "captions.jsonl").write_text("\n".join(map(json.dumps, lines)))
    assert call("process", f"file://{tmp_path}/captions.jsonl")[0]["status"] == "completed"
    assert call("search", "wave function")[0]["video_id"] == "v"
    found = call("list-candidates", "--status", "pending")
    mine = next(c for c in found if c["text"] == "quantum tunnelling")
    assert call("candidate", mine["candidate_id"])[0]["status"] == "pending" and call("candidates", "v")
    concept = call("approve-candidate", mine["candidate_id"])
    assert call("approve-candidate", mine["candidate_id"]) == concept and len(call("list-concepts")) == 3
    other = next(c for c in found if c["text"] != "quantum tunnelling")["candidate_id"]
    call("reject-candidate", other, "too common")
    assert call("candidate", other)[0]["rejection_reason"] == "too common"
    call("edit-candidate", other, "--text", "NEW text")
    assert call("candidate", other)[0]["text"] == "new text"
    call("delete-candidate", other)
    assert call("candidate", other) == [] and {r["group"] for r in call("stats")} >= {"candidates", "physics"}
