"""The command line: python -m conspectus.cli STORE COMMAND ...; each result row is a line of JSON."""

from __future__ import annotations

import argparse
import json

from pyspark.sql import DataFrame, SparkSession

from .service import Service
from .sources.store import Store


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="conspectus")
    p.add_argument("store", help="the index's folder")
    sub = p.add_subparsers(dest="command", required=True)

    def command(name: str, *arguments: str, **options):
        c = sub.add_parser(name)
        for a in arguments:
            c.add_argument(a, nargs="*" if a.endswith("s") and a != "address" else None)
        for o, kind in options.items():
            c.add_argument(f"--{o.replace('_', '-')}", type=kind)

    command("process", "captions")  # JSON lines: video_id, title, pos, start, duration, text
    command("search", "phrase", page=int, limit=int, language=str, ratio=float)
    command("concept", "id")
    command("path", "targets", most=int)
    command("list-concepts", page=int, limit=int, language=str)
    command("add-concept", "id", "texts", language=str, category=str, domain=str)
    command("add-representation", "id", "language", "text")
    command("add-relationship", "id", prerequisite=str, related=str)
    command("edit-concept", "id", new_id=str, add_prerequisite=str, drop_prerequisite=str, add_related=str, drop_related=str, category=str)
    command("candidates", "video")
    command("list-candidates", status=str, page=int, limit=int)
    command("candidate", "id")
    command("approve-candidate", "id")
    command("reject-candidate", "id", "reason")
    command("edit-candidate", "id", text=str, domain=str)
    command("delete-candidate", "id")
    command("stats")
    command("find-path", "source", "target")
    return p


def run(spark: SparkSession, arguments: list[str]) -> list[str]:
    """The lines that a command prints."""
    a = parser().parse_args(arguments)
    s = Service(Store(spark, a.store))
    s.store.bootstrap()
    given = lambda *names: {n: getattr(a, n) for n in names if getattr(a, n) is not None}
    listed = lambda x: None if x is None else [x]
    match a.command:
        case "process":
            rows = spark.read.schema("video_id string, title string, pos int, start double, duration double, text string").json(a.captions)
            out = s.process(rows.select("video_id", "title").dropDuplicates(["video_id"]), rows.drop("title").filter("text is not null"))
        case "search":
            out = s.search(a.phrase, **given("page", "limit", "language", "ratio"))
        case "concept":
            out = s.concept(a.id)
        case "path":
            out = s.learning_path([t for x in a.targets for t in x.split(",")], a.most)
        case "list-concepts":
            out = s.list_concepts(**given("page", "limit", "language"))
        case "add-concept":
            out = s.add_concept(a.id, {a.language or "en": a.texts}, **given("category", "domain"))
        case "add-representation":
            out = s.add_representation(a.id, a.language, a.text)
        case "add-relationship":
            out = s.add_relationship(a.id, a.prerequisite, a.related)
        case "edit-concept":
            out = s.edit_concept(a.id, new_id=a.new_id, add_prerequisites=listed(a.add_prerequisite), drop_prerequisites=listed(a.drop_prerequisite), add_related=listed(a.add_related), drop_related=listed(a.drop_related), category=a.category)
        case "candidates":
            out = s.store.read("candidates").filter(f"video_id = '{a.video}'" if a.video.isalnum() else "false")
        case "list-candidates":
            out = s.candidates(**given("status", "page", "limit"))
        case "candidate":
            out = s.candidate(a.id)
        case "approve-candidate":
            out = s.approve(a.id)
        case "reject-candidate":
            out = s.reject(a.id, a.reason)
        case "edit-candidate":
            out = s.edit_candidate(a.id, a.text, a.domain)
        case "delete-candidate":
            out = s.delete_candidate(a.id)
        case "stats":
            out = s.statistics()
        case "find-path":
            out = s.find_path(a.source, a.target)
    if isinstance(out, DataFrame):
        return out.toJSON().collect()
    return [] if out is None else [json.dumps(out)]


if __name__ == "__main__":
    import sys

    session = SparkSession.builder.getOrCreate()
    for line in run(session, sys.argv[1:]):
        print(line)
