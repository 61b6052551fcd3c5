"""The concept catalogue: JSONL files read, validated, changed and flattened as DataFrames.

Changes return the new catalogue; nothing is updated in place, so a writer can put
it beside the old one and swap.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T

SCHEMA = "concept_id string, representations map<string,array<string>>, prerequisites array<string>, related array<string>, metadata map<string,string>"
#: Categories that have a file from the start; others go to the last.
CATEGORIES = ("mathematics", "physics", "computer_science", "interdisciplinary")


def load(spark: SparkSession, path: str) -> DataFrame:
    """All concepts of JSONL files, with the file's name as category.

    Blank lines, comments, broken lines and lines without an id are left out; of equal
    ids the last line of the last file (by name) stays. Texts are lower-cased, missing
    lists are empty.
    """
    # rows of a split are numbered in order, and splits of a file by where they start
    place = F.struct(F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)\.jsonl?$", 1).alias("category"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("n"))
    lines = spark.read.text(path).select(T.strip(F.col("value")).alias("line"), place.alias("place"))
    real = lines.filter((F.col("line") != "") & ~F.col("line").startswith("#"))
    parsed = real.select("line", "place", F.from_json("line", SCHEMA, {"mode": "PERMISSIVE"}).alias("c")).filter("c.concept_id is not null")
    last = parsed.groupBy("c.concept_id").agg(F.max_by("line", "place").alias("line"), F.max("place")["category"].alias("category"))
    return validated(last.select(F.from_json("line", SCHEMA).alias("c"), "category").select("c.*", "category"))


def ensure_files(path: str) -> list[str]:
    """The standard files' names; those that are missing are made, empty, and need a local or mounted folder."""
    import os

    os.makedirs(path, exist_ok=True)
    names = [f"{path}/{c}.jsonl" for c in CATEGORIES]
    for n in names:
        with open(n, "a", encoding="utf-8"):
            pass
    return names


def category_of(concepts: DataFrame, ids: DataFrame) -> DataFrame:
    """concept_id and its category; the last one for those that no file has."""
    return ids.join(concepts.select("concept_id", "category"), "concept_id", "left").select("concept_id", F.coalesce("category", F.lit(CATEGORIES[-1])).alias("category"))


def edit(concepts: DataFrame, changes: DataFrame) -> DataFrame:
    """Concepts with the changes of their id applied, and links to renamed ones turned to the new id.

    changes: concept_id, new_id, add_prerequisites, drop_prerequisites, add_related, drop_related
    (arrays), metadata (map), category; a null leaves things as they are.
    """
    none, nothing = F.expr("cast(array() as array<string>)"), F.expr("cast(map() as map<string,string>)")
    moved = changes.filter("new_id is not null").select(F.col("concept_id").alias("was"), "new_id")
    c = changes.withColumnsRenamed({"metadata": "new_metadata", "category": "new_category"})
    joined = concepts.join(c, "concept_id", "left")
    lists = lambda name: F.array_except(F.array_union(F.coalesce(name, none), F.coalesce(f"add_{name}", none)), F.coalesce(f"drop_{name}", none))
    kept = F.map_filter(F.coalesce("metadata", nothing), lambda k, _: ~F.array_contains(F.coalesce(F.map_keys("new_metadata"), none), k))
    out = joined.withColumns({"prerequisites": lists("prerequisites"), "related": lists("related"), "metadata": F.map_concat(kept, F.coalesce("new_metadata", nothing)), "category": F.coalesce("new_category", "category")})
    renamed = out.withColumn("concept_id", F.coalesce("new_id", "concept_id")).select(concepts.columns)
    for name in ("prerequisites", "related"):
        each = renamed.select("concept_id", F.posexplode(name).alias("k", "was")).join(moved, "was", "left").select("concept_id", "k", F.coalesce("new_id", "was").alias("to"))
        back = each.groupBy("concept_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "to"))), lambda x: x["to"]).alias("__links"))
        renamed = renamed.join(back, "concept_id", "left").withColumn(name, F.coalesce("__links", none)).drop("__links")
    return renamed.select(concepts.columns)


def validated(concepts: DataFrame) -> DataFrame:
    lower = F.transform_values("representations", lambda _, texts: F.transform(texts, lambda t: F.lower(t)))
    empty = F.expr("cast(array() as array<string>)")
    return concepts.withColumns({"representations": lower, "prerequisites": F.coalesce("prerequisites", empty), "related": F.coalesce("related", empty)})


def representations(concepts: DataFrame) -> DataFrame:
    """representation_id, concept_id, language, text and normalized_text of each non-empty text."""
    by = concepts.select("concept_id", F.explode("representations").alias("language", "texts")).select("concept_id", "language", F.explode("texts").alias("text"))
    some = by.filter(F.trim("text") != "").withColumn("normalized_text", F.trim(F.lower("text")))
    return some.withColumn("representation_id", F.md5(F.concat_ws(":", "concept_id", "language", "text")))


def relationships(concepts: DataFrame) -> DataFrame:
    """source_id, target_id and relationship_type; targets outside the catalogue are left out."""
    one = lambda name, kind: concepts.select(F.col("concept_id").alias("source_id"), F.explode(name).alias("target_id"), F.lit(kind).alias("relationship_type"))
    edges = one("prerequisites", "prerequisite").unionByName(one("related", "related"))
    return edges.join(concepts.select(F.col("concept_id").alias("target_id")), "target_id", "left_semi").select("source_id", "target_id", "relationship_type")


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """old with the rows of new in place of those with the same keys."""
    return old.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new)


def replace_group(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """old with all rows of new's groups replaced: a video's segments, for one."""
    return upsert(old, new, [key])


def delete(old: DataFrame, key: str, ids: list[str]) -> DataFrame:
    return old.filter(~F.col(key).isin(ids))


def cascade_delete(parents: DataFrame, children: DataFrame, key: str, ids: list) -> tuple[DataFrame, DataFrame]:
    """Parents without the ids, and children without their orphans."""
    left = parents.filter(~F.col(key).isin(ids))
    return left, children.join(left.select(key), key, "left_semi")


def add_concepts(concepts: DataFrame, new: DataFrame) -> DataFrame:
    """New concepts whose id is free join the catalogue."""
    return concepts.unionByName(validated(new).join(concepts.select("concept_id"), "concept_id", "left_anti").select(concepts.columns))


def add_representation(concepts: DataFrame, concept_id: str, language: str, text: str) -> DataFrame:
    """The text, lower-cased and once, among the concept's texts of the language."""
    own = F.coalesce(F.try_element_at("representations", F.lit(language)), F.expr("cast(array() as array<string>)"))
    fresh = F.create_map(F.lit(language), F.array_union(own, F.array(F.lit(text.lower()))))
    rest = F.map_filter("representations", lambda k, _: k != language)
    return concepts.withColumn("representations", F.when(F.col("concept_id") == concept_id, F.map_concat(rest, fresh)).otherwise(F.col("representations")))


def _edit(concepts: DataFrame, concept_id: str, name: str, change: Column) -> DataFrame:
    return concepts.withColumn(name, F.when(F.col("concept_id") == concept_id, change).otherwise(F.col(name)))


def add_relationship(concepts: DataFrame, source: str, target: str, kind: str) -> DataFrame:
    """A link to another concept of the catalogue, once."""
    name = {"prerequisite": "prerequisites", "related": "related"}[kind]
    if concepts.filter(F.col("concept_id").isin(source, target)).select("concept_id").distinct().count() < 2:
        raise ValueError("both concepts have to be in the catalogue")
    return _edit(concepts, source, name, F.array_union(name, F.array(F.lit(target))))


def remove_relationship(concepts: DataFrame, source: str, target: str, kind: str) -> DataFrame:
    name = {"prerequisite": "prerequisites", "related": "related"}[kind]
    return _edit(concepts, source, name, F.array_remove(name, target))


def statistics(concepts: DataFrame) -> DataFrame:
    """Per category: concepts, links of both kinds and texts."""
    texts = F.aggregate(F.map_values("representations"), F.lit(0), lambda acc, x: acc + F.size(x))
    return concepts.groupBy("category").agg(F.count("*").alias("concepts"), F.sum(F.size("prerequisites")).alias("prerequisites"), F.sum(F.size("related")).alias("related"), F.sum(texts).alias("texts"))


def save(concepts: DataFrame, path: str) -> str:
    """JSON lines, a folder for each category, in a new folder below the path, which is returned.

    The folder read before is left as it is: the result may be read from it.
    """
    fresh = f"{path.rstrip('/')}/catalogue-{uuid.uuid4().hex}"
    concepts.write.partitionBy("category").json(fresh)
    return fresh


def saved(spark: SparkSession, path: str) -> DataFrame:
    """A catalogue that save() wrote."""
    return spark.read.schema(f"{SCHEMA}, category string").json(path)
