"""Entity resolution: similarity pairs, leader clusters, canonical selection, resolution of hits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import lcs
from ..functions import text as T
from . import similarity
from .lineage import cut


def similar_pairs(names: DataFrame, threshold: float) -> DataFrame:
    """a < b of one block with a subsequence similarity at least so high. names: block, name (distinct)."""
    pairs = similarity.overlap_pairs(names, threshold).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    return pairs.withColumn("similarity", F.round(lcs.overlap_similarity(F.col("a"), F.col("b")), 6)).filter(F.col("similarity") >= threshold)


def similar_lists(pairs: DataFrame) -> DataFrame:
    """name and its similar names, the most similar first."""
    both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"), "similarity"))
    ordered = F.array_sort(F.collect_list(F.struct((-F.col("similarity")).alias("s"), F.col("b").alias("name"))))
    return both.groupBy(F.col("a").alias("name")).agg(F.transform(ordered, lambda x: x["name"]).alias("similar"))


def settle(items: DataFrame, before: DataFrame) -> DataFrame:
    """item and leads, where items are taken in order and one is passed over if an earlier one that leads has a claim on it.

    items: item; before: item, earlier (of lower rank). Rounds settle every item whose
    claims are all decided, so many settle at once; each round's state is written out.
    """
    before = cut(before)
    state = items.select("item", F.lit(None).cast("boolean").alias("leads"))
    while not state.filter("leads is null").isEmpty():
        known = before.join(state.select(F.col("item").alias("earlier"), "leads"), "earlier")
        met = known.groupBy(F.col("item").alias("i")).agg(F.count_if("leads").alias("led"), F.count_if(F.col("leads").isNull()).alias("open"))
        joined = state.join(met, state.item == met.i, "left")
        decided = F.when(F.col("led") > 0, False).when(F.coalesce("open", F.lit(0)) == 0, True)
        state = cut(joined.select("item", F.coalesce("leads", decided).alias("leads")))
    return state


def leader_clusters(order: DataFrame, pairs: DataFrame) -> DataFrame:
    """name and its leader, where names are taken in order and each one joins the first leader it is similar to.

    order: name, rank (distinct); pairs: a, b.
    """
    edges = pairs.select("a", "b").unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    r = order.select(F.col("name").alias("a"), F.col("rank").alias("ra"))
    s = order.select(F.col("name").alias("b"), F.col("rank").alias("rb"))
    earlier = cut(edges.join(r, "a").join(s, "b").filter("rb < ra").select("a", "b", "rb"))
    state = settle(order.select(F.col("name").alias("item")), earlier.select(F.col("a").alias("item"), F.col("b").alias("earlier")))
    joins = earlier.join(state.filter("leads").select(F.col("item").alias("b")), "b").groupBy("a").agg(F.min_by("b", "rb").alias("leader"))
    out = state.join(joins, state.item == joins.a, "left")
    return out.select(F.col("item").alias("name"), F.when(F.col("leads"), F.col("item")).otherwise(F.col("leader")).alias("leader"))


def deduplicate(concepts: DataFrame, language: str = "en", threshold: float = 0.75, fallback: int = 20) -> DataFrame:
    """cluster, canonical, frequency, weight, is_educational, variants, texts, occurrences and place of the merged concepts.

    concepts: id, text, frequency, weight, score, is_educational, occurrences (array of ids), rank.
    Concepts without a valid name are left out; if none has one, the first ``fallback`` stay
    as they are. The best of a cluster is its canonical one; clusters come by doubled
    frequency and score.
    """
    valid = cut(concepts.filter(T.valid_concept(F.col("text"), language)))
    if valid.isEmpty():
        one = concepts.orderBy("rank").limit(fallback).withColumn("leader", F.col("text"))
        return merged(one)
    names = valid.groupBy(F.col("text").alias("name")).agg(F.min("rank").alias("rank"))
    clusters = leader_clusters(names, similar_pairs(names.select(F.lit(1).alias("block"), "name"), threshold))
    return merged(valid.join(clusters.withColumnRenamed("name", "text"), "text"))


def quality(frequency: float = 0.4, score: float = 0.2, weight: float = 0.3, words: float = 0.1) -> Column:
    """The weighed sum that picks a canonical concept; the defaults are those of a video's result."""
    n = F.size(F.split("text", " "))
    return F.round(frequency * F.col("frequency") + score * F.col("score") + weight * F.col("weight") + words * n, 6)


def merged(members: DataFrame) -> DataFrame:
    """One row of each leader's cluster, and its place among them."""
    rated = members.withColumn("quality", quality())
    best = F.max_by(F.struct("id", "text", "score"), F.struct("quality", -F.col("id")))
    by = rated.groupBy("leader").agg(
        best.alias("best"), F.sum("frequency").alias("frequency"), F.max("weight").alias("weight"), F.bool_or("is_educational").alias("is_educational"),
        F.count("*").alias("variants"), F.array_join(F.array_sort(F.collect_set("text")), "|").alias("texts"), F.size(F.flatten(F.collect_list("occurrences"))).cast("long").alias("occurrences"),
    )
    order = Window.orderBy(F.desc(2 * F.col("frequency") + F.col("best.score")), "best.id")
    return by.select(F.col("best.id").alias("canonical"), F.col("best.text").alias("text"), "frequency", "weight", "is_educational", "variants", "texts", "occurrences", F.row_number().over(order).alias("place"))


def reduction(before: DataFrame, after: DataFrame) -> DataFrame:
    """original, deduplicated and the reduction in per cent."""
    n, m = (df.agg(F.count("*").alias(c)) for df, c in ((before, "original"), (after, "deduplicated")))
    both = n.crossJoin(m)  # a row each
    return both.select("original", "deduplicated", F.round(100.0 * (F.col("original") - F.col("deduplicated")) / F.greatest("original", F.lit(1)), 2).alias("reduction"))


def corpus_links(concepts: DataFrame, pairs: DataFrame) -> DataFrame:
    """id and canonical of the concepts that are linked to another, where concepts are taken by rank.

    concepts: id, text, rank, frequency, score, weight; pairs: a, b (ids). One that is linked
    already is passed over; else the best of it and its similar ones takes all others, and
    later links replace earlier ones, so that links may chain: see compress_chains().
    """
    both = pairs.select("a", "b").unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    rated = cut(concepts.withColumn("q", quality(0.3, 0.3, 0.2, 0.2)).select("id", "rank", "q"))
    group = cut(both.unionByName(rated.select(F.col("id").alias("a"), F.col("id").alias("b"))).join(rated.select(F.col("id").alias("b"), "q", F.col("rank").alias("rb")), "b").join(rated.select(F.col("id").alias("a"), F.col("rank").alias("ra")), "a"))
    own = F.when(F.col("a") == F.col("b"), 1).otherwise(0)
    best = group.groupBy("a").agg(F.max_by("b", F.struct("q", own, -F.col("rb"))).alias("canonical"), F.count("*").alias("n")).filter("n > 1").drop("n")
    claims = group.join(best, "a").filter("b <> canonical").select("a", "b", "canonical", "ra", "rb")
    claims = cut(claims)
    state = settle(rated.select(F.col("id").alias("item")), claims.filter("ra < rb").select(F.col("b").alias("item"), F.col("a").alias("earlier")))
    live = claims.join(state.filter("leads").select(F.col("item").alias("a")), "a")
    return live.groupBy(F.col("b").alias("id")).agg(F.max_by("canonical", "ra").alias("canonical"))


def manual_links(wanted: DataFrame, concepts: DataFrame) -> DataFrame:
    """canonical, variant and what becomes of the link: linked, self, missing, or not a root. concepts: concept_id, canonical."""
    roots = concepts.select(F.col("concept_id").alias("canonical"), F.col("canonical").isNull().alias("is_root"))
    known = concepts.select(F.col("concept_id").alias("variant"), F.lit(True).alias("known"))
    joined = wanted.join(roots, "canonical", "left").join(known, "variant", "left")
    status = F.when(F.col("is_root").isNull(), "missing canonical").when(~F.col("is_root"), "not a root").when(F.col("canonical") == F.col("variant"), "self").when(F.col("known").isNull(), "missing").otherwise("linked")
    return joined.select("canonical", "variant", status.alias("status"))


def canonical_pick(members: DataFrame) -> DataFrame:
    """Per cluster the member of highest quality, with merged figures. members: cluster, id, text, frequency, weight, score."""
    quality = 0.4 * F.col("frequency") + 0.2 * F.col("score") + 0.3 * F.col("weight") + 0.1 * F.size(F.split("text", " "))
    rated = members.withColumn("quality", F.round(quality, 6))
    return rated.groupBy("cluster").agg(
        F.max_by("id", F.struct("quality", -F.col("id"))).alias("canonical"), F.sum("frequency").alias("frequency"), F.max("weight").alias("weight"), F.count("*").alias("variants")
    )


def resolve_hits(hits: DataFrame, concepts: DataFrame) -> DataFrame:
    """The best hit of each root concept and video, with how many variants were hit."""
    rooted = hits.join(concepts.select("concept_id", "root"), "concept_id")
    return rooted.groupBy("root", "video_id").agg(F.max("significance").alias("best"), F.countDistinct("concept_id").alias("variants"))


def compress_chains(links: DataFrame) -> DataFrame:
    """id and root for links id -> canonical that may chain; pointers jump until nothing moves.

    Links that run in a circle have no root, and raise.
    """
    state = links.select("id", F.col("canonical").alias("root"))
    for _ in range(2 + max(1, links.count()).bit_length()):  # a jump doubles the distance
        step = state.join(state.select(F.col("id").alias("root"), F.col("root").alias("next")), "root", "left")
        moved = cut(step.select("id", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        state = moved.drop("moved")
        if moved.filter("moved").isEmpty():
            return state
    raise ValueError("links run in a circle")
