"""Joins, aggregates, rankings and set operations over the concept index."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.model import COMPREHENSIVE


def concept_occurrences(occ: DataFrame, videos: DataFrame, concepts: DataFrame, segments: DataFrame | None = None, least: float = COMPREHENSIVE, limit: int = 100) -> DataFrame:
    """The most significant occurrences with their video and concept, and their segment where segments (video_id, segment_pos) are given.

    Occurrences without a stored video, concept or segment are no part of the result, so
    the joins come before the limit.
    """
    order = [F.desc("significance"), "concept_id", "video_id", "segment_pos"]
    found = occ.filter(F.col("significance") >= least)
    if segments is not None:
        found = found.join(segments.select("video_id", "segment_pos").distinct(), ["video_id", "segment_pos"], "left_semi")
    found = found.join(videos.select("video_id", "title", "language"), "video_id").join(concepts.select("concept_id", "text", "domain"), "concept_id")
    return found.select("concept_id", "text", "domain", "video_id", "title", "language", "segment_pos", "significance").orderBy(*order).limit(limit)


def page(df: DataFrame, order: list[Column | str], number: int, size: int) -> DataFrame:
    """One page of a totally ordered result."""
    return df.orderBy(*order).offset((number - 1) * size).limit(size)


def page_meta(df: DataFrame, size: int, number: int) -> DataFrame:
    total = df.agg(F.count("*").alias("total"))
    pages = F.ceil(F.col("total") / size).cast("long")
    return total.select("total", pages.alias("total_pages"), (F.lit(number) < pages).alias("has_next"), F.lit(number > 1).alias("has_prev"))


def root_totals(occ: DataFrame, concepts: DataFrame) -> DataFrame:
    """Occurrences and videos of each root concept, variants included."""
    # per concept and video first, so that the shuffle carries pairs rather than occurrences
    pairs = occ.groupBy("concept_id", "video_id").agg(F.count("*").alias("n"))
    rooted = pairs.join(concepts.select("concept_id", "root"), "concept_id")
    by = rooted.groupBy("root").agg(F.countDistinct("video_id").alias("videos"), F.sum("n").alias("occurrences"))
    return by.withColumn("multi_video", F.col("videos") > 1)


def sample_videos(occ: DataFrame, n: int = 3) -> DataFrame:
    """The n lowest videos of each concept, by a ranked window over distinct pairs."""
    w = Window.partitionBy("concept_id").orderBy("video_id")
    return occ.select("concept_id", "video_id").distinct().withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)


def educational_report(occ: DataFrame, concepts: DataFrame, least: float, limit: int = 100) -> DataFrame:
    by = occ.filter(F.col("significance") >= least).groupBy("concept_id").agg(
        F.countDistinct("video_id").alias("videos"), F.count("*").alias("occurrences"), F.max("significance").alias("weight")
    )
    known = by.join(concepts.select("concept_id", "text", "domain"), "concept_id")  # before the limit: the catalogue may lack some
    return known.orderBy(F.desc("weight"), F.desc("occurrences"), "concept_id").limit(limit)


def domain_stats(occ: DataFrame, concepts: DataFrame) -> DataFrame:
    found = occ.join(concepts.select("concept_id", "domain"), "concept_id")
    return found.groupBy("domain").agg(
        F.countDistinct("video_id").alias("videos"), F.count("*").alias("occurrences"), F.count_if(F.col("significance") >= COMPREHENSIVE).alias("comprehensive")
    )


def video_rollup(occ: DataFrame) -> DataFrame:
    """Per video and concept: count, best significance and whether it is explained."""
    by = occ.groupBy("video_id", "concept_id").agg(F.count("*").alias("n"), F.max("significance").alias("best"), F.min("start_time").alias("first_start"))
    return by.withColumn("is_educational", F.col("best") >= COMPREHENSIVE)


def concept_detail(occ: DataFrame, concepts: DataFrame) -> DataFrame:
    """Two-level rollup: videos of each root concept with counts, and how many there are."""
    by = occ.join(concepts.select("concept_id", "root", "domain"), "concept_id").groupBy("root", "domain", "video_id").agg(F.count("*").alias("n"))
    return by.groupBy("root", "domain").agg(F.count("*").alias("videos"), F.sum("n").alias("occurrences"), F.max("n").alias("most_in_video"))


def timeline(occ: DataFrame, least: float) -> DataFrame:
    """Segments with their concepts in order, those at least so significant."""
    by = occ.filter(F.col("significance") >= least).groupBy("video_id", "segment_pos").agg(F.count("*").alias("concepts"), F.array_sort(F.collect_set("concept_id")).alias("ids"))
    return by.select("video_id", "segment_pos", "concepts", F.array_join(F.transform("ids", lambda x: x.cast("string")), ",").alias("ids"))


def segment_counts(transcripts: DataFrame, occ: DataFrame) -> DataFrame:
    """Every segment with its number of concepts, zero included."""
    counts = occ.groupBy("video_id", "segment_pos").agg(F.count("concept_id").alias("n"))
    joined = transcripts.join(counts, (transcripts.video_id == counts.video_id) & (transcripts.pos == counts.segment_pos), "left")
    return joined.select(transcripts.video_id, "pos", F.coalesce("n", F.lit(0)).alias("n"))


def cooccurrence(occ: DataFrame, least_shared: int = 2) -> DataFrame:
    """Pairs of concepts that share videos. Pairs are made from distinct (video, concept) rows."""
    one = occ.select("video_id", "concept_id").distinct()
    two = one.select("video_id", F.col("concept_id").alias("other_id"))
    pairs = one.join(two, "video_id").filter("concept_id < other_id")
    return pairs.groupBy("concept_id", "other_id").agg(F.count("*").alias("shared")).filter(F.col("shared") >= least_shared)


def facets(occ: DataFrame, concepts: DataFrame, videos: DataFrame) -> DataFrame:
    """Counts by domain, by language and by kind of occurrence, in one aggregate over grouping sets."""
    kind = F.when(F.col("significance") >= COMPREHENSIVE, "comprehensive").otherwise("passing")
    rows = occ.join(concepts.select("concept_id", "domain"), "concept_id").join(videos.select("video_id", "language"), "video_id")
    counted = rows.groupBy("domain", "language", kind.alias("kind")).agg(F.count("*").alias("n"))
    cells = F.explode(F.array(*[F.struct(F.lit(c).alias("facet"), F.col(c).alias("value")) for c in ("domain", "language", "kind")]))
    return counted.select(cells.alias("c"), "n").groupBy("c.facet", "c.value").agg(F.sum("n").alias("n"))


def status_stats(candidates: DataFrame) -> DataFrame:
    flags = [F.count_if(F.col("status") == s).alias(s) for s in ("pending", "approved", "rejected")]
    return candidates.agg(F.count("*").alias("total"), *flags)


def top_per_group(df: DataFrame, keys: list[str], order: list, n: int, rank: str = "rank") -> DataFrame:
    """The first n rows of each group in a total order; ranks come before the rest is dropped."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).filter(F.col(rank) <= n)


def video_score(occ: DataFrame, videos: DataFrame, preferred: float = 0.5) -> DataFrame:
    """Recommendation score of each concept's videos: occurrences and how well the ratio fits."""
    by = occ.groupBy("concept_id", "video_id").agg(F.count("*").alias("n"), F.max("significance").alias("best"))
    joined = by.join(videos.select("video_id", "ratio"), "video_id")
    match = 1 - F.abs(F.col("ratio") - preferred)
    score = F.col("n") * 0.3 * (0.7 + 0.3 * match) * F.when(F.col("best") >= COMPREHENSIVE, 1.2).otherwise(1.0) * F.when(F.col("n") > 3, 1.2).otherwise(1.0)
    return joined.select("concept_id", "video_id", F.round(score, 6).alias("score"))


def related_concepts(occ: DataFrame, concepts: DataFrame, n: int = 10) -> DataFrame:
    """Co-occurring concepts first, then those of the same domain, n of each concept at most."""
    pairs = cooccurrence(occ)
    both = pairs.unionByName(pairs.select(F.col("other_id").alias("concept_id"), F.col("concept_id").alias("other_id"), "shared"))
    near = both.select("concept_id", "other_id", F.lit(0).alias("kind"), "shared")
    heads = top_per_group(concepts.filter("canonical is null"), ["domain"], ["concept_id"], n, "place").select("domain", F.col("concept_id").alias("other_id"))
    alike = concepts.select("concept_id", "domain").join(heads, "domain").filter("concept_id <> other_id")
    every = near.unionByName(alike.select("concept_id", "other_id", F.lit(1).alias("kind"), F.lit(0).cast("long").alias("shared")))
    once = every.groupBy("concept_id", "other_id").agg(F.min("kind").alias("kind"), F.max("shared").alias("shared"))
    return top_per_group(once, ["concept_id"], ["kind", F.desc("shared"), "other_id"], n)


def sections(occ: DataFrame) -> DataFrame:
    """Concepts of each video as core, supporting or mentions."""
    by = occ.groupBy("video_id", "concept_id").agg(F.max("significance").alias("w"))
    name = F.when((F.col("w") >= COMPREHENSIVE) & (F.col("w") > 3), "core").when((F.col("w") >= COMPREHENSIVE) | (F.col("w") > 1.5), "supporting").otherwise("mentions")
    return by.groupBy("video_id", name.alias("section")).agg(F.count("*").alias("concepts"))
