"""Learning paths, for many requests at once.

A request is a path_id with its targets. Every step keeps path_id as a key, so the
sets of one request never meet those of another, and rankings are windows over a
path.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import graph
from .lineage import cut


def members(requests: DataFrame, edges: DataFrame) -> DataFrame:
    """path_id, id and is_target: the targets (path_id, id) and all that they need. edges: src needs dst."""
    seeds = cut(requests.select(F.col("path_id").alias("seed"), F.col("id").alias("node")).distinct())
    needed = graph.closure(edges, seeds).select(F.col("seed").alias("path_id"), F.col("node").alias("id"), F.lit(False).alias("is_target"))
    return needed.unionByName(seeds.select(F.col("seed").alias("path_id"), F.col("node").alias("id"), F.lit(True).alias("is_target")))


def induced(inside: DataFrame, edges: DataFrame) -> DataFrame:
    """path_id, src and dst of the edges with both ends inside the path."""
    one = inside.select("path_id", F.col("id").alias("src")).join(edges.select("src", "dst"), "src")
    return one.join(inside.select("path_id", F.col("id").alias("dst")), ["path_id", "dst"]).select("path_id", "src", "dst").distinct()


def ordered(inside: DataFrame, edges: DataFrame) -> DataFrame:
    """Members with their place (from 1): what nothing else needs comes last, and what much builds on first.

    Concepts are peeled from those that no other needs, the highest ids of a layer first;
    the order is that of the peeling turned round. Concepts on a cycle, or needed only
    there, are never peeled: they come first, the highest ids first.
    """
    inside, own = cut(inside), cut(induced(inside, edges))
    key = lambda c: F.struct(F.col("path_id").alias("p"), F.col(c).alias("n"))
    layers = graph.levels(inside.select(key("id").alias("node")), own.select(key("dst").alias("src"), key("src").alias("dst")))
    placed = inside.join(layers.select(F.col("node.p").alias("path_id"), F.col("node.n").alias("id"), "level"), ["path_id", "id"])
    w = Window.partitionBy("path_id").orderBy(F.col("level").isNotNull(), F.desc("level"), F.desc("id"))
    return placed.select("path_id", "id", "is_target", F.row_number().over(w).alias("place"))


def trimmed(path: DataFrame, most: int) -> DataFrame:
    """At most so many concepts of each path: all targets and the first of the others; of too many targets the first."""
    p = Window.partitionBy("path_id")
    ranked = path.withColumns({"targets": F.count_if("is_target").over(p), "n": F.row_number().over(Window.partitionBy("path_id", "is_target").orderBy("place"))})
    stays = F.when(F.col("is_target"), F.col("n") <= most).otherwise(F.col("n") <= F.greatest(most - F.col("targets"), F.lit(0)))
    kept = ranked.filter(stays).drop("targets", "n")
    return kept.withColumn("place", F.row_number().over(p.orderBy("place")))


def detailed(path: DataFrame, concepts: DataFrame, edges: DataFrame, related: DataFrame) -> DataFrame:
    """The path with each concept's text and its direct prerequisites and related concepts, as sorted lists."""
    ids = path.select(F.col("id").alias("src")).distinct()
    listed = lambda e, name: e.join(ids, "src", "left_semi").groupBy(F.col("src").alias("id")).agg(F.array_sort(F.collect_set("dst")).alias(name))
    out = path.join(concepts.select(F.col("concept_id").alias("id"), "text"), "id").join(listed(edges, "needs"), "id", "left").join(listed(related, "near"), "id", "left")
    shown = lambda c: F.coalesce(F.array_join(F.transform(c, lambda x: x.cast("string")), ","), F.lit(""))
    return out.select("path_id", "place", "id", "text", "is_target", shown("needs").alias("prerequisites"), shown("near").alias("related"))


def learning_paths(requests: DataFrame, concepts: DataFrame, edges: DataFrame, related: DataFrame, most: int = 15) -> DataFrame:
    """Paths to the targets that exist: prerequisites, their order, a bounded length, details."""
    valid = requests.join(concepts.select(F.col("concept_id").alias("id")), "id", "left_semi")
    return detailed(trimmed(ordered(members(valid, edges), edges), most), concepts, edges, related)


def concept_paths(edges: DataFrame, source: int | str) -> DataFrame:
    """node, hops and path from a source by breadth-first search. edges: src, dst, kind (0 related, 1 prerequisite), pos.

    Of equally short paths that stays which takes related links before prerequisites, and
    earlier links of a list before later ones, at the first step where they differ.
    """
    spark = edges.sparkSession
    n, kind = spark.sparkContext.defaultParallelism, dict(edges.dtypes)["src"]
    edges = cut(edges.groupBy("src", "dst").agg(F.min(F.struct("kind", "pos")).alias("turn")))
    seen = cut(spark.createDataFrame([(source, 0, [source])], f"node {kind}, hops int, path array<{kind}>").withColumn("turns", F.expr("cast(array() as array<struct<kind:int,pos:int>>)")))
    frontier = seen
    while not frontier.isEmpty():
        step = frontier.join(edges, frontier.node == edges.src).select(
            F.col("dst").alias("node"), (F.col("hops") + 1).alias("hops"), F.concat("path", F.array("dst")).alias("path"), F.concat("turns", F.array(F.col("turn").cast("struct<kind:int,pos:int>"))).alias("turns")
        )
        fresh = step.join(seen.select("node"), "node", "left_anti").groupBy("node").agg(F.min("hops").alias("hops"), F.min_by("path", "turns").alias("path"), F.min("turns").alias("turns"))
        frontier = cut(fresh)
        seen = cut(seen.unionByName(frontier).coalesce(n))
    return seen.drop("turns")


def weighted_order(inside: DataFrame, edges: DataFrame, scores: DataFrame) -> DataFrame:
    """Members (path_id, id) with their place by all edges src -> dst, sources first; what is on a cycle comes last by score. scores: id, score."""
    inside, own = cut(inside), cut(induced(inside, edges))
    key = lambda c: F.struct(F.col("path_id").alias("p"), F.col(c).alias("n"))
    layers = graph.levels(inside.select(key("id").alias("node")), own.select(key("dst").alias("src"), key("src").alias("dst")))
    placed = inside.join(layers.select(F.col("node.p").alias("path_id"), F.col("node.n").alias("id"), "level"), ["path_id", "id"]).join(scores, "id", "left")
    w = Window.partitionBy("path_id").orderBy(F.col("level").isNull(), "level", F.when(F.col("level").isNull(), -F.coalesce("score", F.lit(0.0))), "id")
    return placed.withColumn("place", F.row_number().over(w)).drop("level", "score")


def ratio_members(requests: DataFrame, nodes: DataFrame, edges: DataFrame, ratio: float = 0.5, most: int = 20) -> DataFrame:
    """path_id, id, is_target and concept_class: the best theoretical and practical concepts in the wanted ratio, and all targets.

    nodes: id, concept_class, score; edges: src, dst, kind. A concept's prerequisites are the
    sources of its prerequisite edges, and theirs.
    """
    valid = requests.join(nodes.select("id"), "id", "left_semi")
    needs = edges.filter("kind = 'prerequisite'").select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    every = cut(members(valid, needs).join(nodes, "id"))
    p = Window.partitionBy("path_id")
    theory = F.col("concept_class") == "theoretical"
    total = F.least(F.count("*").over(p), F.lit(most))
    wanted = F.floor(total * ratio)
    ranked = every.withColumns({"wanted": F.when(theory, wanted).otherwise(total - wanted), "n": F.row_number().over(Window.partitionBy("path_id", theory).orderBy(F.desc("score"), "id"))})
    return ranked.filter((F.col("n") <= F.col("wanted")) | F.col("is_target")).select("path_id", "id", "is_target", "concept_class")


def ratio_paths(requests: DataFrame, nodes: DataFrame, edges: DataFrame, ratio: float = 0.5, most: int = 20) -> DataFrame:
    """The ratio's members in the order of all edges."""
    chosen = cut(ratio_members(requests, nodes, edges, ratio, most))
    return weighted_order(chosen, edges, nodes.select("id", "score"))


def enhanced_paths(requests: DataFrame, nodes: DataFrame, edges: DataFrame, domain: str | None = None, ratio: float = 0.5) -> DataFrame:
    """ratio_paths() of the targets of one domain, with score, prerequisites (highest score first) and related concepts of 0.3 and more."""
    inside = nodes if domain is None else nodes.filter(F.col("domain") == domain)
    wanted = requests.join(inside.select("id"), "id", "left_semi")
    path = ratio_paths(wanted, nodes.select("id", "concept_class", "score"), edges, ratio)
    needs = graph.direct_prerequisites(edges, nodes.select("id", "score")).groupBy("id").agg(F.array_sort(F.collect_list(F.struct("rank", "prerequisite"))).alias("p"))
    near = graph.related(edges).groupBy(F.col("src").alias("id")).agg(F.array_sort(F.collect_set("dst")).alias("near"))
    out = path.join(nodes.select("id", "text", "domain", "score"), "id").join(needs, "id", "left").join(near, "id", "left")
    joined = lambda c: F.coalesce(F.array_join(F.transform(c, lambda x: x.cast("string")), ","), F.lit(""))
    return out.select("path_id", "place", "id", "text", "domain", "concept_class", "is_target", "score", joined(F.transform("p", lambda x: x["prerequisite"])).alias("prerequisites"), joined(F.col("near")).alias("related"))


def section(weight: Column, educational: Column) -> Column:
    return F.when(educational & (weight > 3), "core").when(educational | (weight > 1.5), "supporting").otherwise("mentions")


def engine_paths(requests: DataFrame, concepts: DataFrame, occ: DataFrame, videos: DataFrame, preferred: float = 0.5, domain: str | None = None, least: float = 2.5) -> DataFrame:
    """Requested concepts, variants as their root, in order of weight, with section and up to three recommended videos.

    Roots asked for twice through variants count once. concepts: concept_id, text, domain, root.
    """
    from .reports import top_per_group, video_score

    rooted = requests.join(concepts.select(F.col("concept_id").alias("id"), "root"), "id").select("path_id", F.col("root").alias("id")).distinct()
    known = rooted.join(concepts.select(F.col("concept_id").alias("id"), "text", "domain"), "id")
    known = known if domain is None else known.filter(F.col("domain") == domain)
    by = occ.groupBy(F.col("concept_id").alias("id")).agg(F.max("significance").alias("weight"), F.count("*").alias("occurrences"))
    weighed = known.join(by, "id", "left").fillna(0, ["weight", "occurrences"])
    order = Window.partitionBy("path_id").orderBy(F.desc("weight"), F.desc("occurrences"), "id")
    best = top_per_group(video_score(occ, videos, preferred), ["concept_id"], [F.desc("score"), "video_id"], 3)
    shown = best.groupBy(F.col("concept_id").alias("id")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "video_id"))), lambda x: x["video_id"].cast("string")), ",").alias("recommended"))
    out = weighed.withColumns({"place": F.row_number().over(order), "section": section(F.col("weight"), F.col("weight") >= least)})
    return out.join(shown, "id", "left").select("path_id", "place", "id", "text", "domain", "weight", "occurrences", "section", F.coalesce("recommended", F.lit("")).alias("recommended"))


def merged(base: DataFrame, enhanced: DataFrame) -> DataFrame:
    """The enhanced path of each request where there is one, with the base's section; else the base. Both: path_id, place, id; base: section too."""
    has = enhanced.select("path_id").distinct()
    better = enhanced.select("path_id", "place", "id").join(base.select("path_id", "id", "section"), ["path_id", "id"], "left").withColumn("is_enhanced", F.lit(True))
    plain = base.select("path_id", "place", "id", "section").join(has, "path_id", "left_anti").withColumn("is_enhanced", F.lit(False))
    return better.unionByName(plain)
