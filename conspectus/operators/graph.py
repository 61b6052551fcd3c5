"""The concept graph: weighted edges, hierarchy, closure, order and paths.

Loops run over frontiers of edges; the driver sees counts only, and every round is
checkpointed to the shared folder.
"""

from __future__ import annotations

from itertools import count

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .lineage import cut


def relationships(mentions: DataFrame, concepts: DataFrame, gap: int = 3) -> DataFrame:
    """src, dst, kind and strength for every ordered pair of concepts that share segments.

    mentions: concept_id, segment_id, pos, context; concepts: concept_id, text. Strength grows
    with shared segments up to five. src is a prerequisite of dst where it first appears
    more than ``gap`` places earlier and a context of dst names it; dst is a more general
    form of src (is_a, of strength 0.7 at least) where its text is a part of src's. A
    segment's pairs are made once, for src below dst, and turned round afterwards.
    """
    m = mentions.groupBy("concept_id", "segment_id").agg(F.min("pos").alias("pos"))
    first = m.groupBy("concept_id").agg(F.min("pos").alias("first"))
    held = m.select("segment_id", "concept_id")
    pairs = held.join(held.select("segment_id", F.col("concept_id").alias("other_id")), "segment_id").filter("concept_id < other_id")
    shared = pairs.groupBy("concept_id", "other_id").agg(F.count("*").alias("n"))
    both = shared.select(F.explode(F.array(F.struct(F.col("concept_id").alias("src"), F.col("other_id").alias("dst")), F.struct(F.col("other_id").alias("src"), F.col("concept_id").alias("dst")))).alias("e"), "n").select("e.*", "n")
    facts = concepts.select("concept_id", F.lower("text").alias("name")).join(first, "concept_id")
    side = lambda c, n: facts.select(F.col("concept_id").alias(c), F.col("name").alias(f"{c}_name"), F.col("first").alias(n))
    known = both.join(side("src", "src_first"), "src").join(side("dst", "dst_first"), "dst")
    early = known.filter(F.col("src_first") < F.col("dst_first") - gap)
    # only early pairs look into contexts, each context once
    contexts = mentions.select(F.col("concept_id").alias("dst"), F.lower("context").alias("context")).filter("context is not null").distinct()
    named = early.select("src", "dst", "src_name").join(contexts, "dst").filter(F.contains("context", "src_name")).select("src", "dst").distinct().withColumn("named", F.lit(True))
    strength = F.least(F.col("n") / 5, F.lit(1.0))
    general = F.contains("src_name", "dst_name") & (F.length("src_name") > F.length("dst_name"))
    kind = F.when(general, "is_a").when(F.col("named"), "prerequisite").otherwise("related")
    return known.join(named, ["src", "dst"], "left").select("src", "dst", kind.alias("kind"), F.when(general, F.greatest(strength, F.lit(0.7))).otherwise(strength).alias("strength"))


def set_edges(edges: DataFrame, new: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges (src, dst, kind, strength) with the new ones (and their ``at``) in place of those of the same ends; the last wins.

    Both ends have to be nodes (id).
    """
    valid = new.join(nodes.select(F.col("id").alias("src")), "src", "left_semi").join(nodes.select(F.col("id").alias("dst")), "dst", "left_semi")
    last = valid.groupBy("src", "dst").agg(F.max_by(F.struct("kind", "strength"), "at").alias("e")).select("src", "dst", "e.kind", "e.strength")
    return edges.join(last, ["src", "dst"], "left_anti").unionByName(last)


def related(edges: DataFrame, least: float = 0.3) -> DataFrame:
    """Out-edges of at least this strength."""
    return edges.filter(F.col("strength") >= least).select("src", "dst", "strength")


def direct_prerequisites(edges: DataFrame, scores: DataFrame) -> DataFrame:
    """id, prerequisite and rank: sources of prerequisite edges, the highest score first. scores: id, score."""
    from .reports import top_per_group

    into = edges.filter("kind = 'prerequisite'").select(F.col("dst").alias("id"), F.col("src").alias("prerequisite"))
    known = into.join(scores.select(F.col("id").alias("prerequisite"), "score"), "prerequisite")
    return top_per_group(known, ["id"], [F.desc("score"), "prerequisite"], 1 << 30).select("id", "prerequisite", "rank")


def clusters(nodes: DataFrame) -> DataFrame:
    """Node ids by domain and by language. nodes: id, domain, language."""
    by = F.explode(F.array(*[F.struct(F.lit(c).alias("kind"), F.col(c).alias("value")) for c in ("domain", "language")]))
    return nodes.select("id", by.alias("c")).groupBy("c.kind", "c.value").agg(F.count("*").alias("nodes"))


def hierarchy(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Score from pattern length, out- and in-degree, occurrences and weight. nodes: id, words, occurrences, weight; edges: src, dst."""
    out = edges.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("outs"))
    back = edges.groupBy(F.col("dst").alias("id")).agg(F.count("*").alias("ins"))
    n = nodes.join(out, "id", "left").join(back, "id", "left").fillna(0, ["outs", "ins"])
    share = lambda c, top: F.least(F.col(c) / top, F.lit(1.0))
    score = 0.2 / F.col("words") + 0.25 * share("outs", 10) + 0.15 * share("occurrences", 20) + 0.25 * share("ins", 5) + 0.15 * F.least(F.col("weight") / 5, F.lit(0.4))
    return n.select("id", F.round(score, 6).alias("score"))


def closure(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """All nodes that seeds (seed, node) reach, seeds themselves excluded; cycles end by themselves."""
    reached = cut(seeds.select("seed", "node").distinct())
    frontier = reached
    while not frontier.isEmpty():
        step = frontier.join(edges, frontier.node == edges.src).select("seed", F.col("dst").alias("node")).distinct()
        frontier = cut(step.join(reached, ["seed", "node"], "left_anti"))
        reached = cut(reached.unionByName(frontier))
    return reached.join(seeds.select("seed", "node").distinct(), ["seed", "node"], "left_anti")


def levels(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Place of each node in a topological order: node and level, prerequisites first.

    edges: src needs dst. Nodes on a cycle, or behind one, have no level (null) and come
    last, by id.
    """
    left = cut(nodes.select("node"))
    out, level = left.limit(0).select("node", F.lit(0).alias("level")), 0
    live = cut(edges.join(nodes.select(F.col("node").alias("src")), "src", "left_semi").join(nodes.select(F.col("node").alias("dst")), "dst", "left_semi").filter("src <> dst"))
    while True:
        ready = cut(left.join(live.select(F.col("src").alias("node")).distinct(), "node", "left_anti"))
        if ready.isEmpty():
            return out.unionByName(left.select("node", F.lit(None).cast("int").alias("level")))
        out = out.unionByName(ready.select("node", F.lit(level).alias("level")))
        left = cut(left.join(ready, "node", "left_anti"))
        live = cut(live.join(ready.select(F.col("node").alias("dst")), "dst", "left_anti"))
        level += 1


def shortest_paths(edges: DataFrame, source: int, most: int | None = None) -> DataFrame:
    """node, hops and path from one source; of equally short paths the one of least nodes in order.

    All nodes that can be reached, however far; with ``most`` those within so many hops.
    """
    spark = edges.sparkSession
    n = spark.sparkContext.defaultParallelism  # unions would add partitions in every round
    seen = cut(spark.createDataFrame([(source, 0, [source])], "node long, hops int, path array<long>"))
    frontier = seen
    for _ in count() if most is None else range(most):
        step = frontier.join(edges, frontier.node == edges.src).select(F.col("dst").alias("node"), (F.col("hops") + 1).alias("hops"), F.concat("path", F.array("dst")).alias("path"))
        fresh = cut(step.join(seen, "node", "left_anti").groupBy("node").agg(F.min("hops").alias("hops"), F.min("path").alias("path")))
        if fresh.isEmpty():
            break
        seen = cut(seen.unionByName(fresh).coalesce(n))
        frontier = fresh
    return seen
