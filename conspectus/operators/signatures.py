"""Signatures of concepts: patterns shared by their contexts, weights, similar nodes, stored graphs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import lcs
from ..functions import lexicons as L
from ..functions import morphology as W
from ..functions import text as T

NODE = "id string, text string, normalized_text string, pattern array<string>, domain string, concept_class string, language string, confidence double, score double, weight double, canonical string"
EDGE = "src string, dst string, kind string, strength double"


def _runs(n: int) -> Column:
    """All runs of n words of the column w."""
    starts = F.sequence(F.lit(1), F.size("w") - n + 1)
    return F.when(F.size("w") >= n, F.transform(starts, lambda i: F.slice("w", i, n))).otherwise(F.expr("cast(array() as array<array<string>>)"))


def pattern_grams(texts: DataFrame, keys: list[str], item: str, shortest: int = 2, longest: int = 10, keep: list[str] | None = None) -> DataFrame:
    """keys, item, gram (array) of all distinct runs of significant words, once for each text. texts: keys, item, text."""
    held = texts.select(*keys, item, T.words(F.lower("text")).alias("w")).select(*keys, item, W.significant(F.col("w"), keep=keep).alias("w"))
    runs = [_runs(n) for n in range(shortest, longest + 1)]
    return held.select(*keys, item, F.explode(F.array_distinct(F.concat(*runs))).alias("gram"))


def patterns(texts: DataFrame, keys: list[str], item: str, domain_terms: list[str] | None = None, shortest: int = 2, longest: int = 10, least: int = 2, keep: list[str] | None = None) -> DataFrame:
    """keys, gram, df and score of the runs of words that a third of a group's texts share (``least`` of them at least).

    The score is 0.3 for each word, the doubled share of texts, and 0.5 for each domain term.
    """
    total = texts.groupBy(*keys).agg(F.count("*").alias("total"))
    by = pattern_grams(texts, keys, item, shortest, longest, keep).groupBy(*keys, "gram").agg(F.count("*").alias("df")).join(total, keys)
    shared = by.filter(F.col("df") >= F.greatest(F.lit(least), F.floor(F.col("total") / 3)))
    terms = F.array(*map(F.lit, domain_terms or L.PATTERN_TERMS))
    own = F.size(F.filter("gram", lambda t: F.array_contains(terms, t)))
    return shared.withColumn("score", F.round(0.3 * F.size("gram") + 2.0 * F.col("df") / F.col("total") + 0.5 * own, 6)).drop("total")


def best_run(sequences: DataFrame, key: str, item: str, domain_terms: list[str] | None = None, shortest: int = 2, longest: int = 10) -> DataFrame:
    """key and pattern: the run of words of the highest score among those that half of a group's texts share.

    The score is length times the share of texts, raised by a fifth for each domain term;
    of equal scores the run that comes first in order of its words stays.
    """
    total = sequences.groupBy(key).agg(F.count("*").alias("total"))
    runs = [_runs(n) for n in range(shortest, longest + 1)]
    held = sequences.select(key, item, F.explode(F.array_distinct(F.concat(*runs))).alias("gram"))
    by = held.groupBy(key, "gram").agg(F.count("*").alias("df")).join(total, key).filter(F.col("df") >= F.greatest(F.lit(2), F.floor(F.col("total") / 2)))
    terms = F.array(*map(F.lit, domain_terms or L.PATTERN_TERMS))
    own = F.size(F.filter("gram", lambda t: F.array_contains(terms, t)))
    score = F.round(F.size("gram") * F.col("df") / F.col("total") * (1 + 0.2 * own), 6)
    return by.withColumn("score", score).groupBy(key).agg(F.min_by("gram", F.struct((-F.col("score")).alias("s"), "gram")).alias("pattern"), F.max("score").alias("score"))


def signatures(concepts: DataFrame, contexts: DataFrame, domain_terms: list[str] | None = None, keep: list[str] | None = None) -> DataFrame:
    """concept_id, pattern (array) and confidence. concepts: concept_id, text; contexts: concept_id, item, text.

    The best shared run of the contexts is the pattern, if it has a word of the name or two
    words at most; else the second; else the name's own words, with confidence 0.5.
    """
    own = concepts.select("concept_id", T.words(F.lower("text")).alias("w")).select("concept_id", W.significant(F.col("w"), keep=keep).alias("own"))
    ranked = patterns(contexts, ["concept_id"], "item", domain_terms, keep=keep)
    w = Window.partitionBy("concept_id").orderBy(F.desc("score"), "gram")
    top = ranked.withColumn("n", F.row_number().over(w)).filter("n <= 2")
    two = top.groupBy("concept_id").agg(*[F.max(F.when(F.col("n") == n, F.struct("gram", "score"))).alias(f"p{n}") for n in (1, 2)])
    joined = own.join(two, "concept_id", "left")
    fits = F.arrays_overlap("p1.gram", "own") | (F.size("p1.gram") <= 2)
    conf = lambda n, top: F.round(F.least(F.col(f"p{n}.score") / 10, F.lit(top)), 6)
    pattern = F.when(F.coalesce(fits, F.lit(False)), F.col("p1.gram")).when(F.col("p2").isNotNull(), F.col("p2.gram")).otherwise(F.col("own"))
    confidence = F.when(F.coalesce(fits, F.lit(False)), conf(1, 0.95)).when(F.col("p2").isNotNull(), conf(2, 0.9)).otherwise(0.5)
    return joined.select("concept_id", pattern.alias("pattern"), confidence.alias("confidence"))


def weights(contexts: DataFrame, markers: list[str] | None = None) -> DataFrame:
    """concept_id, weight and is_educational of a concept's contexts: concept_id, segment_id, duration, text.

    Up to five occurrences count 0.5 each, up to three segments 0.7, ten seconds 1 up to 3,
    and up to three contexts with a marker, as whole words, 0.8.
    """
    marker = F.lower("text").rlike(r"(?U)\b(?:" + "|".join(markers or L.SIGNATURE_MARKERS) + r")\b")
    by = contexts.groupBy("concept_id").agg(F.count("*").alias("n"), F.countDistinct("segment_id").alias("s"), F.sum("duration").alias("d"), F.count_if(marker).alias("m"))
    weight = F.least("n", F.lit(5)) * 0.5 + F.least("s", F.lit(3)) * 0.7 + F.least(F.col("d") / 10.0, F.lit(3.0)) + F.least("m", F.lit(3)) * 0.8
    return by.select("concept_id", F.round(weight, 6).alias("weight")).withColumn("is_educational", F.col("weight") > 2.5)


def contexts_of(concepts: DataFrame, segments: DataFrame, least: int = 3, longest: int = 4) -> DataFrame:
    """concept_id and segment_id of the segments that hold a concept's name as whole words."""
    from .matching import contained

    names = concepts.filter(F.length("text") >= least).select("concept_id", F.trim(F.regexp_replace(F.lower("text"), r"[^\p{L}\p{N}]+", " ")).alias("term"))
    return contained(segments, "segment_id", names.select("term").distinct(), longest).join(names, "term").select("concept_id", "segment_id").distinct()


def similar_nodes(wanted: DataFrame, nodes: DataFrame, least: float = 0.5, most: int = 10) -> DataFrame:
    """text, id, similarity, pattern_score, score and rank of the nodes like a wanted text (text, language, domain).

    nodes: id, text, pattern, language, domain, canonical. Only roots of the language and domain
    are compared. 0.7 of the texts' ratio and 0.3 of the pattern's share have to pass ``least``:
    that bounds the ratio from below, so a prefix filter finds the pairs.
    """
    from .similarity import ratio_pairs

    form = T.collapse(F.col("text"))
    roots = nodes.filter("canonical is null").withColumn("name", form)
    asked = wanted.withColumn("query", form)
    pairs = ratio_pairs(asked.select(F.col("query").alias("name")), roots.select("name"), (least - 0.3) / 0.7)
    met = asked.join(pairs.withColumnRenamed("a", "query"), "query").join(roots.select("id", "pattern", F.col("name").alias("b"), F.col("language").alias("l"), F.col("domain").alias("dm")), "b").filter("language = l and domain = dm")
    scored = met.withColumns({"similarity": F.round(lcs.indel_ratio(F.col("query"), F.col("b")), 6), "pattern_score": F.round(T.pattern_match(F.col("pattern"), F.col("text")), 6)})
    scored = scored.withColumn("score", F.round(0.7 * F.col("similarity") + 0.3 * F.col("pattern_score"), 6)).filter(F.col("score") > least)
    w = Window.partitionBy("text", "language", "domain").orderBy(F.desc("score"), "id")
    return scored.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= most).select("text", "language", "domain", "id", "similarity", "pattern_score", "score", "rank")


def canonical_of(similar: DataFrame, match: float = 3.0, similarity: float = 0.85) -> DataFrame:
    """The best similar node of a text, where it is near enough to stand for it."""
    return similar.filter((F.col("rank") == 1) & ((F.col("score") >= match) | (F.col("similarity") > similarity))).select("text", "language", "domain", F.col("id").alias("canonical"))


def encoded(nodes: DataFrame) -> DataFrame:
    """id and the node as JSON."""
    return nodes.select("id", F.to_json(F.struct(*nodes.columns)).alias("node"))


def decoded(rows: DataFrame) -> DataFrame:
    """Nodes from JSON (column node); a missing normal form is made again."""
    return rows.select(F.from_json("node", NODE).alias("n")).select("n.*").withColumn("normalized_text", F.coalesce("normalized_text", T.collapse(F.col("text"))))


def save_graph(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """A graph as JSON lines: nodes, edges, and a line of counts."""
    nodes.write.mode("overwrite").json(f"{path}/nodes")
    edges.write.mode("overwrite").json(f"{path}/edges")
    n, m = nodes.agg(F.count("*").alias("concepts")), edges.agg(F.count("*").alias("relationships"))
    n.crossJoin(m).write.mode("overwrite").json(f"{path}/metadata")  # a row each


def load_graph(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """A stored graph's nodes and edges; empty ones where none is stored."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/metadata/_SUCCESS")
    if not folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(folder):
        return spark.createDataFrame([], NODE), spark.createDataFrame([], EDGE)
    return spark.read.schema(NODE).json(f"{path}/nodes"), spark.read.schema(EDGE).json(f"{path}/edges")

