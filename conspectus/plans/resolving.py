"""Registered queries: de-duplication of names and concepts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import matching, resolve
from ..sources import model as M
from .base import registry

Q, S, query = registry()

#: Length of the longest common subsequence of the columns a and b.
LCS = "list_reduce(list_transform(string_split(a, ''), lambda c: [CAST(unicode(c) AS BIGINT)]), lambda row, x: list_reduce(list_transform(range(1, length(b) + 1), lambda j: [j]), lambda acc, j: list_append(acc, greatest(acc[len(acc)], row[j[1] + 1], row[j[1]] + CASE WHEN unicode(substr(b, j[1], 1)) = x[1] THEN 1 ELSE 0 END)), [CAST(0 AS BIGINT)]), list_transform(range(0, length(b) + 1), lambda z: CAST(0 AS BIGINT)))[length(b) + 1]"
NAMES = "SELECT DISTINCT p_name AS n FROM part"
SIMILAR = f"sim AS (SELECT a, b, round(CASE WHEN n < 2 THEN 0 ELSE n / least(length(a), length(b)) END, 6) AS similarity FROM (SELECT a, b, {LCS} AS n FROM (SELECT n AS a FROM ({NAMES})) JOIN (SELECT n AS b FROM ({NAMES})) ON a < b))"


def names(spark, d):
    return M.table(spark, d, "part").groupBy(F.col("p_name").alias("name")).agg(F.min("p_partkey").alias("rank"))


def pairs(spark, d, threshold):
    return resolve.similar_pairs(names(spark, d).select(F.lit(1).alias("block"), "name"), threshold)


@query("lcs_similarity_n1", f"WITH {SIMILAR} SELECT a, b, similarity FROM sim WHERE similarity >= 0.6")
def lcs_similarity(spark, d):
    return pairs(spark, d, 0.6)


@query("indel_ratio_k4", f"SELECT a AS query, b AS name, ratio FROM (SELECT a, b, round(2 * n / (length(a) + length(b)), 6) AS ratio FROM (SELECT a, b, {LCS} AS n FROM (SELECT n AS a FROM ({NAMES})) JOIN (SELECT n AS b FROM ({NAMES})) ON a < b)) WHERE ratio >= 0.6")
def indel_ratio(spark, d):
    n = names(spark, d).select("name")
    return matching.fuzzy(n.select(F.col("name").alias("query")), n, 0.6).filter("query < name")


@query("similar_lists_n2", f"WITH {SIMILAR}, b AS (SELECT a, b, similarity FROM sim UNION ALL SELECT b, a, similarity FROM sim) SELECT a AS name, string_agg(b, '|' ORDER BY similarity DESC, b) AS similar FROM b WHERE similarity >= 0.8 GROUP BY a")
def similar_lists(spark, d):
    return resolve.similar_lists(pairs(spark, d, 0.8)).select("name", F.array_join("similar", "|").alias("similar"))


_ORDER = "ord AS (SELECT name, rank, row_number() OVER (ORDER BY rank) AS i FROM (SELECT p_name AS name, min(p_partkey) AS rank FROM part GROUP BY p_name))"
_LEAD = f"{SIMILAR}, bo AS (SELECT a, b FROM sim WHERE similarity >= 0.75 UNION ALL SELECT b, a FROM sim WHERE similarity >= 0.75), {_ORDER}, adj AS (SELECT i, name, coalesce(list(b), []) AS near FROM ord LEFT JOIN (SELECT a, b FROM bo) ON a = name GROUP BY i, name), run(i, leaders) AS (SELECT CAST(0 AS BIGINT), CAST([] AS VARCHAR[]) UNION ALL SELECT run.i + 1, CASE WHEN len(list_filter(leaders, lambda x: list_contains(near, x))) = 0 THEN list_append(leaders, name) ELSE leaders END FROM run JOIN adj ON adj.i = run.i + 1), fin AS (SELECT leaders FROM run ORDER BY i DESC LIMIT 1), ldr AS (SELECT name, CASE WHEN list_contains(leaders, name) THEN name ELSE list_filter(leaders, lambda x: list_contains(near, x))[1] END AS leader FROM adj, fin)"


@query("leader_clusters_n3", f"WITH RECURSIVE {_LEAD} SELECT name, leader FROM ldr")
def leader_clusters(spark, d):
    return resolve.leader_clusters(names(spark, d), pairs(spark, d, 0.75))


_CONCEPTS = "con AS (SELECT p_partkey AS id, p_name AS text, CAST(p_size AS BIGINT) AS frequency, p_retailprice / 1000 AS weight, p_retailprice / 500 AS score, p_size > 40 AS is_educational, 1 + p_partkey % 3 AS occ FROM part)"


def concepts(spark, d):
    p = M.table(spark, d, "part")
    occ = F.sequence(F.lit(1), (1 + F.col("p_partkey") % 3).cast("int"))
    return p.select(F.col("p_partkey").alias("id"), F.col("p_name").alias("text"), F.col("p_size").cast("long").alias("frequency"), (F.col("p_retailprice") / 1000).alias("weight"), (F.col("p_retailprice") / 500).alias("score"), (F.col("p_size") > 40).alias("is_educational"), occ.alias("occurrences"), F.col("p_partkey").alias("rank"))


_MERGED = f"WITH RECURSIVE {_LEAD}, {_CONCEPTS}, rt AS (SELECT con.*, leader, round(0.4 * frequency + 0.2 * score + 0.3 * weight + 0.1 * len(string_split(text, ' ')), 6) AS q FROM con JOIN ldr ON name = text), mg AS (SELECT leader, arg_max(id, (q, -id)) AS canonical, arg_max(text, (q, -id)) AS text, arg_max(score, (q, -id)) AS sc, CAST(sum(frequency) AS BIGINT) AS frequency, max(weight) AS weight, bool_or(is_educational) AS is_educational, count(*) AS variants, string_agg(DISTINCT text, '|' ORDER BY text) AS texts, CAST(sum(occ) AS BIGINT) AS occurrences FROM rt GROUP BY leader)"


@query("deduplicate_n5", f"{_MERGED} SELECT canonical, text, frequency, weight, is_educational, variants, texts, occurrences, CAST(row_number() OVER (ORDER BY 2 * frequency + sc DESC, canonical) AS INTEGER) AS place FROM mg")
def deduplicate(spark, d):
    return resolve.deduplicate(concepts(spark, d))


@query("canonical_merge_e14", f"{_MERGED} SELECT canonical, frequency, weight, is_educational, variants, texts FROM mg")
def canonical_merge(spark, d):
    clusters = leader_clusters(spark, d).withColumnRenamed("name", "text")
    return resolve.merged(concepts(spark, d).join(clusters, "text")).select("canonical", "frequency", "weight", "is_educational", "variants", "texts")


@query("canonical_selection_n4", f"{_MERGED} SELECT rt.id, mg.canonical FROM rt JOIN mg USING (leader)")
def canonical_selection(spark, d):
    rows = concepts(spark, d).join(leader_clusters(spark, d).withColumnRenamed("name", "text"), "text").withColumn("quality", resolve.quality())
    best = rows.groupBy("leader").agg(F.max_by("id", F.struct("quality", -F.col("id"))).alias("canonical"))
    return rows.join(best, "leader").select("id", "canonical")


@query("dedup_applied_n6", f"{_MERGED} SELECT l_orderkey AS video_id, mg.canonical AS concept_id, count(*) AS n FROM lineitem JOIN rt ON rt.id = l_partkey JOIN mg USING (leader) GROUP BY ALL")
def dedup_applied(spark, d):
    occ = M.occurrences(spark, d).join(canonical_selection(spark, d), F.col("concept_id") == F.col("id"))
    return occ.groupBy("video_id", F.col("canonical").alias("concept_id")).agg(F.count("*").alias("n"))


@query("dedup_stats_e18", f"{_MERGED} SELECT (SELECT count(*) FROM con) AS original, count(*) AS deduplicated, round(100.0 * ((SELECT count(*) FROM con) - count(*)) / (SELECT count(*) FROM con), 2) AS reduction FROM mg")
def dedup_stats(spark, d):
    c = concepts(spark, d)
    return resolve.reduction(c, resolve.deduplicate(c))


@query("cluster_order_l12", "SELECT p_partkey AS id, CAST(row_number() OVER (PARTITION BY p_type ORDER BY 2 * p_size + p_retailprice / 500 DESC, p_partkey) AS INTEGER) AS place FROM part")
def cluster_order(spark, d):
    from pyspark.sql import Window

    w = Window.partitionBy("p_type").orderBy(F.desc(2 * F.col("p_size") + F.col("p_retailprice") / 500), "p_partkey")
    return M.table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.row_number().over(w).alias("place"))


@query("canonical_quality_l10", "SELECT p_partkey AS id, round(0.4 * p_size + 0.2 * (p_retailprice / 500) + 0.3 * (p_retailprice / 1000) + 0.1 * len(string_split(p_name, ' ')), 6) AS quality FROM part")
def canonical_quality(spark, d):
    return concepts(spark, d).select("id", resolve.quality().alias("quality"))


@query("canonical_quality_l11", "SELECT p_partkey AS id, round(0.3 * p_size + 0.3 * (p_retailprice / 500) + 0.2 * (p_retailprice / 1000) + 0.2 * len(string_split(p_name, ' ')), 6) AS quality FROM part")
def canonical_quality_corpus(spark, d):
    return concepts(spark, d).select("id", resolve.quality(0.3, 0.3, 0.2, 0.2).alias("quality"))


# distinct names with the figures of their first part; the job's state runs through them in order
_JOB = (
    f"{SIMILAR}, pr AS (SELECT a, b FROM sim WHERE similarity >= 0.8 UNION ALL SELECT b, a FROM sim WHERE similarity >= 0.8), {_ORDER}, "
    "rt AS (SELECT ord.*, round(0.3 * p_size + 0.3 * (p_retailprice / 500) + 0.2 * (p_retailprice / 1000) + 0.2 * len(string_split(name, ' ')), 6) AS q FROM ord JOIN part ON p_partkey = rank), "
    "gr AS (SELECT rank AS a, rank AS b FROM rt UNION ALL SELECT x.rank, y.rank FROM pr JOIN rt x ON x.name = a JOIN rt y ON y.name = b), "
    "be AS (SELECT a, arg_max(b, (q, CASE WHEN a = b THEN 1 ELSE 0 END, -b)) AS canonical, list(b) AS members FROM gr JOIN rt ON rt.rank = b GROUP BY a HAVING count(*) > 1), "
    "st AS (SELECT i, rank, canonical, list_filter(coalesce(members, []), lambda x: x <> canonical) AS taken FROM rt LEFT JOIN be ON a = rank), "
    "run(i, done, mapped) AS (SELECT CAST(0 AS BIGINT), CAST([] AS BIGINT[]), CAST([] AS BIGINT[]) UNION ALL SELECT run.i + 1, CASE WHEN list_contains(mapped, rank) THEN done ELSE list_append(done, rank) END, CASE WHEN list_contains(mapped, rank) THEN mapped ELSE list_concat(mapped, taken) END FROM run JOIN st ON st.i = run.i + 1), "
    "fin AS (SELECT done FROM run ORDER BY i DESC LIMIT 1), lk AS (SELECT id, arg_max(canonical, i) AS canonical FROM (SELECT i, canonical, unnest(taken) AS id FROM st, fin WHERE list_contains(done, rank)) GROUP BY id)"
)


@query("corpus_links_n7", f"WITH RECURSIVE {_JOB} SELECT id, canonical FROM lk")
def corpus_links(spark, d):
    n = names(spark, d)
    ids = lambda c: n.select(F.col("name").alias(c), F.col("rank").alias(f"{c}_id"))
    near = pairs(spark, d, 0.8).join(ids("a"), "a").join(ids("b"), "b").select(F.col("a_id").alias("a"), F.col("b_id").alias("b"))
    return resolve.corpus_links(concepts(spark, d).join(n.select("rank"), "rank"), near)


@query("manual_links_n8", M.with_sql("concepts", ", w AS (SELECT p_partkey // 2 AS canonical, p_partkey * 3 // 2 AS variant FROM part WHERE p_partkey > 0 UNION SELECT p_partkey + 100000, 1 FROM part WHERE p_partkey < 5) SELECT w.canonical, w.variant, CASE WHEN r.concept_id IS NULL THEN 'missing canonical' WHEN r.canonical IS NOT NULL THEN 'not a root' WHEN w.canonical = w.variant THEN 'self' WHEN v.concept_id IS NULL THEN 'missing' ELSE 'linked' END AS status FROM w LEFT JOIN concepts r ON r.concept_id = w.canonical LEFT JOIN concepts v ON v.concept_id = w.variant"))
def manual_links(spark, d):
    k = F.col("p_partkey")
    p = M.table(spark, d, "part")
    wanted = p.filter("p_partkey > 0").select(F.floor(k / 2).cast("long").alias("canonical"), F.floor(k * 3 / 2).cast("long").alias("variant")).union(p.filter("p_partkey < 5").select(k + 100000, F.lit(1).cast("long"))).distinct()
    return resolve.manual_links(wanted, M.concepts(spark, d).select("concept_id", "canonical"))
