"""Registered queries: the concept graph and learning paths."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import graph, paths
from ..sources import model as M
from .base import registry

Q, S, query = registry()

#: Twenty requests of two or three targets among the parts.
_REQ = "req AS (SELECT (p_partkey // 40) % 20 AS path_id, p_partkey AS id FROM part WHERE p_partkey % 40 = 7)"
_EDGES = "e AS (SELECT p_partkey AS src, p_partkey // 2 AS dst FROM part WHERE p_partkey >= 2)"
_IN = "reach(path_id, id) AS (SELECT path_id, id FROM req UNION SELECT path_id, dst FROM reach JOIN e ON src = id), m AS (SELECT path_id, id, (path_id, id) IN (SELECT (path_id, id) FROM req) AS is_target FROM reach)"
_IND = "ind AS (SELECT a.path_id, e.src, e.dst FROM m a JOIN e ON e.src = a.id JOIN m b ON b.path_id = a.path_id AND b.id = e.dst)"
_DEPTH = "walk(path_id, id, h) AS (SELECT path_id, id, 0 FROM m UNION SELECT w.path_id, dst, h + 1 FROM walk w JOIN ind i ON i.path_id = w.path_id AND i.src = w.id), dep AS (SELECT path_id, id, max(h) AS level FROM walk GROUP BY ALL)"
_ORD = "ord AS (SELECT path_id, id, is_target, row_number() OVER (PARTITION BY path_id ORDER BY level DESC, id DESC) AS place FROM dep JOIN m USING (path_id, id))"
_TRIM = "trim AS (SELECT path_id, id, is_target, row_number() OVER (PARTITION BY path_id ORDER BY place) AS place FROM (SELECT *, count(*) FILTER (is_target) OVER (PARTITION BY path_id) AS t, row_number() OVER (PARTITION BY path_id, is_target ORDER BY place) AS n FROM ord) WHERE CASE WHEN is_target THEN n <= 8 ELSE n <= greatest(8 - t, 0) END)"
_BASE = f"WITH RECURSIVE {_REQ}, {_EDGES}, {_IN}, {_IND}"


def requests(spark, d):
    k = F.col("p_partkey")
    return M.table(spark, d, "part").filter(k % 40 == 7).select((F.floor(k / 40) % 20).cast("long").alias("path_id"), k.alias("id"))


def related(spark, d):
    p = M.table(spark, d, "part")
    n = p.count()
    return p.select(F.col("p_partkey").alias("src"), ((F.col("p_partkey") * 7 + 3) % n).alias("dst"))


@query("path_members_p8", f"WITH RECURSIVE {_REQ}, {_EDGES}, {_IN} SELECT * FROM m")
def path_members(spark, d):
    return paths.members(requests(spark, d), M.prerequisites(spark, d))


@query("induced_subgraph_p2", f"{_BASE} SELECT * FROM ind")
def induced(spark, d):
    e = M.prerequisites(spark, d)
    return paths.induced(paths.members(requests(spark, d), e), e)


@query("path_order_p3", f"{_BASE}, {_DEPTH}, {_ORD} SELECT path_id, id, is_target, CAST(place AS INTEGER) AS place FROM ord")
def path_order(spark, d):
    e = M.prerequisites(spark, d)
    return paths.ordered(paths.members(requests(spark, d), e), e)


@query("path_trim_p4", f"{_BASE}, {_DEPTH}, {_ORD}, {_TRIM} SELECT path_id, id, is_target, CAST(place AS INTEGER) AS place FROM trim")
def path_trim(spark, d):
    e = M.prerequisites(spark, d)
    return paths.trimmed(paths.ordered(paths.members(requests(spark, d), e), e), 8)


@query("learning_path_p6", f"{_BASE}, {_DEPTH}, {_ORD}, {_TRIM} SELECT path_id, CAST(place AS INTEGER) AS place, id, p_name AS text, is_target, CASE WHEN id >= 2 THEN CAST(id // 2 AS VARCHAR) ELSE '' END AS prerequisites, CAST((id * 7 + 3) % (SELECT count(*) FROM part) AS VARCHAR) AS related FROM trim JOIN part ON p_partkey = id")
def learning_path(spark, d):
    return paths.learning_paths(requests(spark, d), M.concepts(spark, d), M.prerequisites(spark, d), related(spark, d), 8)


@query("path_detail_p5", f"WITH {_REQ} SELECT path_id, CAST(row_number() OVER (PARTITION BY path_id ORDER BY id) AS INTEGER) AS place, id, p_name AS text, true AS is_target, CASE WHEN id >= 2 THEN CAST(id // 2 AS VARCHAR) ELSE '' END AS prerequisites, CAST((id * 7 + 3) % (SELECT count(*) FROM part) AS VARCHAR) AS related FROM req JOIN part ON p_partkey = id")
def path_detail(spark, d):
    from pyspark.sql import Window

    path = requests(spark, d).withColumns({"is_target": F.lit(True), "place": F.row_number().over(Window.partitionBy("path_id").orderBy("id"))})
    return paths.detailed(path, M.concepts(spark, d), M.prerequisites(spark, d), related(spark, d))


_STEPS = "n AS (SELECT count(*) AS n FROM part), st AS (SELECT p_partkey AS src, (p_partkey * 7 + 3) % n AS dst FROM part, n UNION SELECT p_partkey, (p_partkey * 11 + 5) % n FROM part, n UNION SELECT p_partkey, p_partkey // 2 FROM part)"


@query("shortest_path_p7", f"WITH RECURSIVE {_STEPS}, r(node, hops) AS (SELECT CAST(1 AS BIGINT), 0 UNION SELECT dst, hops + 1 FROM r JOIN st ON src = node WHERE hops < 60) SELECT node, CAST(min(hops) AS INTEGER) AS hops, CAST(min(hops) + 1 AS INTEGER) AS nodes FROM r GROUP BY node")
def shortest_path(spark, d):
    """From one concept to all that can be reached, over related links before prerequisites."""
    p = M.table(spark, d, "part")
    n = p.count()
    k = F.col("p_partkey")
    links = F.array(*[F.struct(F.lit(kind).alias("kind"), F.lit(pos).alias("pos"), dst.cast("long").alias("dst")) for kind, pos, dst in ((0, 0, (k * 7 + 3) % n), (0, 1, (k * 11 + 5) % n), (1, 0, F.floor(k / 2)))])
    edges = p.select(k.alias("src"), F.explode(links).alias("l")).select("src", "l.*")
    return paths.concept_paths(edges, 1).select("node", "hops", F.size("path").alias("nodes"))


# a weighted graph over the parts: prerequisite edges lead from a part to the one of twice its number
_NODES = "nodes AS (SELECT p_partkey AS id, p_name AS text, p_type AS domain, CASE WHEN p_partkey % 3 = 0 THEN 'theoretical' ELSE 'practical' END AS concept_class, (p_size * 37 % 101) / 100.0 AS score FROM part)"
_WEDGES = "we AS (SELECT p_partkey // 2 AS src, p_partkey AS dst, 'prerequisite' AS kind, (p_size % 10) / 10.0 AS strength FROM part WHERE p_partkey >= 2 UNION ALL SELECT p_partkey, p_partkey + 5, 'related', (p_size % 7) / 7.0 FROM part WHERE p_partkey + 5 < (SELECT count(*) FROM part))"


def nodes(spark, d):
    p, k = M.table(spark, d, "part"), F.col("p_partkey")
    return p.select(k.alias("id"), F.col("p_name").alias("text"), F.col("p_type").alias("domain"), F.when(k % 3 == 0, "theoretical").otherwise("practical").alias("concept_class"), (F.col("p_size") * 37 % 101 / 100.0).alias("score"))


def weighted(spark, d):
    p, k = M.table(spark, d, "part"), F.col("p_partkey")
    n = p.count()
    one = p.filter("p_partkey >= 2").select(F.floor(k / 2).cast("long").alias("src"), k.alias("dst"), F.lit("prerequisite").alias("kind"), (F.col("p_size") % 10 / 10.0).alias("strength"))
    return one.unionByName(p.filter(k + 5 < n).select(k.alias("src"), (k + 5).alias("dst"), F.lit("related").alias("kind"), (F.col("p_size") % 7 / 7.0).alias("strength")))


_RATIO = "pick AS (SELECT path_id, id, is_target, concept_class FROM (SELECT *, CASE WHEN concept_class = 'theoretical' THEN floor(least(t, 9) * 0.4) ELSE least(t, 9) - floor(least(t, 9) * 0.4) END AS wanted, row_number() OVER (PARTITION BY path_id, concept_class ORDER BY score DESC, id) AS n FROM (SELECT m.*, concept_class, score, count(*) OVER (PARTITION BY path_id) AS t FROM m JOIN nodes USING (id))) WHERE n <= wanted OR is_target)"
_RBASE = f"WITH RECURSIVE {_NODES}, {_WEDGES}, {_REQ}, e AS (SELECT dst AS src, src AS dst FROM we WHERE kind = 'prerequisite'), {_IN}, {_RATIO}"


@query("ratio_members_p10", f"{_RBASE} SELECT * FROM pick")
def ratio_members(spark, d):
    return paths.ratio_members(requests(spark, d), nodes(spark, d).drop("text", "domain"), weighted(spark, d), 0.4, 9)


_WORD = "pi AS (SELECT DISTINCT a.path_id, we.src, we.dst FROM pick a JOIN we ON we.src = a.id JOIN pick b ON b.path_id = a.path_id AND b.id = we.dst), pw(path_id, id, h) AS (SELECT path_id, id, 0 FROM pick UNION SELECT w.path_id, dst, h + 1 FROM pw w JOIN pi i ON i.path_id = w.path_id AND i.src = w.id), pd AS (SELECT path_id, id, max(h) AS level FROM pw GROUP BY ALL), po AS (SELECT pick.*, CAST(row_number() OVER (PARTITION BY path_id ORDER BY level, id) AS INTEGER) AS place FROM pick JOIN pd USING (path_id, id))"


@query("weighted_order_p9", f"{_RBASE}, {_WORD} SELECT path_id, id, is_target, concept_class, place FROM po")
def weighted_order(spark, d):
    return paths.ratio_paths(requests(spark, d), nodes(spark, d).select("id", "concept_class", "score"), weighted(spark, d), 0.4, 9)


_ENH = _RBASE.replace(_REQ, f"req0 AS (SELECT * FROM ({_REQ.split(' AS (', 1)[1][:-1]})), req AS (SELECT req0.* FROM req0 JOIN nodes USING (id) WHERE domain = 'PROMO')").replace("least(t, 9)", "least(t, 20)").replace("0.4", "0.5")


@query("enhanced_path_p11", f"{_ENH}, {_WORD}, pre AS (SELECT dst AS id, string_agg(CAST(src AS VARCHAR), ',' ORDER BY score DESC, src) AS prerequisites FROM we JOIN nodes n ON n.id = src WHERE kind = 'prerequisite' GROUP BY dst), nea AS (SELECT src AS id, string_agg(CAST(dst AS VARCHAR), ',' ORDER BY dst) AS related FROM (SELECT DISTINCT src, dst FROM we WHERE strength >= 0.3) GROUP BY src) SELECT path_id, place, id, text, domain, po.concept_class, is_target, score, coalesce(prerequisites, '') AS prerequisites, coalesce(related, '') AS related FROM po JOIN nodes USING (id) LEFT JOIN pre USING (id) LEFT JOIN nea USING (id)")
def enhanced_path(spark, d):
    return paths.enhanced_paths(requests(spark, d), nodes(spark, d), weighted(spark, d), "PROMO")


_ENGINE = M.with_sql("concepts occ videos", f", {_REQ}, rr AS (SELECT DISTINCT path_id, root AS id FROM req JOIN concepts ON concept_id = req.id), k AS (SELECT rr.path_id, rr.id, text, domain FROM rr JOIN concepts ON concept_id = rr.id), b AS (SELECT concept_id AS id, max(significance) AS weight, count(*) AS occurrences FROM occ GROUP BY 1), s AS (SELECT concept_id, video_id, round(n * 0.3 * (0.7 + 0.3 * (1 - abs(ratio - 0.5))) * CASE WHEN best >= 2.5 THEN 1.2 ELSE 1.0 END * CASE WHEN n > 3 THEN 1.2 ELSE 1.0 END, 6) AS score FROM (SELECT concept_id, video_id, count(*) AS n, max(significance) AS best FROM occ GROUP BY ALL) JOIN videos USING (video_id)), t AS (SELECT concept_id AS id, string_agg(CAST(video_id AS VARCHAR), ',' ORDER BY score DESC, video_id) AS recommended FROM (SELECT *, row_number() OVER (PARTITION BY concept_id ORDER BY score DESC, video_id) AS r FROM s) WHERE r <= 3 GROUP BY 1), eng AS (SELECT path_id, CAST(row_number() OVER (PARTITION BY path_id ORDER BY coalesce(weight, 0) DESC, coalesce(occurrences, 0) DESC, id) AS INTEGER) AS place, id, text, domain, coalesce(weight, 0.0) AS weight, coalesce(occurrences, 0) AS occurrences, CASE WHEN weight >= 2.5 AND weight > 3 THEN 'core' WHEN weight > 1.5 THEN 'supporting' ELSE 'mentions' END AS section, coalesce(recommended, '') AS recommended FROM k LEFT JOIN b USING (id) LEFT JOIN t USING (id))")


@query("engine_path_p12", f"{_ENGINE} SELECT * FROM eng")
def engine_path(spark, d):
    return paths.engine_paths(requests(spark, d), M.concepts(spark, d), M.occurrences(spark, d), M.videos(spark, d))


@query("merged_path_p14", f"{_ENGINE}, en AS (SELECT path_id, row_number() OVER (PARTITION BY path_id ORDER BY id DESC) AS place, id FROM req WHERE path_id % 2 = 0) SELECT path_id, CAST(en.place AS INTEGER) AS place, id, section, true AS is_enhanced FROM en LEFT JOIN (SELECT path_id, id, section FROM eng) USING (path_id, id) UNION ALL SELECT path_id, place, id, section, false FROM eng WHERE path_id NOT IN (SELECT path_id FROM en)")
def merged_path(spark, d):
    from pyspark.sql import Window

    enhanced = requests(spark, d).filter("path_id % 2 = 0").withColumn("place", F.row_number().over(Window.partitionBy("path_id").orderBy(F.desc("id"))))
    return paths.merged(engine_path(spark, d), enhanced)


_M = "m AS (SELECT l_partkey AS concept_id, l_orderkey AS segment_id, min(l_orderkey % 100) AS pos, min(CAST(l_orderkey AS VARCHAR) || ' about ' || (CASE l_orderkey % 3 WHEN 0 THEN 'small ring' WHEN 1 THEN 'Red Widget' ELSE 'bolt' END)) AS context FROM lineitem WHERE l_quantity >= 10 GROUP BY 1, 2), c AS (SELECT p_partkey AS concept_id, CASE WHEN p_partkey % 5 = 0 THEN split_part(p_name, ' ', 2) ELSE p_name END AS text FROM part)"


@query("relationships_o2", f"WITH {_M}, f AS (SELECT concept_id, min(pos) AS first FROM m GROUP BY 1), s AS (SELECT a.concept_id AS src, b.concept_id AS dst, count(*) AS n FROM m a JOIN m b USING (segment_id) WHERE a.concept_id <> b.concept_id GROUP BY 1, 2), k AS (SELECT src, dst, n, lower(x.text) AS sn, lower(y.text) AS dn, fx.first AS sf, fy.first AS df FROM s JOIN c x ON x.concept_id = src JOIN c y ON y.concept_id = dst JOIN f fx ON fx.concept_id = src JOIN f fy ON fy.concept_id = dst), g AS (SELECT DISTINCT src, dst FROM k JOIN m ON m.concept_id = dst WHERE sf < df - 3 AND contains(lower(context), sn)) SELECT src, dst, CASE WHEN contains(sn, dn) AND length(sn) > length(dn) THEN 'is_a' WHEN (src, dst) IN (SELECT (src, dst) FROM g) THEN 'prerequisite' ELSE 'related' END AS kind, CASE WHEN contains(sn, dn) AND length(sn) > length(dn) THEN greatest(least(n / 5, 1.0), 0.7) ELSE least(n / 5, 1.0) END AS strength FROM k")
def relationships(spark, d):
    k = F.col("l_orderkey")
    context = F.concat(k.cast("string"), F.lit(" about "), F.when(k % 3 == 0, "small ring").when(k % 3 == 1, "Red Widget").otherwise("bolt"))
    mentions = M.table(spark, d, "lineitem").filter("l_quantity >= 10").select(F.col("l_partkey").alias("concept_id"), k.alias("segment_id"), (k % 100).alias("pos"), context.alias("context"))
    p = M.table(spark, d, "part")
    concepts = p.select(F.col("p_partkey").alias("concept_id"), F.when(F.col("p_partkey") % 5 == 0, F.split_part("p_name", F.lit(" "), F.lit(2))).otherwise(F.col("p_name")).alias("text"))
    return graph.relationships(mentions, concepts)


@query("set_edges_o5", f"WITH {_WEDGES}, new AS (SELECT p_partkey // 2 AS src, p_partkey AS dst, CASE k WHEN 1 THEN 'is_a' ELSE 'related' END AS kind, k / 10.0 AS strength, k AS tt FROM part, (VALUES (1), (2)) v(k) WHERE p_partkey % 3 = 0 AND p_partkey % 2 + 1 >= k), val AS (SELECT src, dst, kind, strength FROM (SELECT *, row_number() OVER (PARTITION BY src, dst ORDER BY tt DESC) AS r FROM new WHERE src IN (SELECT p_partkey FROM part WHERE p_size < 40) AND dst IN (SELECT p_partkey FROM part WHERE p_size < 40)) WHERE r = 1) SELECT * FROM we WHERE (src, dst) NOT IN (SELECT (src, dst) FROM val) UNION ALL SELECT * FROM val")
def set_edges(spark, d):
    p, k = M.table(spark, d, "part"), F.col("p_partkey")
    turn = F.explode(F.when(k % 2 == 1, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1))))
    new = p.filter(k % 3 == 0).select(F.floor(k / 2).cast("long").alias("src"), k.alias("dst"), turn.alias("at"))
    new = new.select("src", "dst", F.when(F.col("at") == 1, "is_a").otherwise("related").alias("kind"), (F.col("at") / 10.0).alias("strength"), "at")
    return graph.set_edges(weighted(spark, d), new, p.filter("p_size < 40").select(k.alias("id")))


@query("related_strength_o6", f"WITH {_WEDGES} SELECT src, dst, strength FROM we WHERE strength >= 0.5")
def related_strength(spark, d):
    return graph.related(weighted(spark, d), 0.5)


@query("direct_prerequisites_o7", f"WITH {_WEDGES}, {_NODES} SELECT dst AS id, src AS prerequisite, CAST(row_number() OVER (PARTITION BY dst ORDER BY score DESC, src) AS INTEGER) AS rank FROM we JOIN nodes ON nodes.id = src WHERE kind = 'prerequisite'")
def direct_prerequisites(spark, d):
    return graph.direct_prerequisites(weighted(spark, d), nodes(spark, d).select("id", "score"))


@query("graph_clusters_o4", "SELECT 'domain' AS kind, p_type AS value, count(*) AS nodes FROM part GROUP BY ALL UNION ALL SELECT 'language', CASE p_partkey % 2 WHEN 0 THEN 'en' ELSE 'ru' END, count(*) FROM part GROUP BY ALL")
def graph_clusters(spark, d):
    n = M.table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_type").alias("domain"), F.when(F.col("p_partkey") % 2 == 0, "en").otherwise("ru").alias("language"))
    return graph.clusters(n)


@query("all_hierarchy_scores_l5", f"WITH {_WEDGES}, o AS (SELECT l_partkey AS id, count(*) AS occurrences, max(l_quantity / 10) AS weight FROM lineitem GROUP BY l_partkey) SELECT id, round(0.2 / len(string_split(p_name, ' ')) + 0.25 * least(coalesce(outs, 0) / 10, 1.0) + 0.15 * least(occurrences / 20, 1.0) + 0.25 * least(coalesce(ins, 0) / 5, 1.0) + 0.15 * least(weight / 5, 0.4), 6) AS score FROM o JOIN part ON p_partkey = id LEFT JOIN (SELECT src AS s, count(*) AS outs FROM we GROUP BY src) ON s = id LEFT JOIN (SELECT dst AS t, count(*) AS ins FROM we GROUP BY dst) ON t = id")
def all_hierarchy_scores(spark, d):
    by = M.occurrences(spark, d).groupBy(F.col("concept_id").alias("id")).agg(F.count("*").alias("occurrences"), F.max("significance").alias("weight"))
    p = M.table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.size(F.split("p_name", " ")).alias("words"))
    return graph.hierarchy(by.join(p, "id"), weighted(spark, d).select("src", "dst"))
