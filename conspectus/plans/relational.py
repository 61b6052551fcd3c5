"""Registered queries: scans, joins, aggregates, rankings and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import reports as R
from ..sources import model as M

Q: dict = {}
S: dict[str, str] = {}


def query(name: str, sql: str):
    def add(f):
        Q[name] = f
        S[name] = sql
        return f

    return add


# occurrences of some videos, concepts and segments that are not stored
_STORED = "v AS (SELECT * FROM videos WHERE video_id % 7 <> 3), c AS (SELECT * FROM concepts WHERE concept_id % 11 <> 5), g AS (SELECT DISTINCT video_id, segment_pos FROM occ WHERE video_id % 5 <> 1)"


def _stored(spark, d):
    occ = M.occurrences(spark, d)
    return occ, M.videos(spark, d).filter("video_id % 7 <> 3"), M.concepts(spark, d).filter("concept_id % 11 <> 5"), occ.filter("video_id % 5 <> 1")


@query("concept_occurrences_c2", M.with_sql("videos concepts occ", f", {_STORED} SELECT concept_id, text, domain, video_id, title, language, segment_pos, significance FROM occ JOIN v USING (video_id) JOIN c USING (concept_id) JOIN g USING (video_id, segment_pos) WHERE significance >= 2.5 ORDER BY significance DESC, concept_id, video_id, segment_pos LIMIT 100"))
def concept_occurrences(spark, d):
    return R.concept_occurrences(*_stored(spark, d))


@query("occurrence_joins_d1", M.with_sql("videos concepts occ", f", {_STORED} SELECT title, count(*) AS n, round(sum(significance), 4) AS weight FROM occ JOIN v USING (video_id) JOIN g USING (video_id, segment_pos) GROUP BY title"))
def occurrence_joins(spark, d):
    occ, v, _, g = _stored(spark, d)
    found = occ.join(v, "video_id").join(g.select("video_id", "segment_pos").distinct(), ["video_id", "segment_pos"])
    return found.groupBy("title").agg(F.count("*").alias("n"), F.round(F.sum("significance"), 4).alias("weight"))


@query("catalogue_occurrences_d4", M.with_sql("videos concepts occ", f", {_STORED} SELECT domain, count(*) AS n FROM occ JOIN c USING (concept_id) GROUP BY domain"))
def catalogue_occurrences(spark, d):
    occ, _, c, _ = _stored(spark, d)
    return occ.join(c, "concept_id").groupBy("domain").agg(F.count("*").alias("n"))


@query("variant_occurrences_d7", M.with_sql("concepts occ", ", f AS (SELECT root AS family, concept_id FROM concepts) SELECT family, concept_id, count(*) AS n FROM f JOIN occ USING (concept_id) GROUP BY ALL"))
def variant_occurrences(spark, d):
    family = M.concepts(spark, d).select(F.col("root").alias("family"), "concept_id")
    return family.join(M.occurrences(spark, d), "concept_id").groupBy("family", "concept_id").agg(F.count("*").alias("n"))


@query("segments_by_video_c1", M.with_sql("occ", "SELECT video_id, segment_pos, start_time, significance FROM occ WHERE video_id BETWEEN 1 AND 50 AND significance >= 1.0 AND start_time >= 20"))
def segments_by_video(spark, d):
    return M.occurrences(spark, d).filter("video_id between 1 and 50 and significance >= 1.0 and start_time >= 20").select("video_id", "segment_pos", "start_time", "significance")


@query("list_concepts_page_c3", M.with_sql("concepts", "SELECT concept_id, text, domain FROM concepts ORDER BY text DESC, concept_id LIMIT 20 OFFSET 40"))
def list_concepts_page(spark, d):
    return R.page(M.concepts(spark, d), [F.desc("text"), "concept_id"], 3, 20).select("concept_id", "text", "domain")


@query("page_meta_f9", M.with_sql("concepts", "SELECT count(*) AS total, CAST(ceil(count(*) / 20.0) AS BIGINT) AS total_pages, 3 < ceil(count(*) / 20.0) AS has_next, true AS has_prev FROM concepts"))
def page_meta(spark, d):
    return R.page_meta(M.concepts(spark, d), 20, 3)


@query("inlist_c6", M.with_sql("videos", "SELECT video_id, title FROM videos WHERE title IN ('1-URGENT', '2-HIGH') AND language IN ('F', 'O')"))
def inlist(spark, d):
    return M.videos(spark, d).filter(F.col("title").isin("1-URGENT", "2-HIGH") & F.col("language").isin("F", "O")).select("video_id", "title")


@query("canonical_only_c7", M.with_sql("concepts", "SELECT concept_id, text FROM concepts WHERE canonical IS NULL"))
def canonical_only(spark, d):
    return M.concepts(spark, d).filter("canonical is null").select("concept_id", "text")


@query("representation_lookup_d3", M.with_sql("concepts", "SELECT a.concept_id, b.text FROM concepts a JOIN (SELECT DISTINCT text FROM concepts WHERE concept_id <= 20) b ON trim(lower(a.text)) = trim(lower(b.text))"))
def representation_lookup(spark, d):
    c = M.concepts(spark, d)
    wanted = c.filter("concept_id <= 20").select(F.col("text").alias("wanted")).distinct()
    return c.join(wanted, F.trim(F.lower("text")) == F.trim(F.lower("wanted"))).select("concept_id", F.col("wanted").alias("text"))


@query("representation_lookup_all_d3", M.with_sql("concepts", "SELECT a.concept_id, b.text FROM concepts a JOIN (SELECT DISTINCT text FROM concepts) b ON trim(lower(a.text)) = trim(lower(b.text))"))
def representation_lookup_all(spark, d):
    c = M.concepts(spark, d)
    wanted = c.select(F.col("text").alias("wanted")).distinct()
    return c.join(wanted, F.trim(F.lower("text")) == F.trim(F.lower("wanted"))).select("concept_id", F.col("wanted").alias("text"))


@query("segment_counts_left_d5", M.with_sql("transcripts occ", "SELECT t.video_id, t.pos, count(o.concept_id) AS n FROM transcripts t LEFT JOIN occ o ON t.video_id = o.video_id AND t.pos = o.segment_pos GROUP BY t.video_id, t.pos"))
def segment_counts(spark, d):
    return R.segment_counts(M.transcripts(spark, d), M.occurrences(spark, d))


@query("cooccurrence_d6", M.with_sql("occ", "SELECT a.concept_id, b.concept_id AS other_id, count(*) AS shared FROM (SELECT DISTINCT video_id, concept_id FROM occ) a JOIN (SELECT DISTINCT video_id, concept_id FROM occ) b ON a.video_id = b.video_id AND a.concept_id < b.concept_id GROUP BY ALL HAVING count(*) >= 2"))
def cooccurrence(spark, d):
    return R.cooccurrence(M.occurrences(spark, d))


@query("fk_semi_d12", M.with_sql("occ", "SELECT concept_id, video_id, segment_pos FROM occ WHERE video_id IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F') AND concept_id IN (SELECT p_partkey FROM part WHERE p_size > 25)"))
def fk_semi(spark, d):
    occ, o, p = M.occurrences(spark, d), M.table(spark, d, "orders").filter("o_orderstatus = 'F'"), M.table(spark, d, "part").filter("p_size > 25")
    return occ.join(o, occ.video_id == o.o_orderkey, "left_semi").join(p, occ.concept_id == p.p_partkey, "left_semi").select("concept_id", "video_id", "segment_pos")


@query("orphan_anti_d13", "SELECT c_custkey AS client FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def orphan_anti(spark, d):
    c, o = M.table(spark, d, "customer"), M.table(spark, d, "orders")
    return c.join(o, c.c_custkey == o.o_custkey, "left_anti").select(F.col("c_custkey").alias("client"))


@query("hit_enrichment_d14", M.with_sql("videos concepts occ", "SELECT o.concept_id, o.video_id, o.segment_pos, c.text, CASE WHEN o.significance >= 2.5 THEN v.title END AS title FROM occ o LEFT JOIN concepts c USING (concept_id) LEFT JOIN videos v ON v.video_id = o.video_id AND o.significance >= 2.5 WHERE o.significance >= 1.5"))
def hit_enrichment(spark, d):
    occ = M.occurrences(spark, d).filter(F.col("significance") >= M.INDEXED)
    out = occ.join(M.concepts(spark, d).select("concept_id", "text"), "concept_id", "left").join(M.videos(spark, d).select("video_id", "title"), "video_id", "left")
    return out.select("concept_id", "video_id", "segment_pos", "text", F.when(F.col("significance") >= M.COMPREHENSIVE, F.col("title")).alias("title"))


@query("educational_report_e1", M.with_sql("concepts occ", "SELECT concept_id, count(DISTINCT video_id) AS videos, count(*) AS occurrences, max(significance) AS weight, text, domain FROM occ JOIN (SELECT concept_id, text, domain FROM concepts WHERE concept_id % 11 <> 5) USING (concept_id) WHERE significance >= 2.5 GROUP BY concept_id, text, domain ORDER BY weight DESC, occurrences DESC, concept_id LIMIT 100"))
def educational_report(spark, d):
    return R.educational_report(M.occurrences(spark, d), M.concepts(spark, d).filter("concept_id % 11 <> 5"), M.COMPREHENSIVE)


@query("domain_stats_e2", M.with_sql("concepts occ", "SELECT domain, count(DISTINCT video_id) AS videos, count(*) AS occurrences, count(*) FILTER (significance >= 2.5) AS comprehensive FROM occ JOIN concepts USING (concept_id) GROUP BY domain"))
def domain_stats(spark, d):
    return R.domain_stats(M.occurrences(spark, d), M.concepts(spark, d))


@query("variant_root_totals_e3", M.with_sql("concepts occ", "SELECT root, count(DISTINCT video_id) AS videos, count(*) AS occurrences, count(DISTINCT video_id) > 1 AS multi_video FROM occ JOIN concepts USING (concept_id) GROUP BY root"))
def variant_root_totals(spark, d):
    return R.root_totals(M.occurrences(spark, d), M.concepts(spark, d))


@query("sample_videos_e4", M.with_sql("occ", "SELECT * FROM (SELECT concept_id, video_id, CAST(row_number() OVER (PARTITION BY concept_id ORDER BY video_id) AS INTEGER) AS rank FROM (SELECT DISTINCT concept_id, video_id FROM occ)) WHERE rank <= 3"))
def sample_videos(spark, d):
    return R.sample_videos(M.occurrences(spark, d))


@query("video_rollup_e5", M.with_sql("occ", "SELECT video_id, concept_id, count(*) AS n, max(significance) AS best, min(start_time) AS first_start, max(significance) >= 2.5 AS is_educational FROM occ GROUP BY ALL"))
def video_rollup(spark, d):
    return R.video_rollup(M.occurrences(spark, d))


@query("concept_detail_e6", M.with_sql("concepts occ", "SELECT root, domain, count(*) AS videos, CAST(sum(n) AS BIGINT) AS occurrences, max(n) AS most_in_video FROM (SELECT root, domain, video_id, count(*) AS n FROM occ JOIN concepts USING (concept_id) GROUP BY ALL) GROUP BY root, domain"))
def concept_detail(spark, d):
    return R.concept_detail(M.occurrences(spark, d), M.concepts(spark, d))


@query("timeline_e7", M.with_sql("occ", "SELECT video_id, segment_pos, count(*) AS concepts, array_to_string(list_sort(list_distinct(list(concept_id))), ',') AS ids FROM occ WHERE significance >= 3 GROUP BY ALL"))
def timeline(spark, d):
    return R.timeline(M.occurrences(spark, d), 3.0)


@query("facets_e8", M.with_sql("concepts videos occ", ", r AS (SELECT domain, language, CASE WHEN significance >= 2.5 THEN 'comprehensive' ELSE 'passing' END AS kind FROM occ JOIN concepts USING (concept_id) JOIN videos USING (video_id)) SELECT 'domain' AS facet, domain AS value, count(*) AS n FROM r GROUP BY domain UNION ALL SELECT 'language', language, count(*) FROM r GROUP BY language UNION ALL SELECT 'kind', kind, count(*) FROM r GROUP BY kind"))
def facets(spark, d):
    return R.facets(M.occurrences(spark, d), M.concepts(spark, d), M.videos(spark, d))


@query("catalogue_stats_e9", M.with_sql("concepts", "SELECT domain, count(*) AS concepts, count(DISTINCT text) AS names, count(*) FILTER (canonical IS NOT NULL) AS variants, round(avg(length(text)), 6) AS mean_length FROM concepts GROUP BY domain"))
def catalogue_stats(spark, d):
    c = M.concepts(spark, d)
    return c.groupBy("domain").agg(F.count("*").alias("concepts"), F.countDistinct("text").alias("names"), F.count("canonical").alias("variants"), F.round(F.avg(F.length("text")), 6).alias("mean_length"))


@query("status_stats_e10", "SELECT count(*) AS total, count(*) FILTER (status = 'pending') AS pending, count(*) FILTER (status = 'approved') AS approved, count(*) FILTER (status = 'rejected') AS rejected FROM (SELECT CASE o_orderstatus WHEN 'O' THEN 'pending' WHEN 'F' THEN 'approved' ELSE 'rejected' END AS status FROM orders)")
def status_stats(spark, d):
    s = F.col("o_orderstatus")
    return R.status_stats(M.table(spark, d, "orders").select(F.when(s == "O", "pending").when(s == "F", "approved").otherwise("rejected").alias("status")))


@query("playlist_totals_e11", "SELECT o_custkey AS playlist, count(*) FILTER (o_orderstatus = 'F') AS completed, count(*) AS videos, round(sum(CASE WHEN o_orderstatus = 'F' THEN o_totalprice ELSE 0 END), 2) AS total FROM orders GROUP BY o_custkey")
def playlist_totals(spark, d):
    done = F.col("o_orderstatus") == "F"
    return M.table(spark, d, "orders").groupBy(F.col("o_custkey").alias("playlist")).agg(F.count_if(done).alias("completed"), F.count("*").alias("videos"), F.round(F.sum(F.when(done, F.col("o_totalprice")).otherwise(0.0)), 2).alias("total"))


@query("existence_count_e15", M.with_sql("occ", "SELECT count(*) AS n FROM occ WHERE concept_id = 7"))
def existence_count(spark, d):
    return M.occurrences(spark, d).filter("concept_id = 7").agg(F.count("*").alias("n"))


@query("centroid_e17", "SELECT label, CAST(i - 1 AS INTEGER) AS dim, round(avg(embedding[i]), 5) AS mean FROM (SELECT label, embedding, unnest(range(1, 65)) AS i FROM embeddings) GROUP BY label, i")
def centroid(spark, d):
    e = M.table(spark, d, "embeddings").select("label", F.posexplode("embedding").alias("dim", "x"))
    return e.groupBy("label", "dim").agg(F.round(F.avg(F.col("x").cast("double")), 5).alias("mean"))


@query("first_per_group_f3", "SELECT user_id, event_type, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS r FROM events) WHERE r = 1")
def first_per_group(spark, d):
    return R.top_per_group(M.table(spark, d, "events"), ["user_id", "event_type"], ["ts", "event_id"], 1).select("user_id", "event_type", "event_id")


@query("sequence_numbers_f4", M.with_sql("occ", "SELECT video_id, concept_id, w, n, CAST(row_number() OVER (PARTITION BY video_id ORDER BY w DESC, n DESC, concept_id) AS INTEGER) AS seq FROM (SELECT video_id, concept_id, max(significance) AS w, count(*) AS n FROM occ GROUP BY ALL)"))
def sequence_numbers(spark, d):
    by = M.occurrences(spark, d).groupBy("video_id", "concept_id").agg(F.max("significance").alias("w"), F.count("*").alias("n"))
    return R.top_per_group(by, ["video_id"], [F.desc("w"), F.desc("n"), "concept_id"], 1 << 30, "seq")


@query("top3_videos_f6", M.with_sql("videos occ", ", s AS (SELECT concept_id, video_id, round(n * 0.3 * (0.7 + 0.3 * (1 - abs(ratio - 0.5))) * CASE WHEN best >= 2.5 THEN 1.2 ELSE 1 END * CASE WHEN n > 3 THEN 1.2 ELSE 1 END, 6) AS score FROM (SELECT concept_id, video_id, count(*) AS n, max(significance) AS best FROM occ GROUP BY ALL) JOIN videos USING (video_id)) SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY concept_id ORDER BY score DESC, video_id) AS INTEGER) AS rank FROM s) WHERE rank <= 3"))
def top3_videos(spark, d):
    return R.top_per_group(R.video_score(M.occurrences(spark, d), M.videos(spark, d)), ["concept_id"], [F.desc("score"), "video_id"], 3)


@query("earliest_segment_f8", M.with_sql("occ", "SELECT concept_id, min(segment_pos) AS first_pos, min(video_id) AS first_video FROM occ GROUP BY concept_id"))
def earliest_segment(spark, d):
    return M.occurrences(spark, d).groupBy("concept_id").agg(F.min("segment_pos").alias("first_pos"), F.min("video_id").alias("first_video"))


@query("canonical_and_variants_g1", M.with_sql("concepts", "SELECT DISTINCT root AS concept_id, 'canonical' AS kind FROM concepts UNION ALL SELECT concept_id, 'variant' FROM concepts WHERE canonical IS NOT NULL"))
def canonical_and_variants(spark, d):
    c = M.concepts(spark, d)
    return c.select(F.col("root").alias("concept_id"), F.lit("canonical").alias("kind")).distinct().unionByName(c.filter("canonical is not null").select("concept_id", F.lit("variant").alias("kind")))


@query("shared_ids_g2", "SELECT o_custkey AS id FROM orders WHERE o_orderstatus = 'F' INTERSECT SELECT o_custkey FROM orders WHERE o_orderstatus = 'O'")
def shared_ids(spark, d):
    o = M.table(spark, d, "orders")
    return o.filter("o_orderstatus = 'F'").select(F.col("o_custkey").alias("id")).intersect(o.filter("o_orderstatus = 'O'").select("o_custkey"))


@query("missing_ids_g3", "SELECT o_custkey AS id FROM orders WHERE o_orderstatus = 'F' EXCEPT SELECT o_custkey FROM orders WHERE o_orderstatus = 'O'")
def missing_ids(spark, d):
    o = M.table(spark, d, "orders")
    return o.filter("o_orderstatus = 'F'").select(F.col("o_custkey").alias("id")).subtract(o.filter("o_orderstatus = 'O'").select("o_custkey"))


@query("exact_then_variant_g5", M.with_sql("concepts", "SELECT domain, text, min(CASE WHEN canonical IS NULL THEN 0 ELSE 1 END) AS kind, min(concept_id) AS concept_id FROM concepts GROUP BY domain, text"))
def exact_then_variant(spark, d):
    return M.concepts(spark, d).groupBy("domain", "text").agg(F.min(F.when(F.col("canonical").isNull(), 0).otherwise(1)).alias("kind"), F.min("concept_id").alias("concept_id"))


@query("related_union_g6", M.with_sql("concepts occ", ", o AS (SELECT DISTINCT video_id, concept_id FROM occ), p AS (SELECT a.concept_id, b.concept_id AS other_id, count(*) AS shared FROM o a JOIN o b ON a.video_id = b.video_id AND a.concept_id <> b.concept_id GROUP BY ALL HAVING count(*) >= 2), h AS (SELECT domain, concept_id AS other_id FROM (SELECT *, row_number() OVER (PARTITION BY domain ORDER BY concept_id) AS r FROM concepts WHERE canonical IS NULL) WHERE r <= 10), u AS (SELECT concept_id, other_id, 0 AS kind, shared FROM p UNION ALL SELECT c.concept_id, h.other_id, 1, 0 FROM concepts c JOIN h USING (domain) WHERE c.concept_id <> h.other_id), g AS (SELECT concept_id, other_id, min(kind) AS kind, max(shared) AS shared FROM u GROUP BY ALL) SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY concept_id ORDER BY kind, shared DESC, other_id) AS INTEGER) AS rank FROM g) WHERE rank <= 10"))
def related_union(spark, d):
    return R.related_concepts(M.occurrences(spark, d), M.concepts(spark, d))


@query("sections_p13", M.with_sql("occ", "SELECT video_id, CASE WHEN w >= 2.5 AND w > 3 THEN 'core' WHEN w >= 2.5 OR w > 1.5 THEN 'supporting' ELSE 'mentions' END AS section, count(*) AS concepts FROM (SELECT video_id, concept_id, max(significance) AS w FROM occ GROUP BY ALL) GROUP BY ALL"))
def sections(spark, d):
    return R.sections(M.occurrences(spark, d))


@query("index_promotion_b8", M.with_sql("videos occ", "SELECT concept_id, o.video_id, segment_pos, coalesce(nullif(language, 'P'), 'en') AS language FROM occ o LEFT JOIN videos v USING (video_id) WHERE significance >= 1.5"))
def index_promotion(spark, d):
    occ = M.occurrences(spark, d).filter(F.col("significance") >= M.INDEXED)
    v = M.videos(spark, d).select("video_id", F.nullif("language", F.lit("P")).alias("language"))
    return occ.join(v, "video_id", "left").select("concept_id", "video_id", "segment_pos", F.coalesce("language", F.lit("en")).alias("language"))


@query("flatten_relationships_b6", "SELECT p_partkey AS source_id, t.target_id, t.kind FROM part JOIN (SELECT p_partkey AS k, p_partkey // 2 AS target_id, 'prerequisite' AS kind FROM part UNION ALL SELECT p_partkey, p_partkey + 100, 'related' FROM part) t ON k = p_partkey WHERE t.target_id IN (SELECT p_partkey FROM part)")
def flatten_relationships(spark, d):
    p = M.table(spark, d, "part").select("p_partkey")
    pairs = F.explode(F.array(F.struct(F.floor(F.col("p_partkey") / 2).cast("long").alias("target_id"), F.lit("prerequisite").alias("kind")), F.struct((F.col("p_partkey") + 100).alias("target_id"), F.lit("related").alias("kind"))))
    edges = p.select(F.col("p_partkey").alias("source_id"), pairs.alias("e")).select("source_id", "e.target_id", "e.kind")
    return edges.join(p, edges.target_id == p.p_partkey, "left_semi")


@query("save_occurrences_b7", M.with_sql("occ", "SELECT concept_id, video_id, segment_pos, significance, CASE WHEN significance >= 2.5 THEN 'comprehensive' ELSE 'passing' END AS kind FROM (SELECT *, row_number() OVER (PARTITION BY concept_id, video_id, segment_pos ORDER BY significance DESC) AS r FROM occ WHERE video_id IN (SELECT o_orderkey FROM orders) AND concept_id IN (SELECT p_partkey FROM part)) WHERE r = 1"))
def save_occurrences(spark, d):
    occ, o, p = M.occurrences(spark, d), M.table(spark, d, "orders"), M.table(spark, d, "part")
    valid = occ.join(o, occ.video_id == o.o_orderkey, "left_semi").join(p, occ.concept_id == p.p_partkey, "left_semi")
    last = valid.groupBy("concept_id", "video_id", "segment_pos").agg(F.max("significance").alias("significance"))
    return last.withColumn("kind", F.when(F.col("significance") >= M.COMPREHENSIVE, "comprehensive").otherwise("passing"))
