"""Registered queries: phrase search, ranking, facets, suggestions.

The index holds three kinds of rows: documents as segments, part names as concepts,
and line items of high quantity as occurrences.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import search
from ..sources import model as M
from .base import registry

Q, S, query = registry()

PHRASES = [(1, "of the"), (2, "und  DIE"), (3, "de la"), (4, "small"), (5, 'Ring "'), (6, "red widget"), (7, "  "), (8, "que")]
_ASKED = "asked(query_id, phrase) AS (VALUES " + ", ".join(f"({q}, '{p}')" for q, p in PHRASES) + ")"
_INDEX = (
    "idx AS (SELECT 'd' || doc_id AS id, text, lang AS language, 'segment' AS item_type, doc_id % 300 AS video_id, (n_chars % 50) / 10.0 AS significance FROM documents "
    "UNION ALL SELECT 'p' || p_partkey, p_name, CASE p_partkey % 2 WHEN 0 THEN 'en' ELSE 'fr' END, 'concept', p_partkey % 300, (p_size % 50) / 10.0 FROM part "
    "UNION ALL SELECT 'o' || l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey, p_name, 'en', 'occurrence', l_orderkey % 300, max(l_quantity) / 10 FROM lineitem JOIN part ON p_partkey = l_partkey WHERE l_quantity >= 48 GROUP BY ALL), "
    "vid AS (SELECT o_orderkey AS video_id, o_orderpriority AS title, (o_orderkey % 11) / 10.0 AS ratio FROM orders WHERE o_orderkey < 250)"
)
_TOK = "list_filter(regexp_split_to_array(translate(lower({c}), 'àáâäãåçèéêëìíîïñòóôöõùúûüýÿ', 'aaaaaaceeeeiiiinooooouuuuyy'), '[^\\p{{L}}\\p{{N}}]+'), lambda t: t <> '')"
_HITS = f"hit AS (SELECT query_id, id FROM idx, asked WHERE len({_TOK.format(c='phrase')}) > 0 AND contains(' ' || array_to_string({_TOK.format(c='text')}, ' ') || ' ', ' ' || array_to_string({_TOK.format(c='phrase')}, ' ') || ' '))"
_SEARCH = f"WITH {_ASKED}, {_INDEX}, {_HITS}"


def index(spark, d):
    k = F.col("p_partkey")
    segments = M.table(spark, d, "documents").select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("id"), "text", F.col("lang").alias("language"), F.lit("segment").alias("item_type"), (F.col("doc_id") % 300).alias("video_id"), (F.col("n_chars") % 50 / 10.0).alias("significance"))
    part = M.table(spark, d, "part")
    concepts = part.select(F.concat(F.lit("p"), k.cast("string")).alias("id"), F.col("p_name").alias("text"), F.when(k % 2 == 0, "en").otherwise("fr").alias("language"), F.lit("concept").alias("item_type"), (k % 300).alias("video_id"), (F.col("p_size") % 50 / 10.0).alias("significance"))
    item = M.table(spark, d, "lineitem").filter("l_quantity >= 48").join(part, F.col("l_partkey") == k)
    name = F.concat(F.lit("o"), F.concat_ws("-", *[F.col(c).cast("string") for c in ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")]))
    found = item.groupBy(name.alias("id"), F.col("p_name").alias("text"), (F.col("l_orderkey") % 300).alias("video_id")).agg((F.max("l_quantity") / 10).alias("significance"))
    occurrences = found.select("id", "text", F.lit("en").alias("language"), F.lit("occurrence").alias("item_type"), "video_id", "significance")
    return segments.unionByName(concepts).unionByName(occurrences)


def asked(spark):
    return spark.createDataFrame(PHRASES, "query_id int, phrase string")


def videos(spark, d):
    return M.videos(spark, d).filter("video_id < 250").select("video_id", "title", "ratio")


@query("phrase_hits_q1", f"{_SEARCH} SELECT * FROM hit")
def phrase_hits(spark, d):
    return search.phrase_hits(search.postings(index(spark, d)), asked(spark)).select("query_id", "id")


_TOP = "top AS (SELECT * FROM (SELECT query_id, id, text, language, item_type, video_id, significance, title, CAST(row_number() OVER (PARTITION BY query_id ORDER BY significance DESC, id) AS INTEGER) AS rank FROM hit JOIN idx USING (id) JOIN vid USING (video_id) WHERE {f}) WHERE rank <= {n})"


def _search(spark, d, **options):
    i = index(spark, d)
    return search.search(i, search.postings(i), asked(spark), videos(spark, d), **options)


@query("phrase_search_q1", f"{_SEARCH}, {_TOP.format(f='true', n=20)} SELECT query_id, rank, id, language, item_type, video_id, significance, title FROM top")
def phrase_search(spark, d):
    return _search(spark, d).select("query_id", "rank", "id", "language", "item_type", "video_id", "significance", "title")


@query("filtered_search_q1", f"{_SEARCH}, {_TOP.format(f=chr(39) + 'en' + chr(39) + ' = language AND significance >= 1.5 AND item_type IN (' + chr(39) + 'segment' + chr(39) + ', ' + chr(39) + 'concept' + chr(39) + ')', n=15)} SELECT query_id, rank, id FROM top")
def filtered_search(spark, d):
    return _search(spark, d, language="en", least=1.5, types=["segment", "concept"], limit=15).select("query_id", "rank", "id")


@query("index_videos_d2", f"WITH {_INDEX} SELECT id, title FROM idx JOIN vid USING (video_id)")
def index_videos(spark, d):
    return index(spark, d).join(videos(spark, d), "video_id").select("id", "title")


_DET = f"{_SEARCH}, {_TOP.format(f='true', n=20)}, det AS (SELECT query_id, rank, top.id, item_type, CASE item_type WHEN 'concept' THEN top.id WHEN 'occurrence' THEN 'p' || string_split(top.id, '-')[3] END AS concept_id, CASE item_type WHEN 'segment' THEN CAST(substr(top.id, 2) AS DOUBLE) * 2 WHEN 'occurrence' THEN CAST(string_split(top.id, '-')[2] AS DOUBLE) * 10 END AS start_time FROM top)"


@query("hit_details_d14", f"{_DET} SELECT query_id, rank, id, item_type, concept_id, p_name AS concept, start_time FROM det LEFT JOIN part ON 'p' || p_partkey = concept_id")
def hit_details(spark, d):
    part = M.table(spark, d, "part").select(F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("concept_id"), F.col("p_name").alias("text"))
    segments = M.table(spark, d, "documents").select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("segment_id"), (F.col("doc_id") * 2.0).alias("start_time"))
    occ = index(spark, d).filter("item_type = 'occurrence'").select(F.col("id").alias("occurrence_id"), F.split("id", "-").alias("x"))
    occ = occ.select("occurrence_id", F.concat(F.lit("p"), F.col("x")[2]).alias("concept_id"), (F.col("x")[1].cast("double") * 10).alias("start_time"))
    return search.details(_search(spark, d), part, segments, occ)


_SYN = [("small", "large"), ("small", "tiny little"), ("ring", "bolt"), ("red", "green")]
_SYN_SQL = "syn(word, synonym) AS (VALUES " + ", ".join(f"('{a}', '{b}')" for a, b in _SYN) + ")"


@query("synonym_phrases_q3", f"WITH {_ASKED}, {_SYN_SQL}, w AS (SELECT query_id, lower(phrase) AS phrase, string_split(lower(phrase), ' ') AS ws FROM asked) SELECT query_id, phrase FROM w UNION SELECT query_id, array_to_string(list_concat(list_concat(ws[:k - 1], [synonym]), ws[k + 1:]), ' ') FROM (SELECT *, unnest(range(1, len(ws) + 1)) AS k FROM w) JOIN syn ON word = ws[k]")
def synonym_phrases(spark, d):
    return search.synonym_phrases(asked(spark), spark.createDataFrame(_SYN, "word string, synonym string"))


@query("synonym_search_q3", f"WITH asked0(query_id, phrase) AS (VALUES (1, 'small widget'), (2, 'ring')), {_SYN_SQL}, w AS (SELECT query_id, phrase, string_split(phrase, ' ') AS ws FROM asked0), asked AS (SELECT query_id, phrase FROM w UNION SELECT query_id, array_to_string(list_concat(list_concat(ws[:k - 1], [synonym]), ws[k + 1:]), ' ') FROM (SELECT *, unnest(range(1, len(ws) + 1)) AS k FROM w) JOIN syn ON word = ws[k]), {_INDEX}, {_HITS} SELECT DISTINCT query_id, id FROM hit")
def synonym_search(spark, d):
    wanted = spark.createDataFrame([(1, "small widget"), (2, "ring")], "query_id int, phrase string")
    phrases = search.synonym_phrases(wanted, spark.createDataFrame(_SYN, "word string, synonym string"))
    return search.phrase_hits(search.postings(index(spark, d)), phrases).select("query_id", "id").distinct()


_TERMS = "list_distinct(regexp_extract_all(lower(phrase), '[\\p{L}\\p{N}_]+'))"
_RANKED = (
    f"{_SEARCH}, {_TOP.format(f='true', n=200)}, sc AS (SELECT top.*, ratio, len(list_filter({_TERMS}, lambda t: contains(' ' || lower(text) || ' ', ' ' || t || ' '))) AS ex, len(list_filter({_TERMS}, lambda t: contains(lower(text), t))) AS an, "
    f"len(list_filter({_TERMS}, lambda t: contains(lower(title), t))) > 0 AS ti FROM top JOIN asked USING (query_id) JOIN (SELECT video_id, ratio FROM vid) USING (video_id)), "
    "rk AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS INTEGER) AS place FROM (SELECT *, round(1 + 2.0 * ex + (an - ex) + CASE WHEN ti THEN 1.5 ELSE 0 END + (1 - abs(0.6 - ratio)) + CASE item_type WHEN 'concept' THEN 1.3 ELSE 1.0 END + CASE language WHEN 'en' THEN 0.5 ELSE 0 END + CASE WHEN significance > 2.5 THEN 2.0 ELSE 0 END + 0.4 * least(significance, 5.0), 2) AS score FROM sc))"
)


def _ranked(spark, d):
    hits = _search(spark, d, limit=200).join(videos(spark, d).select("video_id", "ratio"), "video_id")
    return search.ranked(hits, asked(spark), 0.6, "en")


@query("ranked_search_f2", f"{_RANKED} SELECT query_id, place, id, score FROM rk")
def ranked_search(spark, d):
    return _ranked(spark, d).select("query_id", "place", "id", "score")


@query("relevance_l7", f"{_RANKED} SELECT query_id, item_type, language, count(*) AS n, round(min(score), 2) AS lowest, round(max(score), 2) AS highest FROM rk GROUP BY ALL")
def relevance(spark, d):
    return _ranked(spark, d).groupBy("query_id", "item_type", "language").agg(F.count("*").alias("n"), F.round(F.min("score"), 2).alias("lowest"), F.round(F.max("score"), 2).alias("highest"))


_CANON = f"{_RANKED}, roots AS (SELECT 'p' || p_partkey AS concept_id, 'p' || min(p_partkey) OVER (PARTITION BY p_type, p_name) AS root, p_name AS root_text FROM part), cn AS (SELECT query_id, root, min(place) AS first, max(score) AS score, arg_min(root_text, place) AS text, arg_min(language, place) AS language, coalesce(string_agg(DISTINCT CASE WHEN concept_id <> root THEN text END, ',' ORDER BY CASE WHEN concept_id <> root THEN text END), '') AS variants FROM (SELECT rk.*, concept_id, root, root_text FROM rk JOIN roots ON concept_id = id) GROUP BY query_id, root), ca AS (SELECT query_id, root, text, score, variants, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, first) AS INTEGER) AS place FROM (SELECT *, row_number() OVER (PARTITION BY query_id, lower(text), language ORDER BY first) AS n FROM cn) WHERE n = 1)"


@query("orchestrated_search_q2", f"{_CANON} SELECT * FROM ca WHERE place <= 10")
def orchestrated_search(spark, d):
    """Search, ranking and canonical roots; the first page of each query's concepts."""
    from pyspark.sql import Window

    part = M.table(spark, d, "part")
    name = lambda c: F.concat(F.lit("p"), c.cast("string"))
    least = F.min("p_partkey").over(Window.partitionBy("p_type", "p_name"))
    roots = part.select(name(F.col("p_partkey")).alias("concept_id"), name(least).alias("root"), F.col("p_name").alias("root_text"))
    hits = _ranked(spark, d).withColumn("concept_id", F.col("id")).select("query_id", "concept_id", "text", "language", "score", "place")
    return search.canonical_hits(hits, roots).filter("place <= 10")


_FACETED = f"{_RANKED}, fh AS (SELECT rk.*, coalesce(p_type, 'unknown') AS domain, significance > 2.5 AS is_educational FROM rk LEFT JOIN part ON 'p' || p_partkey = id)"


def _faceted(spark, d):
    part = M.table(spark, d, "part").select(F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("id"), F.col("p_type").alias("domain"))
    hits = _ranked(spark, d).join(part, "id", "left").fillna("unknown", ["domain"])
    return hits.withColumns({"is_educational": F.col("significance") > 2.5, "concept_id": F.when(F.col("item_type") == "concept", F.col("id"))})


@query("search_facets_e8", f"{_FACETED} SELECT query_id, 'domain' AS facet, domain AS value, count(*) AS n FROM fh GROUP BY ALL UNION ALL SELECT query_id, 'language', language, count(*) FROM fh GROUP BY ALL UNION ALL SELECT query_id, 'kind', CASE WHEN is_educational THEN 'educational' ELSE 'passing' END, count(*) FROM fh GROUP BY ALL UNION ALL SELECT query_id, 'distinct videos', '', count(DISTINCT video_id) FROM fh GROUP BY query_id UNION ALL SELECT query_id, 'distinct concepts', '', count(DISTINCT CASE WHEN item_type = 'concept' THEN id END) FROM fh GROUP BY query_id")
def search_facets(spark, d):
    return search.facets(_faceted(spark, d))


_SUG = (
    f"{_FACETED}, g AS (SELECT query_id, list_sort(list(DISTINCT domain)) AS domains, count(*) FILTER (is_educational AND item_type = 'concept') AS taught, count(*) FILTER (NOT is_educational AND item_type = 'concept') AS mentioned, count(*) AS n, count(*) FILTER (item_type = 'concept') AS concepts, count(*) FILTER (language = 'en') AS en FROM fh GROUP BY query_id), "
    "a AS (SELECT asked.*, g.* EXCLUDE (query_id) FROM asked LEFT JOIN g USING (query_id) WHERE length(phrase) >= 3), "
    "l AS (SELECT query_id, list_concat(list_concat(list_concat(list_concat(CASE WHEN len(domains) > 1 THEN list_transform(list_filter(domains, lambda x: x <> 'unknown'), lambda x: 'domain_filter|' || x) ELSE [] END, CASE WHEN contains(lower(phrase), 'of') THEN ['theory_focus|0.8'] ELSE [] END), CASE WHEN contains(lower(phrase), 'ring') THEN ['practice_focus|0.2'] ELSE [] END), "
    "CASE WHEN taught > 0 AND mentioned > 0 AND taught < mentioned THEN ['educational_focus|educational'] ELSE [] END), list_concat(CASE WHEN n > 5 AND concepts > 0 THEN ['learning_path|' || phrase] ELSE [] END, CASE WHEN en > 0 THEN ['language|en'] ELSE [] END))[1:3] AS s FROM a)"
)


@query("suggestions_q4", f"{_SUG} SELECT query_id, CAST(k AS INTEGER) AS rank, string_split(s[k], '|')[1] AS kind, string_split(s[k], '|')[2] AS value FROM (SELECT *, unnest(range(1, len(s) + 1)) AS k FROM l)")
def suggestions(spark, d):
    return search.suggestions(_faceted(spark, d), asked(spark), theory=["of"], practice=["ring"])


@query("related_concepts_q5", M.with_sql("concepts occ", ", q AS (SELECT p_partkey AS concept_id FROM part WHERE p_partkey % 50 = 0), o AS (SELECT DISTINCT video_id, concept_id FROM occ), sh AS (SELECT a.concept_id, b.concept_id AS other_id, count(*) AS shared FROM o a JOIN q USING (concept_id) JOIN o b ON a.video_id = b.video_id AND a.concept_id <> b.concept_id WHERE b.concept_id IN (SELECT concept_id FROM concepts WHERE canonical IS NULL) GROUP BY ALL), n AS (SELECT *, 0 AS kind FROM (SELECT *, row_number() OVER (PARTITION BY concept_id ORDER BY shared DESC, other_id) AS r FROM sh) WHERE r <= 10), al AS (SELECT *, 1 AS kind FROM (SELECT c.concept_id, h.concept_id AS other_id, 0 AS shared, row_number() OVER (PARTITION BY c.concept_id ORDER BY h.concept_id) AS r FROM concepts c JOIN q USING (concept_id) JOIN concepts h ON h.domain = c.domain AND h.canonical IS NULL AND h.concept_id <> c.concept_id) WHERE r <= 10), u AS (SELECT concept_id, other_id, max(shared) AS shared, min(kind) AS kind FROM (SELECT * FROM n UNION ALL SELECT concept_id, other_id, shared, r, kind FROM al) GROUP BY ALL) SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY concept_id ORDER BY shared DESC, kind, other_id) AS INTEGER) AS rank FROM u) WHERE rank <= 10"))
def related_concepts(spark, d):
    """Of the concepts whose id is divisible by 50."""
    wanted = M.table(spark, d, "part").filter("p_partkey % 50 = 0").select(F.col("p_partkey").alias("concept_id"))
    return search.related(wanted, M.occurrences(spark, d), M.concepts(spark, d))
