"""Registered queries: payloads, the stored index, the catalogue's files, batches of videos, time-window state."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import lexicons as L
from ..functions import text as T
from ..operators import ingest, lineage, reports
from ..sources import captions as C
from ..sources import catalog
from ..sources import model as M
from ..sources import store as ST
from ..streaming import state
from .base import count_sql, has_sql, registry, words_sql
from .mining import _CAND, candidates

Q, S, query = registry()

_KEYS = {"mathematics": ["tion", "the", "ing", "of"], "programming": ["que", "eau", "les"], "physics": ["und", "sch", "keit"]}
_BONUS = {"mathematics": "thon", "programming": "eaux", "physics": "nicht"}

# ---- payloads


def video_payloads(spark, d):
    k, s = F.col("doc_id"), lambda c: c.cast("string")
    snippet = F.struct(F.substring("text", 1, 40).alias("title"), F.col("source").alias("channelTitle"), F.lit("2024-01-01T00:00:00Z").alias("publishedAt"), F.lit("27").alias("categoryId"), F.array("lang", "source").alias("tags"), F.substring("text", 1, 300).alias("description"), F.when(k % 2 == 0, F.lit("ru-RU")).alias("defaultLanguage"))
    item = F.struct(s(k).alias("id"), snippet.alias("snippet"), F.struct(F.concat(F.lit("PT"), s(k % 3), F.lit("H"), s(k % 60), F.lit("M"), s(k % 7), F.lit("S")).alias("duration")).alias("contentDetails"), F.struct(s(k * 10).alias("viewCount")).alias("statistics"))
    items = F.when(k % 10 == 9, F.expr("array()")).otherwise(F.array(F.to_json(item)))
    payload = F.concat(F.lit('{"items": ['), F.array_join(items.cast("array<string>"), ","), F.lit("]}"))
    return M.table(spark, d, "documents").select(s(k).alias("video_id"), payload.alias("payload"))


_T16 = "SELECT doc_id, t, " + ", ".join(f"{has_sql('lower(t)', ks)} + CASE WHEN contains(lower(t), '{_BONUS[k]}') THEN 2 ELSE 0 END AS {k[0] + k[1]}" for k, ks in _KEYS.items()) + " FROM (SELECT doc_id, left(text, 40) || ' ' || left(text, 300) AS t FROM documents)"


@query("video_metadata_a7", f"SELECT CAST(doc_id AS VARCHAR) AS video_id, left(text, 40) AS title, source AS channel, CAST((doc_id % 3) * 3600 + (doc_id % 60) * 60 + doc_id % 7 AS INTEGER) AS duration_seconds, lang AS first_tag, CASE WHEN doc_id % 2 = 0 THEN 'ru' ELSE 'en' END AS language, doc_id * 10 AS view_count, CASE WHEN m = 0 THEN 'unknown' WHEN ma = m THEN 'mathematics' WHEN pr = m THEN 'programming' ELSE 'physics' END AS domain FROM documents JOIN (SELECT *, greatest(ma, pr, ph) AS m FROM ({_T16})) USING (doc_id) WHERE doc_id % 10 <> 9")
def video_metadata(spark, d):
    out = C.video_metadata(video_payloads(spark, d), _KEYS, _BONUS)
    return out.select("video_id", "title", "channel", "duration_seconds", F.col("tags")[0].alias("first_tag"), "language", "view_count", "domain")


@query("playlist_videos_a8", "SELECT 'L' || o_custkey % 20 AS playlist_id, CAST(o_orderkey AS INTEGER) AS position, 'v' || o_orderkey AS video_id, o_orderpriority AS title FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey % 20 ORDER BY o_orderkey) <= 12")
def playlist_videos(spark, d):
    k = F.col("o_orderkey")
    snippet = F.struct(F.col("o_orderpriority").alias("title"), F.lit("").alias("description"), k.cast("int").alias("position"), F.struct(F.concat(F.lit("v"), k.cast("string")).alias("videoId")).alias("resourceId"))
    o = M.table(spark, d, "orders").select(F.concat(F.lit("L"), (F.col("o_custkey") % 20).cast("string")).alias("playlist_id"), F.floor(k / 50).alias("page"), F.struct(snippet.alias("snippet")).alias("i"))
    pages = o.groupBy("playlist_id", "page").agg(F.to_json(F.struct(F.collect_list("i").alias("items"))).alias("payload"))
    return C.playlist_videos(pages, 12)


@query("playlist_metadata_a9", "SELECT 'L' || s_suppkey AS playlist_id, s_name AS title, 'c' || s_nationkey AS channel, CAST(s_suppkey % 9 AS INTEGER) AS item_count, 'public' AS privacy_status, CASE WHEN s_suppkey % 2 = 0 THEN 'de' ELSE 'en' END AS language FROM supplier")
def playlist_metadata(spark, d):
    k = F.col("s_suppkey")
    snippet = F.struct(F.col("s_name").alias("title"), F.concat(F.lit("c"), F.col("s_nationkey").cast("string")).alias("channelTitle"), F.when(k % 2 == 0, "de").alias("defaultLanguage"))
    item = F.struct(snippet.alias("snippet"), F.struct((k % 9).cast("int").alias("itemCount")).alias("contentDetails"), F.struct(F.lit("public").alias("privacyStatus")).alias("status"))
    return C.playlist_metadata(M.table(spark, d, "supplier").select(F.concat(F.lit("L"), k.cast("string")).alias("playlist_id"), F.to_json(F.struct(F.array(item).alias("items"))).alias("payload")))


_TRK = "trk AS (SELECT DISTINCT l_orderkey AS video_id, ['de', 'en-GB', 'ru', 'en', 'fr-CA', 'ru-RU', 'it'][l_linenumber] AS code, l_linenumber % 2 = 0 AS is_generated, l_linenumber AS seq FROM lineitem)"
_PREF = "CASE WHEN code = 'ru' OR starts_with(code, 'ru-') THEN 0 WHEN code = 'ru-RU' OR starts_with(code, 'ru-RU-') THEN 1 WHEN code = 'en' OR starts_with(code, 'en-') THEN 2 ELSE 9 END"


@query("best_tracks_a11", f"WITH {_TRK} SELECT video_id, code, is_generated, seq FROM trk QUALIFY row_number() OVER (PARTITION BY video_id ORDER BY {_PREF}, is_generated, seq) = 1")
def best_tracks(spark, d):
    code = F.element_at(F.array(*map(F.lit, ["de", "en-GB", "ru", "en", "fr-CA", "ru-RU", "it"])), F.col("l_linenumber"))
    tracks = M.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("video_id"), code.alias("code"), (F.col("l_linenumber") % 2 == 0).alias("is_generated"), F.col("l_linenumber").alias("seq")).distinct()
    return C.best_tracks(tracks, ["ru", "en"])


@query("page_tracks_a13", "SELECT page_id AS video_id, code, is_generated, seq, address FROM (SELECT page_id, 'en' AS code, false AS is_generated, CAST(0 AS INTEGER) AS seq, 'http://x/' || page_id || '?a=1&b=2' AS address FROM pages WHERE page_id % 3 <> 0 UNION ALL SELECT page_id, 'ru', true, 1, 'http://y' FROM pages WHERE page_id % 3 <> 0)")
def page_tracks(spark, d):
    k = F.col("page_id").cast("string")
    listed = F.concat(F.lit('<script>var x = {"captionTracks": [{"baseUrl":"http://x/'), k, F.lit('?a=1\\u0026b=2","languageCode":"en"},{"baseUrl":"http://y","languageCode":"ru","kind":"asr"}], "n": 1}</script>'))
    html = F.concat("html", F.when(F.col("page_id") % 3 != 0, listed).otherwise(""))
    return C.page_tracks(M.table(spark, d, "pages").select(F.col("page_id").alias("video_id"), html.alias("html")))


def _xml(spark, d):
    c = M.table(spark, d, "conversations").filter(F.trim("text") != "")
    text = F.regexp_replace("text", "<", "(")
    for a, b in (("&", "&amp;"), (">", "&gt;"), ('"', "&quot;")):
        text = F.replace(text, F.lit(a), F.lit(b))
    one = F.concat(F.lit('<text start="'), (F.col("turn") * 10).cast("string"), F.lit('.5" dur="10">'), text, F.lit("</text>"))
    parts = F.transform(F.array_sort(F.collect_list(F.struct("turn", one.alias("x")))), lambda s: s["x"])
    return c.groupBy(F.col("conv_id").alias("video_id")).agg(F.concat(F.lit("<transcript>"), F.array_join(parts, "\n"), F.lit("</transcript>")).alias("xml"))


_TT = "tt AS (SELECT conv_id AS video_id, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS INTEGER) AS pos, turn * 10.0 + 0.5 AS start, 10.0 AS duration, regexp_replace(replace(text, '<', '('), '^\\s+|\\s+$', '', 'g') AS text FROM conversations WHERE trim(text) <> '')"


@query("timed_text_a14", f"WITH {_TT} SELECT video_id, pos, start, duration, md5(text) AS h FROM tt")
def timed_text(spark, d):
    return C.timed_text(_xml(spark, d)).select("video_id", "pos", "start", "duration", F.md5("text").alias("h"))


@query("caption_fallback_a10", f"WITH {_TT} SELECT video_id, pos, CASE WHEN video_id % 3 = 0 THEN 0 ELSE 1 END AS source FROM tt WHERE video_id % 3 <> 1")
def caption_fallback(spark, d):
    every = C.timed_text(_xml(spark, d))
    return C.first_source(every.filter("video_id % 3 = 0"), every.filter("video_id % 3 <> 1")).select("video_id", "pos", "source")


@query("caption_dispatch_a15", f"WITH {_TT} SELECT source, count(*) AS n FROM (SELECT CASE WHEN video_id % 2 = 0 THEN 0 ELSE 1 END AS source FROM tt) GROUP BY source")
def caption_dispatch(spark, d):
    every = C.timed_text(_xml(spark, d))
    return C.first_source(every.filter("video_id % 2 = 0"), every).groupBy("source").agg(F.count("*").alias("n"))


@query("formatted_a16", "SELECT conv_id AS video_id, turn, CASE turn % 3 WHEN 0 THEN 'en' WHEN 1 THEN 'ru' ELSE 'en' END AS language FROM conversations WHERE turn % 5 <> 4 AND trim(text) <> ''")
def formatted(spark, d):
    language = F.when(F.col("turn") % 3 == 0, "EN-us").when(F.col("turn") % 3 == 1, "RU")
    c = M.table(spark, d, "conversations").select(F.col("conv_id").alias("video_id"), "turn", F.when(F.col("turn") % 5 == 4, "  ").otherwise(F.col("text")).alias("text"), language.alias("language"))
    return C.formatted(c).select("video_id", "turn", "language")


@query("mock_sources_a17", "SELECT * FROM (VALUES ('m1', 5, 45.0, 630, 5)) v(video_id, captions, finish, seconds, listed)")
def mock_sources(spark, d):
    t = C.mock_transcript(spark, "m1").groupBy("video_id").agg(F.count("*").cast("int").alias("captions"), F.max(F.col("start") + F.col("duration")).alias("finish"))
    m = C.mock_metadata(spark, "m1").select("video_id", F.col("duration_seconds").alias("seconds"))
    p = C.mock_playlist(spark, "PL123456").agg(F.count("*").cast("int").alias("listed")).withColumn("video_id", F.lit("m1"))
    return t.join(m, "video_id").join(p, "video_id").select("video_id", "captions", "finish", "seconds", "listed")


@query("duration_h13", "SELECT p_partkey, CAST(CASE p_partkey % 4 WHEN 0 THEN p_size * 3600 + 30 * 60 + 15 WHEN 1 THEN p_size * 60 WHEN 2 THEN p_size ELSE p_size * 3600 END AS INTEGER) AS seconds FROM part")
def duration(spark, d):
    n, k = F.col("p_size").cast("string"), F.col("p_partkey") % 4
    iso = F.when(k == 0, F.concat(F.lit("PT"), n, F.lit("H30M15S"))).when(k == 1, F.concat(F.lit("PT"), n, F.lit("M"))).when(k == 2, F.concat(F.lit("PT"), n, F.lit("S"))).otherwise(F.concat(F.lit("P1DT"), n, F.lit("H")))
    return M.table(spark, d, "part").select("p_partkey", T.duration_seconds(iso).alias("seconds"))


# ---- the catalogue's files


def _catalogue(spark, d):
    """JSONL files in the shared folder: a comment, a blank and a broken line, rows without an id, repeated ids."""
    p, k = M.table(spark, d, "part"), F.col("p_partkey")
    line = F.to_json(F.struct(F.concat(F.lit("c"), (F.floor(k / 2)).cast("string")).alias("concept_id"), F.create_map(F.lit("en"), F.array(F.upper("p_name"), F.lit(" "))).alias("representations"), F.array(F.concat(F.lit("c"), F.floor(k / 4).cast("string")), F.lit("gone")).alias("prerequisites"), F.create_map(F.lit("domain"), F.col("p_type")).alias("metadata")))
    odd = F.when(k % 17 == 3, "# comment").when(k % 17 == 5, "  ").when(k % 17 == 7, "{broken").when(k % 17 == 9, '{"representations": {}}').otherwise(line)
    path = lineage.folder(spark)
    for n, name in enumerate(("mathematics", "physics")):
        p.filter(F.floor(k / 2) % 2 == n).select(k, odd.alias("value")).repartition(1).sortWithinPartitions("p_partkey").select("value").write.text(f"{path}/raw/{name}")
        jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        folder = jvm.org.apache.hadoop.fs.Path(f"{path}/raw/{name}")
        system = folder.getFileSystem(conf)
        part = next(s.getPath() for s in system.listStatus(folder) if s.getPath().getName().startswith("part-"))
        system.rename(part, jvm.org.apache.hadoop.fs.Path(f"{path}/{name}.jsonl"))
    return catalog.load(spark, f"{path}/*.jsonl")


_GOOD = "good AS (SELECT p_partkey AS k, 'c' || p_partkey // 2 AS concept_id, lower(p_name) AS name, 'c' || p_partkey // 4 AS needs, p_type AS domain, CASE (p_partkey // 2) % 2 WHEN 0 THEN 'mathematics' ELSE 'physics' END AS category FROM part WHERE p_partkey % 17 NOT IN (3, 5, 7, 9)), cata AS (SELECT * FROM good QUALIFY row_number() OVER (PARTITION BY concept_id ORDER BY k DESC) = 1)"


@query("load_concepts_a1", f"WITH {_GOOD} SELECT concept_id, name, category FROM cata")
def load_concepts(spark, d):
    return _catalogue(spark, d).select("concept_id", F.col("representations")["en"][0].alias("name"), "category")


@query("scan_lines_a2", f"WITH {_GOOD} SELECT category, count(*) AS concepts FROM cata GROUP BY category")
def scan_lines(spark, d):
    return _catalogue(spark, d).groupBy("category").agg(F.count("*").alias("concepts"))


@query("validated_a4", f"WITH {_GOOD} SELECT concept_id, name, 2 AS prerequisites, 0 AS related, domain FROM cata")
def validated(spark, d):
    return _catalogue(spark, d).select("concept_id", F.col("representations")["en"][0].alias("name"), F.size("prerequisites").alias("prerequisites"), F.size("related").alias("related"), F.col("metadata")["domain"].alias("domain"))


@query("concept_get_a20", f"WITH {_GOOD} SELECT concept_id, name FROM cata WHERE concept_id = 'c20'")
def concept_get(spark, d):
    return _catalogue(spark, d).filter("concept_id = 'c20'").select("concept_id", F.col("representations")["en"][0].alias("name"))


@query("flatten_representations_b5", f"WITH {_GOOD} SELECT md5(concept_id || ':en:' || name) AS representation_id, concept_id, 'en' AS language, name AS text, name AS normalized_text FROM cata")
def flatten_representations(spark, d):
    return catalog.representations(_catalogue(spark, d))


@query("catalogue_links_b4", f"WITH {_GOOD} SELECT concept_id AS source_id, needs AS target_id, 'prerequisite' AS relationship_type FROM cata WHERE needs IN (SELECT concept_id FROM cata)")
def catalogue_links(spark, d):
    return catalog.relationships(_catalogue(spark, d))


@query("catalogue_save_b11", f"WITH {_GOOD} SELECT concept_id, name, category FROM cata WHERE concept_id NOT IN ('c1', 'c2')")
def catalogue_save(spark, d):
    """Saved beside the old files and read again, without two concepts."""
    path = catalog.save(catalog.delete(_catalogue(spark, d), "concept_id", ["c1", "c2"]), lineage.folder(spark))
    return catalog.saved(spark, path).select("concept_id", F.col("representations")["en"][0].alias("name"), "category")


@query("catalogue_delete_b12", f"WITH {_GOOD} SELECT concept_id FROM cata WHERE concept_id NOT IN ('c4', 'c6')")
def catalogue_delete(spark, d):
    return catalog.delete(_catalogue(spark, d), "concept_id", ["c4", "c6"]).select("concept_id")


@query("category_of_b13", f"WITH {_GOOD}, w AS (SELECT 'c' || p_partkey AS concept_id FROM part WHERE p_partkey % 2 = 1) SELECT concept_id, coalesce(category, 'interdisciplinary') AS category FROM w LEFT JOIN cata USING (concept_id)")
def category_of(spark, d):
    ids = M.table(spark, d, "part").filter("p_partkey % 2 = 1").select(F.concat(F.lit("c"), F.col("p_partkey").cast("string")).alias("concept_id"))
    return catalog.category_of(_catalogue(spark, d), ids)


@query("add_concepts_r1", f"WITH {_GOOD} SELECT concept_id, name FROM cata UNION ALL SELECT 'new' || p_partkey, lower(p_name) FROM part WHERE p_partkey < 20 AND p_partkey % 2 = 0")
def add_concepts(spark, d):
    c = _catalogue(spark, d)
    k = F.col("p_partkey")
    new = M.table(spark, d, "part").filter("p_partkey < 20").select(F.when(k % 2 == 0, F.concat(F.lit("new"), k.cast("string"))).otherwise("c10").alias("concept_id"), F.create_map(F.lit("en"), F.array(F.upper("p_name"))).alias("representations"), F.lit(None).cast("array<string>").alias("prerequisites"), F.lit(None).cast("array<string>").alias("related"), F.lit(None).cast("map<string,string>").alias("metadata"), F.lit("physics").alias("category"))
    return catalog.add_concepts(c, new).select("concept_id", F.col("representations")["en"][0].alias("name"))


@query("add_representation_r2", f"WITH {_GOOD} SELECT concept_id, CASE concept_id WHEN 'c5' THEN 3 ELSE 2 END AS texts FROM cata")
def add_representation(spark, d):
    c = catalog.add_representation(_catalogue(spark, d), "c5", "en", "Another NAME")
    return catalog.add_representation(c, "c5", "en", "another name").select("concept_id", F.size(F.col("representations")["en"]).alias("texts"))


@query("change_relationships_r3", f"WITH {_GOOD} SELECT concept_id, CASE concept_id WHEN 'c8' THEN needs || ',gone,c11' WHEN 'c9' THEN needs ELSE needs || ',gone' END AS needs FROM cata")
def change_relationships(spark, d):
    c = catalog.add_relationship(_catalogue(spark, d), "c8", "c11", "prerequisite")
    c = catalog.remove_relationship(c, "c9", "gone", "prerequisite")
    return c.select("concept_id", F.array_join("prerequisites", ",").alias("needs"))


@query("edit_concept_r5", f"WITH {_GOOD} SELECT CASE concept_id WHEN 'c2' THEN 'renamed' ELSE concept_id END AS concept_id, CASE needs WHEN 'c2' THEN 'renamed' ELSE needs END || ',gone' || CASE concept_id WHEN 'c2' THEN ',c7' ELSE '' END AS needs, CASE concept_id WHEN 'c2' THEN 'computer_science' ELSE category END AS category FROM cata")
def edit_concept(spark, d):
    changes = spark.createDataFrame([("c2", "renamed", ["c7"], None, None, None, {"note": "x"}, "computer_science")], "concept_id string, new_id string, add_prerequisites array<string>, drop_prerequisites array<string>, add_related array<string>, drop_related array<string>, metadata map<string,string>, category string")
    return catalog.edit(_catalogue(spark, d), changes).select("concept_id", F.array_join("prerequisites", ",").alias("needs"), "category")


@query("rebuild_index_r6", f"WITH {_GOOD} SELECT name AS text, count(*) AS concepts FROM cata GROUP BY name")
def rebuild_index(spark, d):
    return catalog.representations(_catalogue(spark, d)).groupBy("text").agg(F.count("*").alias("concepts"))


# ---- the stored index


def _videos(spark, d, n=60):
    o = M.table(spark, d, "orders").filter(F.col("o_orderkey") < n)
    none = F.lit(None).cast("string")
    return o.select(F.col("o_orderkey").cast("string").alias("video_id"), F.col("o_orderpriority").alias("title"), none.alias("description"), none.alias("channel"), none.alias("publication_date"), F.lit(630).alias("duration_seconds"), F.lit("en").alias("language"), F.lit("x").alias("domain"), F.lit(0.5).alias("ratio"), F.lit("pending").alias("processing_status"))


def _items(spark, d, n=60):
    i = M.table(spark, d, "lineitem").filter(F.col("l_orderkey") < n).groupBy("l_orderkey", "l_linenumber", "l_partkey").agg((F.max("l_quantity") / 10).alias("w"))
    v, seg = F.col("l_orderkey").cast("string"), F.concat_ws("-", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string"))
    segments = i.groupBy(seg.alias("segment_id"), v.alias("video_id"), "l_linenumber").agg(F.max("w").alias("w")).select("segment_id", "video_id", (F.col("l_linenumber") * 10.0).alias("start_time"), F.concat(F.lit("text of "), "segment_id").alias("text"), F.when(F.col("l_linenumber") % 2 == 0, "ru").alias("language"), F.col("w").alias("educational_value"))
    occ = i.select(F.concat_ws("-", seg, F.col("l_partkey").cast("string")).alias("occurrence_id"), F.col("l_partkey").cast("string").alias("concept_id"), v.alias("video_id"), seg.alias("segment_id"), (F.col("l_linenumber") * 10.0).alias("start_time"), F.col("w").alias("significance"), F.lit("passing").alias("kind"), F.lit(1.0).alias("similarity"), F.concat(F.lit("of "), seg).alias("context"))
    return segments, occ


def _stored(spark, d):
    """A store with the parts as concepts, filled by one indexing, and by another for some of its videos."""
    s = ST.Store(spark, lineage.folder(spark))
    s.bootstrap()
    p = M.table(spark, d, "part").filter("p_partkey % 5 <> 0")
    none = F.expr("cast(array() as array<string>)")
    s.upsert_concepts(p.select(F.col("p_partkey").cast("string").alias("concept_id"), F.create_map(F.lit("en"), F.array("p_name")).alias("representations"), none.alias("prerequisites"), none.alias("related"), F.create_map(F.lit("domain"), F.col("p_type")).alias("metadata"), F.lit("physics").alias("category")))
    v, (g, o) = _videos(spark, d), _items(spark, d)
    s.index_content(v, g, o)
    again = v.filter("video_id % 4 = 0").withColumn("title", F.lit("again"))
    keep = F.col("video_id") % 4 == 0
    s.index_content(again, g.filter(keep & (F.col("start_time") < 30)), o.filter(keep))
    return s


_STORE = "it AS (SELECT CAST(l_orderkey AS VARCHAR) AS video_id, l_linenumber AS n, CAST(l_partkey AS VARCHAR) AS concept_id, max(l_quantity) / 10 AS w FROM lineitem WHERE l_orderkey < 60 AND NOT (l_orderkey % 4 = 0 AND l_linenumber >= 3) GROUP BY ALL), it2 AS (SELECT * FROM it WHERE video_id IN (SELECT CAST(o_orderkey AS VARCHAR) FROM orders)), ocs AS (SELECT video_id || '-' || n || '-' || concept_id AS occurrence_id, it2.* FROM it2 WHERE CAST(concept_id AS BIGINT) % 5 <> 0 AND CAST(concept_id AS BIGINT) IN (SELECT p_partkey FROM part))"


@query("index_content_b17", f"WITH {_STORE} SELECT item_type, language, count(*) AS n, round(sum(w), 4) AS weight FROM (SELECT 'segment' AS item_type, CASE WHEN n % 2 = 0 THEN 'ru' ELSE 'en' END AS language, max(w) AS w FROM it2 GROUP BY video_id, n UNION ALL SELECT 'occurrence', CASE WHEN n % 2 = 0 THEN 'ru' ELSE 'en' END, w FROM ocs WHERE w >= 1.5) GROUP BY ALL")
def index_content(spark, d):
    return _stored(spark, d).read("search_index").groupBy("item_type", "language").agg(F.count("*").alias("n"), F.round(F.sum("significance"), 4).alias("weight"))


@query("stored_occurrences_b7", f"WITH {_STORE} SELECT occurrence_id, CASE WHEN w >= 2.5 THEN 'comprehensive' ELSE 'passing' END AS kind FROM ocs")
def stored_occurrences(spark, d):
    return _stored(spark, d).read("occurrences").select("occurrence_id", "kind")


@query("upsert_videos_b2", "SELECT CAST(o_orderkey AS VARCHAR) AS video_id, CASE WHEN o_orderkey % 4 = 0 THEN 'again' ELSE o_orderpriority END AS title, 'completed' AS status FROM orders WHERE o_orderkey < 60")
def upsert_videos(spark, d):
    return _stored(spark, d).read("videos").select("video_id", "title", F.col("processing_status").alias("status"))


@query("replace_segments_b3", f"WITH {_STORE} SELECT video_id, count(*) AS n FROM (SELECT DISTINCT video_id, n FROM it2 WHERE video_id <> '7' UNION ALL SELECT '7', -1 WHERE EXISTS (SELECT 1 FROM it2)) GROUP BY video_id")
def replace_segments(spark, d):
    s = _stored(spark, d)
    one = spark.createDataFrame([("7-x", "7", 0.0, "new text", "en", 1.0)], ST.SCHEMAS["segments"])
    s.replace_segments(one)
    return s.read("segments").groupBy("video_id").agg(F.count("*").alias("n"))


@query("cascade_delete_b20", f"WITH {_STORE} SELECT 'occurrences' AS name, count(*) AS n FROM ocs WHERE video_id NOT IN ('1', '2', '3') UNION ALL SELECT 'segments', count(*) FROM (SELECT DISTINCT video_id, n FROM it2 WHERE video_id NOT IN ('1', '2', '3')) UNION ALL SELECT 'videos', count(*) FROM orders WHERE o_orderkey < 60 AND o_orderkey NOT IN (1, 2, 3)")
def cascade_delete(spark, d):
    s = _stored(spark, d)
    s.delete_videos(["1", "2", "3"])
    counts = [s.read(n).agg(F.count("*").alias("n")).select(F.lit(n).alias("name"), "n") for n in ("occurrences", "segments", "videos")]
    return counts[0].unionByName(counts[1]).unionByName(counts[2])


@query("execute_update_b10", "SELECT (SELECT count(*) FROM orders WHERE o_orderkey < 60 AND o_orderkey % 4 = 0) AS changed, (SELECT count(*) FROM orders WHERE o_orderkey < 60 AND o_orderkey % 4 = 0) AS found")
def execute_update(spark, d):
    s = _stored(spark, d)
    n = s.update("videos", "title = 'again'", {"language": "'de'"})
    return s.read("videos").agg(F.lit(n).cast("long").alias("changed"), F.count_if(F.col("language") == "de").alias("found"))


@query("optimise_b18", f"WITH {_STORE} SELECT count(*) AS kept FROM ocs")
def optimise(spark, d):
    s = _stored(spark, d)
    s.optimise()
    s.sweep()
    return s.read("occurrences").agg(F.count("*").alias("kept"))


@query("bootstrap_b1", "SELECT * FROM (VALUES ('candidates', 0), ('concepts', 0), ('occurrences', 0), ('relationships', 0), ('representations', 0), ('search_index', 0), ('segments', 0), ('videos', 0)) v(name, n)")
def bootstrap(spark, d):
    s = ST.Store(spark, lineage.folder(spark))
    s.bootstrap()
    rows = [s.read(n).agg(F.count("*").cast("int").alias("n")).select(F.lit(n).alias("name"), "n") for n in sorted(ST.SCHEMAS)]
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out


@query("parameterised_sql_a18", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'F' AND o_totalprice > 150000")
def parameterised_sql(spark, d):
    return ST.query(spark, "SELECT o_orderkey, o_totalprice FROM {t} WHERE o_orderstatus = :s AND o_totalprice > :p", {"t": M.table(spark, d, "orders")}, s="F", p=150000)


@query("get_by_key_a19", "SELECT o_orderkey, o_orderpriority FROM orders WHERE o_orderkey = 7")
def get_by_key(spark, d):
    return M.table(spark, d, "orders").filter("o_orderkey = 7").select("o_orderkey", "o_orderpriority")


@query("candidate_files_a5", f"WITH {_CAND} SELECT candidate_id, text, score, status FROM cand")
def candidate_files(spark, d):
    """Candidates written as JSON and scanned again."""
    path = lineage.folder(spark)
    c = candidates(spark, d).drop("concept_id")
    c.write.json(path)
    return spark.read.schema(c.schema).json(path).select("candidate_id", "text", "score", "status")


@query("dictionary_files_a22", "SELECT p_name AS text, min(p_type) AS translation FROM part GROUP BY p_name")
def dictionary_files(spark, d):
    path = lineage.folder(spark)
    M.table(spark, d, "part").groupBy(F.col("p_name").alias("text")).agg(F.min("p_type").alias("translation")).write.json(path)
    return spark.read.schema("text string, translation string").json(path)


# ---- batches of videos

_PROC = {"theory": L.TEST_MARKERS[:3], "practice": L.TEST_MARKERS[3:]}
_RATIO = f"SELECT conv_id, CASE WHEN t + p = 0 THEN 0.5 ELSE 1 / (1 + 2.5 * pow(2.71828, -5 * (t / (t + p) - 0.5))) END AS r FROM (SELECT conv_id, CAST({count_sql('lower(text)', _PROC['theory'])} AS DOUBLE) AS t, CAST({count_sql('lower(text)', _PROC['practice'])} AS DOUBLE) AS p FROM (SELECT conv_id, string_agg(text, ' ' ORDER BY turn, text) AS text FROM conversations GROUP BY conv_id))"


def _analysed(spark, d):
    t = M.transcripts(spark, d)
    return ingest.analysed(t.select("video_id").distinct().withColumn("title", F.lit("t")), t, L.TEST_MARKERS, L.TEST_DOMAINS, _PROC["theory"], _PROC["practice"])


def _batch(spark, d):
    from .mining import _GROUPS, _TERMS, catalogue

    t = M.transcripts(spark, d)
    meta = t.select("video_id").distinct().unionByName(spark.createDataFrame([(-1,), (-2,)], "video_id long")).withColumn("title", F.lit("t"))
    return ingest.process(meta, t, catalogue(spark, d).drop("rank"), L.TEST_MARKERS, L.TEST_DOMAINS, **_PROC, groups=_GROUPS, terms=_TERMS)


@query("processed_videos_i1", f"SELECT conv_id AS video_id, 'en' AS language, round(r, 6) AS ratio FROM ({_RATIO})")
def processed_videos(spark, d):
    return _analysed(spark, d)[0].select("video_id", "language", "ratio")


@query("processed_segments_i13", f"SELECT conv_id AS video_id, turn AS pos, round(0.8 * ({has_sql('lower(t)', L.TEST_MARKERS)}) + least(len({words_sql('t')}) / 20.0, 2.0), 6) AS value FROM (SELECT conv_id, turn, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(replace(regexp_replace(text, '\\s+', ' ', 'g'), ' i ', ' I '), '([\\p{{L}}\\p{{N}}_])\\.([\\p{{L}}\\p{{N}}_])', '\\1. \\2', 'g'), '\\[[^\\]]*\\]:?', '', 'g'), '\\.{{3,}}', '...', 'g'), '\\s+([,.])', '\\1', 'g'), '^\\s+|\\s+$', '', 'g') AS t FROM conversations WHERE trim(text) <> '')")
def processed_segments(spark, d):
    return _analysed(spark, d)[1].select("video_id", "pos", F.col("educational_value").alias("value"))


@query("batch_results_s2", "SELECT DISTINCT conv_id AS video_id, 'completed' AS status, CAST(NULL AS VARCHAR) AS reason FROM conversations UNION ALL SELECT * FROM (VALUES (-1, 'error', 'no transcript'), (-2, 'error', 'no transcript')) v")
def batch_results(spark, d):
    return _batch(spark, d).results.select("video_id", "status", "reason")


@query("process_video_s1")
def process_video(spark, d):
    """The whole result of each video of a batch; its parts have SQL of their own."""
    return _batch(spark, d).results


@query("playlist_run_s3")
def playlist_run(spark, d):
    results = _batch(spark, d).results
    return ingest.playlist_totals(results, results.select(F.pmod("video_id", F.lit(7)).alias("playlist_id"), "video_id"))


@query("submitted_s4", "SELECT CAST(o_orderkey AS VARCHAR) AS video_id, CASE WHEN o_orderstatus = 'F' THEN 'already_processed' ELSE 'accepted' END AS status FROM orders")
def submitted(spark, d):
    o = M.table(spark, d, "orders").select(F.col("o_orderkey").cast("string").alias("video_id"), F.when(F.col("o_orderstatus") == "F", "completed").otherwise("pending").alias("processing_status"))
    return ingest.submitted(o.select("video_id"), o)


@query("video_status_s5", "SELECT 'v' || p_partkey AS video_id, CASE WHEN p_partkey % 3 = 0 THEN 'not_found' ELSE p_type END AS status FROM part")
def video_status(spark, d):
    name = F.concat(F.lit("v"), F.col("p_partkey").cast("string"))
    p = M.table(spark, d, "part")
    return ingest.status_of(p.select(name.alias("video_id")), p.filter("p_partkey % 3 <> 0").select(name.alias("video_id"), F.col("p_type").alias("processing_status")))


@query("video_concepts_s7", M.with_sql("concepts occ", ", b AS (SELECT video_id, concept_id, max(significance) AS significance, max(significance) >= 2.5 AS is_educational FROM occ GROUP BY ALL) SELECT video_id, CAST(r AS INTEGER) AS rank, concept_id, text, significance FROM (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY significance DESC, concept_id) AS r FROM b WHERE is_educational) JOIN concepts USING (concept_id) WHERE r <= 5"))
def video_concepts(spark, d):
    by = M.occurrences(spark, d).groupBy("video_id", "concept_id").agg(F.max("significance").alias("significance")).withColumn("is_educational", F.col("significance") >= 2.5)
    return ingest.explained(by, M.concepts(spark, d))


@query("address_kind_s15", "SELECT page_id, CASE page_id % 3 WHEN 0 THEN 'playlist' WHEN 1 THEN 'video' ELSE 'unknown' END AS kind FROM pages")
def address_kind(spark, d):
    k = F.col("page_id") % 3
    a = F.when(k == 0, "https://www.youtube.com/watch?v=abc&list=PL1").when(k == 1, "https://youtu.be/abc?t=5").otherwise(F.col("url"))
    return M.table(spark, d, "pages").select("page_id", ingest.address_kind(a).alias("kind"))


@query("educational_exists_e15", M.with_sql("occ", "SELECT p_partkey AS concept_id, count(o.concept_id) > 0 AS has FROM part LEFT JOIN occ o ON o.concept_id = p_partkey AND significance >= 4.9 GROUP BY p_partkey"))
def educational_exists(spark, d):
    some = M.occurrences(spark, d).filter("significance >= 4.9").select("concept_id").distinct().withColumn("has", F.lit(True))
    return M.table(spark, d, "part").select(F.col("p_partkey").alias("concept_id")).join(some, "concept_id", "left").select("concept_id", F.coalesce("has", F.lit(False)).alias("has"))


# ---- time-window state


def _events(spark, d):
    return M.table(spark, d, "events").withColumn("seconds", F.unix_seconds(F.col("ts").cast("timestamp")).cast("double"))


@query("rate_limit_u1", "WITH RECURSIVE e AS (SELECT user_id AS client, event_id, CAST(floor(epoch(ts)) AS DOUBLE) AS s, row_number() OVER (PARTITION BY user_id ORDER BY floor(epoch(ts)), event_id) AS i FROM events), r AS (SELECT client, event_id, i, s AS anchor, 1 AS used FROM e WHERE i = 1 UNION ALL SELECT e.client, e.event_id, e.i, CASE WHEN s - anchor > 21600 THEN s ELSE anchor END, CASE WHEN s - anchor > 21600 THEN 1 ELSE used + 1 END FROM r JOIN e ON e.client = r.client AND e.i = r.i + 1) SELECT client, event_id, used <= 3 AS allowed FROM r")
def rate_limit(spark, d):
    return state.rate_limit(_events(spark, d).select(F.col("user_id").alias("client"), "event_id", "seconds"), 3600 * 6, 3)


_LRU = (
    "WITH RECURSIVE e AS (SELECT event_type AS cache, CAST(user_id AS VARCHAR) AS k, CAST(floor(epoch(ts)) AS DOUBLE) AS s, row_number() OVER (PARTITION BY event_type ORDER BY floor(epoch(ts)), event_id) AS i FROM events), "
    "r(cache, i, held, hit) AS (SELECT DISTINCT cache, CAST(0 AS BIGINT), CAST([] AS STRUCT(k VARCHAR, x DOUBLE)[]), false FROM e UNION ALL SELECT r.cache, e.i, CASE WHEN len(list_filter(held, lambda h: h.k = e.k AND h.x > e.s)) > 0 THEN list_concat(list_filter(held, lambda h: h.k <> e.k), list_filter(held, lambda h: h.k = e.k)) "
    "ELSE list_append((list_filter(held, lambda h: h.k <> e.k))[greatest(1, len(list_filter(held, lambda h: h.k <> e.k)) - 48):], {'k': e.k, 'x': e.s + 86400}) END, len(list_filter(held, lambda h: h.k = e.k AND h.x > e.s)) > 0 FROM r JOIN e ON e.cache = r.cache AND e.i = r.i + 1) "
)


@query("cache_replay_u2", f"{_LRU} SELECT cache, count(*) FILTER (hit) AS hits, count(*) FILTER (NOT hit) AS misses, round(avg(CAST(hit AS INTEGER)), 6) AS hit_rate FROM r WHERE i > 0 GROUP BY cache")
def cache_replay(spark, d):
    e = _events(spark, d).select(F.col("event_type").alias("cache"), F.col("user_id").cast("string").alias("key"), "event_id", "seconds")
    return state.cache_stats(state.cache_replay(e, 50, 3600 * 24))


@query("cache_log_u8")
def cache_log(spark, d):
    """Gets, sets, deletes, sweeps and clears of four caches: results of each, by operation."""
    k = F.col("event_id")
    op = F.when(k % 97 == 0, "clear").when(k % 53 == 0, "sweep").when(k % 11 == 0, "delete").when(k % 3 == 0, "set").otherwise("get")
    log = _events(spark, d).select(F.element_at(F.array(*map(F.lit, L.CACHES)), (k % 4 + 1).cast("int")).alias("cache"), F.col("user_id").cast("string").alias("key"), op.alias("op"), "event_id", "seconds")
    return state.log_stats(state.cache_log(log))


@query("cache_sweep_u6", "SELECT event_id FROM events WHERE floor(epoch(ts)) + value * 3600 > epoch(TIMESTAMP '2024-01-15 00:00:00')")
def cache_sweep(spark, d):
    entries = _events(spark, d).select("event_id", (F.col("seconds") + F.col("value") * 3600).alias("expires"))
    return state.expire(entries, 1705276800.0).select("event_id")


@query("event_windows", "SELECT event_type, date_trunc('hour', ts) AS begin, count(*) AS n, round(sum(value), 4) AS value FROM events GROUP BY ALL")
def event_windows(spark, d):
    return state.event_windows(M.table(spark, d, "events"))


@query("playlist_report_s17", "SELECT c_nationkey AS playlist_id, count(*) AS videos, count(*) FILTER (c_acctbal > 0) AS completed, CAST(sum(CASE WHEN c_acctbal > 0 THEN c_custkey % 5 ELSE 0 END) AS BIGINT) AS concepts FROM customer GROUP BY c_nationkey")
def playlist_report(spark, d):
    c = M.table(spark, d, "customer")
    results = c.select(F.col("c_custkey").alias("video_id"), F.when(F.col("c_acctbal") > 0, "completed").otherwise("error").alias("status"), (F.col("c_custkey") % 5).alias("concepts"), F.lit(0).alias("educational"), F.lit(0).alias("candidates"))
    return ingest.playlist_totals(results, c.select(F.col("c_nationkey").alias("playlist_id"), F.col("c_custkey").alias("video_id"))).drop("educational", "candidates")


@query("concept_listing_s22", M.with_sql("concepts", "SELECT concept_id, text FROM concepts ORDER BY text, concept_id LIMIT 20"))
def concept_listing(spark, d):
    return reports.page(M.concepts(spark, d), ["text", "concept_id"], 1, 20).select("concept_id", "text")
