"""Registered queries: lookups, single steps of larger operators, stored graphs, cache figures."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import lcs
from ..functions import lexicons as L
from ..functions import text as T
from ..operators import analysis, lineage, matching, reports, resolve, search, signatures, transcripts
from ..sources import catalog
from ..sources import model as M
from ..streaming import state
from . import language, mining, relational, resolving, searching, storing, textual
from .base import names_ru, registry

Q, S, query = registry()


@query("exact_lookup_k2", M.with_sql("concepts", "SELECT DISTINCT upper(q.text) AS query, c.concept_id FROM concepts c JOIN concepts q ON c.text = q.text WHERE q.domain = 'SMALL' AND c.concept_id % 2 = 0"))
def exact_lookup(spark, d):
    c = M.concepts(spark, d)
    index = c.select("concept_id", F.when(F.col("concept_id") % 2 == 0, "en").otherwise("ru").alias("language"), T.collapse(F.col("text")).alias("form"))
    wanted = c.filter("domain = 'SMALL'").select(T.collapse(F.upper("text")).alias("query"), F.lit("en").alias("asked")).distinct()
    return matching.lookup(wanted, index).select(F.upper("query").alias("query"), "concept_id")


_VI = language.S["variant_index_j22"]


@query("variant_lookup_k3", f"WITH vi AS ({_VI}) SELECT DISTINCT a.form AS query, b.concept_id FROM vi a JOIN vi b USING (form) WHERE a.concept_id % 40 = 0")
def variant_lookup(spark, d):
    index = analysis.variant_index(names_ru(spark, d).select(F.col("id").alias("concept_id"), F.col("name").alias("text"), F.lit("ru").alias("language")))
    wanted = index.filter("concept_id % 40 = 0").select(F.col("form").alias("query"), F.col("language").alias("asked")).distinct()
    return matching.lookup(wanted, index).select("query", "concept_id")


@query("text_lookup_k5", M.with_sql("concepts", "SELECT concept_id FROM concepts WHERE trim(lower(text)) = 'red widget' ORDER BY concept_id LIMIT 5"))
def text_lookup(spark, d):
    return M.concepts(spark, d).filter(T.normalise(F.col("text")) == "red widget").orderBy("concept_id").limit(5).select("concept_id")


@query("recommended_score_l9", M.with_sql("videos occ", "SELECT concept_id, video_id, round(n * 0.3 * (0.7 + 0.3 * (1 - abs(ratio - 0.5))) * CASE WHEN best >= 2.5 THEN 1.2 ELSE 1.0 END * CASE WHEN n > 3 THEN 1.2 ELSE 1.0 END, 6) AS score FROM (SELECT concept_id, video_id, count(*) AS n, max(significance) AS best FROM occ GROUP BY ALL) JOIN videos USING (video_id)"))
def recommended_score(spark, d):
    return reports.video_score(M.occurrences(spark, d), M.videos(spark, d))


@query("catalogue_page_c4", f"WITH {storing._GOOD} SELECT concept_id FROM cata ORDER BY concept_id DESC LIMIT 10 OFFSET 10")
def catalogue_page(spark, d):
    c = storing._catalogue(spark, d).filter(F.map_contains_key("representations", "en"))
    return reports.page(c, [F.desc("concept_id")], 2, 10).select("concept_id")


@query("fuzzy_join_d10", f"SELECT a AS query, b AS name, round(2 * n / (length(a) + length(b)), 6) AS ratio FROM (SELECT a, b, {resolving.LCS} AS n FROM (SELECT DISTINCT left(p_name, 1) || substr(p_name, 3) AS a FROM part) JOIN (SELECT DISTINCT p_name AS b FROM part) ON true) WHERE round(2 * n / (length(a) + length(b)), 6) >= 0.85")
def fuzzy_join(spark, d):
    names = M.table(spark, d, "part").select(F.col("p_name").alias("name")).distinct()
    misspelt = names.select(F.concat(F.substring("name", 1, 1), F.expr("substring(name, 3)")).alias("query")).distinct()
    return matching.fuzzy(misspelt, names, 0.85)


@query("pairwise_join_d11", f"WITH {resolving.SIMILAR} SELECT a, b, similarity FROM sim WHERE similarity >= 0.75")
def pairwise_join(spark, d):
    return resolving.pairs(spark, d, 0.75)


@query("running_offset_f7", f"SELECT video_id, pos, n, begin FROM ({textual.S['sentences_i9']})")
def running_offset(spark, d):
    return transcripts.sentences(M.transcripts(spark, d), ["video_id", "pos"]).select("video_id", "pos", "n", "begin")


@query("remove_relationship_r4", f"WITH {storing._GOOD} SELECT concept_id, CASE WHEN concept_id = 'c7' THEN 1 ELSE 2 END AS links FROM cata")
def remove_relationship(spark, d):
    return catalog.remove_relationship(storing._catalogue(spark, d), "c7", "gone", "prerequisite").select("concept_id", F.size("prerequisites").alias("links"))


@query("index_representations_r7", f"WITH {storing._GOOD} SELECT 'en' AS language, name AS text, concept_id FROM cata")
def index_representations(spark, d):
    return catalog.representations(storing._catalogue(spark, d)).select("language", "text", "concept_id")


@query("update_variant_index_r8", f"SELECT concept_id, language, form FROM ({_VI}) WHERE concept_id = 12")
def update_variant_index(spark, d):
    """The forms of one concept."""
    n = names_ru(spark, d).filter("id = 12")
    return analysis.variant_index(n.select(F.col("id").alias("concept_id"), F.col("name").alias("text"), F.lit("ru").alias("language")))


@query("search_page_s6", f"{searching._RANKED} SELECT query_id, id, CAST(ceil(t / 5.0) AS BIGINT) AS total_pages FROM (SELECT *, count(*) OVER (PARTITION BY query_id) AS t FROM rk) WHERE place BETWEEN 6 AND 10")
def search_page(spark, d):
    ranked = searching._ranked(spark, d).withColumn("t", F.count("*").over(Window.partitionBy("query_id")))
    return ranked.filter("place between 6 and 10").select("query_id", "id", F.ceil(F.col("t") / 5).cast("long").alias("total_pages"))


@query("cli_search_q6", f"{searching._SEARCH}, {searching._TOP.format(f='item_type IN (' + chr(39) + 'segment' + chr(39) + ', ' + chr(39) + 'occurrence' + chr(39) + ')', n=20)} SELECT query_id, rank, id FROM top")
def cli_search(spark, d):
    return searching._search(spark, d, types=["segment", "occurrence"]).select("query_id", "rank", "id")


@query("concept_detail_s8", relational.S["concept_detail_e6"])
def concept_detail(spark, d):
    return reports.concept_detail(M.occurrences(spark, d), M.concepts(spark, d))


@query("catalogue_figures_s28", f"WITH {storing._GOOD} SELECT category, count(*) AS concepts, 2 * count(*) AS prerequisites, CAST(0 AS BIGINT) AS related, 2 * count(*) AS texts FROM cata GROUP BY category")
def catalogue_figures(spark, d):
    return catalog.statistics(storing._catalogue(spark, d))


@query("graph_load_a6", "SELECT CAST(p_partkey AS VARCHAR) AS src, CAST(p_partkey // 2 AS VARCHAR) AS dst, 'prerequisite' AS kind, p_size / 100 AS strength FROM part WHERE p_partkey >= 2")
def graph_load(spark, d):
    path = lineage.folder(spark)
    signatures.save_graph(*mining._graph(spark, d), path)
    return signatures.load_graph(spark, path)[1]


@query("graph_restore_a24", "SELECT 0 AS nodes, 0 AS edges")
def graph_restore(spark, d):
    """Where no graph is stored, an empty one."""
    n, e = signatures.load_graph(spark, lineage.folder(spark))
    return n.agg(F.count("*").cast("int").alias("nodes")).crossJoin(e.agg(F.count("*").cast("int").alias("edges")))  # a row each


@query("node_decode_a23", "SELECT CAST(p_partkey AS VARCHAR) AS id, lower(p_name) AS normalized_text FROM part")
def node_decode(spark, d):
    return signatures.decoded(signatures.encoded(mining._graph(spark, d)[0])).select("id", "normalized_text")


_LCS_TEXT = "list_reduce(list_transform(string_split({a}, ''), lambda c: [c]), lambda row, x: list_reduce(list_transform(range(1, length({b}) + 1), lambda j: [CAST(j AS VARCHAR)]), lambda acc, j: list_append(acc, CASE WHEN substr({b}, CAST(j[1] AS BIGINT), 1) = x[1] THEN row[CAST(j[1] AS BIGINT)] || x[1] WHEN length(row[CAST(j[1] AS BIGINT) + 1]) > length(acc[len(acc)]) THEN row[CAST(j[1] AS BIGINT) + 1] ELSE acc[len(acc)] END), ['']), list_transform(range(0, length({b}) + 1), lambda z: ''))[length({b}) + 1]"


@query("lcs_text_j9", f"SELECT a, b, {_LCS_TEXT.format(a='a', b='b')} AS common FROM (SELECT DISTINCT p_name AS a, p_type AS b FROM (SELECT p_name, lower(p_type) AS p_type FROM part))")
def lcs_text(spark, d):
    pairs = M.table(spark, d, "part").select(F.col("p_name").alias("a"), F.lower("p_type").alias("b")).distinct()
    return pairs.select("a", "b", lcs.lcs_text(F.col("a"), F.col("b")).alias("common"))


@query("lcs_length_j10", f"SELECT a, b, CAST({resolving.LCS} AS INTEGER) AS n FROM (SELECT DISTINCT p_name AS a, lower(p_type) AS b FROM part)")
def lcs_length(spark, d):
    pairs = M.table(spark, d, "part").select(F.col("p_name").alias("a"), F.lower("p_type").alias("b")).distinct()
    return pairs.select("a", "b", lcs.lcs_len(F.col("a"), F.col("b")).alias("n"))


_THREE = "SELECT DISTINCT p_name AS a, split_part(p_name, ' ', 2) || 's' AS b, lower(p_type) AS c FROM part"


@query("char_mlcs_j13", f"SELECT a, b, c, CASE WHEN length(ab) < 2 OR length(abc) < 2 THEN '' ELSE abc END AS common FROM (SELECT *, {_LCS_TEXT.format(a='ab', b='c')} AS abc FROM (SELECT *, {_LCS_TEXT.format(a='a', b='b')} AS ab FROM ({_THREE})))")
def char_mlcs(spark, d):
    rows = M.table(spark, d, "part").select(F.col("p_name").alias("a"), F.concat(F.split_part("p_name", F.lit(" "), F.lit(2)), F.lit("s")).alias("b"), F.lower("p_type").alias("c")).distinct()
    letters = F.array(*[F.split(c, "") for c in ("a", "b", "c")])
    return rows.select("a", "b", "c", F.array_join(lcs.mlcs(letters), "").alias("common"))


def _log(spark, d):
    k = F.col("event_id")
    op = F.when(k % 97 == 0, "clear").when(k % 53 == 0, "sweep").when(k % 11 == 0, "delete").when(k % 3 == 0, "set").otherwise("get")
    cache = F.element_at(F.array(*map(F.lit, L.CACHES)), (k % 4 + 1).cast("int"))
    return state.cache_log(storing._events(spark, d).select(cache.alias("cache"), F.col("user_id").cast("string").alias("key"), op.alias("op"), "event_id", "seconds"))


def _operation(name: str, op: str):
    @query(name)
    def run(spark, d):
        return _log(spark, d).filter(F.col("op") == op)

    return run


cache_set = _operation("cache_set_u3", "set")
cache_clear = _operation("cache_clear_u9", "clear")
cache_maintenance = _operation("cache_maintenance_u10", "sweep")
cache_delete = _operation("cache_delete_u11", "delete")


@query("cache_figures_u12")
def cache_figures(spark, d):
    return state.log_stats(_log(spark, d))


@query("cache_settings_u7", "SELECT * FROM (VALUES ('video', 200, 3600), ('transcript', 200, 3600), ('search', 500, 300), ('concept', 300, 3600), ('other', 200, 3600)) v(kind, entries, seconds)")
def cache_settings(spark, d):
    kinds = [*L.CACHES, "other"]
    return spark.createDataFrame([(k, (c := state.configured(k)).size, int(c.ttl)) for k in kinds], "kind string, entries int, seconds int")


@query("union_terms_g4", "SELECT p_name AS term FROM part UNION SELECT p_type FROM part")
def union_terms(spark, d):
    p = M.table(spark, d, "part")
    return p.select(F.col("p_name").alias("term")).union(p.select("p_type")).distinct()


@query("top_documents_f10", "SELECT doc_id, n_chars FROM documents ORDER BY n_chars DESC, doc_id LIMIT 25")
def top_documents(spark, d):
    return M.table(spark, d, "documents").orderBy(F.desc("n_chars"), "doc_id").limit(25).select("doc_id", "n_chars")


@query("explained_s16", M.with_sql("concepts occ", ", b AS (SELECT video_id, concept_id, max(significance) AS s FROM occ GROUP BY ALL) SELECT video_id, concept_id, text FROM b JOIN concepts USING (concept_id) WHERE s >= 2.5 QUALIFY row_number() OVER (PARTITION BY video_id ORDER BY s DESC, concept_id) <= 5"))
def explained(spark, d):
    return storing.video_concepts(spark, d).select("video_id", "concept_id", "text")


@query("compressed_links_n7", f"WITH RECURSIVE {resolving._JOB}, ch(id, root, h) AS (SELECT id, canonical, 0 FROM lk UNION ALL SELECT ch.id, lk.canonical, h + 1 FROM ch JOIN lk ON lk.id = ch.root) SELECT id, arg_max(root, h) AS root FROM ch GROUP BY id")
def compressed_links(spark, d):
    return resolve.compress_chains(resolving.corpus_links(spark, d))


@query("index_tokens", f"WITH {searching._INDEX} SELECT token, count(*) AS n FROM (SELECT unnest({searching._TOK.format(c='text')}) AS token FROM idx) GROUP BY token")
def index_tokens(spark, d):
    return search.postings(searching.index(spark, d)).groupBy("token").agg(F.count("*").alias("n"))
