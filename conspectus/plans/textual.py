"""Registered queries: text functions, transcripts, matching, resolution, graphs, search and state."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import morphology
from ..functions import lexicons as L
from ..functions import text as T
from ..operators import graph, matching, resolve, transcripts
from ..sources import model as M

Q: dict = {}
S: dict[str, str] = {}


def query(name: str, sql: str = ""):
    def add(f):
        Q[name] = f
        S[name] = sql
        return f

    return add


def docs(spark, d):
    return M.table(spark, d, "documents")


def count_sql(column: str, words: list[str]) -> str:
    return " + ".join(f"(length({column}) - length(replace({column}, '{w}', ''))) // {len(w)}" for w in words)


def has_sql(column: str, words: list[str]) -> str:
    return " + ".join(f"CAST(contains({column}, '{w}') AS INTEGER)" for w in words)


WORDS_SQL = "len(list_filter(regexp_split_to_array({c}, '\\s+'), lambda w: w <> ''))"


@query("captions_a12", "SELECT page_id, CAST(p - 1 AS INTEGER) AS pos, replace(replace(replace(replace(replace(m[p], '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#39;', ''''), '&amp;', '&') AS text FROM (SELECT page_id, m, unnest(range(1, len(m) + 1)) AS p FROM (SELECT page_id, regexp_extract_all(html, '<p[^>]*>([^<]*)</p>', 1) AS m FROM pages)) WHERE trim(m[p]) <> ''")
def captions(spark, d):
    return transcripts.captions(M.table(spark, d, "pages"), "p")


FORMS = (r"^https?://[^/]+/[a-z]{2}/(\d+)\.html", r"^https?://[^/]+/[a-z]{2}/(\d+)")


@query("url_parse_c12", r"SELECT page_id, coalesce(nullif(regexp_extract(url, '^https?://[^/]+/[a-z]{2}/(\d+)\.html', 1), ''), nullif(regexp_extract(url, '^https?://[^/]+/[a-z]{2}/(\d+)', 1), '')) AS video_id FROM pages")
def url_parse(spark, d):
    return M.table(spark, d, "pages").select("page_id", T.address_id(F.col("url"), FORMS).alias("video_id"))


@query("norm_basic_h1", r"SELECT doc_id, md5(regexp_replace(lower(text), '^\s+|\s+$', '', 'g')) AS h FROM documents")
def norm_basic(spark, d):
    return docs(spark, d).select("doc_id", F.md5(T.normalise(F.col("text"))).alias("h"))


@query("norm_transcript_h7", r"SELECT doc_id, md5(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(replace(regexp_replace(text, '\s+', ' ', 'g'), ' i ', ' I '), '([\p{L}\p{N}_])\.([\p{L}\p{N}_])', '\1. \2', 'g'), '\[[^\]]*\]:?', '', 'g'), '\.{3,}', '...', 'g'), '\s+([,.])', '\1', 'g'), '^\s+|\s+$', '', 'g')) AS h FROM documents")
def norm_transcript(spark, d):
    return docs(spark, d).select("doc_id", F.md5(T.normalise_transcript(F.col("text"))).alias("h"))


@query("language_detect_h10", "SELECT doc_id, CASE WHEN cyr > 0.5 * (lat + cyr) AND cyr > 0 THEN 'ru' ELSE 'en' END AS language FROM (SELECT doc_id, len(regexp_extract_all(left(text, 2000), '[a-zA-Z]')) AS lat, len(regexp_extract_all(left(text, 2000), '[а-яА-ЯёЁ]')) AS cyr FROM documents)")
def language_detect(spark, d):
    return docs(spark, d).select("doc_id", T.language(F.col("text")).alias("language"))


@query("substring_count_h20", f"SELECT doc_id, CAST({count_sql('lower(text)', ['tion'])} AS INTEGER) AS n FROM documents")
def substring_count(spark, d):
    return docs(spark, d).select("doc_id", T.count_of(F.lower("text"), "tion").alias("n"))


_RATIO = "SELECT doc_id, CASE WHEN t + p = 0 THEN 0.5 ELSE 1 / (1 + 2.5 * pow(2.71828, -5 * (t / (t + p) - 0.5))) END AS r FROM (SELECT doc_id, CAST(" + count_sql("lower(text)", L.TEST_MARKERS[:3]) + " AS DOUBLE) AS t, CAST(" + count_sql("lower(text)", L.TEST_MARKERS[3:]) + " AS DOUBLE) AS p FROM documents)"


def _ratios(spark, d):
    t, p = (sum((T.count_of(F.lower("text"), w) for w in ws), F.lit(0)).cast("double") for ws in (L.TEST_MARKERS[:3], L.TEST_MARKERS[3:]))
    return docs(spark, d).select("doc_id", t.alias("t"), p.alias("p")).select("doc_id", T.theory_ratio(F.col("t"), F.col("p")).alias("r"))


@query("ratio_h18", f"SELECT doc_id, round(r, 6) AS ratio FROM ({_RATIO})")
def ratio(spark, d):
    return _ratios(spark, d).select("doc_id", F.round("r", 6).alias("ratio"))


@query("ratio_class_h19", f"SELECT CASE WHEN r > 0.7 THEN 'theoretical' WHEN r < 0.3 THEN 'practical' ELSE 'mixed' END AS kind, count(*) AS n FROM ({_RATIO}) GROUP BY kind")
def ratio_class(spark, d):
    return _ratios(spark, d).groupBy(T.ratio_class(F.col("r")).alias("kind")).agg(F.count("*").alias("n"))


@query("timecode_h29", "SELECT DISTINCT l_partkey AS s, CASE WHEN l_partkey < 600 THEN '0' ELSE '' END || CAST(l_partkey // 60 AS VARCHAR) || ':' || lpad(CAST(l_partkey % 60 AS VARCHAR), 2, '0') AS shown FROM lineitem")
def timecode(spark, d):
    return M.table(spark, d, "lineitem").select(F.col("l_partkey").alias("s"), T.timecode(F.col("l_partkey")).alias("shown")).distinct()


@query("shortened_h30", "SELECT doc_id, CASE WHEN length(text) > 70 THEN left(text, 67) || '...' ELSE text END AS shown FROM documents")
def shortened(spark, d):
    return docs(spark, d).select("doc_id", T.shortened(F.col("text")).alias("shown"))


@query("slug_h28", r"SELECT p_partkey, regexp_replace(replace(regexp_replace(regexp_replace(lower(p_name), '\s+', ' ', 'g'), '^\s+|\s+$', '', 'g'), ' ', '_'), '[^a-z0-9_]', '', 'g') AS slug FROM part")
def slug(spark, d):
    return M.table(spark, d, "part").select("p_partkey", T.slug(F.col("p_name")).alias("slug"))


@query("md5_id_h33", "SELECT p_partkey, md5(concat_ws(':', p_name, p_type, 'en')) AS id FROM part")
def md5_id(spark, d):
    return M.table(spark, d, "part").select("p_partkey", T.identity(F.col("p_name"), F.col("p_type"), F.lit("en")).alias("id"))


@query("sentences_i9", r"WITH s AS (SELECT conv_id AS video_id, turn AS pos, turn * 10.0 AS start, unnest(range(len(p))) AS n, p FROM (SELECT conv_id, turn, string_split(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)) AS p FROM conversations WHERE trim(text) <> '')), t AS (SELECT video_id, pos, start, n, p[n + 1] AS sentence, length(p[n + 1]) AS size FROM s WHERE trim(p[n + 1]) <> ''), w AS (SELECT *, coalesce(sum(size) OVER (PARTITION BY video_id, pos ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before, sum(size) OVER (PARTITION BY video_id, pos) AS total FROM t) SELECT video_id, pos, CAST(n AS INTEGER) AS n, sentence, round(CAST(start + 10.0 * before / total AS DOUBLE), 6) AS begin, round(CAST(start + 10.0 * (before + size) / total AS DOUBLE), 6) AS finish FROM w")
def sentences(spark, d):
    return transcripts.sentences(M.transcripts(spark, d), ["video_id", "pos"])


@query("full_text_i3", "SELECT conv_id AS video_id, md5(string_agg(text, ' ' ORDER BY turn, text)) AS h FROM conversations GROUP BY conv_id")
def full_text(spark, d):
    return transcripts.full_text(M.transcripts(spark, d)).select("video_id", F.md5("text").alias("h"))


_TERMS = r"(SELECT doc_id, lang, unnest(regexp_extract_all(lower(text), '\p{L}{4,}')) AS term FROM documents)"


@query("term_frequency_e12", f"SELECT lang, term, n, CAST(r AS INTEGER) AS rank FROM (SELECT lang, term, n, row_number() OVER (PARTITION BY lang ORDER BY n DESC, term) AS r FROM (SELECT lang, term, count(*) AS n FROM {_TERMS} GROUP BY ALL)) WHERE r <= 50")
def term_frequency(spark, d):
    return transcripts.catalogue(docs(spark, d), 50)


@query("video_key_terms_i4", r"WITH t AS (SELECT video_id, m[p] AS term, p FROM (SELECT video_id, m, unnest(range(1, len(m) + 1)) AS p FROM (SELECT conv_id AS video_id, regexp_extract_all(lower(string_agg(text, ' ' ORDER BY turn, text)), '\p{L}{4,}') AS m FROM conversations GROUP BY conv_id))) SELECT video_id, term, n, CAST(r AS INTEGER) AS rank FROM (SELECT video_id, term, count(*) AS n, row_number() OVER (PARTITION BY video_id ORDER BY count(*) DESC, min(p)) AS r FROM t GROUP BY video_id, term) WHERE r <= 20")
def video_key_terms(spark, d):
    from ..operators.reports import top_per_group

    by = transcripts.frequencies(transcripts.terms(transcripts.full_text(M.transcripts(spark, d)), ["video_id"]), ["video_id"])
    return top_per_group(by, ["video_id"], [F.desc("n"), "first"], 20).select("video_id", "term", "n", "rank")


@query("educational_value_i12", "SELECT conv_id, turn, round(0.8 * (" + has_sql("lower(text)", L.TEST_MARKERS) + ") + least(" + WORDS_SQL.format(c="text") + " / 20.0, 2.0), 6) AS value FROM conversations")
def educational_value(spark, d):
    c = M.table(spark, d, "conversations")
    return c.select("conv_id", "turn", F.round(T.educational_value(F.col("text"), L.TEST_MARKERS), 6).alias("value"))


@query("stem_j3", r"SELECT term, regexp_replace(CASE WHEN length(term) > 3 AND term LIKE '%s' AND term NOT LIKE '%ss' THEN left(term, length(term) - 1) WHEN length(term) > 4 AND term LIKE '%ing' THEN left(term, length(term) - 3) WHEN length(term) > 4 AND term LIKE '%ed' THEN left(term, length(term) - 2) ELSE term END, '[^\p{L}\p{N}-]', '', 'g') AS stem FROM (SELECT DISTINCT term FROM " + _TERMS + ")")
def stem(spark, d):
    found = transcripts.terms(docs(spark, d), ["doc_id"]).select("term").distinct()
    return found.select("term", morphology.stem(F.col("term")).alias("stem"))


@query("variants_en_j18", "WITH n AS (SELECT DISTINCT p_name AS t, string_split(p_name, ' ') AS ws FROM part), w AS (SELECT t, unnest(ws) AS w FROM n) SELECT t AS text, t AS form FROM n UNION SELECT t, 'the ' || t FROM n WHERE len(ws) > 1 AND ws[1] NOT IN ('the', 'a', 'an') UNION SELECT t, CASE WHEN regexp_matches(ws[1], '^[aeiou]') THEN 'an ' ELSE 'a ' END || t FROM n WHERE len(ws) > 1 AND ws[1] NOT IN ('the', 'a', 'an') UNION SELECT t, array_to_string(ws[2:], ' ') FROM n WHERE len(ws) > 1 AND ws[1] IN ('the', 'a', 'an') UNION SELECT t, replace(t, w, left(w, length(w) - 1)) FROM w WHERE length(w) > 4 AND w LIKE '%s' UNION SELECT t, replace(t, w, w || 's') FROM w WHERE length(w) > 3 AND w NOT LIKE '%s' UNION SELECT t, replace(t, w, left(w, length(w) - 3)) FROM w WHERE length(w) > 5 AND w LIKE '%ing' UNION SELECT t, replace(t, w, left(w, length(w) - 3) || 'e') FROM w WHERE length(w) > 5 AND w LIKE '%ing' UNION SELECT t, replace(t, w, left(w, length(w) - k) || e) FROM w, (VALUES (2, ''), (1, ''), (2, 'e')) x(k, e) WHERE length(w) > 4 AND w LIKE '%ed' AND w NOT LIKE '%ing'")
def variants_en(spark, d):
    names = M.table(spark, d, "part").select(F.col("p_name").alias("text")).distinct()
    return names.select("text", F.explode(morphology.variants(F.col("text"))).alias("form")).distinct()


@query("containment_d9", "WITH c AS (SELECT term FROM (SELECT lang, term, row_number() OVER (PARTITION BY lang ORDER BY count(*) DESC, term) AS r FROM " + _TERMS + r" GROUP BY lang, term) WHERE r <= 30 GROUP BY term), t AS (SELECT DISTINCT doc_id, unnest(string_split(trim(regexp_replace(lower(text), '[^\p{L}\p{N}]+', ' ', 'g')), ' ')) AS term FROM documents) SELECT doc_id, term FROM t JOIN c USING (term)")
def containment(spark, d):
    return matching.contained(docs(spark, d), "doc_id", transcripts.catalogue(docs(spark, d), 30), longest=1)


@query("cascade_lookup_k1", M.with_sql("concepts", "SELECT query, concept_id, CASE WHEN query = text THEN 1.0 ELSE 0.95 END AS similarity FROM (SELECT DISTINCT CASE WHEN p_partkey % 2 = 0 THEN p_name ELSE 'the ' || p_name END AS query FROM part WHERE p_partkey <= 40) JOIN concepts ON text = query OR 'the ' || text = query"))
def cascade_lookup(spark, d):
    """Of the first 40 concepts' names only, which all hit exactly or by a variant, as its SQL has it; cascade_lookup_all_k1 has all names."""
    p = M.table(spark, d, "part").filter("p_partkey <= 40")
    wanted = p.select(F.when(F.col("p_partkey") % 2 == 0, F.col("p_name")).otherwise(F.concat(F.lit("the "), F.col("p_name"))).alias("query")).distinct()
    return matching.cascade(wanted, M.concepts(spark, d).select("concept_id", "text"))


@query("cascade_lookup_all_k1")
def cascade_lookup_all(spark, d):
    """All names as they are, with an article, and misspelt (without their second letter): those only the fuzzy step finds."""
    name = F.col("p_name")
    forms = F.array(name, F.concat(F.lit("the "), name), F.concat(F.substring(name, 1, 1), F.expr("substring(p_name, 3)")))
    wanted = M.table(spark, d, "part").select("p_name").distinct().select(F.explode(forms).alias("query")).distinct()
    return matching.cascade(wanted, M.concepts(spark, d).select("concept_id", "text"))


@query("canonical_pick_e14", "WITH m AS (SELECT p_type AS cluster, p_partkey AS id, p_size AS frequency, p_retailprice / 1000 AS weight, round(0.4 * p_size + 0.2 * (p_retailprice / 500) + 0.3 * (p_retailprice / 1000) + 0.1 * len(string_split(p_name, ' ')), 6) AS q FROM part) SELECT cluster, arg_max(id, (q, -id)) AS canonical, CAST(sum(frequency) AS BIGINT) AS frequency, max(weight) AS weight, count(*) AS variants FROM m GROUP BY cluster")
def canonical_pick(spark, d):
    p = M.table(spark, d, "part")
    members = p.select(F.col("p_type").alias("cluster"), F.col("p_partkey").alias("id"), F.col("p_name").alias("text"), F.col("p_size").alias("frequency"), (F.col("p_retailprice") / 1000).alias("weight"), (F.col("p_retailprice") / 500).alias("score"))
    return resolve.canonical_pick(members)


@query("hit_resolution_n9", M.with_sql("concepts occ", "SELECT root, video_id, max(significance) AS best, count(DISTINCT concept_id) AS variants FROM occ JOIN concepts USING (concept_id) GROUP BY root, video_id"))
def hit_resolution(spark, d):
    return resolve.resolve_hits(M.occurrences(spark, d), M.concepts(spark, d))


@query("link_chains_n7", "SELECT p_partkey AS id, CAST(1 AS BIGINT) AS root FROM part WHERE p_partkey > 1")
def link_chains(spark, d):
    links = M.table(spark, d, "part").filter("p_partkey > 1").select(F.col("p_partkey").alias("id"), F.floor(F.col("p_partkey") / 2).cast("long").alias("canonical"))
    return resolve.compress_chains(links)


@query("hierarchy_l4", "WITH o AS (SELECT l_partkey AS id, count(*) AS occurrences, max(l_quantity / 10) AS weight FROM lineitem GROUP BY l_partkey), e AS (SELECT p_partkey AS src, p_partkey // 2 AS dst FROM part WHERE p_partkey > 1) SELECT id, round(0.2 / len(string_split(p_name, ' ')) + 0.25 * least(coalesce(outs, 0) / 10, 1.0) + 0.15 * least(occurrences / 20, 1.0) + 0.25 * least(coalesce(ins, 0) / 5, 1.0) + 0.15 * least(weight / 5, 0.4), 6) AS score FROM o JOIN part ON p_partkey = id LEFT JOIN (SELECT src AS s, count(*) AS outs FROM e GROUP BY src) ON s = id LEFT JOIN (SELECT dst AS t, count(*) AS ins FROM e GROUP BY dst) ON t = id")
def hierarchy(spark, d):
    by = M.occurrences(spark, d).groupBy(F.col("concept_id").alias("id")).agg(F.count("*").alias("occurrences"), F.max("significance").alias("weight"))
    p = M.table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.size(F.split("p_name", " ")).alias("words"))
    return graph.hierarchy(by.join(p, "id"), M.prerequisites(spark, d))


@query("closure_p1", "WITH RECURSIVE r(seed, node) AS (SELECT p_partkey, p_partkey // 2 FROM part WHERE p_partkey % 50 = 0 UNION SELECT seed, node // 2 FROM r WHERE node > 1) SELECT seed, node FROM r WHERE node >= 1")
def closure(spark, d):
    seeds = M.table(spark, d, "part").filter("p_partkey % 50 = 0").select(F.col("p_partkey").alias("seed"), F.col("p_partkey").alias("node"))
    return graph.closure(M.prerequisites(spark, d), seeds)


@query("closure_all_p1")
def closure_all(spark, d):
    seeds = M.table(spark, d, "part").select(F.col("p_partkey").alias("seed"), F.col("p_partkey").alias("node"))
    return graph.closure(M.prerequisites(spark, d), seeds)


@query("topological_levels_p3", "SELECT p_partkey AS node, CAST(length(bin(p_partkey)) - 1 AS INTEGER) AS level FROM part")
def topological_levels(spark, d):
    return graph.levels(M.table(spark, d, "part").select(F.col("p_partkey").alias("node")), M.prerequisites(spark, d))


@query("significance_l1", "SELECT conv_id, turn, round(least(5.0, 0.8 * (0.8 * m + least(w / 20.0, 2.0)) + 1.2 * least(m, 1) + CASE WHEN i > 0 THEN 0.5 * (1 - 2 * abs(0.5 - (i - 1) / greatest(1, length(text) - 4))) ELSE 0 END + CASE WHEN w > 30 THEN 0.8 WHEN w > 15 THEN 0.4 ELSE 0 END), 6) AS significance FROM (SELECT conv_id, turn, text, " + has_sql("lower(text)", L.TEST_MARKERS) + " AS m, " + WORDS_SQL.format(c="text") + " AS w, strpos(lower(text), 'tion') AS i FROM conversations)")
def significance(spark, d):
    c = M.table(spark, d, "conversations")
    low, n = F.lower("text"), F.size(T.words(F.col("text")))
    at = F.instr(low, "tion")
    place = F.when(at > 0, 0.5 * (1 - 2 * F.abs(0.5 - (at - 1) / F.greatest(F.lit(1), F.length("text") - 4)))).otherwise(0.0)
    marked = F.least(T.markers_in(F.col("text"), L.TEST_MARKERS), F.lit(1))
    length = F.when(n > 30, 0.8).when(n > 15, 0.4).otherwise(0.0)
    score = 0.8 * T.educational_value(F.col("text"), L.TEST_MARKERS) + 1.2 * marked + place + length
    return c.select("conv_id", "turn", F.round(F.least(score, F.lit(5.0)), 6).alias("significance"))
