"""Registered queries: candidates, extraction from transcripts, signatures."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import lcs
from ..functions import lexicons as L
from ..operators import extraction, lineage, matching, mining, signatures
from ..sources import model as M
from .base import NAMES_SQL, has_sql, listed, names, registry, words_sql
from .language import PREPROCESSED

Q, S, query = registry()

STOP = ["de", "la", "que", "und", "der", "die", "the", "of", "and"]


def stop(words):
    return f"[{listed(words)}]"


# ---- candidates

_WS = "regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+')"
_PLAIN = f"NOT list_contains({stop(STOP)}, {{x}})"
_GRAMS = (
    f"ws AS (SELECT conv_id AS video_id, turn, {_WS} AS w FROM conversations), "
    f"gr AS (SELECT video_id, turn, unnest(list_concat(list_concat(list_filter(w, lambda x: {_PLAIN.format(x='x')}), "
    + "), ".join(f"list_transform(list_filter(range(1, len(w) - {n - 2}), lambda i: {_PLAIN.format(x='w[i]')} AND {_PLAIN.format(x=f'w[i + {n - 1}]')}), lambda i: array_to_string(w[i:i + {n - 1}], ' '))" for n in (2, 3))
    + ")) AS term FROM ws)"
)
_TFIDF = (
    f"{_GRAMS}, tot AS (SELECT video_id, count(*) AS total FROM ws GROUP BY 1), tf AS (SELECT video_id, turn, term, count(*) AS tf FROM gr GROUP BY ALL), "
    "df AS (SELECT video_id, term, count(*) AS df, sum(tf) AS f, any_value(total) AS total FROM tf JOIN tot USING (video_id) GROUP BY ALL HAVING count(*) >= 2 AND count(*) <= 0.95 * any_value(total)), "
    "us AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY f DESC, term) AS n FROM df) WHERE n <= 1000), "
    "we AS (SELECT tf.video_id, turn, tf.term, total, tf * (ln((1.0 + total) / (1.0 + df)) + 1) AS w FROM tf JOIN us USING (video_id, term)), no AS (SELECT video_id, turn, sqrt(sum(w * w)) AS norm FROM we GROUP BY ALL), "
    "ti AS (SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY video_id ORDER BY score DESC, term) AS INTEGER) AS rank FROM (SELECT video_id, term, round(3.0 * sum(w / norm) / any_value(total), 6) AS score FROM we JOIN no USING (video_id, turn) GROUP BY ALL)) WHERE rank <= 50)"
)


def turns(spark, d):
    return M.table(spark, d, "conversations").select(F.col("conv_id").alias("video_id"), "turn", "text")


@query("tfidf_m5", f"WITH {_TFIDF} SELECT * FROM ti")
def tfidf(spark, d):
    return mining.weighted_terms(turns(spark, d), ["video_id"], "turn", STOP)


@query("tfidf_means_e16", f"WITH {_TFIDF} SELECT video_id, count(*) AS terms, round(max(score), 6) AS best FROM ti GROUP BY video_id")
def tfidf_means(spark, d):
    return tfidf(spark, d).groupBy("video_id").agg(F.count("*").alias("terms"), F.round(F.max("score"), 6).alias("best"))


def _pattern_lists() -> str:
    out = [f"regexp_extract_all(text, '{p.replace(chr(39), chr(39) * 2)}', 1)" for p in L.CANDIDATE_PATTERNS["en"]]
    return "list_concat(list_concat(list_concat({}, {}), {}), {})".format(*out)


_FOUND = f"fo AS (SELECT doc_id, trim(t) AS text FROM (SELECT doc_id, unnest({_pattern_lists()}) AS t FROM documents)), re AS (SELECT doc_id, text FROM fo WHERE length(text) >= 3 AND len(list_filter({words_sql('text')}, lambda w: NOT list_contains({stop(STOP)}, lower(w)))) > 0)"


@query("pattern_terms_m6", f"WITH {_FOUND} SELECT doc_id, text, count(*) AS n FROM re GROUP BY ALL")
def pattern_terms(spark, d):
    t = M.table(spark, d, "documents")
    return mining.pattern_terms(t, ["doc_id"], stopwords=STOP).groupBy("doc_id", "text").agg(F.count("*").alias("n"))


_METHODS = ["spacy_noun_phrase", "nltk_noun_phrase", "tfidf", "regex", "other"]
_SCORE = "{base} + CASE {method} WHEN 'spacy_noun_phrase' THEN 2.0 WHEN 'nltk_noun_phrase' THEN 1.5 WHEN 'tfidf' THEN 1.0 WHEN 'regex' THEN 0.5 ELSE 0 END + CASE n WHEN 1 THEN 0.5 WHEN 2 THEN 1.0 WHEN 3 THEN 0.8 ELSE 0.3 END + CASE WHEN left({text}, 1) <> lower(left({text}, 1)) AND {text} <> upper({text}) THEN 0.5 ELSE 0 END + CASE WHEN {near} THEN 1.0 ELSE 0 END"


@query("candidate_score_l6", f"WITH {NAMES_SQL} SELECT id, round({_SCORE.format(base='id % 3', method='[' + listed(_METHODS) + '][id % 5 + 1]', text='name', near='contains(lower(name), ' + chr(39) + 'ring' + chr(39) + ') OR contains(' + chr(39) + 'often' + chr(39) + ', lower(name))')}, 6) AS score FROM (SELECT *, len({words_sql('name')}) AS n FROM names)")
def candidate_score(spark, d):
    method = F.element_at(F.array(*map(F.lit, _METHODS)), (F.col("id") % 5 + 1).cast("int"))
    score = mining.candidate_score(F.col("name"), method, F.col("id") % 3, F.array(F.lit("Ring"), F.lit("often")))
    return names(spark, d).select("id", F.round(score, 6).alias("score"))


_KEYTERMS = r"kt AS (SELECT video_id, list(term ORDER BY r) AS terms FROM (SELECT video_id, term, row_number() OVER (PARTITION BY video_id ORDER BY count(*) DESC, min(p)) AS r FROM (SELECT video_id, m[p] AS term, p FROM (SELECT video_id, m, unnest(range(1, len(m) + 1)) AS p FROM (SELECT conv_id AS video_id, regexp_extract_all(lower(string_agg(text, ' ' ORDER BY turn, text)), '\p{L}{4,}') AS m FROM conversations GROUP BY conv_id))) GROUP BY video_id, term) WHERE r <= 20 GROUP BY video_id)"
_NEW = (
    f"WITH {_TFIDF}, {_KEYTERMS}, ex AS (SELECT DISTINCT term AS form FROM ti WHERE length(term) % 7 = 0), ca AS (SELECT video_id, term AS text, score AS base FROM ti WHERE length(term) >= 3 AND NOT regexp_full_match(term, '[0-9]+') AND len(list_filter(string_split(term, ' '), lambda w: w NOT IN ({listed(L.STOPWORDS['en'])}))) > 0 AND term NOT IN (SELECT form FROM ex)), "
    "sc AS (SELECT video_id, text, round(" + _SCORE.format(base="base", method="'tfidf'", text="text", near="len(list_filter(coalesce(terms, []), lambda t: contains(text, t) OR contains(t, text))) > 0") + ", 6) AS score FROM (SELECT ca.*, terms, len(string_split(text, ' ')) AS n FROM ca LEFT JOIN kt USING (video_id))) "
    "SELECT video_id, text, score, CAST(r AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY score DESC, text) AS r FROM sc) WHERE r <= 30"
)


def _candidates(spark, d):
    top = tfidf(spark, d)
    existing = top.filter("length(term) % 7 = 0").select(F.col("term").alias("known")).distinct()
    found = top.select("video_id", F.col("term").alias("text"), F.lit("tfidf").alias("method"), F.col("score").alias("base"), F.lit("x").alias("domain"), F.col("rank").alias("seq"), F.lit(0).alias("segment"))
    return mining.new_candidates(found, existing, mining.key_terms(M.transcripts(spark, d)))


@query("new_candidates_m1", _NEW)
def new_candidates(spark, d):
    return _candidates(spark, d).select("video_id", "text", "score", "rank")


@query("top_candidates_f5", f"{_NEW.replace('r <= 30', 'r <= 3')}")
def top_candidates(spark, d):
    return _candidates(spark, d).filter("rank <= 3").select("video_id", "text", "score", "rank")


_CAND = "cand AS (SELECT 'c' || p_partkey AS candidate_id, p_name AS text, round(p_retailprice / 300, 6) AS score, ['pending', 'approved', 'rejected'][p_partkey % 3 + 1] AS status, CASE p_partkey % 2 WHEN 0 THEN 'en' ELSE 'ru' END AS language, p_type AS domain, p_partkey % 50 AS video_id, [p_partkey, p_partkey + 1] AS segments FROM part)"


def candidates(spark, d):
    p, k = M.table(spark, d, "part"), F.col("p_partkey")
    status = F.element_at(F.array(*map(F.lit, ["pending", "approved", "rejected"])), (k % 3 + 1).cast("int"))
    return p.select(F.concat(F.lit("c"), k.cast("string")).alias("candidate_id"), F.col("p_name").alias("text"), F.round(F.col("p_retailprice") / 300, 6).alias("score"), status.alias("status"), F.when(k % 2 == 0, "en").otherwise("ru").alias("language"), F.col("p_type").alias("domain"), (k % 50).alias("video_id"), F.array(k, k + 1).alias("segments"), F.lit(None).cast("string").alias("concept_id"))


@query("existing_texts_m7", f"WITH {_CAND} SELECT lower(p_type) AS known FROM part UNION SELECT text FROM cand WHERE status <> 'rejected'")
def existing_texts(spark, d):
    return mining.existing_texts(M.table(spark, d, "part").select(F.col("p_type").alias("text")), candidates(spark, d))


@query("not_catalogued_d13", f"WITH {_CAND} SELECT candidate_id FROM cand WHERE text NOT IN (SELECT p_name FROM part WHERE p_size < 3)")
def not_catalogued(spark, d):
    known = M.table(spark, d, "part").filter("p_size < 3").select(F.col("p_name").alias("text")).distinct()
    return candidates(spark, d).join(known, "text", "left_anti").select("candidate_id")


@query("candidate_page_c5", f"WITH {_CAND} SELECT candidate_id, text, score FROM cand WHERE status = 'pending' ORDER BY score DESC, candidate_id LIMIT 15 OFFSET 15")
def candidate_page(spark, d):
    return mining.list_page(candidates(spark, d), "pending", 2, 15).select("candidate_id", "text", "score")


@query("candidate_status_m10", f"WITH {_CAND}, ch AS (SELECT candidate_id, CASE WHEN score > 5 THEN 'rejected' WHEN score > 4 THEN 'approved' ELSE 'unheard' END AS t FROM cand WHERE video_id < 25) SELECT candidate_id, CASE WHEN t IN ('approved', 'rejected') THEN t ELSE status END AS status, CASE WHEN t = 'rejected' THEN 'too dear' END AS rejection_reason FROM cand LEFT JOIN ch USING (candidate_id)")
def candidate_status(spark, d):
    c = candidates(spark, d)
    to = F.when(F.col("score") > 5, "rejected").when(F.col("score") > 4, "approved").otherwise("unheard")
    changes = c.filter("video_id < 25").select("candidate_id", to.alias("to"), F.lit("too dear").alias("reason"))
    return mining.set_status(c, changes).select("candidate_id", "status", "rejection_reason")


@query("candidate_edit_m11", f"WITH {_CAND} SELECT candidate_id, CASE WHEN video_id = 7 THEN 'new ' || text ELSE text END AS text, CASE WHEN video_id = 7 AND language = 'en' THEN 'changed' ELSE domain END AS domain FROM cand")
def candidate_edit(spark, d):
    c = candidates(spark, d)
    changes = c.filter("video_id = 7").select("candidate_id", F.concat(F.lit("NEW "), "text").alias("new_text"), F.when(F.col("language") == "en", "changed").alias("new_domain"))
    return mining.edit(c, changes).select("candidate_id", "text", "domain")


@query("candidate_delete_m12", f"WITH {_CAND} SELECT candidate_id FROM cand WHERE candidate_id NOT IN ('c3', 'c5')")
def candidate_delete(spark, d):
    gone = spark.createDataFrame([("c3",), ("c5",), ("none",)], "candidate_id string")
    return candidates(spark, d).join(gone, "candidate_id", "left_anti").select("candidate_id")


@query("candidate_get_m13", f"WITH {_CAND} SELECT candidate_id, text, status FROM cand WHERE candidate_id = 'c12'")
def candidate_get(spark, d):
    return candidates(spark, d).filter("candidate_id = 'c12'").select("candidate_id", "text", "status")


@query("approved_concepts_m8", f"WITH {_CAND} SELECT md5(language || ':' || text) AS concept_id, text AS name, CASE WHEN domain = 'physics' THEN 'physics' ELSE 'interdisciplinary' END AS category FROM cand WHERE status = 'approved'")
def approved_concepts(spark, d):
    return mining.approved_concepts(candidates(spark, d)).select("concept_id", F.map_values("representations")[0][0].alias("name"), "category")


@query("candidate_occurrences_m9", f"WITH {_CAND}, e AS (SELECT *, unnest(segments) AS segment_id FROM cand WHERE status = 'approved') SELECT md5(language || ':' || text) AS concept_id, video_id, segment_id, o_custkey * 1.0 AS start_time, least(score, 4.0) AS significance, CASE WHEN least(score, 4.0) >= 2.5 THEN 'comprehensive' ELSE 'passing' END AS kind, 1.0 AS similarity FROM e JOIN orders ON o_orderkey = segment_id")
def candidate_occurrences(spark, d):
    segments = M.table(spark, d, "orders").select(F.col("o_orderkey").alias("segment_id"), (F.col("o_custkey") * 1.0).alias("start_time"))
    return mining.candidate_occurrences(candidates(spark, d), segments)


# ---- extraction

_CAT = (
    r"tm AS (SELECT lang, term, row_number() OVER (PARTITION BY lang ORDER BY count(*) DESC, term) AS r FROM (SELECT lang, unnest(regexp_extract_all(lower(text), '\p{L}{4,}')) AS term FROM documents) GROUP BY lang, term), "
    "cat AS (SELECT lang || r AS concept_id, term AS text, lang AS language, ['first', 'second', 'unknown', 'third'][r % 4 + 1] AS domain FROM tm WHERE r <= 40), "
    "seg AS (SELECT conv_id AS video_id, conv_id * 1000 + turn AS segment_id, turn AS pos, turn * 10.0 AS start_time, text, ['first', 'second', 'third'][conv_id % 3 + 1] AS domain FROM conversations)"
)
_GROUPS = {"first": "a", "second": "a", "third": "b"}
_TERMS = {"first": ["eau", "tion", "sch"], "third": ["qq", "que"]}


def catalogue(spark, d):
    from ..operators import transcripts

    top = transcripts.catalogue(M.table(spark, d, "documents"), 40)
    domain = F.element_at(F.array(*map(F.lit, ["first", "second", "unknown", "third"])), (F.col("rank") % 4 + 1).cast("int"))
    return top.select(F.concat("lang", F.col("rank").cast("string")).alias("concept_id"), F.col("term").alias("text"), F.col("lang").alias("language"), domain.alias("domain"), "rank")


def segments(spark, d):
    c = M.table(spark, d, "conversations")
    domain = F.element_at(F.array(*map(F.lit, ["first", "second", "third"])), (F.col("conv_id") % 3 + 1).cast("int"))
    return c.select(F.col("conv_id").alias("video_id"), (F.col("conv_id") * 1000 + F.col("turn")).alias("segment_id"), F.col("turn").alias("pos"), (F.col("turn") * 10.0).alias("start_time"), "text", domain.alias("domain"))


_TOKENS = r"tk AS (SELECT DISTINCT segment_id, unnest(string_split(trim(regexp_replace(lower(text), '[^\p{L}\p{N}]+', ' ', 'g')), ' ')) AS term FROM seg)"
_WORDFORMS = (
    "fm AS (SELECT concept_id, text AS form FROM cat UNION SELECT concept_id, left(text, length(text) - 1) FROM cat WHERE length(text) > 4 AND ends_with(text, 's') UNION SELECT concept_id, text || 's' FROM cat WHERE NOT ends_with(text, 's') "
    "UNION SELECT concept_id, left(text, length(text) - 3) FROM cat WHERE length(text) > 5 AND ends_with(text, 'ing') UNION SELECT concept_id, left(text, length(text) - 3) || 'e' FROM cat WHERE length(text) > 5 AND ends_with(text, 'ing') "
    "UNION SELECT concept_id, left(text, length(text) - k) || e FROM cat, (VALUES (2, ''), (1, ''), (2, 'e')) x(k, e) WHERE length(text) > 4 AND ends_with(text, 'ed'))"
)
_VM = f"{_CAT}, {_TOKENS}, {_WORDFORMS}, vm AS (SELECT segment_id, concept_id, min(form) AS matched, 0.9 AS similarity FROM tk JOIN fm ON form = term GROUP BY ALL)"


@query("variant_matches_k9", f"WITH {_VM} SELECT * FROM vm")
def variant_matches(spark, d):
    return extraction.variant_matches(segments(spark, d), catalogue(spark, d), longest=1)


@query("direct_matches_k11", f"WITH {_CAT}, {_TOKENS} SELECT segment_id, concept_id, text AS matched, 0.95 AS similarity FROM tk JOIN cat ON text = term")
def direct_matches(spark, d):
    return extraction.direct_matches(segments(spark, d), catalogue(spark, d), longest=1)


@query("containment_d8", f"WITH {_CAT}, {_TOKENS} SELECT segment_id, text AS term FROM tk JOIN (SELECT DISTINCT text FROM cat) ON text = term")
def containment(spark, d):
    return matching.contained(segments(spark, d), "segment_id", catalogue(spark, d).select(F.col("text").alias("term")), longest=1)


@query("contexts_d15", f"WITH {_CAT}, {_TOKENS} SELECT DISTINCT concept_id, segment_id FROM tk JOIN cat ON text = term")
def contexts(spark, d):
    return signatures.contexts_of(catalogue(spark, d), segments(spark, d), longest=1)


_MARK = ["thon", "eaux", "ungs"]
_N = f"len({words_sql('s.text')})"
_VALUE = f"(0.8 * ({has_sql('lower(s.text)', _MARK)}) + least({_N} / 20.0, 2.0))"
_SIG = f"least(5.0, 0.8 * {_VALUE} + CASE WHEN regexp_matches(s.text, '(?i){'|'.join(_MARK)}') THEN 1.2 ELSE 0 END + CASE WHEN strpos(lower(s.text), lower(matched)) > 0 THEN 0.5 * (1 - 2 * abs(0.5 - (strpos(lower(s.text), lower(matched)) - 1) / greatest(1, length(s.text) - length(matched)))) ELSE 0 END + CASE WHEN {_N} > 30 THEN 0.8 WHEN {_N} > 15 THEN 0.4 ELSE 0 END)"
_FITS = "(s.domain = c.domain OR c.domain = 'unknown' OR (s.domain IN ('first', 'second') AND c.domain IN ('first', 'second')))"
_CONTEXT = f"(s.domain <> 'first' OR {has_sql('lower(s.text)', _TERMS['first'])} >= 1) AND (s.domain <> 'third' OR {has_sql('lower(s.text)', _TERMS['third'])} >= 1)"
_OCC = f"{_VM}, oc AS (SELECT concept_id, s.video_id, segment_id, s.start_time, matched, similarity, round({_SIG}, 6) AS significance FROM vm JOIN seg s USING (segment_id) JOIN cat c USING (concept_id) WHERE {_FITS} AND {_CONTEXT})"


def _occurrences(spark, d):
    s, c = segments(spark, d), catalogue(spark, d)
    return extraction.occurrences(s, c, extraction.variant_matches(s, c, longest=1), _MARK, _TERMS, _GROUPS)


@query("segment_occurrences_k8", f"WITH {_OCC} SELECT *, CASE WHEN significance >= 2.5 THEN 'comprehensive' ELSE 'passing' END AS kind FROM oc")
def segment_occurrences(spark, d):
    return _occurrences(spark, d)


@query("extracted_concepts_k6", f"WITH {_OCC} SELECT video_id, concept_id, max(significance) AS significance, count(*) AS occurrences, max(significance) >= 2.5 AS is_educational FROM oc GROUP BY ALL")
def extracted_concepts(spark, d):
    return extraction.concepts_of(_occurrences(spark, d))


@query("max_significance_e13", f"WITH {_OCC} SELECT concept_id, max(significance) AS significance, bool_or(significance >= 2.5) AS is_educational FROM oc GROUP BY concept_id")
def max_significance(spark, d):
    by = _occurrences(spark, d).groupBy("concept_id").agg(F.max("significance").alias("significance"))
    return by.withColumn("is_educational", F.col("significance") >= 2.5)


@query("sorted_extraction_k7", f"WITH {_OCC}, b AS (SELECT video_id, concept_id, max(significance) AS s, count(*) AS n FROM oc GROUP BY ALL) SELECT video_id, concept_id, CAST(row_number() OVER (PARTITION BY video_id ORDER BY s DESC, n DESC, concept_id) AS INTEGER) AS rank FROM b")
def sorted_extraction(spark, d):
    from ..operators.reports import top_per_group

    return top_per_group(extracted_concepts(spark, d), ["video_id"], [F.desc("significance"), F.desc("occurrences"), "concept_id"], 1 << 30).select("video_id", "concept_id", "rank")


@query("sentence_matches_k9", f"WITH {_CAT}, s2 AS (SELECT segment_id, CASE segment_id % 3 WHEN 0 THEN t1.text WHEN 1 THEN t1.text || 's' ELSE 'no match here' END AS q FROM (SELECT seg.segment_id, 'en' || (segment_id % 40 + 1) AS cid FROM seg) x JOIN cat t1 ON t1.concept_id = cid), {_WORDFORMS} SELECT segment_id, concept_id, max(similarity) AS similarity, q AS matched FROM (SELECT segment_id, concept_id, 1.0 AS similarity, q FROM s2 JOIN cat ON cat.text = q UNION ALL SELECT segment_id, f.concept_id, 0.95, q FROM (SELECT segment_id, q, form AS qf FROM (SELECT DISTINCT segment_id, q, unnest(list_concat(list_concat(list_concat([q], CASE WHEN length(q) > 4 AND ends_with(q, 's') THEN [left(q, length(q) - 1)] WHEN length(q) > 3 AND NOT ends_with(q, 's') THEN [q || 's'] ELSE [] END), CASE WHEN length(q) > 5 AND ends_with(q, 'ing') THEN [left(q, length(q) - 3), left(q, length(q) - 3) || 'e'] ELSE [] END), CASE WHEN length(q) > 4 AND ends_with(q, 'ed') THEN [left(q, length(q) - 2), left(q, length(q) - 1), left(q, length(q) - 2) || 'e'] ELSE [] END)) AS form FROM s2 WHERE q <> 'no match here')) y JOIN fm f ON f.form = qf) GROUP BY segment_id, concept_id, q")
def sentence_matches(spark, d):
    s, c = segments(spark, d), catalogue(spark, d)
    wanted = s.select("segment_id", F.concat(F.lit("en"), (F.col("segment_id") % 40 + 1).cast("string")).alias("concept_id")).join(c.select("concept_id", F.col("text").alias("t")), "concept_id")
    k = F.col("segment_id") % 3
    sentences = wanted.select("segment_id", F.when(k == 0, F.col("t")).when(k == 1, F.concat("t", F.lit("s"))).otherwise("no match here").alias("text"))
    return extraction.sentence_matches(sentences, c)


@query("newest_concepts_k10", f"WITH {_CAT} SELECT concept_id FROM (SELECT *, row_number() OVER (PARTITION BY language ORDER BY text DESC, concept_id) AS n FROM cat) WHERE n <= 10")
def newest_concepts(spark, d):
    return extraction.newest(catalogue(spark, d).drop("rank"), 10, "text").select("concept_id")


@query("significance_ru_l2", f"SELECT conv_id * 1000 + turn AS segment_id, least(2.0 + CASE WHEN n > 30 THEN 1.0 WHEN n > 15 THEN 0.5 ELSE 0 END, 4.0) AS significance FROM (SELECT *, len({words_sql('text')}) AS n FROM conversations)")
def significance_ru(spark, d):
    return segments(spark, d).select("segment_id", extraction.significance_ru(F.col("text")).alias("significance"))


# ---- signatures

_KEEP, _DOM = ["el", "la"], ["les", "des", "und", "pour"]
_SEQ = f"sq AS (SELECT conv_id AS g, turn, {PREPROCESSED.replace('{c}', 'text')} AS w FROM conversations)"
_RUNS = "rn AS (SELECT DISTINCT g, turn, w[i:i + k - 1] AS gram FROM (SELECT g, turn, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM sq, (SELECT unnest(range(2, 11)) AS k)))"
_DOMS = f"len(list_filter(gram, lambda t: t IN ({listed(_DOM)})))"
_PAT = f"{_SEQ}, {_RUNS}, nn AS (SELECT g, count(*) AS total FROM sq GROUP BY g), pt AS (SELECT g, gram, count(*) AS df, any_value(total) AS total FROM rn JOIN nn USING (g) GROUP BY g, gram)"


def talks(spark, d):
    return M.table(spark, d, "conversations").select(F.col("conv_id").alias("g"), "turn", "text")


@query("ngram_mining_j16", f"WITH {_PAT} SELECT g, array_to_string(gram, ' ') AS gram, df, round(0.3 * len(gram) + 2.0 * df / total + 0.5 * {_DOMS}, 6) AS score FROM pt WHERE df >= greatest(2, total // 3)")
def ngram_mining(spark, d):
    found = signatures.patterns(talks(spark, d), ["g"], "turn", _DOM, keep=_KEEP)
    return found.select("g", F.array_join("gram", " ").alias("gram"), "df", "score")


@query("token_mlcs_j14", f"WITH {_PAT}, sc AS (SELECT g, gram, round(len(gram) * df / total * (1 + 0.2 * {_DOMS}), 6) AS score FROM pt WHERE df >= greatest(2, total // 2)) SELECT g, array_to_string(arg_min(gram, (-score, gram)), ' ') AS pattern, max(score) AS score FROM sc GROUP BY g")
def token_mlcs(spark, d):
    from ..functions import morphology as W
    from ..functions import text as T

    seq = talks(spark, d).select("g", "turn", T.words(F.lower("text")).alias("w")).select("g", "turn", W.significant(F.col("w"), keep=_KEEP).alias("w"))
    return signatures.best_run(seq, "g", "turn", _DOM).select("g", F.array_join("pattern", " ").alias("pattern"), "score")


_SIGN = f"WITH {_PAT}, rk AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY score DESC, gram) AS n FROM (SELECT g, gram, round(0.3 * len(gram) + 2.0 * df / total + 0.5 * {_DOMS}, 6) AS score FROM pt WHERE df >= greatest(2, total // 3))), ow AS (SELECT c.conv_id AS concept_id, {PREPROCESSED.replace('{c}', 'c.name')} AS own FROM (SELECT DISTINCT conv_id, CASE conv_id % 3 WHEN 0 THEN 'pour les' WHEN 1 THEN 'Nothings here' ELSE 'und sich' END AS name FROM conversations) c), jn AS (SELECT ow.*, a.gram AS g1, a.score AS s1, b.gram AS g2, b.score AS s2 FROM ow LEFT JOIN rk a ON a.g = concept_id AND a.n = 1 LEFT JOIN rk b ON b.g = concept_id AND b.n = 2)"


def _named(spark, d):
    k = F.col("conv_id")
    name = F.when(k % 3 == 0, "pour les").when(k % 3 == 1, "Nothings here").otherwise("und sich")
    return M.table(spark, d, "conversations").select(k.alias("concept_id"), name.alias("text")).distinct()


@query("signatures_o1", f"{_SIGN} SELECT concept_id, CASE WHEN g1 IS NOT NULL AND (len(list_intersect(g1, own)) > 0 OR len(g1) <= 2) THEN array_to_string(g1, ' ') WHEN g2 IS NOT NULL THEN array_to_string(g2, ' ') ELSE array_to_string(own, ' ') END AS pattern, CASE WHEN g1 IS NOT NULL AND (len(list_intersect(g1, own)) > 0 OR len(g1) <= 2) THEN round(least(s1 / 10, 0.95), 6) WHEN g2 IS NOT NULL THEN round(least(s2 / 10, 0.9), 6) ELSE 0.5 END AS confidence FROM jn")
def generate_signatures(spark, d):
    contexts = talks(spark, d).select(F.col("g").alias("concept_id"), F.col("turn").alias("item"), "text")
    return signatures.signatures(_named(spark, d), contexts, _DOM, _KEEP).select("concept_id", F.array_join("pattern", " ").alias("pattern"), "confidence")


@query("signature_of_contexts_j15", f"{_SIGN} SELECT count(*) AS concepts, count(g1) AS patterned, count(g2) AS second FROM jn")
def signature_counts(spark, d):
    contexts = talks(spark, d).select(F.col("g").alias("concept_id"), F.col("turn").alias("item"), "text")
    by = signatures.patterns(contexts, ["concept_id"], "item", _DOM, keep=_KEEP).groupBy("concept_id").agg(F.count("*").alias("n"))
    return _named(spark, d).join(by, "concept_id", "left").agg(F.count("*").alias("concepts"), F.count("n").alias("patterned"), F.count_if(F.col("n") > 1).alias("second"))


@query("signature_weights_l3", "SELECT g AS concept_id, round(least(n, 5) * 0.5 + least(s, 3) * 0.7 + least(d / 10.0, 3.0) + least(m, 3) * 0.8, 6) AS weight, round(least(n, 5) * 0.5 + least(s, 3) * 0.7 + least(d / 10.0, 3.0) + least(m, 3) * 0.8, 6) > 2.5 AS is_educational FROM (SELECT conv_id AS g, count(*) AS n, count(DISTINCT turn % 2) AS s, sum(length(text) % 5) AS d, count(*) FILTER (regexp_matches(lower(text), '(^|[^\\p{L}\\p{N}_])(?:pour les|les|und)($|[^\\p{L}\\p{N}_])')) AS m FROM conversations GROUP BY 1)")
def signature_weights(spark, d):
    c = M.table(spark, d, "conversations")
    contexts = c.select(F.col("conv_id").alias("concept_id"), (F.col("turn") % 2).alias("segment_id"), (F.length("text") % 5).alias("duration"), "text")
    return signatures.weights(contexts, ["pour les", "les", "und"])


_ALIKE = "nd AS (SELECT min(p_partkey) AS id, p_name AS text, CASE length(p_name) % 2 WHEN 0 THEN 'en' ELSE 'fr' END AS language, left(p_name, 1) < 'm' AS half, [split_part(p_name, ' ', 2), 'red'] AS pattern, min(p_partkey) % 5 = 0 AS variant FROM part GROUP BY p_name)"


@query("similar_nodes_k12", "WITH " + _ALIKE + ", pr AS (SELECT x.text AS a, y.text AS b, x.language, x.half, y.id, y.pattern FROM nd x JOIN nd y ON x.language = y.language AND x.half = y.half WHERE NOT y.variant), sm AS (SELECT *, round(2 * n / (length(a) + length(b)), 6) AS similarity, round(len(list_filter(pattern, lambda t: contains(a, t))) / 2.0, 6) AS pattern_score FROM (SELECT *, " + "list_reduce(list_transform(string_split(a, ''), lambda c: [CAST(unicode(c) AS BIGINT)]), lambda row, x: list_reduce(list_transform(range(1, length(b) + 1), lambda j: [j]), lambda acc, j: list_append(acc, greatest(acc[len(acc)], row[j[1] + 1], row[j[1]] + CASE WHEN unicode(substr(b, j[1], 1)) = x[1] THEN 1 ELSE 0 END)), [CAST(0 AS BIGINT)]), list_transform(range(0, length(b) + 1), lambda z: CAST(0 AS BIGINT)))[length(b) + 1]" + " AS n FROM pr)) SELECT text, id, similarity, pattern_score, score, CAST(r AS INTEGER) AS rank FROM (SELECT a AS text, id, similarity, pattern_score, score, row_number() OVER (PARTITION BY a ORDER BY score DESC, id) AS r FROM (SELECT *, round(0.7 * similarity + 0.3 * pattern_score, 6) AS score FROM sm) WHERE score > 0.5) WHERE r <= 10")
def similar_nodes(spark, d):
    by = M.table(spark, d, "part").groupBy(F.col("p_name").alias("text")).agg(F.min("p_partkey").alias("id"))
    n = by.select("id", "text", F.when(F.length("text") % 2 == 0, "en").otherwise("fr").alias("language"), (F.left("text", F.lit(1)) < "m").cast("string").alias("domain"), F.array(F.split_part("text", F.lit(" "), F.lit(2)), F.lit("red")).alias("pattern"), F.when(F.col("id") % 5 == 0, 1).alias("canonical"))
    return signatures.similar_nodes(n.select("text", "language", "domain"), n).select("text", "id", "similarity", "pattern_score", "score", "rank")


def _graph(spark, d):
    p, k = M.table(spark, d, "part"), F.col("p_partkey")
    none = F.lit(None).cast("string")
    n = p.select(k.cast("string").alias("id"), F.col("p_name").alias("text"), none.alias("normalized_text"), F.split("p_name", " ").alias("pattern"), F.col("p_type").alias("domain"), F.lit("theoretical").alias("concept_class"), F.lit("en").alias("language"), (F.col("p_size") / 100).alias("confidence"), F.lit(0.5).alias("score"), F.col("p_retailprice").alias("weight"), none.alias("canonical"))
    e = p.filter("p_partkey >= 2").select(k.cast("string").alias("src"), F.floor(k / 2).cast("string").alias("dst"), F.lit("prerequisite").alias("kind"), (F.col("p_size") / 100).alias("strength"))
    return n, e


@query("node_codec_o9", "SELECT CAST(p_partkey AS VARCHAR) AS id, p_name AS text, lower(p_name) AS normalized_text, string_split(p_name, ' ')[1] AS first, p_size / 100 AS confidence FROM part")
def node_codec(spark, d):
    n, _ = _graph(spark, d)
    return signatures.decoded(signatures.encoded(n)).select("id", "text", "normalized_text", F.col("pattern")[0].alias("first"), "confidence")


@query("graph_store_b16", "SELECT CAST(p_partkey AS VARCHAR) AS id, p_name AS text, CASE WHEN p_partkey >= 2 THEN CAST(p_partkey // 2 AS VARCHAR) END AS dst, CASE WHEN p_partkey >= 2 THEN p_size / 100 END AS strength FROM part")
def graph_store(spark, d):
    """A graph saved to the shared folder and loaded again."""
    path = lineage.folder(spark)
    signatures.save_graph(*_graph(spark, d), path)
    n, e = signatures.load_graph(spark, path)
    return n.join(e, n.id == e.src, "left").select("id", "text", "dst", "strength")


@query("find_mlcs_j11")
def find_mlcs(spark, d):
    """What the names of each kind of part have in common, by characters and by words."""
    by = M.table(spark, d, "part").groupBy("p_type", "p_size").agg(F.array_sort(F.collect_set("p_name")).alias("names"))
    chars = F.transform("names", lambda n: F.split(n, ""))
    words = F.transform("names", lambda n: F.split(n, " "))
    return by.select("p_type", "p_size", F.array_join(lcs.mlcs(chars), "").alias("letters"), F.array_join(lcs.mlcs(words), " ").alias("words"))
