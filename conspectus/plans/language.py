"""Registered queries: normal forms, languages, domains, predicates and word forms of names and texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import lexicons as L
from ..functions import morphology as W
from ..functions import text as T
from ..operators import analysis
from ..sources import model as M
from .base import NAMES_RU_SQL, NAMES_SQL, RUSSIAN_SQL, count_sql, has_sql, listed, names, names_ru, registry, russian, words_sql

Q, S, query = registry()


def nested(text: str, steps: list[tuple[str, str]], every: bool = True) -> str:
    """regexp_replace calls, one inside the other."""
    for pattern, to in steps:
        text = f"regexp_replace({text}, '{pattern}', '{to}'{', ' + chr(39) + 'g' + chr(39) if every else ''})"
    return text


def replaced(text: str, phrases: list[str]) -> str:
    for p in phrases:
        text = f"replace({text}, '{p}', '')"
    return text


STRIP = [(r"^\s+|\s+$", "")]
COLLAPSE = nested("lower({c})", [(r"\s+", " "), *STRIP])
EDGE, TAIL = r"(^|[^\p{L}\p{N}_])", r"($|[^\p{L}\p{N}_])"
NOISE = [*L.NAME_NOISE, "ring", "ed"]


@query("norm_catalogue_h2", f"WITH {NAMES_SQL} SELECT id, {nested('replace(' + replaced(nested(COLLAPSE.format(c='name'), [(f'^{w} ', '') for w in L.FILLERS]), NOISE) + ', ' + chr(39) + '-' + chr(39) + ', ' + chr(39) + ' ' + chr(39) + ')', [(chr(92) + 's+', ' '), *STRIP])} AS form FROM names")
def norm_catalogue(spark, d):
    return names(spark, d).select("id", T.normalise_catalogue(F.col("name"), NOISE).alias("form"))


@query("norm_candidate_h4", f"WITH {NAMES_SQL} SELECT id, CASE WHEN id % 2 = 0 THEN replace({COLLAPSE.format(c='name')}, 'ё', 'е') ELSE {COLLAPSE.format(c='name')} END AS form FROM names")
def norm_candidate(spark, d):
    return names(spark, d).select("id", T.normalise_candidate(F.col("name"), F.when(F.col("id") % 2 == 0, "ru").otherwise("en")).alias("form"))


_DEDUP = nested(nested(COLLAPSE.format(c="name"), [(f"^{w} ", "") for w in L.DEDUP_FILLERS["en"]]), STRIP)


@query("norm_dedup_h5", f"WITH {NAMES_SQL} SELECT id, CASE WHEN f IN ({listed(L.BARE_WORDS['en'])}) THEN '' ELSE f END AS form FROM (SELECT id, {_DEDUP} AS f FROM names)")
def norm_dedup(spark, d):
    return names(spark, d).select("id", T.normalise_dedup(F.col("name")).alias("form"))


_DANGLING = "|".join(L.DANGLING_RU)


@query("norm_dedup_ru_h5", f"WITH {NAMES_RU_SQL} SELECT id, CASE WHEN f IN ({listed(L.BARE_WORDS['ru'])}) THEN '' ELSE f END AS form FROM (SELECT id, {nested(COLLAPSE.format(c='name'), [*[(f'^{w} ', '') for w in L.DEDUP_FILLERS['ru']], (rf' ({_DANGLING})$', ''), (rf'^({_DANGLING}) ', ''), *STRIP])} AS f FROM names)")
def norm_dedup_ru(spark, d):
    return names_ru(spark, d).select("id", T.normalise_dedup(F.col("name"), "ru").alias("form"))


@query("norm_signature_h6", f"WITH {NAMES_SQL} SELECT id, {nested(COLLAPSE.format(c='name'), [(f'^{w} ', '') for w in L.SIGNATURE_FILLERS])} AS form FROM names")
def norm_signature(spark, d):
    return names(spark, d).select("id", T.normalise_signature(F.col("name")).alias("form"))


@query("norm_catalogue_ru_h3", f"WITH {NAMES_RU_SQL} SELECT id, trim(regexp_replace(list_reduce([list_filter(string_split({COLLAPSE.format(c='name')}, ' '), lambda w: w NOT IN ({listed(L.NAME_NOISE_RU)}))], lambda a, b: a)[1:99]::VARCHAR, '[\\[\\],'']', '', 'g')) AS form FROM names")
def norm_catalogue_ru(spark, d):
    return names_ru(spark, d).select("id", T.normalise_catalogue_ru(F.col("name")).alias("form"))


# words of the texts stand for the noise words, which are too rare there
_ANY, _START, _PHRASES = ["де", "les"], ["ин", "un la"], ["тион", "еау"]
_RU8 = nested("translate(text, 'ёЁ', 'еЕ')", [(r"\s+", " "), *STRIP, (r"([\p{L}\p{N}_])\.([\p{L}\p{N}_])", r"\1. \2"), (r"\[[\p{L}\p{N}_]+\]:", ""), (r"\.{3,}", "..."), (r"\[.*?\]", ""), (r"\s+,", ","), (r"\s+\.", ".")])


@query("norm_transcript_ru_h8", f"WITH {RUSSIAN_SQL} SELECT doc_id, md5({nested(replaced(nested(_RU8, [(f'^{w}' + chr(92) + 's+', '') for w in _START]), _PHRASES), STRIP)}) AS h FROM ru")
def norm_transcript_ru(spark, d):
    return russian(spark, d).select("doc_id", F.md5(T.normalise_transcript_ru(F.col("text"), [], _START, _PHRASES)).alias("h"))


@query("norm_segments_ru_h9", f"WITH {RUSSIAN_SQL} SELECT doc_id, md5({nested('translate(text, ' + chr(39) + 'ёЁ' + chr(39) + ', ' + chr(39) + 'еЕ' + chr(39) + ')', [(chr(92) + 's+', ' '), *STRIP, (chr(92) + 's+' + chr(92) + '.', '.'), (chr(92) + 's+,', ',')])}) AS h FROM ru")
def norm_segments_ru(spark, d):
    return russian(spark, d).select("doc_id", F.md5(T.normalise_russian(F.col("text"))).alias("h"))


_MIXED_SQL = f"mixed AS (SELECT doc_id, lang, CASE doc_id % 4 WHEN 0 THEN text WHEN 1 THEN translate(text, '{L.TEST_CYRILLIC[0]}', '{L.TEST_CYRILLIC[1]}') WHEN 2 THEN translate(lower(text), 'aeinorstu', 'αεινορστυ') ELSE regexp_replace(text, '[a-zA-Z]', '中', 'g') END AS text FROM documents)"


def mixed(spark, d):
    t, k = F.col("text"), F.col("doc_id") % 4
    forms = F.when(k == 0, t).when(k == 1, F.translate(t, *L.TEST_CYRILLIC)).when(k == 2, F.translate(F.lower(t), "aeinorstu", "αεινορστυ")).otherwise(F.regexp_replace(t, "[a-zA-Z]", "中"))
    return M.table(spark, d, "documents").select("doc_id", "lang", forms.alias("text"))


_SCRIPT_SQL = "CASE WHEN greatest(l, c, g, h) = 0 THEN 'Latin' WHEN l = greatest(l, c, g, h) THEN 'Latin' WHEN c = greatest(l, c, g, h) THEN 'Cyrillic' WHEN g = greatest(l, c, g, h) THEN 'Greek' ELSE 'CJK' END"
_COUNTS_SQL = ", ".join(f"len(regexp_extract_all(text, '\\p{{{p}}}')) AS {a}" for a, p in (("l", "Latin"), ("c", "Cyrillic"), ("g", "Greek"), ("h", "Han")))


@query("script_detect_h12", f"WITH {_MIXED_SQL} SELECT doc_id, {_SCRIPT_SQL} AS script FROM (SELECT doc_id, {_COUNTS_SQL} FROM mixed)")
def script_detect(spark, d):
    return mixed(spark, d).select("doc_id", T.script(F.col("text")).alias("script"))


@query("declared_language_h11", f"WITH {_MIXED_SQL} SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'ru' WHEN {_SCRIPT_SQL} = 'Cyrillic' THEN 'ru' ELSE 'en' END AS language FROM (SELECT doc_id, {_COUNTS_SQL} FROM mixed)")
def declared_language(spark, d):
    declared = F.when(F.col("doc_id") % 3 == 0, "RU-RU").when(F.col("doc_id") % 3 == 1, "de-DE")
    return mixed(spark, d).select("doc_id", T.declared_language(declared, F.col("text")).alias("language"))


_KEYS = {"mathematics": ["tion", "the", "ing", "of"], "programming": ["que", "eau", "les"], "physics": ["und", "sch", "keit"]}
_BONUS = {"mathematics": "thon", "programming": "eaux", "physics": "nicht"}
_H16 = "SELECT doc_id, " + ", ".join(f"{has_sql('lower(text)', ks)} + CASE WHEN contains(lower(text), '{_BONUS[k]}') THEN 2 ELSE 0 END AS {k[0] + k[1]}" for k, ks in _KEYS.items()) + " FROM documents"


@query("metadata_domain_h16", f"SELECT doc_id, CASE WHEN m = 0 THEN 'unknown' WHEN ma = m THEN 'mathematics' WHEN pr = m THEN 'programming' ELSE 'physics' END AS domain, round(CASE WHEN m = 0 THEN 0 WHEN n > 1 THEN 0.5 WHEN m >= 3 THEN least(m / (ma + pr + ph) + 0.2, 0.95) ELSE m / (ma + pr + ph) END, 6) AS confidence FROM (SELECT *, greatest(ma, pr, ph) AS m, CAST(ma = greatest(ma, pr, ph) AS INTEGER) + CAST(pr = greatest(ma, pr, ph) AS INTEGER) + CAST(ph = greatest(ma, pr, ph) AS INTEGER) AS n FROM ({_H16}))")
def metadata_domain(spark, d):
    found = M.table(spark, d, "documents").select("doc_id", T.metadata_domain(F.col("text"), _KEYS, _BONUS).alias("m"))
    return found.select("doc_id", "m.domain", F.round("m.confidence", 6).alias("confidence"))


@query("keyword_domain_h14", "SELECT doc_id, CASE WHEN greatest(m, p, f) = 0 THEN 'unknown' WHEN m = greatest(m, p, f) THEN 'mathematics' WHEN p = greatest(m, p, f) THEN 'programming' ELSE 'physics' END AS domain FROM (SELECT doc_id, " + ", ".join(f"{count_sql('lower(text)', L.TEST_DOMAINS[k])} AS {a}" for a, k in (("m", "mathematics"), ("p", "programming"), ("f", "physics"))) + " FROM documents)")
def keyword_domain(spark, d):
    return M.table(spark, d, "documents").select("doc_id", T.keyword_domain(F.col("text"), L.TEST_DOMAINS).alias("domain"))


@query("domain_category_h17", "SELECT p_partkey, CASE WHEN p_type = 'ECONOMY' THEN 'mathematics' WHEN p_type IN ('PROMO', 'SMALL') THEN 'computer_science' ELSE 'interdisciplinary' END AS category FROM part")
def domain_category(spark, d):
    t = F.col("p_type")
    domain = F.when(t == "ECONOMY", "Mathematics").when(t == "PROMO", "programming").when(t == "SMALL", "computer_science").otherwise(t)
    return M.table(spark, d, "part").select("p_partkey", T.domain_category(domain).alias("category"))


@query("nearest_centroid_h15", "WITH e AS (SELECT vec_id, label, unnest(range(1, 65)) AS i, unnest(embedding) AS x FROM embeddings), c AS (SELECT label AS domain, i, avg(x) AS m FROM e GROUP BY label, i), n AS (SELECT domain, sqrt(sum(m * m)) AS norm FROM c GROUP BY domain), v AS (SELECT vec_id, sqrt(sum(x * x)) AS norm FROM e GROUP BY vec_id), s AS (SELECT e.vec_id, c.domain, round(sum(x * m) / max(v.norm) / max(n.norm), 6) AS score FROM e JOIN c USING (i) JOIN n USING (domain) JOIN v USING (vec_id) GROUP BY e.vec_id, c.domain) SELECT vec_id, CASE WHEN max(score) > 0.1 THEN arg_max(domain, (score, -domain)) END AS domain, max(score) AS score FROM s GROUP BY vec_id")
def nearest_centroid(spark, d):
    return analysis.nearest_centroid(M.table(spark, d, "embeddings").select("vec_id", F.col("embedding").alias("vector"), F.col("label").alias("domain")), "vec_id")


@query("marker_test_h21", "SELECT doc_id, regexp_matches(text, '(?i)" + "|".join(["thon", "eaux", "ungs"]) + "') AS marked FROM documents")
def marker_test(spark, d):
    return M.table(spark, d, "documents").select("doc_id", T.marked(F.col("text"), ["thon", "eaux", "ungs"]).alias("marked"))


_PATTERN = r"list_filter(regexp_extract_all(lower({c}), '[\p{{L}}\p{{N}}_-]*[\p{{L}}\p{{N}}_][\p{{L}}\p{{N}}_-]*'), lambda w: length(w) > 2)"


@query("pattern_words_h22", f"WITH {NAMES_SQL} SELECT id, array_to_string({_PATTERN.format(c='name')}, ' ') AS pattern FROM names")
def pattern_words(spark, d):
    return names(spark, d).select("id", F.array_join(T.pattern_words(F.col("name")), " ").alias("pattern"))


@query("pattern_match_h23", "SELECT doc_id, round((" + has_sql("lower(text)", ["thon", "tion", "eau", "que"]) + ") / 4.0, 6) AS share FROM documents")
def pattern_match(spark, d):
    pattern = F.array(*map(F.lit, ["thon", "tion", "eau", "que"]))
    return M.table(spark, d, "documents").select("doc_id", F.round(T.pattern_match(pattern, F.col("text")), 6).alias("share"))


def letters_sql(c: str) -> str:
    single = {a: b for a, b in L.LETTERS_RU.items() if len(b) == 1}
    c = f"translate({c}, '{''.join(single) + ''.join(single).upper()}', '{''.join(single.values()) + ''.join(single.values()).upper()}')"
    for a, b in L.LETTERS_RU.items():
        if len(b) != 1:
            c = f"replace(replace({c}, '{a}', '{b}'), '{a.upper()}', '{b.capitalize()}')"
    return c


@query("transliterate_h24", f"WITH {NAMES_RU_SQL} SELECT id, {letters_sql('name')} AS form FROM names")
def transliterate(spark, d):
    return names_ru(spark, d).select("id", T.transliterate(F.col("name")).alias("form"))


# words of the names stand for the terms
_TERMS = {"кольцо": "ring", "красный": "red", "большой болт": "large bolt"}


@query("to_russian_h25", "SELECT p_partkey AS id, CASE WHEN p_name = 'ring' THEN 'кольцо' WHEN contains(p_name, 'ring') THEN replace(p_name, 'ring', 'кольцо') WHEN contains(p_name, 'red') THEN replace(p_name, 'red', 'красный') WHEN contains(p_name, 'large bolt') THEN replace(p_name, 'large bolt', 'большой болт') ELSE p_name END AS form FROM part")
def to_russian(spark, d):
    return M.table(spark, d, "part").select(F.col("p_partkey").alias("id"), T.to_russian(F.col("p_name"), _TERMS).alias("form"))


@query("translate_h26", f"WITH {NAMES_RU_SQL}, t AS (SELECT name, 'known ' || min(id) AS word FROM names GROUP BY name HAVING min(id) % 2 = 0) SELECT id, coalesce(word, lower({letters_sql('lower(name)')})) AS form FROM names LEFT JOIN t USING (name)")
def translate(spark, d):
    n = names_ru(spark, d)
    dictionary = n.groupBy(F.col("name").alias("text")).agg(F.min("id").alias("k")).filter("k % 2 = 0").select("text", F.concat(F.lit("known "), F.col("k").cast("string")).alias("translation"))
    return analysis.translate(n, "name", dictionary).select("id", F.col("translated").alias("form"))


@query("translit_dispatch_h27", f"WITH {NAMES_RU_SQL} SELECT id, CASE WHEN id % 2 = 0 THEN {letters_sql('name')} ELSE name END AS form FROM names")
def translit_dispatch(spark, d):
    source = F.when(F.col("id") % 2 == 0, "ru").otherwise("de")
    return names_ru(spark, d).select("id", T.transliteration(F.col("name"), source, F.lit("en")).alias("form"))


@query("slug_ru_h28", f"WITH {NAMES_RU_SQL} SELECT id, regexp_replace(replace({letters_sql('lower(name)')}, ' ', '_'), '[^a-z0-9_]', '', 'g') AS slug FROM names")
def slug_ru(spark, d):
    return names_ru(spark, d).select("id", T.slug(F.lower("name")).alias("slug"))


_REPS = "CASE WHEN p_partkey % 3 = 0 THEN map {'ru': [p_brand], 'en': [p_name, p_type]} WHEN p_partkey % 3 = 1 THEN map {'de': [p_type, p_name]} ELSE map {'en': CAST([] AS VARCHAR[]), 'fr': [p_brand]} END"


def with_representations(spark, d):
    k = F.col("p_partkey") % 3
    many = F.create_map(F.lit("ru"), F.array("p_brand"), F.lit("en"), F.array("p_name", "p_type"))
    reps = F.when(k == 0, many).when(k == 1, F.create_map(F.lit("de"), F.array("p_type", "p_name"))).otherwise(F.create_map(F.lit("en"), F.array().cast("array<string>"), F.lit("fr"), F.array("p_brand")))
    return M.table(spark, d, "part").select("p_partkey", reps.alias("representations"))


@query("display_name_h31", "SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN p_name WHEN 1 THEN p_type END AS shown FROM part")
def display_name(spark, d):
    return with_representations(spark, d).select("p_partkey", T.display_name(F.col("representations")).alias("shown"))


@query("json_codec_h32", "SELECT p_partkey, len(CAST(CAST({'n': p_name, 's': p_size} AS JSON) AS VARCHAR)) AS size, p_name AS name, p_size AS number FROM part")
def json_codec(spark, d):
    coded = M.table(spark, d, "part").select("p_partkey", F.to_json(F.struct(F.col("p_name").alias("n"), F.col("p_size").alias("s"))).alias("j"))
    back = F.from_json("j", "n string, s int")
    return coded.select("p_partkey", F.length("j").cast("long").alias("size"), back["n"].alias("name"), back["s"].alias("number"))


# ---- predicates


@query("candidate_valid_c8", f"WITH {NAMES_SQL} SELECT id, length(name) >= 3 AND NOT regexp_full_match(name, '[0-9]+') AND len({words_sql('name')}) <= 5 AND len(list_filter({words_sql('name')}, lambda w: lower(w) NOT IN ({listed(L.STOPWORDS['en'])}))) > 0 AND lower(name) NOT IN ({listed(L.GENERIC_PHRASES)}) AND NOT (domain = 'mathematics' AND lower(name) IN ({listed(L.MATH_PHRASES)})) AS valid FROM names")
def candidate_valid(spark, d):
    return names(spark, d).select("id", T.valid_candidate(F.col("name"), F.col("domain")).alias("valid"))


@query("concept_valid_c9", f"WITH {NAMES_SQL} SELECT id, length(f) >= 3 AND len({words_sql('f')}) BETWEEN 1 AND 5 AND len(regexp_extract_all(f, '[0-9]')) / greatest(length(f), 1) <= 0.3 AS valid FROM (SELECT id, CASE WHEN f IN ({listed(L.BARE_WORDS['en'])}) THEN '' ELSE f END AS f FROM (SELECT id, {_DEDUP} AS f FROM names))")
def concept_valid(spark, d):
    return names(spark, d).select("id", T.valid_concept(F.col("name")).alias("valid"))


_GROUPS = {"SMALL": "light", "PROMO": "light", "LARGE": "heavy", "STANDARD": "heavy"}


@query("domain_compat_c10", "WITH t AS (SELECT DISTINCT CASE p_type WHEN 'MEDIUM' THEN 'unknown' ELSE p_type END AS d FROM part), g(d, grp) AS (VALUES ('SMALL', 'light'), ('PROMO', 'light'), ('LARGE', 'heavy'), ('STANDARD', 'heavy')) SELECT a.d AS one, b.d AS two, a.d = b.d OR a.d = 'unknown' OR b.d = 'unknown' OR coalesce(x.grp = y.grp, false) AS fits FROM t a CROSS JOIN t b LEFT JOIN g x ON x.d = a.d LEFT JOIN g y ON y.d = b.d")
def domain_compat(spark, d):
    one = M.table(spark, d, "part").select(F.when(F.col("p_type") == "MEDIUM", "unknown").otherwise(F.col("p_type")).alias("one")).distinct()
    # the list of domains is a handful of names, so each row carries it instead of a join
    every = one.agg(F.collect_set("one").alias("all"))
    pairs = every.select(F.explode("all").alias("one"), "all").select("one", F.explode("all").alias("two"))
    return pairs.select("one", "two", T.compatible_domains(F.col("one"), F.col("two"), _GROUPS).alias("fits"))


@query("context_valid_c11", "SELECT conv_id, turn, (" + has_sql("lower(text)", ["tion", "thon", "eaux", "keit"]) + ") >= CASE WHEN turn % 2 = 0 THEN 2 ELSE 1 END AS fits FROM conversations")
def context_valid(spark, d):
    c = M.table(spark, d, "conversations")
    return c.select("conv_id", "turn", T.in_context(F.col("text"), ["tion", "thon", "eaux", "keit"], F.when(F.col("turn") % 2 == 0, 2).otherwise(1)).alias("fits"))


_LISTS = r"SELECT page_id, coalesce(nullif(regexp_extract(a, 'youtube\.com/playlist\?list=([^&\s]+)', 1), ''), nullif(regexp_extract(a, 'youtube\.com/watch\?v=[^&\s]+&list=([^&\s]+)', 1), '')) AS playlist_id FROM (SELECT page_id, CASE page_id % 3 WHEN 0 THEN 'see https://www.youtube.com/playlist?list=PL' || page_id || '&x=1' WHEN 1 THEN 'youtube.com/watch?v=v' || page_id || '&list=L' || page_id ELSE url END AS a FROM pages)"


@query("playlist_url_c13", _LISTS)
def playlist_url(spark, d):
    k, n = F.col("page_id") % 3, F.col("page_id").cast("string")
    a = F.when(k == 0, F.concat(F.lit("see https://www.youtube.com/playlist?list=PL"), n, F.lit("&x=1"))).when(k == 1, F.concat(F.lit("youtube.com/watch?v=v"), n, F.lit("&list=L"), n)).otherwise(F.col("url"))
    return M.table(spark, d, "pages").select("page_id", T.address_id(a, T.PLAYLIST_FORMS).alias("playlist_id"))


# ---- word forms


def swapped_sql(word: str, endings: dict, first_only: bool, start: str = "''", rest: str = "''") -> str:
    """A list of forms of a word."""
    one = lambda e, to: "[" + ", ".join(f"{start} || left({word}, length({word}) - {len(e)}) || '{t}' || {rest}" for t in to) + "]"
    fits = lambda e: f"ends_with({word}, '{e}') AND length({word}) > {len(e) + 2}"
    if first_only:
        return "CASE " + " ".join(f"WHEN {fits(e)} THEN {one(e, to)}" for e, to in endings.items()) + " ELSE [] END"
    return "list_concat(" + ", ".join(f"CASE WHEN {fits(e)} THEN {one(e, to)} ELSE [] END" for e, to in endings.items()) + ")"


def concat_lists(*parts: str) -> str:
    out = parts[0]
    for p in parts[1:]:
        out = f"list_concat({out}, {p})"
    return out


_SPLIT = "w AS (SELECT id, name, string_split(name, ' ') AS ws FROM names), v AS (SELECT id, name, ws, ws[-1] AS z, ws[1] AS a, CASE WHEN len(ws) > 1 THEN array_to_string(ws[:-2], ' ') || ' ' ELSE '' END AS head, array_to_string(ws[2:], ' ') AS tail FROM w)"
_KERNEL_EN = "list_concat(" + ", ".join(f"CASE WHEN ends_with(z, '{e}') AND length(z) > {len(e) + 2} THEN [" + ", ".join(f"head || left(z, length(z) - {len(e)}) || '{t}'" for t in to) + "] ELSE [] END" for e, to in L.ENDINGS_KERNEL_EN.items()) + ")"


def _forms(names_sql: str, lists: str) -> str:
    return f"WITH {names_sql}, {_SPLIT} SELECT DISTINCT id, form FROM (SELECT id, unnest({lists}) AS form FROM v)"


@query("kernel_variants_en_j7", _forms(NAMES_SQL.replace("'The  '", "'The '"), f"list_concat([name], {_KERNEL_EN})"))
def kernel_variants_en(spark, d):
    n = names(spark, d).select("id", F.regexp_replace("name", r"\s+", " ").alias("name"))
    return n.select("id", F.explode(W.kernel_variants(F.col("name"))).alias("form"))


@query("kernel_variants_ru_j6", _forms(NAMES_RU_SQL, concat_lists("[name]", swapped_sql("z", L.ENDINGS_KERNEL_RU, False, "head"), f"CASE WHEN len(ws) > 1 THEN {swapped_sql('a', L.ENDINGS_KERNEL_RU, False, chr(39) * 2, (chr(39) + ' ' + chr(39) + ' || tail'))} ELSE [] END")))
def kernel_variants_ru(spark, d):
    return names_ru(spark, d).select("id", F.explode(W.kernel_variants(F.col("name"), "ru")).alias("form"))


_SHORT = listed(L.SHORT_WORDS_RU)
_WORD_RU = f"CASE WHEN length(z) <= 3 OR z IN ({_SHORT}) THEN [] ELSE {swapped_sql('z', L.ENDINGS_CATALOGUE_RU, True)} END"
_WORD_RU_A = f"CASE WHEN length(a) <= 3 OR a IN ({_SHORT}) THEN [] ELSE {swapped_sql('a', L.ENDINGS_CATALOGUE_RU, True)} END"


@query("word_forms_ru_j20", f"WITH {NAMES_RU_SQL}, {_SPLIT} SELECT DISTINCT z AS word, form FROM (SELECT z, unnest({_WORD_RU}) AS form FROM v)")
def word_forms_ru(spark, d):
    word = names_ru(spark, d).select(F.element_at(F.split("name", " "), -1).alias("word")).distinct()
    return word.select("word", F.explode(W.word_forms_ru(F.col("word"))).alias("form")).distinct()


_VARIANTS_RU = f"WITH {NAMES_RU_SQL}, {_SPLIT}, f AS (SELECT *, {_WORD_RU} AS last, {_WORD_RU_A} AS first FROM v) SELECT DISTINCT id, form FROM (SELECT id, unnest(" + concat_lists("[name]", "list_transform(last, lambda x: head || x)", "CASE WHEN len(ws) = 2 THEN list_transform(first, lambda x: x || ' ' || z) ELSE [] END", "CASE WHEN len(ws) = 2 THEN flatten(list_transform(first, lambda x: list_transform(last, lambda y: x || ' ' || y)))[1:5] ELSE [] END") + ") AS form FROM f)"


@query("variants_ru_j19", _VARIANTS_RU)
def variants_ru(spark, d):
    return names_ru(spark, d).select("id", F.explode(W.variants_ru(F.col("name"))).alias("form"))


@query("catalogue_variants_j21", _VARIANTS_RU)
def catalogue_variants(spark, d):
    return names_ru(spark, d).select("id", F.explode(W.catalogue_variants(F.col("name"), "ru")).alias("form"))


@query("matcher_variants_ru_j23", _forms(NAMES_RU_SQL, f"list_concat([name], CASE WHEN len(ws) > 3 OR length(name) <= 3 OR length(z) <= 3 OR z IN ({_SHORT}) THEN [] ELSE list_transform(({swapped_sql('z', L.ENDINGS_MATCHER_RU, True)})[1:5], lambda x: head || x) END)"))
def matcher_variants_ru(spark, d):
    return names_ru(spark, d).select("id", F.explode(W.matcher_variants_ru(F.col("name"))).alias("form"))


@query("variant_index_j22")
def variant_index(spark, d):
    return analysis.variant_index(names_ru(spark, d).select(F.col("id").alias("concept_id"), F.col("name").alias("text"), F.lit("ru").alias("language")))


# the index holds each normal form once for each concept
S["variant_index_j22"] = f"SELECT id AS concept_id, 'ru' AS language, regexp_replace(regexp_replace(lower(form), '\\s+', ' ', 'g'), '^\\s+|\\s+$', '', 'g') AS form FROM ({_VARIANTS_RU}) GROUP BY ALL"


_STEM = "regexp_replace(CASE WHEN length(w) > 3 AND ends_with(w, 's') AND NOT ends_with(w, 'ss') THEN left(w, length(w) - 1) WHEN length(w) > 4 AND ends_with(w, 'ing') THEN left(w, length(w) - 3) WHEN length(w) > 4 AND ends_with(w, 'ed') THEN left(w, length(w) - 2) ELSE w END, '[^\\p{L}\\p{N}-]', '', 'g')"
_KEEP = ["el", "la"]
PREPROCESSED = f"list_filter(list_transform({words_sql('lower({c})')}, lambda w: {_STEM}), lambda t: t <> '' AND (t IN ({listed(_KEEP)}) OR (t NOT IN ({listed(L.PATTERN_STOPWORDS)}) AND length(t) > 2 AND NOT regexp_full_match(t, '[0-9]+'))))"


@query("preprocess_j4", f"SELECT doc_id, md5(array_to_string({PREPROCESSED.replace('{c}', 'text')}, ' ')) AS h FROM documents")
def preprocess(spark, d):
    held = M.table(spark, d, "documents").select("doc_id", T.words(F.lower("text")).alias("w"))
    return held.select("doc_id", F.md5(F.array_join(W.significant(F.col("w"), keep=_KEEP), " ")).alias("h"))


@query("domain_term_j2", f"SELECT p_partkey, split_part(p_name, ' ', 2) IN ('ring', 'bolt') AS is_term FROM part")
def domain_term(spark, d):
    return M.table(spark, d, "part").select("p_partkey", F.coalesce(F.split_part("p_name", F.lit(" "), F.lit(2)).isin("ring", "bolt"), F.lit(False)).alias("is_term"))


_PAIRS_SQL = "p AS (SELECT DISTINCT p_name AS a, CASE WHEN length(p_name) % 2 = 0 THEN p_name || 's' ELSE split_part(p_name, ' ', 1) || ' ' || left(split_part(p_name, ' ', 2), 3) || 'xyz' END AS b FROM part)"
_FORMS_OF = lambda x: f"list_concat([{x}], " + "list_concat(" + ", ".join(f"CASE WHEN ends_with(split_part({x}, ' ', 2), '{e}') AND length(split_part({x}, ' ', 2)) > {len(e) + 2} THEN [" + ", ".join(f"left({x}, length({x}) - {len(e)}) || '{t}'" for t in to) + "] ELSE [] END" for e, to in L.ENDINGS_KERNEL_EN.items()) + "))"


@query("form_match_j8", f"WITH {_PAIRS_SQL} SELECT a, b, CASE WHEN a = b THEN 1.0 WHEN len(list_intersect({_FORMS_OF('a')}, {_FORMS_OF('b')})) > 0 THEN 0.95 WHEN split_part(a, ' ', 1) = split_part(b, ' ', 1) AND n > 2 AND left(split_part(a, ' ', 2), n) = left(split_part(b, ' ', 2), n) THEN 0.85 ELSE 0.0 END AS score FROM (SELECT a, b, least(length(split_part(a, ' ', 2)) - 2, length(split_part(b, ' ', 2)) - 2, 5) AS n FROM p)")
def form_match(spark, d):
    p = M.table(spark, d, "part").select(F.col("p_name").alias("a")).distinct()
    second = F.split_part("a", F.lit(" "), F.lit(2))
    b = F.when(F.length("a") % 2 == 0, F.concat("a", F.lit("s"))).otherwise(F.concat(F.split_part("a", F.lit(" "), F.lit(1)), F.lit(" "), F.substring(second, 1, 3), F.lit("xyz")))
    return p.select("a", b.alias("b")).select("a", "b", W.form_match(F.col("a"), F.col("b")).alias("score"))


# ---- Russian transcripts


@query("sentences_ru_i10", "WITH s AS (SELECT conv_id AS video_id, turn AS pos, turn * 10.0 AS start, t AS text FROM (SELECT conv_id, turn, translate(text, '" + L.TEST_CYRILLIC[0] + "ABDEGIKLMNOPRSTUVZ', '" + L.TEST_CYRILLIC[1] + L.TEST_CYRILLIC[1].upper() + "') AS t FROM conversations)), p AS (SELECT video_id, pos, start, CASE WHEN length(text) > 50 AND regexp_matches(text, '[.!?]') THEN string_split(regexp_replace(text, '([.!?…])\\s+([А-ЯЁ])', '\\1' || chr(1) || '\\2', 'g'), chr(1)) ELSE [text] END AS p FROM s WHERE trim(text) <> ''), t AS (SELECT video_id, pos, start, n, p[n + 1] AS sentence, length(p[n + 1]) AS size FROM (SELECT *, unnest(range(len(p))) AS n FROM p) WHERE trim(p[n + 1]) <> '') SELECT video_id, pos, CAST(n AS INTEGER) AS n, md5(sentence) AS h, round(CAST(start + 10.0 * coalesce(sum(size) OVER (PARTITION BY video_id, pos ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) / sum(size) OVER (PARTITION BY video_id, pos) AS DOUBLE), 6) AS begin FROM t")
def sentences_ru(spark, d):
    upper = "ABDEGIKLMNOPRSTUVZ"
    t = M.transcripts(spark, d).withColumn("text", F.translate("text", L.TEST_CYRILLIC[0] + upper, L.TEST_CYRILLIC[1] + L.TEST_CYRILLIC[1].upper()))
    return analysis.sentences_ru(t, ["video_id", "pos"]).select("video_id", "pos", "n", F.md5("sentence").alias("h"), "begin")


@query("educational_value_ru_i14", f"SELECT conv_id, turn, round(least(1 + len({words_sql('text')}) / 20.0, 4.0), 6) AS value FROM conversations")
def educational_value_ru(spark, d):
    return M.table(spark, d, "conversations").select("conv_id", "turn", F.round(T.educational_value_ru(F.col("text")), 6).alias("value"))


@query("normalised_segments_i8", "SELECT conv_id AS video_id, turn AS pos, turn * 10.0 AS start_time, turn * 10.0 + 10 AS end_time, length(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(replace(regexp_replace(text, '\\s+', ' ', 'g'), ' i ', ' I '), '([\\p{L}\\p{N}_])\\.([\\p{L}\\p{N}_])', '\\1. \\2', 'g'), '\\[[^\\]]*\\]:?', '', 'g'), '\\.{3,}', '...', 'g'), '\\s+([,.])', '\\1', 'g'), '^\\s+|\\s+$', '', 'g')) AS n FROM conversations WHERE trim(text) <> ''")
def normalised_segments(spark, d):
    out = analysis.normalised_segments(M.transcripts(spark, d))
    return out.select("video_id", "pos", "start_time", "end_time", F.length("text").cast("long").alias("n"))


_TEXTS = "f AS (SELECT conv_id AS video_id, string_agg(text, ' ' ORDER BY turn, text) AS text FROM conversations GROUP BY conv_id)"


@query("global_analysis_i4", f"WITH {_TEXTS} SELECT video_id, len({words_sql('text')}) AS words, len(list_filter(string_split_regex(text, '[.!?]+'), lambda s: trim(s) <> '')) AS sentences, CAST({count_sql('lower(text)', L.TEST_MARKERS[:3])} AS BIGINT) AS theoretical, CAST({count_sql('lower(text)', L.TEST_MARKERS[3:])} AS BIGINT) AS practical FROM f")
def global_analysis(spark, d):
    return analysis.global_counts(M.transcripts(spark, d), L.TEST_MARKERS[:3], L.TEST_MARKERS[3:])


@query("global_analysis_ru_i5", f"WITH {_TEXTS}, r AS (SELECT video_id, translate(lower(text), '{L.TEST_CYRILLIC[0]}', '{L.TEST_CYRILLIC[1]}') AS text FROM f) SELECT video_id, len(regexp_extract_all(text, '[а-яё]+')) AS words, greatest(1, len(regexp_extract_all(text, '[.!?]+'))) AS sentences, len(list_distinct(regexp_extract_all(text, '[а-яё]{{4,}}'))) AS key_terms FROM r")
def global_analysis_ru(spark, d):
    t = M.transcripts(spark, d).withColumn("text", F.translate(F.lower("text"), *L.TEST_CYRILLIC))
    return analysis.global_counts_ru(t)
