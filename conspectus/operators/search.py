"""Phrase search over stored postings, with filters, ranking, paging, synonyms, facets and suggestions.

A posting is a token of an indexed row with its place. A phrase is found by joining
each of its tokens with the postings and counting, for each start, how many of them
stand in their place: the work follows the tokens' postings, not the texts. Many
queries run at once; query_id is a key throughout.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import lexicons as L

_FROM, _TO = "àáâäãåçèéêëìíîïñòóôöõùúûüýÿ", "aaaaaaceeeeiiiinooooouuuuyy"


def tokens(c: Column) -> Column:
    """Lower-case runs of letters and digits, without accents."""
    return F.regexp_extract_all(F.translate(F.lower(c), _FROM, _TO), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def postings(index: DataFrame) -> DataFrame:
    """token, id and place of every token. index: id, text. Store the result, by token, to search it often."""
    return index.select("id", F.posexplode(tokens(F.col("text"))).alias("place", "token")).select("token", "id", "place")


def phrase_hits(posted: DataFrame, phrases: DataFrame) -> DataFrame:
    """query_id, phrase and id of every row that holds the phrase. phrases: query_id, phrase. A phrase without tokens finds nothing."""
    asked = phrases.select("query_id", "phrase", tokens(F.col("phrase")).alias("ts"))
    each = asked.select("query_id", "phrase", F.size("ts").alias("n"), F.posexplode("ts").alias("k", "token"))
    met = posted.join(each, "token").select("query_id", "phrase", "n", "id", (F.col("place") - F.col("k")).alias("start"))
    whole = met.groupBy("query_id", "phrase", "id", "start").agg(F.count("*").alias("found"), F.first("n").alias("n")).filter("found = n")
    return whole.select("query_id", "phrase", "id").distinct()


def search(index: DataFrame, posted: DataFrame, phrases: DataFrame, videos: DataFrame, language: str | None = None, least: float | None = None, types: list[str] | None = None, limit: int = 20) -> DataFrame:
    """The hits of each query that pass the filters, the most significant first, up to ``limit`` of each.

    index: id, text, language, item_type, video_id, significance; videos: video_id, title. Hits
    of videos that are not stored are left out.
    """
    rows = index
    if language is not None:
        rows = rows.filter(F.col("language") == language)
    if least is not None:
        rows = rows.filter(F.col("significance") >= least)
    if types is not None:
        rows = rows.filter(F.col("item_type").isin(types))
    hits = phrase_hits(posted, phrases).select("query_id", "id").distinct()
    found = hits.join(rows, "id").join(videos.select("video_id", "title"), "video_id")
    w = Window.partitionBy("query_id").orderBy(F.desc("significance"), "id")
    return found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= limit)


def details(hits: DataFrame, concepts: DataFrame, segments: DataFrame, occurrences: DataFrame) -> DataFrame:
    """Hits with the details of their kind: a concept's text, a segment's start, an occurrence's start and concept.

    concepts: concept_id, text; segments: segment_id, start_time; occurrences: occurrence_id, concept_id, start_time.
    """
    of = lambda kind, c: F.when(F.col("item_type") == kind, F.col(c))
    keyed = hits.withColumns({"s": of("segment", "id"), "o": of("occurrence", "id")})
    keyed = keyed.join(segments.select(F.col("segment_id").alias("s"), F.col("start_time").alias("segment_start")), "s", "left")
    keyed = keyed.join(occurrences.select(F.col("occurrence_id").alias("o"), F.col("concept_id").alias("oc"), F.col("start_time").alias("occurrence_start")), "o", "left")
    keyed = keyed.withColumn("concept_id", F.coalesce("oc", of("concept", "id")))
    named = keyed.join(concepts.select("concept_id", F.col("text").alias("concept")), "concept_id", "left")
    return named.select("query_id", "rank", "id", "item_type", "concept_id", "concept", F.coalesce("segment_start", "occurrence_start").alias("start_time"))


def synonym_phrases(queries: DataFrame, synonyms: DataFrame) -> DataFrame:
    """query_id and phrase: the query with each word, in turn, replaced by each of its synonyms, and as it is. synonyms: word, synonym."""
    own = queries.select("query_id", F.lower("phrase").alias("phrase"))
    word = own.select("query_id", "phrase", F.posexplode(F.split("phrase", " ")).alias("k", "word"))
    put = word.join(synonyms, "word").select("query_id", F.array_join(F.transform(F.split("phrase", " "), lambda w, i: F.when(i == F.col("k"), F.col("synonym")).otherwise(w)), " ").alias("phrase"))
    return own.unionByName(put).distinct()


def synonym_table(spark, domain: str, synonyms: dict[str, dict[str, list[str]]] | None = None) -> DataFrame:
    rows = [(w, s) for w, others in (synonyms or L.SYNONYMS).get(domain, {}).items() for s in others]
    return spark.createDataFrame(rows, "word string, synonym string")


def relevance(title_hit: Column, exact: Column, partial: Column, ratio: Column, preferred: float | None, is_concept: Column, weight: Column, language_hit: Column, digits: int = 2) -> Column:
    w = L.RANKING
    fit = F.lit(0.0) if preferred is None else 1 - F.abs(F.lit(preferred) - ratio)
    score = (
        1 + w["exact_match"] * exact + w["partial_match"] * partial + F.when(title_hit, w["title_match"]).otherwise(0.0) + fit
        + F.when(is_concept, w["concept"]).otherwise(w["segment"]) + F.when(language_hit, w["language"]).otherwise(0.0)
        + F.when(weight > 2.5, w["educational"]).otherwise(0.0) + w["educational_weight"] * F.least(weight, F.lit(5.0))
    )
    return F.round(score, digits)


def ranked(hits: DataFrame, queries: DataFrame, preferred: float | None = None, language: str | None = None) -> DataFrame:
    """Hits with their score and place. hits: query_id, id, text, title, language, item_type, ratio, significance; queries: query_id, phrase.

    A query's distinct words count as exact where they stand between spaces, else as partial
    where they stand at all. Equal scores keep the order of ids.
    """
    terms = F.array_distinct(F.regexp_extract_all(F.lower("phrase"), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0)))
    known = hits.join(queries.select("query_id", terms.alias("terms")), "query_id")
    low, padded = F.lower("text"), F.concat(F.lit(" "), F.lower("text"), F.lit(" "))
    count = lambda test: F.size(F.filter("terms", test))
    exact = count(lambda t: F.contains(padded, F.concat(F.lit(" "), t, F.lit(" "))))
    any_ = count(lambda t: F.contains(low, t))
    title = F.exists("terms", lambda t: F.contains(F.lower("title"), t))
    fits = F.lit(False) if language is None else F.col("language") == language
    scored = known.withColumn("score", relevance(title, exact, any_ - exact, F.col("ratio"), preferred, F.col("item_type") == "concept", F.col("significance"), fits)).drop("terms")
    return scored.withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id")))


def canonical_hits(hits: DataFrame, roots: DataFrame) -> DataFrame:
    """query_id, root, score, place and variants: concept hits as their root, each root and each text once.

    hits: query_id, concept_id, text, language, score, place; roots: concept_id, root, root_text. The
    first hit by place stands for a root, with the best score of all and the texts of its
    variants; of roots with one text and language the first stays.
    """
    known = hits.join(roots, "concept_id")
    by = known.groupBy("query_id", "root").agg(
        F.min("place").alias("first"), F.max("score").alias("score"), F.min_by("root_text", "place").alias("text"), F.min_by("language", "place").alias("language"),
        F.array_sort(F.collect_set(F.when(F.col("concept_id") != F.col("root"), F.col("text")))).alias("variants"),
    )
    once = by.withColumn("n", F.row_number().over(Window.partitionBy("query_id", F.lower("text"), "language").orderBy("first"))).filter("n = 1")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "first"))
    return once.select("query_id", "root", "text", "score", F.array_join("variants", ",").alias("variants"), place.alias("place"))


def facets(hits: DataFrame) -> DataFrame:
    """Of each query's hits (domain, language, is_educational, video_id, concept_id): counts by value, distinct videos and concepts."""
    kind = F.when(F.col("is_educational"), "educational").otherwise("passing")
    cell = lambda name, value: F.struct(F.lit(name).alias("facet"), value.alias("value"))
    cells = F.explode(F.array(cell("domain", F.col("domain")), cell("language", F.col("language")), cell("kind", kind)))
    counts = hits.select("query_id", cells.alias("c")).groupBy("query_id", "c.facet", "c.value").agg(F.count("*").alias("n"))
    totals = hits.groupBy("query_id").agg(F.countDistinct("video_id").alias("videos"), F.countDistinct("concept_id").alias("concepts"))
    both = F.explode(F.array(*[F.struct(F.lit(f"distinct {c}").alias("facet"), F.lit("").alias("value"), F.col(c).alias("n")) for c in ("videos", "concepts")]))
    return counts.unionByName(totals.select("query_id", both.alias("x")).select("query_id", "x.*"))


def suggestions(hits: DataFrame, queries: DataFrame, domain: str | None = None, language: str | None = None, ratio: float | None = None, most: int = 3, theory: list[str] | None = None, practice: list[str] | None = None) -> DataFrame:
    """query_id, rank, kind and value of up to three hints for each query of three characters or more.

    In order: a domain each, if there are several and none is set; theory or practice, if the
    query asks for it; explanations, if they are fewer than mentions; a learning path, from
    six hits with a concept on; another language.
    """
    low = F.lower("phrase")
    has = lambda words: F.exists(F.array(*map(F.lit, words)), lambda w: F.contains(low, w))
    concept = F.col("item_type") == "concept"
    taught = F.col("is_educational") & concept
    by = hits.groupBy("query_id").agg(
        F.array_sort(F.collect_set("domain")).alias("domains"), F.count_if(taught).alias("taught"), F.count_if(concept & ~F.col("is_educational")).alias("mentioned"), F.count("*").alias("n"),
        F.count_if(concept).alias("concepts"), F.count_if(F.col("language") == "en").alias("en"), F.count_if(F.col("language") == "ru").alias("ru"),
    )
    known = queries.filter(F.length("phrase") >= 3).join(by, "query_id", "left")
    none = F.expr("cast(array() as array<struct<kind:string,value:string>>)")
    one = lambda kind, value: F.array(F.struct(F.lit(kind).alias("kind"), value.alias("value")))
    when = lambda test, hint: F.when(F.coalesce(test, F.lit(False)), hint).otherwise(none)
    several = F.transform(F.filter("domains", lambda x: x != "unknown"), lambda x: F.struct(F.lit("domain_filter").alias("kind"), x.alias("value")))
    speech = F.lit("en") if language != "en" else F.lit(None)
    english = when((F.col("en") > 0) & speech.isNotNull(), one("language", F.lit("en")))
    russian = when((F.col("ru") > 0) & F.lit(language != "ru") & ~F.coalesce((F.col("en") > 0) & speech.isNotNull(), F.lit(False)), one("language", F.lit("ru")))
    every = F.concat(
        when((F.size("domains") > 1) & F.lit(domain is None), several),
        when(has(theory or L.THEORY_WORDS) & F.lit(ratio != 0.8), one("theory_focus", F.lit("0.8"))),
        when(has(practice or L.PRACTICE_WORDS) & F.lit(ratio != 0.2), one("practice_focus", F.lit("0.2"))),
        when((F.col("taught") > 0) & (F.col("mentioned") > 0) & (F.col("taught") < F.col("mentioned")), one("educational_focus", F.lit("educational"))),
        when((F.col("n") > 5) & (F.col("concepts") > 0), one("learning_path", F.col("phrase"))),
        english, russian,
    )
    return known.select("query_id", F.posexplode(F.slice(every, 1, most)).alias("k", "s")).select("query_id", (F.col("k") + 1).alias("rank"), "s.kind", "s.value")


def related(query_concepts: DataFrame, occ: DataFrame, concepts: DataFrame, n: int = 10) -> DataFrame:
    """The related concepts of some concepts (concept_id): those that share most videos, then those of the domain; n of each at most."""
    own = occ.join(query_concepts.select("concept_id").distinct(), "concept_id", "left_semi").select("concept_id", "video_id").distinct()
    others = occ.select("video_id", F.col("concept_id").alias("other_id")).distinct()
    shared = own.join(others, "video_id").filter("concept_id <> other_id").groupBy("concept_id", "other_id").agg(F.count("*").alias("shared"))
    roots = concepts.filter("canonical is null")
    near = shared.join(roots.select(F.col("concept_id").alias("other_id")), "other_id", "left_semi").withColumn("kind", F.lit(0))
    heads = roots.withColumn("n", F.row_number().over(Window.partitionBy("domain").orderBy("concept_id"))).filter(F.col("n") <= n + 1)
    alike = concepts.join(query_concepts, "concept_id", "left_semi").select("concept_id", "domain").join(heads.select("domain", F.col("concept_id").alias("other_id")), "domain")
    alike = alike.filter("concept_id <> other_id").select("concept_id", "other_id", F.lit(0).cast("long").alias("shared"), F.lit(1).alias("kind"))
    first = lambda df: df.withColumn("r", F.row_number().over(Window.partitionBy("concept_id").orderBy(F.desc("shared"), "other_id"))).filter(F.col("r") <= n).drop("r")
    every = first(near).unionByName(first(alike)).groupBy("concept_id", "other_id").agg(F.max("shared").alias("shared"), F.min("kind").alias("kind"))
    w = Window.partitionBy("concept_id").orderBy(F.desc("shared"), "kind", "other_id")
    return every.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)
