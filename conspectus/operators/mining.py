"""Candidate concepts: n-gram weights, patterns, filters, scores, review states.

A candidate is a row of candidate_id, text, method, score, video_id, segments (array),
language, domain, status.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import lexicons as L
from ..functions import text as T
from . import transcripts
from .lineage import cut


def term_grams(segments: DataFrame, keys: list[str], stopwords: list[str] | None = None) -> DataFrame:
    """keys and term: words that are no stopwords, and runs of two and three that neither begin nor end with one. keys name one segment."""
    words = segments.select(*keys, F.posexplode(F.regexp_extract_all(F.lower("text"), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))).alias("pos", "one"))
    w = Window.partitionBy(*keys).orderBy("pos")
    runs = words.withColumns({"two": F.lead("one", 1).over(w), "three": F.lead("one", 2).over(w)})
    stop = stopwords or L.STOPWORDS["en"]
    plain = lambda c: F.col(c).isNotNull() & ~F.col(c).isin(*stop)
    joined = lambda *cs: F.concat_ws(" ", *cs)
    grams = F.array(F.when(plain("one"), F.col("one")), F.when(plain("one") & plain("two"), joined("one", "two")), F.when(plain("one") & plain("three"), joined("one", "two", "three")))
    return runs.select(*keys, F.explode(F.array_compact(grams)).alias("term"))


def weighted_terms(segments: DataFrame, keys: list[str], segment: str, stopwords: list[str] | None = None, features: int = 1000, most: int = 50, least_df: int = 2, share: float = 0.95, scale: float = 3.0) -> DataFrame:
    """keys, term, score and rank: the terms of the highest mean weight in each corpus (keys) of segments.

    Terms stand in ``least_df`` segments at least and in ``share`` of them at most; of these
    the ``features`` most frequent count. Weights are frequency times the smoothed inverse
    segment frequency, each segment scaled to unit length.
    """
    total = segments.groupBy(*keys).agg(F.count("*").alias("total"))
    tf = cut(term_grams(segments, [*keys, segment], stopwords).groupBy(*keys, segment, "term").agg(F.count("*").alias("tf")))
    df = tf.groupBy(*keys, "term").agg(F.count("*").alias("df"), F.sum("tf").alias("all")).join(total, keys)
    used = df.filter((F.col("df") >= least_df) & (F.col("df") <= share * F.col("total")))
    used = used.withColumn("n", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("all"), "term"))).filter(F.col("n") <= features)
    weighed = tf.join(used.select(*keys, "term", "df", "total"), [*keys, "term"]).withColumn("w", F.col("tf") * (F.log((1.0 + F.col("total")) / (1.0 + F.col("df"))) + 1))
    norms = weighed.groupBy(*keys, segment).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    mean = weighed.join(norms, [*keys, segment]).groupBy(*keys, "term").agg(F.round(scale * F.sum(F.col("w") / F.col("norm")) / F.first("total"), 6).alias("score"))
    w = Window.partitionBy(*keys).orderBy(F.desc("score"), "term")
    return mean.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= most)


def pattern_terms(segments: DataFrame, keys: list[str], patterns: list[str] | None = None, stopwords: list[str] | None = None) -> DataFrame:
    """keys and text of the first group of every match of every pattern, three characters or longer and not of stopwords alone."""
    found = F.concat(*[F.regexp_extract_all("text", F.lit(p), F.lit(1)) for p in (patterns or L.CANDIDATE_PATTERNS["en"])])
    stop = F.array(*map(F.lit, stopwords or L.STOPWORDS["en"]))
    each = segments.select(*keys, F.explode(found).alias("text")).withColumn("text", F.trim("text"))
    real = F.size(F.filter(T.words(F.col("text")), lambda w: ~F.array_contains(stop, F.lower(w)))) > 0
    return each.filter((F.length("text") >= 3) & real)


def candidate_score(text: Column, method: Column, base: Column, key_terms: Column) -> Column:
    """A candidate's score from its method, words, capital and the key terms that it holds or stands in."""
    methods = F.create_map(*[F.lit(x) for pair in L.METHOD_SCORES.items() for x in pair])
    n, low = F.size(T.words(text)), F.lower(text)
    words = F.when(n == 1, 0.5).when(n == 2, 1.0).when(n == 3, 0.8).otherwise(0.3)
    first = F.substring(text, 1, 1)
    capital = F.when((first != F.lower(first)) & (text != F.upper(text)), 0.5).otherwise(0.0)
    near = F.exists(key_terms, lambda t: F.contains(low, F.lower(t)) | F.contains(F.lower(t), low))
    return base + F.coalesce(F.try_element_at(methods, method), F.lit(0.0)) + words + capital + F.when(F.coalesce(near, F.lit(False)), 1.0).otherwise(0.0)


def existing_texts(representations: DataFrame, candidates: DataFrame) -> DataFrame:
    """Normalised texts of the catalogue and of candidates that are not rejected."""
    known = representations.select(T.collapse(F.col("text")).alias("known"))
    return known.union(candidates.filter("status <> 'rejected'").select(T.collapse(F.col("text")))).distinct()


def new_candidates(found: DataFrame, existing: DataFrame, key_terms: DataFrame, most: int = 30) -> DataFrame:
    """The best of each video's findings that are not known yet, each text once, scored and ranked.

    found: video_id, text, method, base, domain, seq (their order), segment; key_terms: video_id, terms (array).
    """
    valid = found.filter(T.valid_candidate(F.col("text"), F.col("domain"))).withColumn("form", T.collapse(F.col("text")))
    fresh = valid.join(existing.select(F.col("known").alias("form")), "form", "left_anti")
    once = fresh.groupBy("video_id", "form").agg(F.min_by(F.struct("text", "method", "base", "domain"), "seq").alias("c"), F.array_sort(F.collect_set("segment")).alias("segments"))
    rows = once.select("video_id", "form", "c.*", "segments").join(key_terms, "video_id", "left")
    none = F.expr("cast(array() as array<string>)")
    scored = rows.withColumn("score", F.round(candidate_score(F.col("text"), F.col("method"), F.col("base"), F.coalesce("terms", none)), 6))
    ranked = scored.withColumn("rank", F.row_number().over(Window.partitionBy("video_id").orderBy(F.desc("score"), "form"))).filter(F.col("rank") <= most)
    return ranked.select(F.md5(F.concat_ws(":", F.col("video_id").cast("string"), "form")).alias("candidate_id"), "video_id", F.col("form").alias("text"), "method", "score", "domain", "segments", "rank", F.lit("pending").alias("status"))


def list_page(candidates: DataFrame, status: str | None, page: int, size: int) -> DataFrame:
    """A page of the candidates of a status (or all), the highest score first."""
    rows = candidates if status is None else candidates.filter(F.col("status") == status)
    return rows.orderBy(F.desc("score"), "candidate_id").offset((page - 1) * size).limit(size)


def set_status(candidates: DataFrame, changes: DataFrame) -> DataFrame:
    """Candidates with the status (and reason) of ``changes``: candidate_id, to, reason; only pending, approved and rejected are taken."""
    valid = changes.filter(F.col("to").isin("pending", "approved", "rejected"))
    joined = candidates.join(valid, "candidate_id", "left")
    return joined.withColumns({"status": F.coalesce("to", "status"), "rejection_reason": F.when(F.col("to") == "rejected", F.col("reason"))}).drop("to", "reason")


def edit(candidates: DataFrame, changes: DataFrame) -> DataFrame:
    """Candidates with the text (in lower case) and domain of ``changes``: candidate_id, new_text, new_domain (null: as before)."""
    joined = candidates.join(changes, "candidate_id", "left")
    return joined.withColumns({"text": F.coalesce(F.lower("new_text"), "text"), "domain": F.coalesce("new_domain", "domain")}).drop("new_text", "new_domain")


def approved_concepts(candidates: DataFrame) -> DataFrame:
    """Concepts of the approved candidates, as rows of the catalogue."""
    ok = candidates.filter("status = 'approved'")
    none = F.expr("cast(array() as array<string>)")
    texts = F.create_map(F.col("language"), F.array(F.lower("text")))
    return ok.select(F.coalesce("concept_id", F.md5(F.concat_ws(":", "language", F.lower("text")))).alias("concept_id"), texts.alias("representations"), none.alias("prerequisites"), none.alias("related"), F.create_map(F.lit("domain"), F.col("domain")).alias("metadata"), T.domain_category(F.col("domain")).alias("category"))


def candidate_occurrences(candidates: DataFrame, segments: DataFrame) -> DataFrame:
    """Occurrences of approved candidates in their segments (segment_id, start_time): the score up to 4 is their significance."""
    ok = candidates.filter("status = 'approved'")
    each = ok.select(F.coalesce("concept_id", F.md5(F.concat_ws(":", "language", F.lower("text")))).alias("concept_id"), "video_id", "score", F.explode("segments").alias("segment_id"))
    significance = F.least("score", F.lit(4.0))
    found = each.join(segments.select("segment_id", "start_time"), "segment_id")
    return found.select("concept_id", "video_id", "segment_id", "start_time", significance.alias("significance"), F.when(significance >= 2.5, "comprehensive").otherwise("passing").alias("kind"), F.lit(1.0).alias("similarity"))


def key_terms(segments: DataFrame, n: int = 20) -> DataFrame:
    """video_id and its most frequent terms, as an array."""
    from .reports import top_per_group

    by = transcripts.frequencies(transcripts.terms(transcripts.full_text(segments), ["video_id"]), ["video_id"])
    top = top_per_group(by, ["video_id"], [F.desc("n"), "first"], n)
    return top.groupBy("video_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "term"))), lambda x: x["term"]).alias("terms"))
