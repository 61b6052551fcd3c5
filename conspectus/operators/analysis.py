"""Analysis of whole transcripts and names: counts, Russian sentences, nearest domains, translation, form index."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import morphology as W
from ..functions import text as T
from . import transcripts


def normalised_segments(segments: DataFrame, russian: bool = False) -> DataFrame:
    """Segments with text, normalised, and their end; blank ones are left out."""
    form = T.normalise_russian if russian else T.normalise_transcript
    some = segments.filter(F.trim("text") != "")
    return some.select("video_id", "pos", F.col("start").alias("start_time"), (F.col("start") + F.col("duration")).alias("end_time"), form(F.col("text")).alias("text"))


def global_counts(segments: DataFrame, theoretical: list[str], practical: list[str]) -> DataFrame:
    """Per video: words, sentences, and indicators of either kind in the whole text."""
    full = transcripts.full_text(segments)
    low = F.lower("text")
    count = lambda ws: sum((T.count_of(low, w) for w in ws), F.lit(0)).cast("long")
    sentences = F.size(F.filter(F.split("text", "[.!?]+"), lambda s: F.trim(s) != ""))
    return full.select("video_id", F.size(T.words(F.col("text"))).cast("long").alias("words"), sentences.cast("long").alias("sentences"), count(theoretical).alias("theoretical"), count(practical).alias("practical"))


def global_counts_ru(segments: DataFrame, least: int = 4) -> DataFrame:
    """Per video: Cyrillic words, sentences (one at least) and distinct key terms."""
    full = transcripts.full_text(segments).withColumn("text", F.lower("text"))
    terms = F.array_distinct(F.regexp_extract_all("text", F.lit(f"[а-яё]{{{least},}}"), F.lit(0)))
    sentences = F.greatest(F.regexp_count("text", F.lit("[.!?]+")), F.lit(1))
    return full.select("video_id", F.regexp_count("text", F.lit("[а-яё]+")).cast("long").alias("words"), sentences.cast("long").alias("sentences"), F.size(terms).cast("long").alias("key_terms"))


def sentences_ru(segments: DataFrame, keys: list[str], least: int = 50) -> DataFrame:
    """Sentences of longer segments, parted only before a capital; times are shared out by characters."""
    whole = (F.length("text") <= least) | ~F.col("text").rlike("[.!?]")
    parts = F.when(whole, F.array("text")).otherwise(F.split("text", r"(?<=[.!?…])\s+(?=[А-ЯЁ])"))
    return transcripts.timed(segments, keys, parts)


def nearest_centroid(vectors: DataFrame, key: str, least: float = 0.1) -> DataFrame:
    """key, domain and score: the domain whose mean vector is nearest by cosine; null below ``least``.

    vectors: key, vector, domain (null where unknown). Centroids are one short row per
    domain; each vector meets them as an array.
    """
    place = vectors.filter("domain is not null").select("domain", F.posexplode("vector").alias("i", "x"))
    means = place.groupBy("domain", "i").agg(F.avg("x").alias("m"))
    centre = means.groupBy("domain").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda s: s["m"]).alias("c"))
    every = centre.agg(F.collect_list(F.struct("domain", "c")).alias("all"))
    norm = lambda v: F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    dot = lambda a, b: F.aggregate(F.arrays_zip(a.alias("a"), b.alias("b")), F.lit(0.0), lambda s, p: s + p["a"].cast("double") * p["b"])
    joined = vectors.select(key, "vector").crossJoin(F.broadcast(every))  # one row
    scored = F.transform("all", lambda c: F.struct(F.round(dot(F.col("vector"), c["c"]) / norm(F.col("vector")) / norm(c["c"]), 6).alias("score"), (-c["domain"]).alias("n")))
    best = joined.select(key, F.array_max(scored).alias("best"))
    return best.select(key, F.when(F.col("best.score") > least, -F.col("best.n")).alias("domain"), F.col("best.score").alias("score"))


def translate(names: DataFrame, column: str, dictionary: DataFrame) -> DataFrame:
    """Add ``translated``: a dictionary's entry (text, translation), else the transliteration in lower case."""
    low = names.withColumn("text", F.lower(column))
    found = low.join(dictionary.select(F.lower("text").alias("text"), "translation").dropDuplicates(["text"]), "text", "left")
    return found.withColumn("translated", F.coalesce("translation", F.lower(T.transliterate(F.col("text"))))).drop("text", "translation")


def variant_index(names: DataFrame) -> DataFrame:
    """concept_id, language and form for every form of every name, normalised and once. names: concept_id, text, language."""
    forms = F.when(F.col("language") == "ru", W.catalogue_variants(F.col("text"), "ru")).otherwise(W.catalogue_variants(F.col("text")))
    return names.select("concept_id", "language", F.explode(F.transform(forms, T.collapse)).alias("form")).distinct()
