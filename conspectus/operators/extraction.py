"""Concepts in transcripts: matches, checks, scores, occurrences.

Segments: video_id, segment_id, pos, start_time, text, domain; catalogue: concept_id,
text, language, domain.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import lexicons as L
from ..functions import morphology as W
from ..functions import text as T
from . import matching


def significance(text: Column, concept: Column, value: Column, marked: Column) -> Column:
    """0 to 5 from the segment's value, markers, the concept's place and the length."""
    low, n = F.lower(text), F.size(T.words(text))
    at = F.instr(low, F.lower(concept))
    place = (at - 1) / F.greatest(F.lit(1), F.length(text) - F.length(concept))
    centrality = F.when(at > 0, 0.5 * (1 - 2 * F.abs(0.5 - place))).otherwise(0.0)
    length = F.when(n > 30, 0.8).when(n > 15, 0.4).otherwise(0.0)
    return F.least(0.8 * value + F.when(marked, 1.2).otherwise(0.0) + centrality + length, F.lit(5.0))


def significance_ru(text: Column) -> Column:
    n = F.size(T.words(text))
    return F.least(2.0 + F.when(n > 30, 1.0).when(n > 15, 0.5).otherwise(0.0), F.lit(4.0))


def variant_matches(segments: DataFrame, catalogue: DataFrame, longest: int = 4, least: int = 4) -> DataFrame:
    """segment_id, concept_id, matched and similarity 0.9: a form of the name stands in the text as whole words.

    Forms and the text's n-grams meet in a hash join: the work follows the text. Of a
    concept's forms the first in order stands for the match.
    """
    forms = catalogue.filter(F.length("text") >= least).select("concept_id", F.explode(W.variants(F.lower("text"))).alias("form"))
    keyed = forms.withColumn("term", F.trim(F.regexp_replace("form", r"[^\p{L}\p{N}]+", " ")))
    found = matching.contained(segments, "segment_id", keyed.select("term").distinct(), longest)
    met = found.join(keyed, "term").groupBy("segment_id", "concept_id").agg(F.min("form").alias("matched"))
    return met.withColumn("similarity", F.lit(0.9))


def sentence_matches(segments: DataFrame, catalogue: DataFrame) -> DataFrame:
    """Segments whose whole text is a concept's name (1.0) or a form of it (0.95)."""
    sentence = segments.select("segment_id", T.normalise_catalogue(F.col("text")).alias("query")).filter(F.length("query") <= 200)
    names = catalogue.select("concept_id", T.normalise_catalogue(F.col("text")).alias("text"))
    hits = matching.cascade(sentence.select("query").distinct(), names, fuzzy_too=False)
    return sentence.join(hits, "query").groupBy("segment_id", "concept_id").agg(F.max("similarity").alias("similarity"), F.min("query").alias("matched"))


def direct_matches(segments: DataFrame, catalogue: DataFrame, longest: int = 4) -> DataFrame:
    """The direct rule of Russian texts: a name as whole words, 0.95. Concepts count once in a segment."""
    names = catalogue.select("concept_id", F.trim(F.regexp_replace(F.lower("text"), r"[^\p{L}\p{N}]+", " ")).alias("term"))
    found = matching.contained(segments, "segment_id", names.select("term").distinct(), longest)
    return found.join(names, "term").groupBy("segment_id", "concept_id").agg(F.min("term").alias("matched")).withColumn("similarity", F.lit(0.95))


def matches(segments: DataFrame, catalogue: DataFrame) -> DataFrame:
    """Whole sentences first; segments without any, by the forms that stand in them."""
    whole = sentence_matches(segments, catalogue).select("segment_id", "concept_id", "matched", "similarity")
    rest = segments.join(whole.select("segment_id").distinct(), "segment_id", "left_anti")
    return whole.unionByName(variant_matches(rest, catalogue).select("segment_id", "concept_id", "matched", "similarity"))


def occurrences(segments: DataFrame, catalogue: DataFrame, found: DataFrame, markers: list[str], terms: dict[str, list[str]] | None = None, groups: dict[str, str] | None = None, russian: bool = False) -> DataFrame:
    """One occurrence of each match whose domain fits and whose text is in context.

    In physics, concepts of up to five characters need two terms of the domain in the text.
    """
    rows = found.join(segments, "segment_id").join(catalogue.select("concept_id", F.col("text").alias("concept"), F.col("domain").alias("concept_domain")), "concept_id")
    fits = T.compatible_domains(F.col("domain"), F.col("concept_domain"), groups)
    context = F.lit(True)
    if not russian:
        for name, words in (L.CONTEXT_TERMS if terms is None else terms).items():
            need = F.when((F.lit(name) == "physics") & (F.length("concept") <= 5), 2).otherwise(1)
            context = context & ((F.col("domain") != name) | F.col("domain").isNull() | T.in_context(F.col("text"), words, need))
    valid = rows.filter(fits & context)
    score = significance_ru(F.col("text")) if russian else significance(F.col("text"), F.col("matched"), T.educational_value(F.col("text"), markers), T.marked(F.col("text"), markers))
    scored = valid.withColumn("significance", F.round(score, 6))
    return scored.select("concept_id", "video_id", "segment_id", "start_time", "matched", "similarity", "significance", F.when(F.col("significance") >= 2.5, "comprehensive").otherwise("passing").alias("kind"))


def concepts_of(occ: DataFrame) -> DataFrame:
    """Each video's concepts: the highest significance, occurrences and whether it is explained."""
    by = occ.groupBy("video_id", "concept_id").agg(F.max("significance").alias("significance"), F.count("*").alias("occurrences"))
    return by.withColumn("is_educational", F.col("significance") >= 2.5)


def newest(catalogue: DataFrame, most: int | None, by: str = "created_at") -> DataFrame:
    """The newest concepts of each language up to ``most``; all of them by default."""
    from .reports import top_per_group

    return catalogue if most is None else top_per_group(catalogue, ["language"], [F.desc(by), "concept_id"], most)
