"""Concept matching: exact, variant and fuzzy lookup, and containment in text by n-grams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import lcs, morphology
from ..functions import text as T
from . import similarity
from .transcripts import ngrams


def contained(texts: DataFrame, key: str, terms: DataFrame, longest: int = 3) -> DataFrame:
    """key and term wherever the term's words stand in the text.

    Texts become distinct n-grams that are hash-joined with the terms: the work follows
    the text, never texts times terms.
    """
    # tokens get a column of their own: an expression that each n-gram names would be evaluated for each
    tokens = texts.select(key, T.words(F.regexp_replace(F.lower("text"), r"[^\p{L}\p{N}]+", " ")).alias("w"))
    grams = [F.col("w") if n == 1 else ngrams(F.col("w"), n) for n in range(1, longest + 1)]
    every = tokens.select(key, F.explode(F.array_distinct(F.concat(*grams) if longest > 1 else grams[0])).alias("term"))
    return every.join(terms.select("term").distinct(), "term").select(key, "term")


def cascade(wanted: DataFrame, concepts: DataFrame, threshold: float = 0.8, fuzzy_too: bool = True) -> DataFrame:
    """wanted (query), concepts (concept_id, text): exact matches and those of a variant; a query without any has its fuzzy ones."""
    exact = wanted.join(concepts, F.col("query") == F.col("text")).select("query", "concept_id", F.lit(1.0).alias("similarity"))
    left = wanted.select("query", F.explode(morphology.variants(F.col("query"))).alias("form"))
    right = concepts.select("concept_id", F.explode(morphology.variants(F.col("text"))).alias("form"))
    variant = left.join(right, "form").select("query", "concept_id").distinct().join(exact, ["query", "concept_id"], "left_anti").select("*", F.lit(0.95).alias("similarity"))
    found = exact.unionByName(variant)
    if not fuzzy_too:
        return found
    rest = wanted.select("query").distinct().join(found.select("query").distinct(), "query", "left_anti")
    near = fuzzy(rest, concepts.select(F.col("text").alias("name")).distinct(), threshold)
    return found.unionByName(near.join(concepts, F.col("name") == F.col("text")).select("query", "concept_id", F.col("ratio").alias("similarity")))


def fuzzy(wanted: DataFrame, names: DataFrame, threshold: float = 0.7) -> DataFrame:
    """Pairs of texts (query, name) whose indel ratio reaches the threshold.

    A prefix filter over characters proposes pairs, lengths and shared characters rule
    most of them out, and only what is left is compared.
    """
    pairs = similarity.ratio_pairs(wanted.select(F.col("query").alias("name")), names.select("name"), threshold)
    pairs = pairs.select(F.col("a").alias("query"), F.col("b").alias("name"))
    return pairs.withColumn("ratio", F.round(lcs.indel_ratio(F.col("query"), F.col("name")), 6)).filter(F.col("ratio") >= threshold)


def lookup(wanted: DataFrame, index: DataFrame) -> DataFrame:
    """query, concept_id: concepts of the query's language one of whose indexed forms equals it. index: concept_id, language, form."""
    return wanted.join(index, (F.col("query") == F.col("form")) & (F.col("asked") == F.col("language"))).select("query", "asked", "concept_id").distinct()
