"""Transcript analytics: segments, timed sentences, term frequencies, scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from .lineage import cut


def captions(pages: DataFrame, tag: str, key: str = "page_id", source: str = "html") -> DataFrame:
    """key, pos and text of each element of one kind, entities unescaped."""
    inner = F.transform(F.regexp_extract_all(source, F.lit(f"<{tag}[^>]*>([^<]*)</{tag}>"), F.lit(1)), unescape)
    return pages.select(key, F.posexplode(inner).alias("pos", "text")).filter(F.trim("text") != "")


def unescape(c: Column) -> Column:
    for a, b in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def full_text(segments: DataFrame) -> DataFrame:
    """One text per video, segments in order."""
    parts = F.array_sort(F.collect_list(F.struct("pos", "text")))
    return segments.groupBy("video_id").agg(F.array_join(F.transform(parts, lambda x: x["text"]), " ").alias("text"))


def sentences(segments: DataFrame, keys: list[str]) -> DataFrame:
    """Sentences with the segment's time shared out by characters."""
    return timed(segments, keys, F.split("text", r"(?<=[.!?])\s+"))


def timed(segments: DataFrame, keys: list[str], parts: Column) -> DataFrame:
    """keys, n, sentence, begin and finish for the parts of each segment that has text."""
    split = segments.filter(F.trim("text") != "").select(*keys, "start", "duration", F.posexplode(parts).alias("n", "sentence"))
    split = split.filter(F.trim("sentence") != "").withColumn("size", F.length("sentence"))
    w = Window.partitionBy(*keys)
    before = F.coalesce(F.sum("size").over(w.orderBy("n").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    total = F.sum("size").over(w)
    begin = F.col("start") + F.col("duration") * before / total
    finish = F.col("start") + F.col("duration") * (before + F.col("size")) / total
    return split.select(*keys, "n", "sentence", F.round(begin, 6).alias("begin"), F.round(finish, 6).alias("finish"))


def terms(docs: DataFrame, keys: list[str], least: int = 4) -> DataFrame:
    """keys, pos and term: lower-case runs of letters."""
    found = F.regexp_extract_all(F.lower("text"), F.lit(rf"\p{{L}}{{{least},}}"), F.lit(0))
    return docs.select(*keys, F.posexplode(found).alias("pos", "term"))


def frequencies(found: DataFrame, keys: list[str]) -> DataFrame:
    return found.groupBy(*keys, "term").agg(F.count("*").alias("n"), F.min("pos").alias("first"))


def catalogue(docs: DataFrame, n: int) -> DataFrame:
    """The n most frequent terms of each language: a catalogue made from the corpus. Counting precedes ranking."""
    by = terms(docs, ["lang"]).groupBy("lang", "term").agg(F.count("*").alias("n"))
    w = Window.partitionBy("lang").orderBy(F.desc("n"), "term")
    return by.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)


def tfidf(found: DataFrame, key: str, total: int, least_df: int = 2) -> DataFrame:
    """Mean weight of each term: smooth inverse document frequency, rows scaled to unit length."""
    tf = cut(found.groupBy(key, "term").agg(F.count("*").alias("tf")))  # three reads of it follow
    df = tf.groupBy("term").agg(F.count("*").alias("df")).filter(F.col("df") >= least_df)
    weighed = tf.join(df, "term").withColumn("w", F.col("tf") * (F.log((F.lit(1.0) + total) / (1.0 + F.col("df"))) + 1))
    norms = weighed.groupBy(key).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    return weighed.join(norms, key).groupBy("term").agg((F.sum(F.col("w") / F.col("norm")) / total).alias("score"))


def ngrams(tokens: Column, n: int) -> Column:
    """All runs of n tokens, joined by spaces; none of a shorter text."""
    starts = F.sequence(F.lit(1), F.size(tokens) - n + 1)
    return F.when(F.size(tokens) >= n, F.transform(starts, lambda i: F.array_join(F.slice(tokens, i, n), " "))).otherwise(F.array())
