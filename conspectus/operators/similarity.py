"""Candidate pairs for subsequence similarities, without comparing all texts.

A common subsequence takes its characters from both texts, so two texts that share one
of length n share n characters, counted with repeats. Characters numbered by repeat
("e1", "e2", ...) make that a set overlap, and a prefix filter finds all pairs with
such an overlap: of a text's characters, rarest first, only so many need an index
entry that the rest is too few for the overlap.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def characters(c: Column) -> Column:
    """The characters of a text, each with the number of its repeat."""
    at = lambda i: F.substring(c, i, F.lit(1))
    repeat = lambda i: F.length(F.substring(c, F.lit(1), i)) - F.length(F.replace(F.substring(c, F.lit(1), i), at(i), F.lit("")))
    return F.when(F.length(c) == 0, F.array().cast("array<string>")).otherwise(F.transform(F.sequence(F.lit(1), F.length(c)), lambda i: F.concat(at(i), F.lit("\u0001"), repeat(i).cast("string"))))


def indexed(names: DataFrame, kept: Column) -> DataFrame:
    """block, name and token of the ``kept`` rarest characters of each name. names: block, name; kept: an expression over them."""
    each = names.select("block", "name", kept.alias("kept"), F.explode(characters(F.col("name"))).alias("token"))
    rare = each.groupBy("token").agg(F.count("*").alias("df"))  # a few entries for each letter of the alphabet
    placed = each.join(rare, "token").withColumn("n", F.row_number().over(Window.partitionBy("block", "name").orderBy("df", "token")))
    return placed.filter("n <= kept").select("block", "name", "token")


def overlap_pairs(names: DataFrame, threshold: float) -> DataFrame:
    """block, a and b (the shorter and the longer; of equal length the lesser first) that may share ``threshold`` of a's characters in order."""
    n = F.length("name")
    short = indexed(names, n - F.ceil(n * threshold - 1e-9).cast("int") + 1).withColumnRenamed("name", "a")
    whole = names.select("block", F.col("name").alias("b"), F.explode(characters(F.col("name"))).alias("token"))
    later = (F.length("a") < F.length("b")) | ((F.length("a") == F.length("b")) & (F.col("a") < F.col("b")))
    pairs = short.join(whole, ["block", "token"]).filter(later).select("block", "a", "b").distinct()
    return pairs.filter(_shared() >= F.ceil(F.length("a") * threshold - 1e-9))


def ratio_pairs(left: DataFrame, right: DataFrame, threshold: float) -> DataFrame:
    """a of left and b of right (both: name) whose doubled common characters may reach ``threshold`` of both lengths."""
    kept = F.length("name") - F.ceil(F.length("name") * threshold / (2 - threshold) - 1e-9).cast("int") + 1
    both = left.select(F.lit(0).alias("block"), "name").unionByName(right.select(F.lit(1).alias("block"), "name"))
    index = indexed(both.distinct(), kept)
    one, two = index.filter("block = 0").select("token", F.col("name").alias("a")), index.filter("block = 1").select("token", F.col("name").alias("b"))
    x, y = F.length("a"), F.length("b")
    near = (x * (2 - threshold) + 1e-9 >= y * threshold) & (y * (2 - threshold) + 1e-9 >= x * threshold)
    pairs = one.join(two, "token").filter(near).select("a", "b").distinct()
    return pairs.filter(2 * _shared() + 1e-9 >= threshold * (x + y))


def _shared() -> Column:
    return F.size(F.array_intersect(characters(F.col("a")), characters(F.col("b"))))
