"""Registration of queries beside their SQL, and pieces of SQL that several share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import lexicons as L
from ..sources import model as M


def registry() -> tuple[dict[str, Callable], dict[str, str], Callable]:
    queries: dict[str, Callable] = {}
    sql: dict[str, str] = {}

    def query(name: str, text: str = ""):
        def add(f):
            queries[name] = f
            sql[name] = text
            return f

        return add

    return queries, sql, query


def count_sql(column: str, words: list[str]) -> str:
    return " + ".join(f"(length({column}) - length(replace({column}, '{w}', ''))) // {len(w)}" for w in words)


def has_sql(column: str, words: list[str]) -> str:
    return " + ".join(f"CAST(contains({column}, '{w}') AS INTEGER)" for w in words)


def words_sql(column: str) -> str:
    return rf"list_filter(regexp_split_to_array({column}, '\s+'), lambda w: w <> '')"


def listed(words: list[str]) -> str:
    return ", ".join(f"'{w}'" for w in words)


#: Names with fillers, digits, bare words and noise; and the same as Russian names with common endings.
NAMES_SQL = (
    "names AS (SELECT p_partkey AS id, CASE p_partkey % 6 WHEN 0 THEN 'The  ' || p_name WHEN 1 THEN p_name || ' 12345678901' WHEN 2 THEN 'Of' "
    "WHEN 3 THEN 'this so-called ' || p_name WHEN 4 THEN 'two-part ' || p_name ELSE 'this case' END AS name, p_type AS domain FROM part)"
)
NAMES_RU_SQL = (
    f"names AS (SELECT p_partkey AS id, CASE p_partkey % 3 WHEN 0 THEN split_part(translate(p_name, '{L.TEST_CYRILLIC[0]}', '{L.TEST_CYRILLIC[1]}'), ' ', 1) "
    f"ELSE translate(p_name, '{L.TEST_CYRILLIC[0]}', '{L.TEST_CYRILLIC[1]}') END || "
    "CASE p_partkey % 7 WHEN 0 THEN 'ия' WHEN 1 THEN 'ость' WHEN 2 THEN 'а' WHEN 3 THEN 'ание' WHEN 4 THEN 'ь' WHEN 5 THEN ' это' ELSE 'ть' END AS name FROM part)"
)


def names(spark, d) -> DataFrame:
    p, k = M.table(spark, d, "part"), F.col("p_partkey") % 6
    name = (
        F.when(k == 0, F.concat(F.lit("The  "), "p_name")).when(k == 1, F.concat("p_name", F.lit(" 12345678901"))).when(k == 2, "Of")
        .when(k == 3, F.concat(F.lit("this so-called "), "p_name")).when(k == 4, F.concat(F.lit("two-part "), "p_name")).otherwise("this case")
    )
    return p.select(F.col("p_partkey").alias("id"), name.alias("name"), F.col("p_type").alias("domain"))


def names_ru(spark, d) -> DataFrame:
    p, k = M.table(spark, d, "part"), F.col("p_partkey")
    plain = F.translate("p_name", *L.TEST_CYRILLIC)
    head = F.when(k % 3 == 0, F.split_part(plain, F.lit(" "), F.lit(1))).otherwise(plain)
    ends = ["ия", "ость", "а", "ание", "ь", " это", "ть"]
    return p.select(k.alias("id"), F.concat(head, F.element_at(F.array(*map(F.lit, ends)), (k % 7 + 1).cast("int"))).alias("name"))


#: Documents as Russian texts.
RUSSIAN_SQL = f"ru AS (SELECT doc_id, translate(text, '{L.TEST_CYRILLIC[0]}', '{L.TEST_CYRILLIC[1]}') AS text FROM documents)"


def russian(spark, d) -> DataFrame:
    return M.table(spark, d, "documents").select("doc_id", F.translate("text", *L.TEST_CYRILLIC).alias("text"))
