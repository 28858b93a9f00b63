"""Substring search by a posting table of trigrams, which names the rows that may match before their text is read.

A text that contains a pattern contains all trigrams of it, so rows that lack one need no look; the others are verified
by the same condition as a search without an index. Patterns of under three characters are searched in all rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusforge.operators.log import search_condition

SIZE = 3


def grams(text: Column) -> Column:
    """The distinct trigrams of a text in lower case."""
    low = F.lower(F.coalesce(text, F.lit("")))
    cut = F.transform(F.sequence(F.lit(1), F.greatest(F.length(low) - (SIZE - 1), F.lit(1))), lambda i: F.substring(low, i, F.lit(SIZE)))
    return F.array_distinct(F.filter(cut, lambda g: F.length(g) == SIZE))


def postings(df: DataFrame, key: str, columns: list[str], arrays: list[str] = ()) -> DataFrame:
    """(gram, key): in which rows each trigram of the columns and array members occurs."""
    found = [grams(F.col(c)) for c in columns] + [F.flatten(F.transform(F.coalesce(F.col(a), F.array().cast("array<string>")), grams)) for a in arrays]
    return df.select(F.explode(F.array_distinct(F.flatten(F.array(*found)))).alias("gram"), F.col(key).alias("key"))


def write_postings(found: DataFrame, path: str) -> None:
    """Write a posting table in the order of its trigrams, so that a search reads the row groups of its own ones only."""
    found.repartitionByRange("gram").sortWithinPartitions("gram").write.mode("overwrite").parquet(path)


def search(df: DataFrame, index: DataFrame, key: str, text: str | None, columns: list[str], arrays: list[str] = (), raw_like: bool = False) -> DataFrame:
    """The rows of df that search_condition admits; index is the posting table of the same columns.

    With raw_like the parts of a pattern between % and _ are looked up.
    """
    condition = search_condition(text, columns, arrays, raw_like)
    pattern = (text or "").strip().lower()
    parts = pattern.replace("%", "\0").replace("_", "\0").split("\0") if raw_like else [pattern]
    if raw_like and "\\" in pattern:
        parts = []  # escapes are left to the condition
    wanted = sorted({p[i : i + SIZE] for p in parts for i in range(len(p) - SIZE + 1)})
    if not wanted:
        return df.filter(condition)
    # merged by key before the shuffle; a key is named once a trigram
    rows = index.filter(F.col("gram").isin(wanted)).groupBy("key").agg(F.count("*").alias("n")).filter(F.col("n") == len(wanted))
    return df.join(rows.select(F.col("key").alias("_key")), F.col(key) == F.col("_key"), "left_semi").filter(condition)
