"""What the operators of this subpackage share: scratch tables, column access and text normalisation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusforge.operators.scratch import materialise, scratch_dir, scratch_path  # noqa: F401

#: The white space of every contract here: space, tab, line feed, vertical tab, form feed, carriage return.
SPACES = r"[\x20\x09-\x0D]+"
WORDS = r"[^\x20\x09-\x0D]+"
#: Rows of a bitmap of hashes, 64 bits each: the size bound of its broadcast.
BITMAP_ROWS = 1 << 18


def text_of(column: str = "text") -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def rows_of(df: DataFrame) -> Column:
    """All columns of df as one struct, so that an operator's own columns cannot clash with them."""
    return F.struct(*[F.col(f"`{c}`") for c in df.columns])


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def without_null(df: DataFrame, column: str) -> DataFrame:
    """column with 0 for null, and none, which says where. A long column that holds nulls would reach pandas as floats, which round large ids."""
    return df.withColumn("none", F.col(column).isNull()).withColumn(column, F.coalesce(column, F.lit(0)))


def with_null(df: DataFrame, column: str) -> DataFrame:
    """The inverse of without_null."""
    return df.withColumn(column, F.when(~F.col("none"), F.col(column))).drop("none")


def marked(rows: DataFrame, key: Column, known: DataFrame, of: Column, name: str) -> DataFrame:
    """rows with a boolean column: false if their 64-bit key is surely none of the keys ``of`` of known.

    The keys' hashes become a bitmap of at most BITMAP_ROWS rows, which is broadcast, so rows that need not be joined can
    stay where they are. When it fills up, more rows are marked; none is missed.
    """
    at = lambda h: F.pmod(h, F.lit(BITMAP_ROWS)).cast("int")
    bit = lambda h: F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(F.shiftright(h, 40), F.lit(64)).cast("int"))
    hashes = known.select(F.xxhash64(of).alias("_h"))
    bits = hashes.select(at(F.col("_h")).alias("_word"), bit(F.col("_h")).alias("_bit")).groupBy("_word").agg(F.bit_or("_bit").alias("_bits"))
    found = rows.withColumn("_h", F.xxhash64(key))
    found = found.join(F.broadcast(bits), at(F.col("_h")) == F.col("_word"), "left")
    return found.withColumn(name, F.coalesce(F.col("_bits").bitwiseAND(bit(F.col("_h"))) != 0, F.lit(False))).drop("_word", "_bits", "_h")


def without(rows: DataFrame, column: str, gone: DataFrame) -> DataFrame:
    """rows whose long column is none of those of gone (one column of that name); only rows that may be are shuffled."""
    found = marked(rows, F.col(column), gone, F.col(column), "_perhaps")
    judged = found.filter("_perhaps").join(gone, column, "left_anti").select(*rows.columns)
    return found.filter("NOT _perhaps").select(*rows.columns).unionByName(judged)
