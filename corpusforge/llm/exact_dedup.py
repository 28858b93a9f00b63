"""Exact deduplication by a heavy-hitter split.

Texts are equal when they are identical after every run of white space is replaced by one space. Their
SHA-256 is the group key. A Misra-Gries pass (DataFrame.freqItems) finds every digest that holds more
than ``support`` of the rows, with a fixed number of counters. The exact winners of those digests, at
most 1/support rows, are broadcast, so the many copies of a hot text are removed in the map tasks and
never meet in one reducer. All other digests hold few rows each and go through an ordinary shuffle.

Defined cases: null text counts as empty; a null doc_id sorts after every number and stays only if its
whole group has none; rows that repeat both doc_id and text all carry kept = true in exact_groups, and
exact_dedup keeps exactly one of them; an empty table gives an empty table; further columns pass through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusforge.llm.common import SPACES, documents, marked, materialise, rows_of, text_of

#: Share of all rows from which a digest is heavy; the broadcast holds at most 1 / SUPPORT rows.
SUPPORT = 1 / 1024


def text_digest(text: str = "text") -> Column:
    return F.sha2(F.regexp_replace(text_of(text), SPACES, " "), 256)


def heavy_winners(digests: DataFrame, support: float = SUPPORT) -> DataFrame:
    """(digest, keep_id, group_size, keep_rows) of every digest above ``support``, counted exactly.

    Misra-Gries may name some light digests too; their exact winners are as valid, and 1 / support bounds all.
    """
    found = digests.select(F.xxhash64("digest").alias("h")).stat.freqItems(["h"], support)
    frequent = found.select(F.explode("h_freqItems").alias("h"))
    heavy = digests.join(F.broadcast(frequent), F.xxhash64("digest") == F.col("h"), "left_semi")
    return _winners(heavy)


def _winners(digests: DataFrame) -> DataFrame:
    per_id = digests.groupBy("digest", "doc_id").agg(F.count("*").alias("n"))
    return per_id.groupBy("digest").agg(
        F.min("doc_id").alias("keep_id"),
        F.sum("n").alias("group_size"),
        F.min_by("n", F.struct(F.col("doc_id").isNull(), "doc_id")).alias("keep_rows"),
    )


def digest_table(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    return materialise(docs.select(F.col(doc_id).alias("doc_id"), text_digest(text).alias("digest")))


def exact_groups(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", support: float = SUPPORT) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256."""
    digests = digest_table(docs, text, doc_id)
    heavy = materialise(heavy_winners(digests, support)).select("digest", "keep_id", "group_size")
    hot = digests.join(F.broadcast(heavy), "digest").select("doc_id", "keep_id", "group_size", "digest")
    same = Window.partitionBy("digest")
    rest = digests.join(F.broadcast(heavy), "digest", "left_anti").select(
        "doc_id", F.min("doc_id").over(same).alias("keep_id"), F.count("*").over(same).alias("group_size"), "digest"
    )
    return hot.unionByName(rest).select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.col("digest").alias("text_sha256")
    )


def exact_dedup(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", support: float = SUPPORT) -> DataFrame:
    """The documents that stay, with all their columns: of equal texts the one with the smallest doc_id."""
    digests = digest_table(docs, text, doc_id)
    heavy = materialise(heavy_winners(digests, support))
    light = materialise(_winners(digests.join(F.broadcast(heavy), "digest", "left_anti")).filter("group_size > 1"))
    rows = docs.select(rows_of(docs).alias("row"), F.col(doc_id).alias("doc_id"), text_digest(text).alias("digest"))
    stays = F.col("w.digest").isNull() | F.col("r.doc_id").eqNullSafe(F.col("w.keep_id"))
    chosen = lambda rows, winners: rows.alias("r").join(winners.alias("w"), F.col("r.digest") == F.col("w.digest"), "left").filter(stays).select("r.*")
    # texts without a light copy, by a bitmap of the digests that have one, are not shuffled
    rows = marked(chosen(rows, F.broadcast(heavy)), F.xxhash64("digest"), light, F.xxhash64("digest"), "copied")
    alone, copied = rows.filter("NOT copied").drop("copied"), rows.filter("copied").drop("copied")
    rows = alone.unionByName(chosen(copied, light))
    repeated = heavy.unionByName(light).filter("keep_rows > 1")
    if repeated.isEmpty():
        return rows.select("row.*")
    repeated = materialise(repeated.select("digest"))
    single = rows.join(repeated, "digest", "left_anti").select("row")
    several = rows.join(repeated, "digest", "left_semi").groupBy("digest").agg(F.min_by("row", F.to_json("row")).alias("row")).select("row")
    return single.unionByName(several).select("row.*")


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(documents(spark, sf_dir))


OP1_SQL = r"""
WITH d AS (
  SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents
), g AS (
  SELECT doc_id, text_sha256, min(doc_id) OVER (PARTITION BY text_sha256) AS keep_id,
         count(*) OVER (PARTITION BY text_sha256) AS group_size FROM d
)
SELECT doc_id, keep_id, group_size, doc_id IS NOT DISTINCT FROM keep_id AS kept, text_sha256 FROM g
"""
