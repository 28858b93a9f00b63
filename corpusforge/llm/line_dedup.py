"""Line deduplication by winnowing over line hashes.

A document is the sequence of its lines that are not blank, with white space runs made one space. A line
goes if it lies in a run of RUN consecutive lines that also starts earlier: in a document with a smaller
doc_id, or further up in the same one.

1. Winnowing selects, in each window of RUN line hashes, the least one (the last among equals), so every
   repeated run of RUN lines shares a selected fingerprint at the same place.
2. Fingerprints that are selected only once are dropped; positions of the others go on, and only around them
   are windows formed: those that selected the position, which reach up to RUN - 1 lines to either side.
3. Every such window is joined to its first occurrence by a 128-bit hash. Not all pairs of positions are
   formed: a line in a third of all documents joins once for each of its windows.
4. Matches are extended both ways along the diagonal: those of one document with the same earlier document and
   the same distance make up the longest runs, which come with where they were copied from (repeated_runs).
5. The later runs are deleted.

Firsts and counts are merged before each shuffle, and the joins hold two plain tables, so a line that a
third of all documents share is split by adaptive execution.

Defined cases: null and empty texts have no lines; texts with fewer than RUN lines lose nothing; a null
doc_id comes after every number; of rows that repeat a doc_id the one with the smaller hash of its text is the
earlier; rows that repeat doc_id and text are told apart by nothing and keep their runs alike; all steps are
linear in the lines of a document, also of one that repeats a single line; an empty table gives an empty
table; further columns pass through dedup_lines.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusforge.llm.common import documents, materialise, rows_of, with_null, without_null

RUN = 2
MARKED = "doc_id long, none boolean, mark long, lines array<long>, at array<int>, first array<int>, last array<int>"


def lines_of(text: str) -> list[bytes]:
    """Lines that are not blank, with white space runs (of the ASCII kinds) made one space."""
    return [b" ".join(words) for line in text.encode().split(b"\n") if (words := line.split())]


def winnow(hashes: np.ndarray, run: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Selected positions, and the first and last start of the windows that select each; those between do too."""
    if len(hashes) < run:
        return (np.zeros(0, np.int32),) * 3
    windows = np.lib.stride_tricks.sliding_window_view(hashes, run)
    starts = np.arange(len(windows), dtype=np.int32)
    chosen = starts + np.int32(run - 1) - windows[:, ::-1].argmin(axis=1).astype(np.int32)
    at, first, n = np.unique(chosen, return_index=True, return_counts=True)
    return at, first.astype(np.int32), (first + n - 1).astype(np.int32)


def _mark(run: int):
    def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for text in batch["text"]:
                hashes = np.frombuffer(b"".join(hashlib.blake2b(x, digest_size=8).digest() for x in lines_of(text)), np.int64)
                rows.append((hashes, *winnow(hashes, run)))
            out = pd.DataFrame(rows, columns=["lines", "at", "first", "last"])
            yield pd.concat([batch[["doc_id", "none", "mark"]].reset_index(drop=True), out], axis=1)

    return of


def _marked(docs: DataFrame, text: str, doc_id: str, run: int) -> DataFrame:
    """One row per document with its line hashes and fingerprints; node is a number of the row that is written with it."""
    whole = F.coalesce(F.col(text), F.lit(""))
    texts = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.xxhash64(whole).alias("mark"), whole.alias("text"))
    found = with_null(without_null(texts, "doc_id").mapInPandas(_mark(run), MARKED), "doc_id")
    return materialise(found.withColumn("node", F.monotonically_increasing_id()))


def _matches(marked: DataFrame, run: int) -> DataFrame:
    """(node, start, source, source_start): every window that starts earlier too, with its first occurrence."""
    prints = F.arrays_zip(F.transform("at", lambda i: F.get("lines", i)).alias("hash"), "first", "last")
    prints = marked.select("node", F.explode(prints).alias("p")).select("node", "p.*")
    twice = materialise(prints.groupBy("hash").agg(F.count("*").alias("n")).filter("n > 1").select("hash"))
    starts = prints.join(twice, "hash").groupBy("node").agg(F.flatten(F.collect_list(F.sequence("first", "last"))).alias("starts"))
    key = lambda s: F.slice("lines", s + 1, run)
    windows = F.transform("starts", lambda s: F.struct(s.alias("start"), F.xxhash64(key(s)).alias("a"), F.xxhash64(F.lit(run), key(s)).alias("b")))
    doc = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "mark").alias("doc")
    around = marked.join(starts, "node").select("node", doc, F.explode(windows).alias("w"))
    around = materialise(around.select("node", "doc", "w.*"))
    firsts = around.groupBy("a", "b").agg(F.min(F.struct("doc", "start")).alias("source"), F.count("*").alias("n")).filter("n > 1").drop("n")
    later = around.join(materialise(firsts), ["a", "b"]).filter(F.struct("doc", "start") > F.col("source"))
    return later.select("node", "start", F.col("source.doc").alias("source"), F.col("source.start").alias("source_start"))


def _runs(matches: DataFrame, run: int) -> DataFrame:
    """(node, source, start, source_start, length): matches of one document and source at one distance, joined while they overlap or touch."""
    diagonal = Window.partitionBy("node", "source", F.col("start") - F.col("source_start")).orderBy("start")
    fresh = F.coalesce(F.col("start") - F.lag("start").over(diagonal) > run, F.lit(True))
    joined = matches.withColumn("fresh", fresh.cast("int")).withColumn("island", F.sum("fresh").over(diagonal))
    joined = joined.groupBy("node", "source", (F.col("start") - F.col("source_start")).alias("distance"), "island").agg(F.min("start").alias("start"), F.max("start").alias("end"))
    return joined.select("node", "source", "start", (F.col("start") - F.col("distance")).alias("source_start"), (F.col("end") - F.col("start") + run).alias("length"))


def repeated_runs(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", run: int = RUN) -> DataFrame:
    """The later runs: doc_id, mark (a hash of the text), start and length in lines, source_id, source_mark, source_start."""
    marked = _marked(docs, text, doc_id, run)
    found = _runs(_matches(marked, run), run).join(marked.select("node", "doc_id", "mark"), "node")
    return found.select("doc_id", "mark", "start", "length", F.col("source.doc_id").alias("source_id"), F.col("source.mark").alias("source_mark"), "source_start")


def repeated_lines(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", run: int = RUN) -> DataFrame:
    """One row per document: doc_id, mark (a hash of the text), n_lines, removed (sorted positions among its lines), n_runs."""
    marked = _marked(docs, text, doc_id, run)
    spans = _runs(_matches(marked, run), run).groupBy("node").agg(F.collect_list(F.sequence("start", F.col("start") + F.col("length") - 1)).alias("spans"))
    gone = spans.select("node", F.array_sort(F.array_distinct(F.flatten("spans"))).alias("gone"))
    out = marked.select("node", "doc_id", "mark", F.size("lines").alias("n_lines")).join(gone, "node", "left")
    lost = F.coalesce("gone", F.array().cast("array<int>"))
    return out.select("doc_id", "mark", "n_lines", lost.alias("removed"), _breaks(lost).alias("n_runs"))


def _breaks(positions: Column) -> Column:
    """The number of runs of consecutive numbers in a sorted array."""
    n = F.size(positions)
    gaps = F.zip_with(F.slice(positions, F.lit(2), F.greatest(n - 1, F.lit(0))), F.slice(positions, F.lit(1), F.greatest(n - 1, F.lit(0))), lambda x, y: x - y > 1)
    return F.when(n > 0, F.size(F.filter(gaps, lambda x: x)) + 1).otherwise(0)


def dedup_lines(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", run: int = RUN) -> DataFrame:
    """docs with the repeated lines taken out of the text; blank lines stay."""
    found = repeated_lines(docs, text, doc_id, run).filter(F.size("removed") > 0).select("doc_id", "mark", "removed").distinct()
    rows = docs.select(rows_of(docs).alias("row"), F.col(doc_id).cast("long").alias("id"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("hash"))
    joined = rows.join(found, F.col("id").eqNullSafe(F.col("doc_id")) & (F.col("hash") == F.col("mark")), "left")
    joined = joined.withColumn("lines", F.when(F.col("removed").isNotNull(), F.split(F.col(f"row.`{text}`"), "\n", -1)))
    all_lines = F.sequence(F.lit(0), F.size("lines") - 1)
    joined = joined.withColumn("full", F.filter(all_lines, lambda i: F.get("lines", i).rlike(r"[^\x20\x09-\x0D]")))
    stay = F.array_except(all_lines, F.transform("removed", lambda i: F.get("full", i)))
    less = F.when(F.col("removed").isNotNull(), F.array_join(F.transform(stay, lambda i: F.get("lines", i)), "\n")).otherwise(F.col(f"row.`{text}`"))
    return joined.select(F.col("row").withField(f"`{text}`", less).alias("row")).select("row.*")


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_lines(documents(spark, sf_dir)).select("doc_id", "n_lines", F.size("removed").alias("n_removed"), "n_runs", "removed")


OP4_SQL = r"""
WITH l AS (
  SELECT doc_id, list_filter(list_transform(string_split(coalesce(text, ''), chr(10)), lambda x: trim(regexp_replace(x, '[\x20\x09-\x0D]+', ' ', 'g'), ' ')), lambda x: x <> '') AS ls FROM documents
), w AS (
  SELECT doc_id, i - 1 AS start, ls[i] || chr(10) || ls[i + 1] AS k FROM l, LATERAL (SELECT unnest(range(1, len(ls))) AS i)
), f AS (SELECT *, min((doc_id, start)) OVER (PARTITION BY k) AS first FROM w
), g AS (
  SELECT doc_id, list_sort(list_distinct(flatten(list([start, start + 1])))) AS removed FROM f WHERE (doc_id, start) > first GROUP BY doc_id
)
SELECT doc_id, len(ls)::INT AS n_lines, coalesce(len(removed), 0)::INT AS n_removed,
       coalesce(len(list_filter(removed, lambda p: NOT list_contains(removed, p - 1))), 0)::INT AS n_runs,
       list_transform(coalesce(removed, []), lambda p: p::INT) AS removed
FROM l LEFT JOIN g USING (doc_id)
"""
