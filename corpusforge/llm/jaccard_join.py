"""N-gram Jaccard join by vertical partitioning.

Every text becomes the set of its distinct n-grams of words. The global order of n-grams is that of their 64-bit
hashes, in which equal ranges hold equal shares of any set. Ranges of that order are fragments, and the part of a set in
one is a segment. The order is cut twice.

1. For candidates. Sets x and y at the threshold differ in at most D = (x + y) (100 - percent) / (100 + percent)
   n-grams, so of D + s fragments at least s hold the same segment of both. Sizes are cut into levels such that sets
   at the threshold lie in one level or in neighbours; each set leaves a hash of every segment for its own level and
   the one above, and pairs meet at the level of the larger set, whose greatest size gives D. Segments that are empty
   tell nothing: s is chosen so that hardly any set has s of them, and a set that has leaves hashes of its empty ones
   too. So no pair at the threshold is missed, at any size, and a common n-gram or passage makes no candidates: all
   of a segment must be common.
2. For counting. Candidates whose sizes and parity sketches allow a link (two sketches differ in no more bits than
   their sets in n-grams) are counted in FRAGMENTS fragments: each pair meets the two segments of a fragment in its own
   row, their common n-grams are counted there, and the partial counts are summed per pair.

Equal sets are one class from the start. A class is compared with the class that leads most of its segments, then with
the leaders of its others; the links are joined into components, and only segments that still hold several
components go on to further meetings, whose rounds (module meetings) grow with the classes while links join them.

Defined cases: as in module near_dedup: null and empty texts and those without words have no n-grams and are linked
with nothing; with fewer words than an n-gram has, the whole sequence is the only one; rows with a null doc_id are
linked with nothing (component null); rows that repeat a doc_id are judged each by its own text; an empty table
gives an empty table; further columns are not returned.
"""

from __future__ import annotations

import math
from bisect import bisect_right
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusforge.llm.common import documents, materialise, with_null, without_null
from corpusforge.llm.components import components
from corpusforge.llm.meetings import dealt, met, rounds, still_open
from corpusforge.llm.near_dedup import LONGS, MIX, Words, among, apart, grouped, led_buckets, merged_labels, mixed, parity, parts_of, plain_texts, set_hash, sets_of, shingles, xor_bits

NGRAM, PERCENT = 3, 90
FRAGMENTS = 8
#: Expected share of sets, at most, that have as many empty segments as a level's spare ones.
EMPTY = 0.01
PRINTED = "doc_id long, none boolean, text_hash long, n_shingles long, set_a long, set_b long, prints array<long>, bits array<long>"
SEGMENTS = "id long, fragment int, tokens array<long>"


def differing(both: int, percent: int) -> int:
    """How many n-grams two sets of this total size at the threshold have apart, at most."""
    return both * (100 - percent) // (100 + percent)


@cache
def lowest(level: int, percent: int) -> int:
    """The smallest size of a level: sets at the threshold lie in one level or in neighbours."""
    return 1 if level == 0 else 100 * lowest(level - 1, percent) // percent + 1


def level_of(size: int, percent: int) -> int:
    high = 0
    while lowest(high + 1, percent) <= size:
        high += 1
    return high


@cache
def cuts(level: int, percent: int) -> tuple[int, int]:
    """Fragments of a level, and how many of them hold equal segments of any pair at the threshold that meets there."""
    most = differing(2 * (lowest(level + 1, percent) - 1), percent)
    least = lowest(level, percent) * percent / 100
    spare = 1
    while spare <= most // 4:  # below 0.85 or so more fragments are never enough; then more sets leave hashes of empty ones
        empty = (most + spare) * math.exp(-least / (most + spare))
        # at the rate ``empty`` of empty segments, so many or more are about as likely as empty^spare / spare!
        if empty == 0 or spare * math.log(empty) - math.lgamma(spare + 1) < math.log(EMPTY):
            break
        spare += 1
    return most + spare, spare


@cache
def edges(fragments: int) -> np.ndarray:
    """The first hash of every fragment but the first."""
    return np.array([-(-(k << 64) // fragments) for k in range(1, fragments)], np.uint64)


def bounds(found: np.ndarray, fragments: int) -> np.ndarray:
    """Where the segments of a sorted set begin, and its size."""
    return np.concatenate([[0], np.searchsorted(found, edges(fragments)), [len(found)]])


def prints(found: np.ndarray, percent: int) -> np.ndarray:
    """Hashes of the segments of a sorted set, for its level and the one above."""
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mixed(found * MIX[0]), dtype=np.uint64)])
    level, out = level_of(len(found), percent), []
    for at in (level, level + 1):
        if at > level and 100 * len(found) < percent * lowest(at, percent):
            continue  # too small for any set of that level
        fragments, spare = cuts(at, percent)
        if fragments == spare:
            continue  # only equal sets meet the threshold
        ends = bounds(found, fragments)
        own = mixed(sums[ends[1:]] - sums[ends[:-1]] + mixed(np.arange(fragments, dtype=np.uint64) * MIX[2] + np.uint64(at + 1)))
        full = ends[1:] > ends[:-1]
        out.append(own if fragments - full.sum() >= spare else own[full])
    return np.concatenate(out).view(np.int64) if out else np.zeros(0, np.int64)


def _printed(size: int, percent: int):
    def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words = Words()
        for batch in batches:
            rows = []
            with np.errstate(over="ignore"):
                for text in batch["text"]:
                    found = shingles(text, words, size)
                    rows.append((len(found), *set_hash(found), prints(found, percent), parity(found.view(np.int64))) if len(found) else (0, 0, 0, [], []))
            out = pd.DataFrame(rows, columns=["n_shingles", "set_a", "set_b", "prints", "bits"])
            yield pd.concat([batch[["doc_id", "none", "text_hash"]].reset_index(drop=True), out], axis=1)

    return of


def _segments(size: int, fragments: int):
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words()
        for part in (p for batch in batches for p in parts_of(batch)):
            tokens = []
            with np.errstate(over="ignore"):
                for text in part["text"]:
                    found = shingles(text.as_py(), words, size)
                    tokens += np.split(found.view(np.int64), bounds(found, fragments)[1:-1])
            ids = np.repeat(part["id"].to_numpy(), fragments)
            numbers = np.tile(np.arange(fragments, dtype=np.int32), part.num_rows)
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(numbers), pa.array(tokens, LONGS)], names=["id", "fragment", "tokens"])

    return of


def allowed(x: Column, y: Column, percent: int) -> Column:
    """Whether sizes allow the threshold."""
    return 100 * F.least(x, y) >= percent * F.greatest(x, y)


def close(x: Column, y: Column, bits_x: Column, bits_y: Column, percent: int) -> Column:
    """Whether sketches allow it: they differ in no more bits than the sets in n-grams."""
    return (100 + percent) * xor_bits(bits_x, bits_y) <= (100 - percent) * (x + y)


def counted(pairs: DataFrame, segments: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b, na, nb) that reach the threshold: partial overlaps of the fragments, summed per pair."""
    a, b = (segments.select(F.col("id").alias(s), F.col("fragment").alias(f"f{s}"), F.col("tokens").alias(f"t{s}")) for s in "ab")
    parts = pairs.join(a, "a").join(b, ["b"]).filter("fa = fb").withColumn("common", F.size(F.array_intersect("ta", "tb")))
    total = parts.groupBy("a", "b", "na", "nb").agg(F.sum("common").alias("common"))
    return total.filter((100 + percent) * F.col("common") >= percent * (F.col("na") + F.col("nb"))).select("a", "b")


def _class_components(reps: DataFrame, texts: DataFrame, ngram: int, percent: int) -> DataFrame:
    """(node, component) of the classes that have links."""
    members = led_buckets(reps.select("id", F.explode("prints").alias("token")))
    facts = materialise(among(reps.select("id", "doc_id", "text_hash", F.col("n_shingles").alias("n"), "bits"), members))
    segments = sets_of(facts, texts, _segments(ngram, FRAGMENTS), SEGMENTS)

    def confirmed(pairs: DataFrame) -> DataFrame:
        a, b = (facts.select(F.col("id").alias(s), F.col("n").alias(f"n{s}"), F.col("bits").alias(f"bits{s}")) for s in "ab")
        n, bits = (F.col("na"), F.col("nb")), (F.col("bitsa"), F.col("bitsb"))
        plausible = materialise(pairs.join(a, "a").join(b, "b").filter(allowed(*n, percent) & close(*n, *bits, percent)).select("a", "b", "na", "nb"))
        return materialise(counted(plausible, segments, percent))

    led = materialise(members.filter("id <> leader").groupBy(F.col("id").alias("a"), F.col("leader").alias("b")).agg(F.count("*").alias("shared")))
    best = led.groupBy("a").agg(F.max_by("b", F.struct("shared", "b")).alias("b"))
    labels = components(confirmed(best))
    labels = merged_labels(labels, confirmed(apart(led.select("a", "b").join(best, ["a", "b"], "left_anti"), labels)))
    posts = dealt(still_open(members.filter("m > 2").select("token", "id"), labels))
    if posts.isEmpty():
        return labels
    for at in range(rounds(posts)):
        posts = still_open(posts, labels)
        labels = merged_labels(labels, confirmed(meetings(posts, facts, percent, at)))
    return labels


def meetings(posts: DataFrame, facts: DataFrame, percent: int, at: int) -> DataFrame:
    """(a, b): pairs of classes of different components that sizes and sketches admit, of the meetings of a round."""
    fits = lambda x, y: allowed(x("n"), y("n"), percent) & close(x("n"), y("n"), x("bits"), y("bits"), percent)
    return met(posts, facts.select("id", "n", "bits"), fits, at)


def jaccard_groups(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", ngram: int = NGRAM, percent: int = PERCENT) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept, and text_hash, which tells rows of one doc_id apart."""
    texts = plain_texts(docs, text, doc_id)
    signed = with_null(without_null(texts, "doc_id").mapInPandas(_printed(ngram, percent), PRINTED), "doc_id")
    return grouped(signed, ["prints", "bits"], lambda reps: _class_components(reps, texts, ngram, percent))


def op13_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_groups(documents(spark, sf_dir)).select("doc_id", "n_shingles", "component_id")


OP13_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents
), s AS (
  SELECT DISTINCT doc_id, CASE WHEN len(ws) < 3 THEN array_to_string(ws, ' ') ELSE array_to_string(ws[i : i + 2], ' ') END AS sh
  FROM w, LATERAL (SELECT unnest(range(1, greatest(len(ws) - 2, 1) + 1)) AS i) WHERE len(ws) > 0
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), p AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id < b.doc_id GROUP BY 1, 2
), l AS (
  SELECT a, b FROM p JOIN n x ON p.a = x.doc_id JOIN n y ON p.b = y.doc_id WHERE 100 * c >= 90 * (x.n + y.n - c)
), e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l
), r AS (SELECT doc_id AS node, doc_id AS reached FROM documents UNION SELECT r.node, e.b FROM r JOIN e ON r.reached = e.a
), c AS (SELECT node, min(reached) AS component_id FROM r GROUP BY node)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, component_id FROM documents d JOIN c ON c.node = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id
"""
