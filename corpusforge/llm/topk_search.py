"""Exact top-k search: tiled matrix products, partial selection per tile, tree merging of the lists.

Queries and candidates are dealt into groups of bounded size; each pair of a query group and a candidate
group meets in one task, which multiplies tile by tile and keeps k candidates per query. The lists of a
query, one per candidate group, are merged level by level with a bounded fan-in, so no task sees more than
FAN_IN * k rows of a query however large the table is.

Components are integers floor(scale * x). Products run in float64 where every partial sum stays below 2^53,
which is exact, and in Python integers (clamped to 64 bits) where it may not; components whose multiple is beyond
float64 are Python integers from the start, so every finite double is defined.

No id goes through a float: tasks get 0 for a null id and a flag beside it.

Defined cases: vectors that are null or hold null or non-finite components take no part; only vectors of
equal length meet; a null vec_id is never a query and sorts last among ties; rows that repeat a vec_id are
candidates and queries each on their own, a row never meets itself; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Callable
from fractions import Fraction
from math import floor

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusforge.llm.common import materialise

K = 5
SCALE = 256
QUERY_GROUP, SHARD_GROUP = 4096, 16_384
QUERY_TILE, SHARD_TILE = 512, 4096
FAN_IN = 32
EXACT = float(2**53)
SCHEMA = "sg long, q_rid long, query_id long, rid long, vec_id long, none boolean, score long"


def usable(vector: str) -> Column:
    bad = lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf"))
    return F.col(vector).isNotNull() & ~F.exists(vector, bad)


def whole(rows: pd.Series, dim: int, scale: int) -> np.ndarray:
    """floor(scale * x) of every component: as float64, or as Python integers if one of them is too large for it."""
    if not dim:
        return np.zeros((len(rows), 0))
    given = np.stack([np.asarray(r, dtype=np.float64) for r in rows])
    with np.errstate(over="ignore"):
        found = np.floor(given * scale)
    if np.isfinite(found).all():
        return found
    return np.array([[floor(Fraction(x) * scale) for x in row] for row in given.tolist()], dtype=object)


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of the rows of a and b as int64."""
    most = lambda x: float(np.abs(x).max(initial=0.0))
    if object not in (a.dtype, b.dtype) and most(a) * most(b) * max(1, a.shape[1]) < EXACT:
        return (a @ b.T).astype(np.int64)
    ints = lambda x: np.array([[int(v) for v in row] for row in x], dtype=object)
    low, high = -(2**63), 2**63 - 1
    return np.array([[min(max(int(v), low), high) for v in row] for row in ints(a) @ ints(b).T], dtype=np.int64)


def best(scores: np.ndarray, own: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions of each row's k highest scores, ties to the left; own marks pairs that do not count.

    The selection takes all scores above a row's k-th and as many of the equal ones from the left as fit.
    """
    rows, width = scores.shape
    k = min(k, width)
    low = np.iinfo(np.int64).min
    masked = np.where(own, low, scores)
    kth = np.partition(masked, width - k, axis=1)[:, width - k][:, None]
    above = masked > kth
    equal = (masked == kth) & ~own
    room = k - above.sum(1, keepdims=True)
    chosen = above | (equal & (np.cumsum(equal, axis=1) <= room))
    return np.nonzero(chosen)


def numbered(vectors: DataFrame, vec_id: str, vector: str, asks: Column, *more: Column) -> DataFrame:
    """The usable rows, written once so that a row has the same number in every role: rid, vec_id, none, v, dim, q and more."""
    named = F.col(vec_id).isNotNull()
    rows = vectors.filter(usable(vector)).select(
        F.monotonically_increasing_id().alias("rid"), F.coalesce(F.col(vec_id).cast("long"), F.lit(0)).alias("vec_id"), (~named).alias("none"),
        F.col(vector).alias("v"), F.size(vector).alias("dim"), (named & F.coalesce(asks, F.lit(False))).alias("q"), *more,
    )
    return materialise(rows)


def group_of(n: Column | int, seed: int) -> Column:
    """One of n groups, by a hash of the row number."""
    return F.pmod(F.xxhash64("rid", F.lit(seed)), F.lit(n) if isinstance(n, int) else n)


def all_groups(n: Column | int) -> Column:
    """A row for each of n groups."""
    n = F.lit(n) if isinstance(n, int) else n
    return F.explode(F.sequence(F.lit(0).cast("long"), n.cast("long") - 1))


def merged(found: DataFrame, by: list[str], k: int, groups: int) -> DataFrame:
    """The k best rows (score, then vec_id) of each key ``by`` from its lists of groups sg, with their rank: FAN_IN lists at a time."""
    order = [F.desc("score"), F.asc("none"), F.asc("vec_id"), F.asc("rid")]
    while True:
        groups = -(-groups // FAN_IN)
        found = found.withColumn("sg", F.floor(F.col("sg") / FAN_IN))
        found = found.withColumn("rank", F.row_number().over(Window.partitionBy(*by, "sg").orderBy(*order))).filter(F.col("rank") <= k)
        if groups <= 1:
            return found


def search(k: int, scale: int) -> Callable:
    """For cogroups of queries and a shard, whose key ends with the shard's group: each query's k best rows."""

    def of_groups(key: tuple, queries: pd.DataFrame, shard: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(queries) and len(shard):
            shard = shard.sort_values(["none", "vec_id", "rid"])
            dim = len(shard["v"].iloc[0])
            a, b = whole(queries["v"], dim, scale), whole(shard["v"], dim, scale)
            q_rid, rid = queries["rid"].to_numpy(), shard["rid"].to_numpy()
            for i in range(0, len(a), QUERY_TILE):
                # lists so far: a row's columns stay in the order of vec_id, so ties go to the left here too
                for j in range(0, len(b), SHARD_TILE):
                    score = products(a[i : i + QUERY_TILE], b[j : j + SHARD_TILE])
                    own = q_rid[i : i + QUERY_TILE, None] == rid[None, j : j + SHARD_TILE]
                    r, c = best(score, own, k)
                    out.append(pd.DataFrame({"q": r + i, "c": c + j, "score": score[r, c]}))
        if not out:
            return pd.DataFrame({x.split()[0]: [] for x in SCHEMA.split(", ")})
        found = pd.concat(out).sort_values(["q", "score", "c"], ascending=[True, False, True])
        found = found[found.groupby("q").cumcount() < k]
        q, c = found["q"].to_numpy(), found["c"].to_numpy()
        return pd.DataFrame({
            "sg": int(key[-1]), "q_rid": q_rid[q], "query_id": queries["vec_id"].to_numpy()[q],
            "rid": rid[c], "vec_id": shard["vec_id"].to_numpy()[c], "none": shard["none"].to_numpy()[c], "score": found["score"].to_numpy(),
        })

    return of_groups


def top_k(vectors: DataFrame, is_query: Column, k: int = K, scale: int = SCALE, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: each query's k highest inner products with the other rows.

    is_query is a condition over the columns of vectors.
    """
    valid = numbered(vectors, vec_id, vector, is_query)
    rows, queries = valid.agg(F.count("*"), F.count_if("q")).first()
    qgs, sgs = -(-queries // QUERY_GROUP) or 1, -(-rows // SHARD_GROUP) or 1
    new = lambda *names: [F.col(c).alias(c) for c in names]  # noqa: E731  the two sides must not share attributes
    asked = valid.filter("q").select(*new("dim"), group_of(qgs, 1).alias("qg"), all_groups(sgs).alias("sg"), *new("rid", "vec_id", "v"))
    shards = valid.select(*new("dim"), all_groups(qgs).alias("qg"), group_of(sgs, 2).alias("sg"), *new("rid", "vec_id", "none", "v"))
    found = asked.groupBy("dim", "qg", "sg").cogroup(shards.groupBy("dim", "qg", "sg")).applyInPandas(search(k, scale), SCHEMA)
    found = merged(found, ["q_rid"], k, sgs)
    return found.select("query_id", F.col("rank").cast("int").alias("rank"), F.when(~F.col("none"), F.col("vec_id")).alias("vec_id"), "score")


def op3_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 50 == 0)


OP3_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), p AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, list_dot_product(q.e, c.e)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id
), r AS (
  SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank, vec_id, score FROM p
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
