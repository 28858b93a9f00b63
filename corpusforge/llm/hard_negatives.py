"""Hard-negative mining by slot-decomposed selection.

Every anchor has up to POSITIVES positives, its best rows of the same label, and for each of them wants the k best
rows of other labels that score between SHARE per cent of the positive's score and that score. The windows
of one anchor overlap.

1. The positives are an exact top-k search among the rows of the anchor's label: tiles of bounded size, partial
   lists, merged as a tree. A label is cut into as many groups as its rows need, so a hot one is many tasks.
2. The distinct scores of the positives are the upper limits. They cut the scores into disjoint slots: slot j
   holds what is at most the limit j and above the next lower one. A negative lies in one slot only.
3. Tiles of anchors and rows keep k rows a slot, and so does every merge of such lists: the combiners never hold
   more than k times POSITIVES rows an anchor and task.
4. From the lowest slot upward each list is put before the list of all lower slots and cut to k. The suffix at a
   positive's slot is the answer below its limit, from which its lower limit cuts the end: a row that a lower
   limit excludes is after all that it admits.

A positive below zero has an empty window, since SHARE per cent of it lies above it.

Defined cases: rows with a null label, a null vector or any component that is null or not finite take no part;
only vectors of one length meet; scores beyond 64 bits are clamped; a row with a null id is never an anchor and
sorts last among ties; rows that repeat an id are each their own, as anchors too; equal scores of positives
share a slot; anchors without positives and windows without rows give no rows; an empty table gives an empty
table; further columns are not returned.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusforge.llm.common import materialise
from corpusforge.llm.topk_search import QUERY_GROUP, QUERY_TILE, SCALE, SCHEMA, SHARD_GROUP, SHARD_TILE, all_groups, group_of, merged, numbered, products, search, whole

K, POSITIVES, SHARE = 5, 5, 80
FOUND = "sg long, q_rid long, slot int, rid long, vec_id long, none boolean, score long"
ENTRY = "struct<lower:bigint,none:boolean,vec_id:bigint,rid:bigint>"


def least(limit: int, share: int) -> int:
    """The smallest score in the window below limit."""
    return -(-share * limit // 100)


def slots(limits: pd.Series, share: int) -> tuple[np.ndarray, np.ndarray]:
    """Highest and lowest score of each anchor's slots, highest slot first; slots that an anchor lacks hold nothing."""
    width = max(map(len, limits))
    high, low = np.full((len(limits), width), -1, np.int64), np.zeros((len(limits), width), np.int64)
    for row, own in enumerate(limits):
        for j, limit in enumerate(map(int, own)):
            high[row, j] = limit
            low[row, j] = max(least(limit, share), int(own[j + 1]) + 1 if j + 1 < len(own) else 0)
    return high, low


def first_of(keys: np.ndarray, score: np.ndarray, column: np.ndarray, k: int) -> np.ndarray:
    """Positions of each key's k highest scores, ties by column."""
    order = np.lexsort((column, -score, keys))
    if not len(order):
        return order
    fresh = np.r_[True, np.diff(keys[order]) != 0]
    return order[np.arange(len(order)) - np.maximum.accumulate(np.where(fresh, np.arange(len(order)), 0)) < k]


def in_slots(k: int, share: int, scale: int) -> Callable:
    """For cogroups of anchors and a shard: each slot's k best rows of other labels."""

    def of_groups(key: tuple, anchors: pd.DataFrame, shard: pd.DataFrame) -> pd.DataFrame:
        found = []
        if len(anchors) and len(shard):
            shard = shard.sort_values(["none", "vec_id", "rid"])
            dim = len(shard["v"].iloc[0])
            a, b = whole(anchors["v"], dim, scale), whole(shard["v"], dim, scale)
            labels, _ = pd.factorize(pd.concat([anchors["label"], shard["label"]]))
            mine, theirs = labels[: len(a)], labels[len(a) :]
            high, low = slots(anchors["limits"], share)
            for i in range(0, len(a), QUERY_TILE):
                own = slice(i, i + QUERY_TILE)
                for j in range(0, len(b), SHARD_TILE):
                    score = products(a[own], b[j : j + SHARD_TILE])
                    r, c = np.nonzero((score <= high[own, :1]) & (score >= 0) & (mine[own, None] != theirs[None, j : j + SHARD_TILE]))
                    s, r = score[r, c], r + i
                    slot = (s[:, None] <= high[r]).sum(1) - 1
                    good = np.nonzero(s >= low[r, slot])[0]
                    keys = (r * high.shape[1] + slot)[good]
                    best = good[first_of(keys, s[good], c[good], k)]
                    found.append(np.stack([r[best] * high.shape[1] + slot[best], s[best], c[best] + j]))
        if not found:
            return pd.DataFrame({x.split()[0]: [] for x in FOUND.split(", ")})
        keys, s, c = np.concatenate(found, axis=1)
        best = first_of(keys, s, c, k)
        row, slot = np.divmod(keys[best], high.shape[1])
        take = lambda name: shard[name].to_numpy()[c[best]]
        return pd.DataFrame({"sg": int(key[-1]), "q_rid": anchors["rid"].to_numpy()[row], "slot": slot, "rid": take("rid"), "vec_id": take("vec_id"), "none": take("none"), "score": s[best]})

    return of_groups


def _new(*names: str) -> list[Column]:
    """The two sides of a cogroup must not share attributes."""
    return [F.col(c).alias(c) for c in names]


def best_positives(valid: DataFrame, positives: int, scale: int) -> DataFrame:
    """q_rid, query_id, rid, vec_id, none, score: the best other rows of each anchor's label."""
    sizes = valid.groupBy("dim", "label").agg(F.ceil(F.count("*") / SHARD_GROUP).alias("sgs"), F.ceil(F.count_if("q") / QUERY_GROUP).alias("qgs")).filter("qgs > 0")
    sizes = materialise(sizes)
    most = sizes.agg(F.max("sgs")).first()[0] or 1
    rows = valid.join(sizes, ["dim", "label"])
    keys = ["dim", "label", "qg", "sg"]
    asked = rows.filter("q").select(*_new("dim", "label"), group_of(F.col("qgs"), 1).alias("qg"), all_groups(F.col("sgs")).alias("sg"), *_new("rid", "vec_id", "v"))
    shards = rows.select(*_new("dim", "label"), all_groups(F.col("qgs")).alias("qg"), group_of(F.col("sgs"), 2).alias("sg"), *_new("rid", "vec_id", "none", "v"))
    found = asked.groupBy(*keys).cogroup(shards.groupBy(*keys)).applyInPandas(search(positives, scale), SCHEMA)
    return materialise(merged(found, ["q_rid"], positives, most))


def slot_lists(valid: DataFrame, limits: DataFrame, k: int, share: int, scale: int) -> DataFrame:
    """q_rid, slot and its k best rows of other labels."""
    anchors = materialise(valid.filter("q").join(limits, F.col("rid") == F.col("q_rid")).drop("q_rid"))
    qgs, sgs = -(-anchors.count() // QUERY_GROUP) or 1, -(-valid.count() // SHARD_GROUP) or 1
    keys = ["dim", "qg", "sg"]
    asked = anchors.select(*_new("dim"), group_of(qgs, 1).alias("qg"), all_groups(sgs).alias("sg"), *_new("rid", "label", "limits", "v"))
    shards = valid.select(*_new("dim"), all_groups(qgs).alias("qg"), group_of(sgs, 2).alias("sg"), *_new("rid", "vec_id", "none", "label", "v"))
    found = asked.groupBy(*keys).cogroup(shards.groupBy(*keys)).applyInPandas(in_slots(k, share, scale), FOUND)
    return merged(found, ["q_rid", "slot"], k, sgs)


def suffixes(lists: DataFrame, positives: int, k: int) -> DataFrame:
    """q_rid and, from the lowest slot upward, the k best rows of each slot and all lower ones."""
    entry = F.struct((-F.col("score")).alias("lower"), "none", "vec_id", "rid")
    per_slot = lists.groupBy("q_rid", "slot").agg(F.array_sort(F.collect_list(entry)).alias("rows"))
    per_anchor = per_slot.groupBy("q_rid").agg(F.map_from_entries(F.collect_list(F.struct("slot", "rows"))).alias("rows"))
    none = F.array().cast(f"array<{ENTRY}>")
    upward = F.transform(F.sequence(F.lit(positives - 1), F.lit(0), F.lit(-1)), lambda j: F.coalesce(F.try_element_at("rows", j), none))
    above = lambda below, own: F.concat(below, F.array(F.slice(F.concat(own, F.element_at(below, -1)), 1, k)))
    return per_anchor.select("q_rid", F.aggregate(upward, F.array(none), above).alias("below"))


def hard_negatives(
    vectors: DataFrame, is_anchor: Column, k: int = K, positives: int = POSITIVES, share: int = SHARE, scale: int = SCALE,
    vec_id: str = "vec_id", vector: str = "embedding", label: Column | str = "label",
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score; is_anchor is a condition over the columns of vectors."""
    name = (F.col(label) if isinstance(label, str) else label).cast("string")
    valid = numbered(vectors.filter(name.isNotNull()), vec_id, vector, is_anchor, name.alias("label"))
    good = best_positives(valid, positives, scale).filter("score >= 0")
    limits = materialise(good.groupBy("q_rid").agg(F.sort_array(F.collect_set("score"), asc=False).alias("limits")))
    below = suffixes(slot_lists(valid, limits, k, share, scale), positives, k)
    asked = good.join(limits, "q_rid").select("q_rid", "query_id", "rid", "vec_id", "none", "score", (F.array_position("limits", F.col("score")) - 1).cast("int").alias("slot"))
    whole_number = "decimal(20,0)"
    admitted = lambda x: 100 * (-x["lower"]).cast(whole_number) >= share * F.col("score").cast(whole_number)
    window = F.filter(F.element_at("below", positives + 1 - F.col("slot")), admitted)
    rows = asked.join(below, "q_rid").select("query_id", "vec_id", "none", "score", F.posexplode(window).alias("at", "n"))
    known = lambda none, found: F.when(~none, found)
    return rows.select(
        F.col("query_id").alias("anchor_id"), known(F.col("none"), F.col("vec_id")).alias("positive_id"), (F.col("at") + 1).cast("int").alias("rank"),
        known(F.col("n.none"), F.col("n.vec_id")).alias("negative_id"), F.col("score").alias("positive_score"), (-F.col("n.lower")).alias("negative_score"),
    )


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    shifted = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 100 == 0, label=shifted)


OP11_SQL = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), p AS (
  SELECT a.vec_id AS a, b.vec_id AS b, a.label = b.label AS same, list_dot_product(a.e, b.e)::BIGINT AS score
  FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id
), g AS (
  SELECT a, b, score FROM p WHERE same QUALIFY row_number() OVER (PARTITION BY a ORDER BY score DESC, b) <= 5
)
SELECT g.a AS anchor_id, g.b AS positive_id, row_number() OVER (PARTITION BY g.a, g.b ORDER BY p.score DESC, p.b)::INT AS rank,
       p.b AS negative_id, g.score AS positive_score, p.score AS negative_score
FROM g JOIN p ON g.a = p.a AND NOT p.same AND 80 * g.score <= 100 * p.score AND p.score <= g.score
QUALIFY rank <= 5
"""
