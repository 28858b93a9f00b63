"""Exact percentiles without a task that holds all values of a group.

The built-in percentile gathers every distinct value of a group in one buffer. Here the distinct values of a group are
counted, cut into RANGES ranges by a sketch of fixed size, and only the counts of the ranges are summed in order. They
tell in which range the values at a percentile's rank lie; the values of those ranges alone are then put in order, each
range in a task of its own. The sketch decides how even the ranges are, never the result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RANGES = 128
ACCURACY = 2000


def percentiles(df: DataFrame, groups: list[str], value: str | Column, names: dict[str, float], *aggregates: Column) -> DataFrame:
    """groups, the aggregates, and for each name the percentile of that share, between two values by linear interpolation.

    Nulls are not counted; a group without values has NULL.
    """
    v = (F.col(value) if isinstance(value, str) else value).cast("double")
    key = F.struct(*groups) if groups else F.struct(F.lit(1).alias("_all"))
    counts = df.select(key.alias("_g"), v.alias("_v")).filter("_v IS NOT NULL").groupBy("_g", "_v").agg(F.count("*").alias("_c"))
    shares = F.array(*[F.lit(i / RANGES) for i in range(1, RANGES)])
    cuts = counts.groupBy("_g").agg(F.percentile_approx("_v", shares, ACCURACY).alias("_cuts"), F.sum("_c").alias("_n"))
    placed = counts.join(cuts.select("_g", "_cuts"), "_g").select("_g", "_v", "_c", F.size(F.filter("_cuts", lambda x: x < F.col("_v"))).alias("_range"))
    sums = placed.groupBy("_g", "_range").agg(F.sum("_c").alias("_in"))
    sums = sums.withColumn("_before", F.sum("_in").over(Window.partitionBy("_g").orderBy("_range")) - F.col("_in"))

    rank = lambda q: (F.col("_n") - 1) * F.lit(q)
    wanted = cuts.select("_g", F.explode(F.array_distinct(F.flatten(F.array(*[F.array(F.floor(rank(q)), F.ceil(rank(q))) for q in names.values()])))).alias("_rank"))
    wanted = wanted.join(sums, "_g").filter((F.col("_rank") >= F.col("_before")) & (F.col("_rank") < F.col("_before") + F.col("_in"))).select("_g", "_range", "_rank", "_before")
    needed = wanted.select("_g", "_range").distinct()
    upto = F.sum("_c").over(Window.partitionBy("_g", "_range").orderBy("_v"))
    ordered = placed.join(needed, ["_g", "_range"], "left_semi").withColumn("_upto", upto)
    at = F.col("_rank") - F.col("_before")
    found = wanted.join(ordered, ["_g", "_range"]).filter((at < F.col("_upto")) & (at >= F.col("_upto") - F.col("_c")))
    values = found.groupBy("_g").agg(F.map_from_entries(F.collect_list(F.struct("_rank", "_v"))).alias("_at"))  # at most two entries a percentile
    values = values.join(cuts.select("_g", "_n"), "_g")

    def between(q: float) -> Column:
        low, high = F.floor(rank(q)), F.ceil(rank(q))
        below, above = F.element_at("_at", low), F.element_at("_at", high)
        return F.when(low == high, below).otherwise((high - rank(q)) * below + (rank(q) - low) * above)

    values = values.select("_g", *[between(q).alias(name) for name, q in names.items()])
    base = df.withColumn("_g", key).groupBy("_g").agg(*(aggregates or [F.count("*").alias("_rows")]))
    out = base.join(values, "_g", "left").select(*[F.col("_g")[g].alias(g) for g in groups], *[c for c in base.columns if c not in ("_g", "_rows")], *names)
    if groups:
        return out
    # an empty table has one row of aggregates, too
    return df.agg(*(aggregates or [F.count("*").alias("_rows")])).drop("_rows").crossJoin(F.broadcast(values.agg(*[F.max(n).alias(n) for n in names])))
