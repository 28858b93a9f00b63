"""Pairs of classes that share a token, in rounds that grow, without forming all pairs of a token.

A token (a shingle, or a fragment's hash) may belong to very many classes, nearly all of which a few links join. So
they meet in rounds. In the first one each token's classes are dealt into cells of about CELL by a hash, before the
join, and only classes of one cell meet; every further round joins 2^STEP cells, the last one is the whole token.
Before each round the classes are labelled with the components found so far: tokens of one component drop out, and
classes of a token's largest component never meet each other. So tests grow with the classes while the links join
them; the pairs of classes that stay apart are all tested, once a token that they share.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusforge.llm.common import materialise

CELL, STEP = 32, 4


def dealt(posts: DataFrame) -> DataFrame:
    """posts (token, id and more) of tokens with several classes, and how many times a token's cells are halved at first."""
    sizes = posts.groupBy("token").agg(F.count("*").alias("m")).filter("m > 1")
    deep = F.greatest(F.lit(0).cast("long"), F.ceil(F.log2(F.col("m") / CELL)))
    return materialise(posts.join(sizes.select("token", deep.cast("int").alias("deep")), "token"))


def rounds(posts: DataFrame) -> int:
    return -(-(posts.agg(F.max("deep")).first()[0] or 0) // STEP) + 1


def still_open(posts: DataFrame, labels: DataFrame) -> DataFrame:
    """The posts of tokens that hold several components, with component and in_main, written."""
    posts = posts.drop("component", "in_main")
    known = posts.join(labels, posts["id"] == labels["node"], "left").select(*posts.columns, F.coalesce("component", "id").alias("component"))
    sizes = known.groupBy("token", "component").agg(F.count("*").alias("k"))
    largest = sizes.groupBy("token").agg(F.max_by("component", F.struct("k", "component")).alias("main"), F.count("*").alias("c")).filter("c > 1")
    return materialise(known.join(largest, "token").withColumn("in_main", F.col("component") == F.col("main")).drop("main", "c"))


def halvings(at: int) -> Column:
    return F.greatest(F.lit(0), F.col("deep") - STEP * at)


def cell(at: int) -> Column:
    """The cell of a post in round ``at``: cells of a round are unions of those of the round before."""
    return F.pmod(F.xxhash64("id", "token"), F.call_function("shiftleft", F.lit(1).cast("long"), halvings(at)))


def met(posts: DataFrame, facts: DataFrame, fits: Callable[[Callable[[str], Column], Callable[[str], Column]], Column], at: int) -> DataFrame:
    """(a, b): pairs of classes of different components that fit and first share a cell of a token in round ``at``.

    posts as still_open gives them; facts (id and more) are looked up for those in cells of several components; fits
    takes two functions, which name the columns of either side.
    """
    if at:
        posts = posts.filter(halvings(at - 1) > 0)  # the others have met as a whole
    posts = posts.withColumn("cell", cell(at)).withColumn("fine", cell(at - 1) if at else F.lit(None).cast("long"))
    several = posts.groupBy("token", "cell").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).filter("lo <> hi").select("token", "cell")
    posts = materialise(posts.join(several, ["token", "cell"]))
    more = posts.join(facts, "id")
    x, y = (more.select(*[F.col(c).alias(f"{c}_{s}") for c in more.columns]) for s in "xy")
    left, right = (lambda c: F.col(f"{c}_x")), (lambda c: F.col(f"{c}_y"))
    new = ~left("fine").eqNullSafe(right("fine")) if at else F.lit(True)
    once = right("in_main") | (left("id") < right("id"))
    meet = (left("token") == right("token")) & (left("cell") == right("cell")) & (left("component") != right("component")) & new & once
    found = x.filter("NOT in_main_x").join(y, meet & fits(left, right))
    return found.select(F.least("id_x", "id_y").alias("a"), F.greatest("id_x", "id_y").alias("b")).distinct()
