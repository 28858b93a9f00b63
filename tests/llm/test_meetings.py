from itertools import combinations

from pyspark.sql import functions as F

from corpusforge.llm import meetings as M
from corpusforge.llm.near_dedup import merged_labels


def table(spark, tokens):
    rows = [(t, i) for t, ids in tokens.items() for i in ids]
    return spark.createDataFrame(rows, "token long, id long"), spark.createDataFrame([(i,) for i in {i for _, i in rows}], "id long")


def none(spark):
    return spark.createDataFrame([], "node long, component long")


def pairs_tested(posts, at):
    """Pairs of rows that the join of a round tests: in each cell those outside the main component with all."""
    if at:
        posts = posts.filter(M.halvings(at - 1) > 0)
    cells = posts.groupBy("token", M.cell(at).alias("cell")).agg(F.count("*").alias("n"), F.count_if(~F.col("in_main")).alias("m"))
    return cells.agg(F.coalesce(F.sum(F.col("n") * F.col("m")), F.lit(0))).first()[0]


def test_every_pair_of_a_token_meets_once(spark, monkeypatch):
    monkeypatch.setattr(M, "CELL", 4)
    monkeypatch.setattr(M, "STEP", 2)
    tokens = {1: range(70), 2: range(60, 75), 3: (1, 100), 4: (200,)}
    posts, facts = table(spark, tokens)
    posts, seen = M.dealt(posts), []
    for at in range(M.rounds(posts)):
        posts = M.still_open(posts, none(spark))
        seen.append([tuple(r) for r in M.met(posts, facts, lambda x, y: F.lit(True), at).collect()])
    assert len(seen) > 2 and all(len(s) == len(set(s)) for s in seen)
    want = {p for ids in tokens.values() for p in combinations(sorted(ids), 2)}
    assert {p for s in seen for p in s} == want
    # of one token a pair meets in one round only
    of_one = [p for s in seen for p in s if p[1] < 60]
    assert len(of_one) == len(set(of_one)) == 60 * 59 // 2


def test_tests_grow_with_classes_that_links_join(spark):
    found = {}
    for n in (500, 1000, 2000):
        posts, facts = table(spark, {1: range(n), 2: range(0, n, 2)})
        posts, labels, found[n] = M.dealt(posts), none(spark), 0
        for at in range(M.rounds(posts)):
            posts = M.still_open(posts, labels)
            found[n] += pairs_tested(posts, at)
            labels = merged_labels(labels, M.materialise(M.met(posts, facts, lambda x, y: F.lit(True), at)))
        assert labels.select("component").distinct().count() == 1 and labels.count() == n
    assert found[2000] < 5 * found[500] and found[2000] < 150 * 2000  # all pairs would be 16 times as many


def test_pairs_of_one_component_do_not_meet(spark):
    posts, facts = table(spark, {1: range(40)})
    labels = spark.createDataFrame([(i, 0) for i in range(38)], "node long, component long")
    posts = M.still_open(M.dealt(posts), labels)
    got = {tuple(r) for r in M.met(posts, facts, lambda x, y: F.lit(True), M.rounds(posts) - 1).collect()}
    got |= {tuple(r) for at in range(M.rounds(posts) - 1) for r in M.met(posts, facts, lambda x, y: F.lit(True), at).collect()}
    assert got == {(i, j) for i in range(38) for j in (38, 39)} | {(38, 39)}
    assert M.still_open(posts.drop("component", "in_main"), spark.createDataFrame([(i, 0) for i in range(40)], "node long, component long")).isEmpty()
