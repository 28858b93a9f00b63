"""The Merkle fingerprint beside plain row comparison."""

from collections import Counter

from corpusforge.operators import merkle as K

COLUMNS = ["a", "b"]


def table(spark, rows):
    return spark.createDataFrame(rows, "a long, b string")


def test_tree_does_not_depend_on_partitions_and_tells_what_changed(spark, tmp_path):
    rows = [(i % 40, None if i % 7 == 0 else f"t{i % 11}") for i in range(300)] + [(1, "x")] * 50
    one = [tuple(r) for r in K.tree(table(spark, rows).coalesce(1), COLUMNS, 2).orderBy("level", "node").collect()]
    assert one == [tuple(r) for r in K.tree(table(spark, rows[::-1]).repartition(7), COLUMNS, 2).orderBy("level", "node").collect()]
    assert one[0][:2] == (0, "") and one[0][3] == len(rows)
    other = rows[1:-1] + [(2, "new"), (None, None), (1, "x,1:y")]
    want = Counter(other)
    want.subtract(rows)
    got = {(r.a, r.b): r.change for r in K.changes(table(spark, rows), table(spark, other), COLUMNS).collect()}
    assert got == {k: n for k, n in want.items() if n}
    for name, some in (("old", rows), ("new", other)):
        K.tree(table(spark, some), COLUMNS, 2).write.parquet(f"{tmp_path}/{name}")
    down = {r.node for r in K.changed_leaves(spark.read.parquet(f"{tmp_path}/old"), spark.read.parquet(f"{tmp_path}/new"), 2).collect()}
    leaf = lambda some: {r.node: r.digest for r in K.leaves(table(spark, some), COLUMNS, 2).collect()}
    a, b = leaf(rows), leaf(other)
    assert down == {n for n in a.keys() | b.keys() if a.get(n) != b.get(n)}
    # swaps of repeated rows, which sums and XOR miss, and parts that only look alike
    assert K.changes(table(spark, [(1, "p"), (1, "p"), (2, "q")]), table(spark, [(1, "p"), (2, "q"), (2, "q")]), COLUMNS).count() == 2
    assert K.changes(table(spark, [(1, "-")]), table(spark, [(1, None)]), COLUMNS).count() == 2
    assert K.changes(table(spark, []), table(spark, []), COLUMNS).count() == 0
