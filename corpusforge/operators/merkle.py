"""A fingerprint of a table as a Merkle tree over ranges of row digests: the same for any order and partitioning, and able to say where two tables differ.

Every row has the SHA-256 of its columns; equal rows are one entry with their number. A leaf is a range of digests (their
first ``depth`` hexadecimal digits) and has the digest of its entries in order; an inner node has that of its up to 16
children. Digests are even, so leaves are, too, whatever keys the rows have. A diff starts at the root and goes down
only into nodes whose digests differ; rows are compared in the leaves that are left.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DEPTH = 3


def row_digest(columns: list[str]) -> Column:
    """SHA-256 over the columns' texts, each with its length before it, so that no two rows give one text; a null has none."""
    text = lambda c: F.col(c).cast("string")
    part = lambda c: F.coalesce(F.concat(F.length(text(c)).cast("string"), F.lit(":"), text(c)), F.lit("-"))
    return F.sha2(F.concat_ws(",", *[part(c) for c in columns]), 256)


def entries(df: DataFrame, columns: list[str]) -> DataFrame:
    """(row_digest, copies) of the distinct rows."""
    return df.select(row_digest(columns).alias("row_digest")).groupBy("row_digest").agg(F.count("*").alias("copies"))


def _over(children: DataFrame, node: Column, name: Column) -> DataFrame:
    """Nodes over children, with the digest of their names in order."""
    listed = F.concat_ws(",", F.array_sort(F.collect_list(name)))
    return children.groupBy(node.alias("node")).agg(F.sha2(listed, 256).alias("digest"), F.sum("n").alias("n"))


def leaves(df: DataFrame, columns: list[str], depth: int = DEPTH) -> DataFrame:
    """(node, digest, n) of the leaves. Raise depth with the rows: a leaf orders rows / 16^depth entries."""
    found = entries(df, columns).withColumnRenamed("copies", "n")
    return _over(found, F.substring("row_digest", 1, depth), F.concat("row_digest", F.lit("="), F.col("n").cast("string")))


def tree(df: DataFrame, columns: list[str], depth: int = DEPTH) -> DataFrame:
    """(level, node, digest, n): all nodes, the root at level 0 as node ''."""
    level = leaves(df, columns, depth)
    out = level.select(F.lit(depth).alias("level"), "*")
    for at in range(depth - 1, -1, -1):
        level = _over(level, F.substring("node", 1, at), F.concat("node", F.lit("="), "digest"))
        out = out.unionByName(level.select(F.lit(at).alias("level"), "*"))
    return out


def changed_leaves(left: DataFrame, right: DataFrame, depth: int = DEPTH) -> DataFrame:
    """(node) of the leaves in which two written trees of one depth differ, found from the root down."""
    at = lambda side, n: side.filter(F.col("level") == n).select("node", "digest")
    open_nodes = None
    for n in range(depth + 1):
        a, b = at(left, n), at(right, n)
        if open_nodes is not None:
            a, b = (x.join(open_nodes, F.substring("node", 1, n - 1) == F.col("above"), "left_semi") for x in (a, b))
        both = a.select("node", F.col("digest").alias("a")).join(b.select("node", F.col("digest").alias("b")), "node", "full")
        differing = both.filter(~F.col("a").eqNullSafe(F.col("b")))
        open_nodes = differing.select(F.col("node").alias("above"))
    return open_nodes.withColumnRenamed("above", "node")


def changes(before: DataFrame, after: DataFrame, columns: list[str], depth: int = DEPTH) -> DataFrame:
    """columns, and change (how many more copies of the row after than before), of the rows that differ in number."""
    a, b = (leaves(x, columns, depth).select("node", F.col("digest").alias(name)) for x, name in ((before, "a"), (after, "b")))
    differing = a.join(b, "node", "full").filter(~F.col("a").eqNullSafe(F.col("b"))).select("node")

    def within(df: DataFrame, sign: int) -> DataFrame:
        rows = df.select(*columns, row_digest(columns).alias("_d"), F.lit(sign).alias("_s"))
        return rows.join(differing, F.substring("_d", 1, depth) == F.col("node"), "left_semi")

    both = within(after, 1).unionByName(within(before, -1))
    return both.groupBy("_d").agg(*[F.first(c).alias(c) for c in columns], F.sum("_s").alias("change")).filter("change <> 0").drop("_d")
