"""Mixing sources to target weights by weighted sampling without replacement.

Every document gets the exponential key -ln(u) / w of Efraimidis and Spirakis: u is uniform and fixed by
the doc_id, w is the document's quality weight. A source whose target is e whole sizes and a remainder
takes all its documents e times (complete epochs), then the documents with the smallest keys until their
sizes add up to the remainder; the document on the boundary is taken if that comes nearer.

The prefix sums work in two levels, so that no task orders a whole source: keys fall into a number of
buckets that grows with the largest source; bucket totals say which bucket holds a source's boundary; only
that bucket is sorted. The result is one cut (key, doc_id, size) per source, and a document is taken if it
is not beyond its source's cut.

Quality weight: 0.5 plus the share of letters among the characters, so between 0.5 and 1.5.

Defined cases: null text has size 0; a null source is a source, last in order; a null doc_id has a key of
its own value and rows that agree in doc_id, source and size are taken together; documents of size 0 cost
nothing and follow their key; an empty table gives an empty table; further columns pass through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusforge.llm.common import WORDS, documents, materialise, rows_of, text_of

WEIGHTS = (5.0, 2.0, 1.0)
MOST_EPOCHS = 3
ROWS_PER_BUCKET = 2000


def words_in(text: str = "text") -> Column:
    return F.regexp_count(text_of(text), F.lit(WORDS)).cast("long")


def quality_weight(text: str = "text") -> Column:
    letters = F.length(F.regexp_replace(text_of(text), r"[^\p{L}]", ""))
    return F.lit(0.5) + letters / F.greatest(F.length(text_of(text)), F.lit(1))


def sampling_key(doc_id: str, weight: Column, seed: str = "mix") -> Column:
    """-ln(u) / weight with u in (0, 1) from 48 bits of a digest of doc_id."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(doc_id).cast("string"), F.lit(""))))
    u = (F.conv(F.substring(digest, 1, 12), 16, 10).cast("double") + 0.5) / float(2**48)
    return -F.log(u) / weight


def source_name(source: str) -> Column:
    """A source as a key that is never null."""
    return F.coalesce(F.concat(F.lit("s"), F.col(source).cast("string")), F.lit("n"))


def sized(docs: DataFrame, text: str, doc_id: str, source: str, weight: Column | None) -> list[Column]:
    return [
        F.col(doc_id).alias("doc_id"), source_name(source).alias("src"), words_in(text).alias("size"),
        sampling_key(doc_id, quality_weight(text) if weight is None else weight).alias("key"),
    ]


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: int = MOST_EPOCHS) -> DataFrame:
    """(src, rows, source_size, target): shares of all words by weight, none above ``most`` times its source.

    Filling up in closed form: in the order of most * size / weight, sources are capped until the level that
    the rest would share lies below the next cap. It works on one row per source.
    """
    sources = sizes.groupBy("src").agg(F.count("*").alias("rows"), F.sum("size").alias("source_size"))
    order = Window.orderBy(F.col("src") == "n", "src")
    pick = F.array(*[F.lit(float(w)) for w in weights])
    sources = sources.withColumn("weight", F.element_at(pick, (F.row_number().over(order) - 1) % len(weights) + 1))
    cap = F.col("source_size") * most
    by_ratio = Window.orderBy(cap / F.col("weight"), "src")
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    level = sources.withColumns({
        "capped": F.coalesce(F.sum(cap).over(before), F.lit(0)),
        "left": F.sum("weight").over(by_ratio.rowsBetween(Window.currentRow, Window.unboundedFollowing)),
        "total": F.sum("source_size").over(everything),
    }).withColumn("level", (F.col("total") - F.col("capped")) / F.col("left"))
    over = F.when(cap / F.col("weight") > F.col("level"), F.col("level"))
    level = level.withColumn("shared", F.first(over, ignorenulls=True).over(by_ratio.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    target = F.when(F.col("shared").isNull(), cap.cast("double")).otherwise(F.least(cap.cast("double"), F.col("weight") * F.col("shared")))
    return level.select("src", "rows", "source_size", target.alias("target"))


def cuts(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: int = MOST_EPOCHS, rows_per_bucket: int = ROWS_PER_BUCKET) -> DataFrame:
    """(src, source_size, target, epochs, cut): how often each source is taken whole, and its last taken (key, doc_id, size)."""
    plan = materialise(targets(sizes, weights, most).withColumn("epochs", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")))
    plan = plan.withColumn("remainder", F.col("target") - F.col("epochs") * F.col("source_size"))
    largest = plan.agg(F.max("rows")).first()[0] or 1
    buckets = -(-largest // rows_per_bucket)
    keyed = sizes.withColumn("bucket", F.least(bucket_of(buckets), F.lit(buckets - 1)))
    totals = keyed.groupBy("src", "bucket").agg(F.sum("size").alias("words"))
    upto = Window.partitionBy("src").orderBy("bucket")
    totals = totals.withColumn("before", F.sum("words").over(upto) - F.col("words"))
    # the bucket in which the sum passes the remainder: all before it are taken, none after it
    edge = totals.join(plan.select("src", "remainder"), "src").filter("before <= remainder")
    edge = edge.withColumn("last", F.max("bucket").over(Window.partitionBy("src"))).filter("bucket = last")
    edge = materialise(edge.select("src", "bucket", "before", "remainder"))
    inside = keyed.join(edge, ["src", "bucket"])
    order = Window.partitionBy("src", "bucket").orderBy("key", "doc_id", "size")
    inside = inside.withColumn("cum", F.col("before") + F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("size"))
    inside = inside.filter("2 * cum + size <= 2 * remainder")
    last = inside.groupBy("src").agg(F.max(F.struct("key", "doc_id", "size")).alias("cut"))
    edge = edge.select("src", F.col("bucket").alias("edge"), F.lit(buckets).alias("buckets"))
    return plan.join(last, "src", "left").join(edge, "src", "left").select("src", "source_size", "target", "epochs", "cut", "edge", "buckets")


def bucket_of(buckets: Column | int) -> Column:
    return F.floor((1 - F.exp(-F.col("key"))) * buckets)


def copies() -> Column:
    """How often a keyed row joined to its source's cut is taken; without a cut in the edge bucket, that is all buckets before it."""
    within = F.struct("key", "doc_id", "size") <= F.col("cut")
    below = bucket_of(F.col("buckets")) < F.col("edge")
    return F.col("epochs") + F.when(F.coalesce(within, below, F.lit(False)), 1).otherwise(0)


def mix_sizes(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", source: str = "source", weight: Column | None = None, **how) -> DataFrame:
    """One row per document: doc_id, size, source_size, target, taken."""
    sizes = materialise(docs.select(*sized(docs, text, doc_id, source, weight)))
    plan = materialise(cuts(sizes, **how))
    taken = (copies() * F.col("size")).cast("long")
    return sizes.join(plan, "src").select("doc_id", "size", "source_size", "target", taken.alias("taken"))


def mix(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", source: str = "source", weight: Column | None = None, **how) -> DataFrame:
    """The mixed corpus with the columns of docs: each document as many times as the mix takes it."""
    named = sized(docs, text, doc_id, source, weight)
    plan = materialise(cuts(materialise(docs.select(*named)), **how))
    rows = docs.select(rows_of(docs).alias("row"), *named).join(plan, "src")
    return rows.select("row", F.explode(F.array_repeat(F.lit(1), copies().cast("int")))).select("row.*")


def op2_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sizes(documents(spark, sf_dir))


OP2_SQL = r"""
WITH s AS (
  SELECT doc_id, coalesce('s' || source, 'n') AS src, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         -ln((('0x' || substr(md5('mix:' || coalesce(doc_id::VARCHAR, '')), 1, 12))::BIGINT::DOUBLE + 0.5) / 281474976710656.0)
           / (0.5 + length(regexp_replace(coalesce(text, ''), '[^\p{L}]', '', 'g')) / greatest(length(coalesce(text, '')), 1)) AS key
  FROM documents
), t AS (
  SELECT src, sum(size)::BIGINT AS source_size,
         [5.0::DOUBLE, 2.0::DOUBLE, 1.0::DOUBLE][1 + ((row_number() OVER (ORDER BY src = 'n', src) - 1) % 3)::INT] AS weight FROM s GROUP BY src
), l AS (
  SELECT *, (sum(source_size) OVER () - coalesce(sum(3 * source_size) OVER (ORDER BY 3 * source_size / weight, src ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
      / sum(weight) OVER (ORDER BY 3 * source_size / weight, src ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM t
), v AS (SELECT min_by(level, (3 * source_size / weight, src)) FILTER (WHERE 3 * source_size / weight > level) AS shared FROM l
), g AS (
  SELECT src, source_size, CASE WHEN shared IS NULL THEN 3.0::DOUBLE * source_size ELSE least(3.0::DOUBLE * source_size, weight * shared) END AS target FROM l, v
), e AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS epochs FROM g
), c AS (
  SELECT s.*, source_size, target, epochs, target - epochs * source_size AS remainder,
         sum(size) OVER (PARTITION BY src ORDER BY key, doc_id, size ROWS UNBOUNDED PRECEDING) - size AS cum FROM s JOIN e USING (src)
)
SELECT doc_id, size, source_size, target, (size * (epochs + CASE WHEN 2 * cum + size <= 2 * remainder THEN 1 ELSE 0 END))::BIGINT AS taken FROM c
"""
