"""Queries that split, sample and weigh pages and documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusforge.operators import sampling as X
from corpusforge.plans.corpus import ROWS, rows
from corpusforge.plans.metrics import SCORED, rounded, scored

Q, S = {}, {}


def query(name: str, sql: str | None = None):
    def add(f):
        Q[name] = f
        if sql:
            S[name] = sql
        return f

    return add


def docs(spark, d):
    return spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "lang", "source", "n_chars")


B100 = "(('0x' || substr(sha256({}), 1, 8))::BIGINT % 100)"


@query("domain_buckets", f"WITH {ROWS} SELECT page_id, {B100.format('site')} AS bucket, CASE WHEN {B100.format('site')} < 60 THEN 'train' WHEN {B100.format('site')} < 70 THEN 'calibration' WHEN {B100.format('site')} < 80 THEN 'validation' ELSE 'test' END AS split FROM r")
def _(spark, d):
    from corpusforge.functions import urls as U

    b = U.hash_bucket(F.col("site"))
    return rows(spark, d).select("page_id", b.alias("bucket"), U.split_of(b, (("train", 60), ("calibration", 70), ("validation", 80), ("test", 100))).alias("split"))


@query("rank_split", f"""WITH {ROWS}, g AS (SELECT DISTINCT site, sha256('repair:' || site) AS s FROM r), n AS (SELECT *, row_number() OVER (ORDER BY s, site) AS n, count(*) OVER () AS t FROM g),
  e AS (SELECT *, round_even(0.35 * t, 0) AS a, round_even(0.15 * t, 0) AS b FROM n) SELECT page_id, CASE WHEN n <= a THEN 'train' WHEN n <= a + b THEN 'calibration' WHEN n <= a + 2 * b THEN 'validation' ELSE 'test' END AS split FROM r JOIN e USING (site)""")
def _(spark, d):
    return X.rank_split(rows(spark, d), "site", "repair").select("page_id", "split")


@query("fraction_split", f"""WITH {ROWS}, g AS (SELECT DISTINCT site, substr(sha256('7:split:' || site), 1, 16) AS s FROM r WHERE label = 0), n AS (SELECT *, row_number() OVER (ORDER BY s, site) AS n, count(*) OVER () AS t FROM g),
  b AS (SELECT max(s) FILTER (WHERE n = round_even(0.6 * t, 0) + 1) AS c1, max(s) FILTER (WHERE n = round_even(0.8 * t, 0) + 1) AS c2 FROM n) SELECT page_id, CASE WHEN substr(sha256('7:split:' || site), 1, 16) < c1 THEN 'train' WHEN substr(sha256('7:split:' || site), 1, 16) < c2 THEN 'validation' ELSE 'test' END AS split FROM r, b""")
def _(spark, d):
    return X.fraction_split(rows(spark, d), "site", F.col("label") == 0, "7", (("train", 0.6), ("validation", 0.2), ("test", 0.2))).select("page_id", "split")


@query("group_split")
def _(spark, d):
    return X.group_split(rows(spark, d), "site", 42, (("train", 0.6), ("test", 0.4))).groupBy("split").agg(F.count("*").alias("n"), F.countDistinct("site").alias("n_sites"))


@query("balanced_split")
def _(spark, d):
    return X.balanced_split(docs(spark, d), "source", {"train": 0.7, "test": 0.3}).groupBy("split").agg(F.count("*").alias("n"))


@query("holdout_by_size", f"WITH {ROWS}, g AS (SELECT site, count(*) AS n FROM r GROUP BY site), c AS (SELECT site, n, sum(n) OVER (ORDER BY n DESC, site ROWS UNBOUNDED PRECEDING) - n AS before FROM g) SELECT page_id, before < 0.15::DOUBLE * (SELECT count(*) FROM r) AS held_out FROM r JOIN c USING (site)")
def _(spark, d):
    return X.holdout_by_size(rows(spark, d), "site").select("page_id", "held_out")


@query("stratified_split", "SELECT doc_id, row_number() OVER (PARTITION BY lang ORDER BY sha256(doc_id::VARCHAR), doc_id) <= floor(count(*) OVER (PARTITION BY lang) * 0.2::DOUBLE) AS test FROM documents")
def _(spark, d):
    return X.stratified_split(docs(spark, d), ["lang"], "doc_id").select("doc_id", "test")


@query("uniform_sample", "SELECT doc_id FROM documents ORDER BY sha256('s1' || doc_id::VARCHAR), doc_id LIMIT 100")
def _(spark, d):
    return X.sample(docs(spark, d), "doc_id", 100, "s1").select("doc_id")


def _quota(spark, d):
    sizes = docs(spark, d).groupBy("lang").agg(F.count("*").alias("size")).withColumn("hard", F.col("lang") == "es")
    return X.quotas(sizes, "lang", "size", "hard", 120)


#: Shares of 120 by size, the hard stratum boosted, largest remainders; no stratum is smaller than its share on these tables.
QUOTAS = """g AS (SELECT lang, count(*) AS size, lang = 'es' AS hard FROM documents GROUP BY lang), w AS (SELECT *, size * CASE WHEN hard THEN 1.25::DOUBLE ELSE 1.0::DOUBLE END AS w FROM g), q AS (SELECT *, w * 120 / sum(w) OVER () AS q FROM w),
b AS (SELECT *, least(floor(q), size)::BIGINT AS base FROM q), o AS (SELECT *, row_number() OVER (ORDER BY q - base DESC, lang) AS n, 120 - sum(base) OVER () AS short FROM b), quota AS (SELECT lang, size, base + CASE WHEN n <= short THEN 1 ELSE 0 END AS quota FROM o)"""


@query("quotas", f"WITH {QUOTAS} SELECT lang, size, quota FROM quota")
def _(spark, d):
    return _quota(spark, d).select("lang", "size", "quota")


@query("systematic", f"""WITH {QUOTAS}, r AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY n_chars, doc_id) - 1 AS r FROM documents),
  k AS (SELECT r.*, ceil((r + 1) * quota / size - 0.5::DOUBLE) - ceil(r * quota / size - 0.5::DOUBLE) >= 1 AS taken FROM r JOIN quota ON r.lang = quota.lang) SELECT lang, count(*) AS n, min(doc_id) AS first, sum(doc_id)::BIGINT AS total FROM k WHERE taken GROUP BY lang""")
def _(spark, d):
    return X.systematic(docs(spark, d), "lang", _quota(spark, d), "n_chars", "doc_id").groupBy("lang").agg(F.count("*").alias("n"), F.min("doc_id").alias("first"), F.sum("doc_id").alias("total"))


@query("cohort_quota", """WITH x AS (SELECT doc_id, lang, source, doc_id % 2 AS label FROM documents), c AS (SELECT *, row_number() OVER (PARTITION BY lang, label, source ORDER BY sha256(doc_id::VARCHAR), doc_id) AS dn FROM x), k AS (SELECT * FROM c WHERE dn <= 3),
  n AS (SELECT lang, least(count(*) FILTER (WHERE label = 0), count(*) FILTER (WHERE label = 1), 40) AS take FROM k GROUP BY lang), r AS (SELECT k.*, row_number() OVER (PARTITION BY lang, label ORDER BY sha256(doc_id::VARCHAR), doc_id) AS n FROM k) SELECT doc_id, r.lang, label FROM r JOIN n USING (lang) WHERE n <= take""")
def _(spark, d):
    df = docs(spark, d).withColumn("label", F.col("doc_id") % 2)
    return X.cohort_quota(df, "lang", "source", "doc_id", 3, 40).select("doc_id", "lang", "label")


@query("top_by_hash", "SELECT doc_id, lang, source FROM documents QUALIFY row_number() OVER (PARTITION BY lang, source ORDER BY sha256(doc_id::VARCHAR), doc_id) <= 2")
def _(spark, d):
    return X.top_by_hash(docs(spark, d), ["lang", "source"], "doc_id", 2).select("doc_id", "lang", "source")


@query("rare_first")
def _(spark, d):
    return X.rare_first(docs(spark, d), "lang", "source", "doc_id", {"en": 3, "es": 2, "fr": 2}).select("doc_id", "lang", "source")


@query("first_per_domain", f"WITH {ROWS}, f AS (SELECT site, page_id, row_number() OVER (PARTITION BY site ORDER BY page_id) AS n FROM r WHERE site NOT IN (SELECT site FROM r WHERE page_id % 40 = 0)) SELECT site, page_id FROM f WHERE n = 1 ORDER BY sha256(page_id::VARCHAR), page_id LIMIT 10")
def _(spark, d):
    df = rows(spark, d)
    return X.first_per_domain(df, "site", "page_id", "page_id", 10, df.filter("page_id % 40 = 0")).select("site", "page_id")


@query("capped_sample", "WITH k AS (SELECT doc_id, source FROM documents QUALIFY row_number() OVER (PARTITION BY source ORDER BY sha256(doc_id::VARCHAR), doc_id) <= 5) SELECT doc_id, source FROM k ORDER BY sha256(doc_id::VARCHAR), doc_id LIMIT 60")
def _(spark, d):
    return X.capped(docs(spark, d), "source", "doc_id", 5, 60).select("doc_id", "source")


@query("class_weights", f"WITH {SCORED} SELECT doc_id, round((count(*) OVER ()) / (2 * count(*) OVER (PARTITION BY label)), 9) AS weight FROM s")
def _(spark, d):
    return rounded(X.class_weights(scored(spark, d).drop("weight")).select("doc_id", "weight"))


@query("source_class_weights", f"WITH {SCORED}, n AS (SELECT label, source, count(*) AS n, count(*) OVER (PARTITION BY label) AS k FROM s GROUP BY label, source) SELECT doc_id, round(1 / (k * n), 9) AS weight FROM s JOIN n USING (label, source)")
def _(spark, d):
    return rounded(X.source_class_weights(scored(spark, d).drop("weight"), "source").select("doc_id", "weight"))


@query("domain_weights", f"WITH {SCORED}, n AS (SELECT label, source, count(*) AS n, count(*) OVER (PARTITION BY label) AS k FROM s GROUP BY label, source) SELECT doc_id, round((SELECT count(*) FROM s) / (2 * k) / n, 9) AS weight FROM s JOIN n USING (label, source)")
def _(spark, d):
    return rounded(X.domain_weights(scored(spark, d).drop("weight"), "source").select("doc_id", "weight"))


@query("capped_source_weights", f"WITH {SCORED} SELECT doc_id, round(CASE WHEN lang IN ('en', 'fr') THEN least(1, 0.5 * (SELECT count(*) FROM s WHERE label = 1) / count(*) OVER (PARTITION BY lang)) ELSE 1 END, 9) AS weight FROM s")
def _(spark, d):
    return rounded(X.capped_source_weights(scored(spark, d).drop("weight"), "lang", ["en", "fr"]).select("doc_id", "weight"))


QUERIES, ORACLE_SQL = Q, S
