"""Queries that build and audit a corpus.

pages stand for labelled URLs: source is page_id modulo 3, label is 1 where the host's first letter is under
n, the duplicate key is the host. documents stand for texts with exact copies.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusforge.functions import cohorts as C
from corpusforge.operators import corpus as O
from corpusforge.operators import merkle
from corpusforge.plans.urls import SPLIT, TAGS_SQL, canonical

PRIORITY = ["beta", "alpha", "gamma"]


def rows(spark, sf_dir):
    source = F.element_at(F.array(F.lit("alpha"), F.lit("beta"), F.lit("gamma")), (F.col("page_id") % 3 + 1).cast("int"))
    first = F.regexp_extract("analysis_url", "^[a-z]+://([^/?#]*)", 1)
    return canonical(spark, sf_dir).withColumn("source", source).withColumn("site", first).withColumn("label", F.when(F.col("page_id") % 7 < 2, 1).otherwise(0))


ROWS = f"""{SPLIT}, r AS (SELECT *, ['alpha', 'beta', 'gamma'][page_id % 3 + 1] AS source, regexp_replace(host, '^www\\.', '') AS site, CASE WHEN page_id % 7 < 2 THEN 1 ELSE 0 END AS label,
  CASE page_id % 3 WHEN 1 THEN 0 WHEN 0 THEN 1 ELSE 2 END AS priority FROM u)"""

Q, S = {}, {}


def query(name: str, sql: str | None = None):
    def add(f):
        Q[name] = f
        if sql:
            S[name] = sql
        return f

    return add


@query("keep_first", f"WITH {ROWS} SELECT site, page_id, source, label FROM r QUALIFY row_number() OVER (PARTITION BY site ORDER BY page_id) = 1")
def _(spark, d):
    return O.keep_first(rows(spark, d), ["site"], "page_id").select("site", "page_id", "source", "label")


@query("keep_best", f"WITH {ROWS} SELECT site, page_id, source, label FROM r QUALIFY row_number() OVER (PARTITION BY site ORDER BY priority, page_id) = 1")
def _(spark, d):
    return O.keep_best(rows(spark, d), ["site"], "source", PRIORITY, "page_id").select("site", "page_id", "source", "label")


@query("drop_conflicts", f"WITH {ROWS} SELECT page_id, site, label FROM r QUALIFY min(label) OVER (PARTITION BY site) = max(label) OVER (PARTITION BY site)")
def _(spark, d):
    return O.drop_conflicts(rows(spark, d), ["site"]).select("page_id", "site", "label")


@query("conflicts", f"WITH {ROWS} SELECT site, count(*) AS n_rows, list_sort(list(DISTINCT label)) AS labels FROM r GROUP BY site HAVING count(DISTINCT label) > 1")
def _(spark, d):
    return O.conflicts(rows(spark, d), ["site"])


@query("merge_membership", f"WITH {ROWS} SELECT site, arg_min(page_id, (priority, page_id)) AS page_id, arg_min(label, (priority, page_id)) AS label, list_sort(list(DISTINCT source)) AS memberships FROM r GROUP BY site")
def _(spark, d):
    return O.merge_membership(rows(spark, d), "site", "source", PRIORITY, "page_id", ["page_id", "label"])


@query("membership_filter", f"WITH {ROWS}, m AS (SELECT site, list_sort(list(DISTINCT source)) AS memberships FROM r GROUP BY site) SELECT site FROM m WHERE list_contains(memberships, 'gamma')")
def _(spark, d):
    merged = O.merge_membership(rows(spark, d), "site", "source", PRIORITY, "page_id", ["label"])
    return merged.filter(F.array_contains("memberships", "gamma")).select("site")


@query("incremental", f"""WITH {ROWS}, k AS (SELECT DISTINCT site FROM r WHERE source = 'gamma'), n AS (SELECT *, row_number() OVER (PARTITION BY site ORDER BY page_id) AS n FROM r WHERE source <> 'gamma')
  SELECT source, CASE WHEN site IN (SELECT site FROM k) THEN 'existing' WHEN n > 1 THEN 'duplicate' ELSE 'added' END AS outcome, count(*) AS n FROM n GROUP BY 1, 2""")
def _(spark, d):
    df = rows(spark, d)
    return O.incremental(df.filter("source <> 'gamma'"), "site", "page_id", df.filter("source = 'gamma'")).groupBy("source", "outcome").agg(F.count("*").alias("n"))


@query("duplicate_examples", f"WITH {ROWS}, w AS (SELECT site, first(url) OVER (PARTITION BY site ORDER BY page_id) AS first, url AS duplicate, page_id AS line, row_number() OVER (PARTITION BY site ORDER BY page_id) AS n FROM r) SELECT site, first, duplicate, line FROM w WHERE n > 1 ORDER BY line LIMIT 20")
def _(spark, d):
    return O.duplicate_examples(rows(spark, d), "site", "url", "page_id")


@query("uniqueness", f"WITH {ROWS} SELECT count(*) AS n_rows, count(DISTINCT url) AS n_raw, count(DISTINCT lower(url)) AS n_folded, count(DISTINCT normalized_url) AS n_normalized, count(DISTINCT analysis_url) AS n_analysis FROM r")
def _(spark, d):
    return O.uniqueness(rows(spark, d), raw=F.col("url"), folded=F.lower("url"), normalized=F.col("normalized_url"), analysis=F.col("analysis_url"))


@query("staged_dedup", r"""WITH e AS (SELECT doc_id, text, lower(text) AS folded, row_number() OVER (PARTITION BY text ORDER BY doc_id) AS e FROM documents),
  n AS (SELECT *, row_number() OVER (PARTITION BY folded, e > 1 ORDER BY doc_id) AS n FROM e) SELECT doc_id, CASE WHEN e > 1 THEN 'exact_duplicate' WHEN n > 1 THEN 'normalized_duplicate' ELSE 'kept' END AS stage FROM n""")
def _(spark, d):
    docs = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", F.sha2("text", 256).alias("exact"), F.sha2(F.lower("text"), 256).alias("folded"))
    return O.staged_dedup(docs, "exact", "folded", "doc_id").select("doc_id", "stage")


@query("row_distinct", "SELECT DISTINCT lang, source FROM documents")
def _(spark, d):
    return spark.read.parquet(f"{d}/documents.parquet").select("lang", "source").distinct()


@query("source_overlap", f"WITH {ROWS} SELECT page_id, site, 'overlap' AS part FROM r WHERE source = 'alpha' AND site IN (SELECT site FROM r WHERE source = 'beta') UNION ALL SELECT page_id, site, 'remainder' FROM r WHERE source = 'alpha' AND site NOT IN (SELECT site FROM r WHERE source = 'beta')")
def _(spark, d):
    df = rows(spark, d)
    a, b = (df.filter(F.col("source") == s) for s in ("alpha", "beta"))
    part = lambda x, name: x.select("page_id", "site", F.lit(name).alias("part"))
    return part(O.overlap(a, b, "site"), "overlap").unionByName(part(O.remainder(a, b, "site"), "remainder"))


@query("reserved_domains", f"WITH {ROWS} SELECT page_id FROM r WHERE registered_domain NOT IN (SELECT registered_domain FROM r WHERE page_id % 50 = 0)")
def _(spark, d):
    df = rows(spark, d)
    return O.remainder(df, df.filter("page_id % 50 = 0"), "registered_domain").select("page_id")


@query("key_sets", f"WITH {ROWS}, a AS (SELECT site FROM r WHERE source = 'alpha'), b AS (SELECT site FROM r WHERE source = 'beta') SELECT 'both' AS part, site FROM (SELECT site FROM a INTERSECT SELECT site FROM b) UNION ALL SELECT 'only_first', site FROM (SELECT site FROM a EXCEPT SELECT site FROM b)")
def _(spark, d):
    df = rows(spark, d)
    a, b = (df.filter(F.col("source") == s).select("site") for s in ("alpha", "beta"))
    return a.intersect(b).select(F.lit("both").alias("part"), "site").union(a.distinct().exceptAll(b.distinct()).select(F.lit("only_first"), "site"))


@query("cross_class", f"""WITH {ROWS}, f AS (SELECT *, min(label) OVER (PARTITION BY site) <> max(label) OVER (PARTITION BY site) AS s, min(label) OVER (PARTITION BY registered_domain) <> max(label) OVER (PARTITION BY registered_domain) AS g FROM r)
  SELECT page_id, CASE WHEN s AND label = 0 THEN 'url' WHEN g THEN 'domain' END AS conflict FROM f""")
def _(spark, d):
    return O.cross_class(rows(spark, d), "site", "registered_domain").select("page_id", "conflict")


@query("skip_list", f"""WITH {ROWS}, n AS (SELECT *, row_number() OVER (PARTITION BY site ORDER BY page_id) AS n FROM r) SELECT page_id, CASE WHEN site IN (SELECT site FROM r WHERE page_id % 11 = 0) THEN 'already_used'
  WHEN site IN (SELECT site FROM r WHERE page_id % 13 = 0) THEN 'reserved' WHEN n > 1 THEN 'duplicate' ELSE 'approved' END AS decision FROM n""")
def _(spark, d):
    df = rows(spark, d)
    return O.skip_list(df, "site", "page_id", df.filter("page_id % 11 = 0"), df.filter("page_id % 13 = 0")).select("page_id", "decision")


@query("enrich", f"WITH {ROWS}, k AS (SELECT site, min(page_id) AS first_page FROM r WHERE source = 'beta' GROUP BY site) SELECT page_id, first_page, k.site IS NOT NULL AS matched FROM r LEFT JOIN k USING (site)")
def _(spark, d):
    df = rows(spark, d)
    lookup = df.filter("source = 'beta'").groupBy("site").agg(F.min("page_id").alias("first_page"))
    return O.enrich(df, lookup, "site", ["first_page"]).select("page_id", "first_page", "matched")


@query("group_overlap", f"WITH {ROWS}, k AS (SELECT DISTINCT source, site FROM r) SELECT a.source AS left_group, b.source AS right_group, count(*) AS n_shared FROM k a JOIN k b ON a.site = b.site AND a.source < b.source GROUP BY 1, 2")
def _(spark, d):
    return O.group_overlap(rows(spark, d), "source", "site")


@query("category_urls", f"""WITH {ROWS}, c AS (SELECT source || ':' || registered_domain AS category, * FROM r)
  SELECT DISTINCT a.category, 'https://' || a.site || b.path AS url FROM (SELECT DISTINCT category, site FROM c WHERE label = 1) a JOIN (SELECT DISTINCT category, path FROM c) b ON a.category = b.category""")
def _(spark, d):
    df = rows(spark, d).withColumn("category", F.concat_ws(":", "source", "registered_domain"))
    paths = df.select("category", F.regexp_extract("url", "^[a-z]+://[^/?#]*([^?#]*)", 1).alias("path"))
    return O.category_urls(df.filter("label = 1").select("category", F.col("site").alias("domain")).distinct(), paths.distinct())


@query("label_sets", f"WITH {ROWS}, g AS (SELECT source, list_sort(list(DISTINCT label)) AS labels FROM r GROUP BY source), e AS (SELECT *, CASE source WHEN 'alpha' THEN [0, 1] WHEN 'beta' THEN [1] END AS expected FROM g) SELECT source, labels, expected, coalesce(labels = expected, false) AS ok FROM e")
def _(spark, d):
    return O.label_sets(rows(spark, d), "source", {"alpha": [0, 1], "beta": [1]})


@query("official_hosts", f"WITH {ROWS} SELECT page_id, host = 'example.org' OR ends_with(host, '.example.org') OR host = 'example.net' OR ends_with(host, '.example.net') AS official FROM r")
def _(spark, d):
    return rows(spark, d).select("page_id", O.official(F.col("host"), ["example.org", "example.net"]).alias("official"))


@query("official_urls", """
WITH v AS (SELECT page_id, regexp_extract(url, '://([^/?#]*)', 1) AS host, regexp_replace(url, '^[a-z]+://[^/?#]*', '') AS rest FROM pages)
SELECT page_id, CASE WHEN page_id % 6 IN (1, 3, 5) AND (host = 'example.org' OR ends_with(host, '.example.org')) THEN 'https://' || host || CASE WHEN page_id % 6 = 5 THEN ':8443' ELSE '' END || CASE WHEN starts_with(rest, '/') THEN '' ELSE '/' END || rest END AS official FROM v
""")
def _(spark, d):
    host, rest = F.regexp_extract("url", "://([^/?#]*)", 1), F.regexp_replace("url", "^[a-z]+://[^/?#]*", "")
    kind = F.col("page_id") % 6
    before = F.when(kind == 0, "http://").when(kind == 1, "  HTTPS://").when(kind == 2, "https://user:secret@").when(kind == 4, "https://not").otherwise("https://")
    port = F.when(kind == 3, ":443").when(kind == 5, ":8443").when(kind == 4, ".org").otherwise("")
    name = F.when(kind == 1, F.upper(host)).when(kind == 4, F.replace(host, F.lit("."), F.lit("-"))).otherwise(host)
    url = F.concat(before, name, port, rest, F.when(kind == 1, " ").otherwise(""))
    return spark.read.parquet(f"{d}/pages.parquet").select("page_id", O.official_url(url, ["example.org"]).alias("official"))


@query("preparation_report", f"WITH {ROWS} SELECT source, count(*) AS n_rows, 0::BIGINT AS n_invalid, count(DISTINCT normalized_url) AS n_normalized, count(DISTINCT analysis_url) AS n_analysis, count(*) FILTER (WHERE label = 0) AS n_legitimate, count(*) FILTER (WHERE label = 1) AS n_phishing, count(DISTINCT registered_domain) AS n_domains FROM r GROUP BY source")
def _(spark, d):
    return O.preparation_report(rows(spark, d), "source", "normalized_url", "analysis_url", "registered_domain", "reject_reason")


@query("split_summary", f"WITH {ROWS} SELECT CASE WHEN ('0x' || substr(sha256(site), 1, 8))::BIGINT % 100 < 70 THEN 'train' ELSE 'test' END AS split, count(*) AS n_rows, count(*) FILTER (WHERE label = 0) AS n_legitimate, count(*) FILTER (WHERE label = 1) AS n_phishing, count(DISTINCT site) AS n_domains, list_sort(list(DISTINCT source)) AS sources, n_legitimate > 0 AND n_phishing > 0 AS both_classes FROM r GROUP BY 1")
def _(spark, d):
    from corpusforge.functions import urls as U

    df = rows(spark, d).withColumn("split", U.split_of(U.hash_bucket(F.col("site")), (("train", 70), ("test", 100))))
    return O.split_summary(df, "split", "site", "source")


def _tagged(spark, d):
    return C.tagged(rows(spark, d), "basic")


TAGGED = f"{ROWS}, tg AS (SELECT *, list_filter([" + ", ".join(f"CASE WHEN {c} THEN '{t}' END" for t, c in TAGS_SQL["basic"]) + "], lambda x: x IS NOT NULL) AS tags FROM r)"


@query("structure_rates", f"WITH {TAGGED} SELECT source, label, count(*) AS n_rows, round(avg(list_contains(tags, 'query')::INT), 9) AS rate_query, round(avg(list_contains(tags, 'fragment')::INT), 9) AS rate_fragment, quantile_cont(length(url), 0.5) AS median_n FROM tg GROUP BY source, label")
def _(spark, d):
    df = _tagged(spark, d).withColumn("n", F.length("url"))
    out = O.structure_rates(df, ["source", "label"], "tags", ["query", "fragment"], ["n"])
    return out.withColumns({c: F.round(c, 9) for c in ("rate_query", "rate_fragment")})


@query("tag_counts", f"WITH {TAGGED}, x AS (SELECT label, unnest(tags) AS tag FROM tg), n AS (SELECT label, count(*) AS total FROM tg GROUP BY label) SELECT tag, label, count(*) AS n, round(100 * count(*) / any_value(total), 6) AS pct FROM x JOIN n USING (label) GROUP BY tag, label")
def _(spark, d):
    return O.tag_counts(_tagged(spark, d), "tags")


@query("tag_overlap", f"WITH {TAGGED}, x AS (SELECT page_id, label, unnest(tags) AS tag FROM tg) SELECT a.tag AS first, b.tag AS second, a.label AS label, count(*) AS n FROM x a JOIN x b ON a.page_id = b.page_id AND a.tag <= b.tag GROUP BY 1, 2, 3")
def _(spark, d):
    return O.tag_overlap(_tagged(spark, d), "tags")


@query("required_tags", f"WITH {TAGGED}, w AS (SELECT unnest(['query', 'encoded', 'fragment']) AS tag), x AS (SELECT tag, count(*) AS n FROM (SELECT unnest(tags) AS tag FROM tg) GROUP BY tag) SELECT tag, coalesce(n, 0) AS n, n IS NULL AS missing FROM w LEFT JOIN x USING (tag)")
def _(spark, d):
    return O.required_tags(_tagged(spark, d), "tags", ["query", "encoded", "fragment"])


@query("claimed_counts", f"WITH {TAGGED}, x AS (SELECT tag, count(*) AS n FROM (SELECT unnest(tags) AS tag FROM tg) GROUP BY tag), c AS (SELECT * FROM (VALUES ('query', 10::BIGINT), ('encoded', 5)) v(tag, claimed)) SELECT tag, coalesce(n, 0) AS n, claimed, n IS NULL AS missing, coalesce(n, 0) - coalesce(claimed, 0) AS difference FROM x FULL JOIN c USING (tag)")
def _(spark, d):
    observed = _tagged(spark, d).select(F.explode("tags").alias("tag")).groupBy("tag").agg(F.count("*").alias("n"))
    return O.claimed_counts(observed, spark.createDataFrame([("query", 10), ("encoded", 5)], "tag string, claimed long"))


@query("mixed_domains", f"WITH {ROWS} SELECT site, count(*) FILTER (WHERE label = 0) AS n_legitimate, count(*) FILTER (WHERE label = 1) AS n_phishing FROM r GROUP BY site HAVING n_legitimate > 0 AND n_phishing > 0")
def _(spark, d):
    return O.mixed_domains(rows(spark, d), "site")


@query("top_domains", f"WITH {ROWS} SELECT site, count(*) AS n_rows FROM r GROUP BY site ORDER BY n_rows DESC, site LIMIT 10")
def _(spark, d):
    return O.top_domains(rows(spark, d), "site")


@query("admissibility", f"""WITH {ROWS}, v AS (SELECT source, CASE WHEN source = 'alpha' THEN label::VARCHAR WHEN source = 'beta' THEN '0' WHEN page_id % 2 = 0 THEN 'x' ELSE '0' END AS raw FROM r)
  SELECT source, count(*) AS n_rows, CASE source WHEN 'alpha' THEN 'labels_not_all_zero' WHEN 'beta' THEN 'valid' ELSE 'non_integer_labels' END AS status FROM v GROUP BY source UNION ALL SELECT 'delta', 0, 'missing'""")
def _(spark, d):
    raw = F.when(F.col("source") == "alpha", F.col("label").cast("string")).when((F.col("source") == "gamma") & (F.col("page_id") % 2 == 0), "x").otherwise("0")
    expected = spark.createDataFrame([(x,) for x in ("alpha", "beta", "gamma", "delta")], "source string")
    return O.admissibility(rows(spark, d).withColumn("raw", raw), "source", "url", "raw", expected)


#: The shapes of observation, by page_id: 0 to 8 break a rule each, or none; the SQL restates the rules for them.
OBSERVED = """o AS (SELECT page_id, page_id % 9 AS k, 'https://' || host || path AS good, registered_domain AS dom FROM u),
n AS (SELECT *, CASE k WHEN 1 THEN NULL ELSE good END AS url, CASE k WHEN 2 THEN good || '/x' ELSE good END AS normalized_url, CASE k WHEN 3 THEN 1 ELSE 0 END AS label, CASE k WHEN 4 THEN 'evil' || dom ELSE dom END AS registered_domain,
  CASE k WHEN 5 THEN 'https://evil' || dom || '/' WHEN 6 THEN 'http://www.' || dom || '/a?b#c' ELSE 'https://' || dom || '/' END AS source_page_url, CASE k WHEN 7 THEN 'http_404_elsewhere' WHEN 8 THEN 'done' ELSE 'http_200_same_registered_domain' END AS status FROM o)"""


@query("provenance", f"""WITH {SPLIT}, {OBSERVED} SELECT page_id, CASE k WHEN 1 THEN ['missing:url'] WHEN 2 THEN ['not_normalized'] WHEN 3 THEN ['label_not_zero'] WHEN 4 THEN ['domain_mismatch'] WHEN 5 THEN ['leaves_first_party_domain'] WHEN 6 THEN ['not_https']
  WHEN 7 THEN ['not_2xx', 'not_same_domain'] WHEN 8 THEN ['malformed'] ELSE []::VARCHAR[] END AS errors FROM n""")
def _(spark, d):
    k = F.col("page_id") % 9
    pages = spark.read.parquet(f"{d}/pages.parquet").select("page_id", F.regexp_extract_all("url", F.lit("^[a-z]+://([^/?#]*)"), 1)[0].alias("host"), F.regexp_extract("url", "^[a-z]+://[^/?#]*([^?#]*)", 1).alias("path"))
    pages = pages.select("page_id", F.concat(F.lit("https://"), "host", "path").alias("good"), F.regexp_extract("host", r"([^.]*\.[^.]*)$", 1).alias("dom"))
    good, dom = F.col("good"), F.col("dom")
    rows_ = pages.select(
        "page_id", F.when(k != 1, good).alias("url"), F.when(k == 2, F.concat(good, F.lit("/x"))).otherwise(good).alias("normalized_url"), F.when(k == 3, 1).otherwise(0).alias("label"),
        F.when(k == 4, F.concat(F.lit("evil"), dom)).otherwise(dom).alias("registered_domain"), F.when(k == 5, F.concat(F.lit("https://evil"), dom, F.lit("/"))).when(k == 6, F.concat(F.lit("http://www."), dom, F.lit("/a?b#c"))).otherwise(F.concat(F.lit("https://"), dom, F.lit("/"))).alias("source_page_url"),
        good.alias("verified_final_url"), F.when(k == 7, "http_404_elsewhere").when(k == 8, "done").otherwise("http_200_same_registered_domain").alias("verification_status"), F.lit("pages").alias("source"),
        F.lit("observed").alias("collection_method"), F.lit("text/html").alias("verified_content_type"), F.lit("2024-05-06").alias("collection_date"), F.lit("seen on a page").alias("provenance"),
    )
    return O.provenance_errors(rows_).select("page_id", "errors")


@query("remove_overlaps", f"""WITH {ROWS}, e AS (SELECT DISTINCT site FROM r WHERE label = 1), h AS (SELECT DISTINCT site FROM r WHERE source = 'gamma'), n AS (SELECT page_id, site, site IN (FROM e) AS old, site IN (FROM h) AS held FROM r WHERE source = 'alpha')
  SELECT count(*) AS n_rows, count(*) FILTER (WHERE old) AS removed_existing, count(*) FILTER (WHERE held AND NOT old) AS removed_holdout, count(*) FILTER (WHERE NOT old AND NOT held) AS kept FROM n""")
def _(spark, d):
    df = rows(spark, d)
    return O.remove_overlaps(df.filter("source = 'alpha'"), "site", df.filter("label = 1"), df.filter("source = 'gamma'"))[1]


@query("remaining_rows", f"WITH {ROWS} SELECT page_id, site FROM r WHERE source = 'alpha' AND site NOT IN (SELECT site FROM r WHERE label = 1 AND source = 'beta') AND site NOT IN (SELECT site FROM r WHERE label = 1 AND source = 'gamma')")
def _(spark, d):
    df = rows(spark, d)
    return O.remove_overlaps(df.filter("source = 'alpha'"), "site", df.filter("label = 1 AND source = 'beta'"), df.filter("label = 1 AND source = 'gamma'"))[0].select("page_id", "site")


@query("identity_guard", f"WITH {ROWS} SELECT min(page_id) AS page_id, normalized_url FROM r WHERE label = 0 AND analysis_url NOT IN (SELECT analysis_url FROM r WHERE label = 1) GROUP BY normalized_url")
def _(spark, d):
    df = rows(spark, d)
    kept, _ = O.identity_guard(df.filter("label = 0"), df.filter("label = 1"), "analysis_url", "normalized_url", "page_id")
    return kept.select("page_id", "normalized_url")


@query("composition", f"""WITH {ROWS}, k AS (SELECT CASE WHEN ('0x' || substr(sha256(site), 1, 8))::BIGINT % 100 < 70 THEN 'train' ELSE 'test' END AS split, source AS category, count(*) AS n_rows FROM r GROUP BY 1, 2),
  q AS (SELECT split, category, 1000 AS quota FROM (VALUES ('train'), ('test')) a(split), (VALUES ('alpha'), ('beta'), ('none')) b(category)) SELECT split, category, coalesce(n_rows, 0) AS n_rows, quota, greatest(coalesce(quota, 0) - coalesce(n_rows, 0), 0) AS shortfall FROM k FULL JOIN q USING (split, category)""")
def _(spark, d):
    from corpusforge.functions import urls as U

    df = rows(spark, d).withColumn("split", U.split_of(U.hash_bucket(F.col("site")), (("train", 70), ("test", 100))))
    return O.composition(df, "split", "source", spark.createDataFrame([(a, b, 1000) for a in ("train", "test") for b in ("alpha", "beta", "none")], "split string, category string, quota int"))


@query("readiness", f"""WITH {TAGGED}, a AS (SELECT *, CASE page_id % 4 WHEN 0 THEN 'http_200_ok' WHEN 1 THEN 'got HTTP_404' WHEN 2 THEN 'http_301' ELSE 'none' END AS status FROM tg WHERE source <> 'beta'), b AS (SELECT site, analysis_url FROM tg WHERE source = 'beta')
  SELECT count(*) AS n_rows, count(DISTINCT analysis_url) AS n_urls, count(DISTINCT site) AS n_domains, count(*) FILTER (WHERE page_id % 4 = 0) AS n_2xx, count(*) FILTER (WHERE page_id % 4 = 2) AS n_3xx, count(*) FILTER (WHERE page_id % 4 = 1) AS n_4xx, 0::BIGINT AS n_5xx,
    count(*) FILTER (WHERE page_id % 4 = 3) AS n_without_status, count(DISTINCT analysis_url) FILTER (WHERE analysis_url IN (SELECT analysis_url FROM b)) AS overlapping_urls, count(DISTINCT site) FILTER (WHERE site IN (SELECT site FROM b)) AS overlapping_domains,
    list_sort(list_filter(['absent', 'query'], lambda t: NOT coalesce(list_contains(flatten(list(tags)), t), false))) AS missing_tags FROM a""")
def _(spark, d):
    df = _tagged(spark, d).withColumn("status", F.element_at(F.array(F.lit("http_200_ok"), F.lit("got HTTP_404"), F.lit("http_301"), F.lit("none")), (F.col("page_id") % 4 + 1).cast("int")))
    return O.readiness(df.filter("source <> 'beta'"), df.filter("source = 'beta'"), ["absent", "query"], "analysis_url", "site", "tags", "status")


@query("fingerprint")
def _(spark, d):
    return O.fingerprint(rows(spark, d), ["registered_domain", "url", "label"], ["source"])


@query("reject_counts", "SELECT CASE WHEN page_id % 5 = 0 THEN 'invalid_url' WHEN page_id % 5 = 1 THEN 'unsupported_scheme' ELSE 'kept' END AS reason, count(*) AS n FROM pages GROUP BY 1")
def _(spark, d):
    from corpusforge.functions import urls as U

    raw = F.when(F.col("page_id") % 5 == 0, F.concat(F.col("url"), F.lit(" x"))).when(F.col("page_id") % 5 == 1, F.regexp_replace("url", "^https?", "ftp")).otherwise(F.col("url"))
    df = U.normalize(spark.read.parquet(f"{d}/pages.parquet").select("page_id", raw.alias("url")))
    return df.groupBy(F.coalesce("reject_reason", F.lit("kept")).alias("reason")).agg(F.count("*").alias("n"))


MERKLE = """
WITH d AS (
  SELECT sha256(concat_ws(',', length(page_id::VARCHAR) || ':' || page_id, length(url) || ':' || url, coalesce(length(lang) || ':' || lang, '-'))) AS row_digest
  FROM (SELECT page_id % 50 AS page_id, url, CASE WHEN page_id % 3 > 0 THEN substr(url, 1, 9) END AS lang FROM pages)
), e AS (SELECT row_digest, count(*) AS n FROM d GROUP BY 1
), l2 AS (SELECT substr(row_digest, 1, 2) AS node, sha256(string_agg(row_digest || '=' || n, ',' ORDER BY row_digest || '=' || n)) AS digest, sum(n)::BIGINT AS n FROM e GROUP BY 1
), l1 AS (SELECT substr(node, 1, 1) AS node, sha256(string_agg(node || '=' || digest, ',' ORDER BY node)) AS digest, sum(n)::BIGINT AS n FROM l2 GROUP BY 1
), l0 AS (SELECT '' AS node, sha256(string_agg(node || '=' || digest, ',' ORDER BY node)) AS digest, sum(n)::BIGINT AS n FROM l1)
SELECT 2 AS level, * FROM l2 UNION ALL SELECT 1, * FROM l1 UNION ALL SELECT 0, * FROM l0
"""


@query("merkle_tree", MERKLE)
def _(spark, d):
    lang = F.when(F.col("page_id") % 3 > 0, F.substring("url", 1, 9))
    pages = spark.read.parquet(f"{d}/pages.parquet").select((F.col("page_id") % 50).alias("page_id"), "url", lang.alias("lang"))
    return merkle.tree(pages, ["page_id", "url", "lang"], depth=2)


@query("merkle_changes", """
WITH b AS (SELECT page_id, url FROM pages), a AS (SELECT page_id, CASE WHEN page_id % 90 = 7 THEN url || '#new' ELSE url END AS url FROM pages WHERE page_id % 70 <> 3 UNION ALL SELECT page_id, url FROM pages WHERE page_id % 80 = 5),
u AS (SELECT *, 1 AS s FROM a UNION ALL SELECT *, -1 FROM b)
SELECT page_id, url, sum(s)::BIGINT AS change FROM u GROUP BY ALL HAVING sum(s) <> 0""")
def _(spark, d):
    before = spark.read.parquet(f"{d}/pages.parquet").select("page_id", "url")
    edited = F.when(F.col("page_id") % 90 == 7, F.concat("url", F.lit("#new"))).otherwise(F.col("url"))
    after = before.filter("page_id % 70 <> 3").select("page_id", edited.alias("url")).unionByName(before.filter("page_id % 80 = 5"))
    return merkle.changes(before, after, ["page_id", "url"])


QUERIES, ORACLE_SQL = Q, S
