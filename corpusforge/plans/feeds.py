"""Queries over events as scan log, feed records and fetch log, over documents as catalogue, and over page html."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusforge.operators import log as L
from corpusforge.operators import trigrams as T
from corpusforge.operators.scratch import materialise
from corpusforge.plans.urls import SPLIT
from corpusforge.sources import feeds as R
from corpusforge.streaming import feed as W

Q, S = {}, {}


def query(name: str, sql: str | None = None):
    def add(f):
        Q[name] = f
        if sql:
            S[name] = sql
        return f

    return add


TYPES = "SELECT event_type, row_number() OVER (ORDER BY event_type) AS k FROM (SELECT DISTINCT event_type FROM events)"
VERDICTS = ["SAFE", "SUSPICIOUS", "PHISHING"]


def log(spark, d):
    events = spark.read.parquet(f"{d}/events.parquet")
    k = F.get_json_object("props", "$.k").cast("int") % 3
    return events.withColumn("verdict", F.element_at(F.array(*[F.lit(v) for v in VERDICTS]), k + 1))


LOG = "e AS (SELECT *, ['SAFE', 'SUSPICIOUS', 'PHISHING'][json_extract_string(props, '$.k')::INT % 3 + 1] AS verdict FROM events)"
N = ", ".join(f"count(*) FILTER (WHERE verdict = '{v}') AS \"n_{v}\"" for v in VERDICTS)


@query("verdict_totals", f"WITH {LOG}, t AS (SELECT count(*) AS total, {N} FROM e) SELECT *, " + ", ".join(f"CASE WHEN total > 0 THEN round_even(\"n_{v}\" * 100 / total, 1) END AS \"pct_{v}\"" for v in VERDICTS) + " FROM t")
def _(spark, d):
    return L.verdict_totals(log(spark, d), "verdict", VERDICTS)


@query("daily_trend", f"WITH {LOG}, c AS (SELECT unnest(range(7)) AS i), day AS (SELECT (DATE '2024-01-31' - i::INT)::DATE AS day FROM c), k AS (SELECT ts::DATE AS day, " + ", ".join(f"count(*) FILTER (WHERE verdict = '{v}') AS \"{v}\"" for v in VERDICTS)
       + " FROM e GROUP BY 1) SELECT strftime(day.day, '%Y-%m-%d') AS day, " + ", ".join(f'coalesce("{v}", 0) AS "{v}"' for v in VERDICTS) + ", " + " + ".join(f'coalesce("{v}", 0)' for v in VERDICTS) + " AS total FROM day LEFT JOIN k USING (day)")
def _(spark, d):
    return L.daily_trend(log(spark, d), "ts", "verdict", VERDICTS, "2024-01-31").withColumn("day", F.date_format("day", "yyyy-MM-dd"))


@query("facet_counts", f"WITH {LOG} SELECT 'verdict' AS facet, verdict AS value, count(*) AS n FROM e GROUP BY 1, 2 UNION ALL SELECT 'event_type', event_type, count(*) FROM e GROUP BY 1, 2")
def _(spark, d):
    return L.facet_counts(log(spark, d), ["verdict", "event_type"])


@query("older_scans", f"WITH {LOG} SELECT event_id, verdict FROM e WHERE event_id < 900 ORDER BY event_id DESC LIMIT 50")
def _(spark, d):
    return L.older(log(spark, d), 900, 50, "event_id").select("event_id", "verdict")


@query("latest_scans", f"WITH {LOG} SELECT event_id, verdict FROM e ORDER BY ts DESC, event_id DESC LIMIT 100")
def _(spark, d):
    return L.newest(log(spark, d), 100, F.desc("ts"), F.desc("event_id")).select("event_id", "verdict")


@query("scan_page", f"WITH {LOG}, f AS (SELECT * FROM e WHERE verdict = 'PHISHING') SELECT event_id, (SELECT count(*) FROM f) AS total, ceil((SELECT count(*) FROM f) / 50)::BIGINT AS total_pages FROM f ORDER BY event_id DESC LIMIT 50 OFFSET 100")
def _(spark, d):
    df = L.faceted(log(spark, d), {"verdict": "PHISHING", "event_type": "all"})
    return L.page(df, 3, 50, F.desc("event_id")).select("event_id", "total", "total_pages")


@query("replay", "SELECT event_id, user_id FROM events WHERE event_id > 500 ORDER BY event_id LIMIT 50")
def _(spark, d):
    return L.since(spark.read.parquet(f"{d}/events.parquet"), "500", 50, "event_id").select("event_id", "user_id")


@query("document_search", "SELECT doc_id, source FROM documents WHERE lang = 'en' AND (text ILIKE '%License%' OR source ILIKE '%License%')")
def _(spark, d):
    docs = spark.read.parquet(f"{d}/documents.parquet")
    return L.faceted(docs, {"lang": "en", "source": " "}, "License", ["text", "source"]).select("doc_id", "source")


@query("catalogue_search", "SELECT 'documents' AS catalogue, doc_id AS id FROM documents WHERE text ILIKE '%disgusting%' UNION ALL SELECT 'conversations', conv_id FROM conversations WHERE text ILIKE '%disgusting%'")
def _(spark, d):
    a = spark.read.parquet(f"{d}/documents.parquet").select(F.col("doc_id").alias("id"), "text")
    b = spark.read.parquet(f"{d}/conversations.parquet").select(F.col("conv_id").alias("id"), "text")
    return L.search_all({"documents": (a, 5), "conversations": (b, 3)}, "disgusting", "id", ["text"])


@query("nested_search", "SELECT conv_id FROM (SELECT conv_id, list(text) AS texts FROM conversations GROUP BY conv_id) WHERE len(list_filter(texts, lambda t: contains(lower(t), 'the of'))) > 0")
def _(spark, d):
    talks = spark.read.parquet(f"{d}/conversations.parquet").groupBy("conv_id").agg(F.collect_list("text").alias("texts"))
    return L.nested_search(talks.withColumn("title", F.lit("")), "the of", ["title"], ["texts"]).select("conv_id")


def records(spark, d):
    events = spark.read.parquet(f"{d}/events.parquet")
    url = F.concat(F.lit("http://U"), F.col("user_id").cast("string"), F.lit(".Example.com/a?x=1"))
    return events.select(
        url.alias("url"), F.col("event_type").alias("source"), F.lit("phishing_url").alias("indicator_type"), F.when(F.col("event_id") % 3 == 0, "").otherwise(F.col("event_type")).alias("status"), F.when(F.col("event_id") % 4 == 0, F.col("ts")).alias("source_timestamp"),
        F.col("event_type").alias("threat_type"), F.array("event_type", F.concat(F.lit("k"), F.get_json_object("props", "$.k"))).alias("tags"), F.create_map(F.lit("k"), F.get_json_object("props", "$.k")).alias("metadata"), F.col("ts").alias("ingested_at"), F.col("event_id").alias("ordinal"),
    )


def keyed(spark, d):
    """Keyed records, written once, since each is read more than once."""
    return materialise(W.keyed(records(spark, d))[0])


UPSERT = """WITH e AS (SELECT *, 'http://u' || user_id || '.example.com/a?x=1' AS url, (ts, event_id) AS o FROM events),
t AS (SELECT user_id, unnest([event_type, 'k' || json_extract_string(props, '$.k')]) AS tag, o, unnest([0, 1]) AS j FROM e), ft AS (SELECT user_id, tag, min((o, j)) AS f FROM t GROUP BY 1, 2), tt AS (SELECT user_id, list(tag ORDER BY f) AS tags FROM ft GROUP BY 1),
fs AS (SELECT user_id, event_type, min(o) AS f FROM e GROUP BY 1, 2), ss AS (SELECT user_id, list(event_type ORDER BY f) AS sources FROM fs GROUP BY 1)
SELECT sha256(any_value(url)) AS indicator_hash, any_value(url) AS normalized_url, arg_min(event_type, o) AS primary_source, any_value(sources) AS sources, any_value(tags) AS tags, arg_max(event_type, o) FILTER (WHERE event_id % 3 <> 0) AS status, arg_min(event_type, o) AS threat_type,
  count(DISTINCT event_type) AS n_metadata, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS first_seen, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS last_seen, strftime(arg_min(ts, o) FILTER (WHERE event_id % 4 = 0), '%Y-%m-%d %H:%M:%S') AS source_time FROM e JOIN tt USING (user_id) JOIN ss USING (user_id) GROUP BY user_id"""


def _shown(state):
    at = lambda c, n: F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(n)
    return state.select("indicator_hash", "normalized_url", "primary_source", "sources", "tags", "status", "threat_type", F.size("metadata").cast("long").alias("n_metadata"), at("first_seen_at", "first_seen"), at("last_seen_at", "last_seen"), at("source_timestamp", "source_time"))


@query("upsert", UPSERT)
def _(spark, d):
    return _shown(W.upsert(keyed(spark, d)))


@query("upsert_in_two_batches", UPSERT)
def _(spark, d):
    good = keyed(spark, d)
    first = materialise(W.upsert(good.filter("ingested_at < '2024-01-15'")))
    return _shown(W.upsert(good.filter("ingested_at >= '2024-01-15'"), first))


@query("change_feed", "SELECT event_id, CASE WHEN row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) = 1 THEN 'indicator.new' ELSE 'indicator.update' END AS event FROM events")
def _(spark, d):
    return W.changes(keyed(spark, d)).select(F.col("ordinal").alias("event_id"), "event")


@query("feed_stats", """
WITH g AS (
  SELECT user_id, min(ts) AS f, arg_min(event_type, (ts, event_id)) AS source, arg_max(event_type, (ts, event_id)) FILTER (WHERE event_id % 3 <> 0) AS status FROM events GROUP BY user_id
), s AS (SELECT source, count(*) AS n FROM g GROUP BY 1), t AS (SELECT status, count(*) AS n FROM g WHERE status IS NOT NULL GROUP BY 1)
SELECT count(*) AS total, count(*) FILTER (WHERE f >= TIMESTAMP '2024-01-02 00:00:00' - INTERVAL 24 HOUR) AS new_24h, count(*) FILTER (WHERE f >= TIMESTAMP '2024-01-02 00:00:00' - INTERVAL 1 HOUR) AS new_1h,
  strftime(max(f), '%Y-%m-%d %H:%M:%S') AS latest, (SELECT list(source || '=' || n ORDER BY source) FROM s) AS by_source, (SELECT list(status || '=' || n ORDER BY status) FROM t) AS by_status,
  (SELECT count(DISTINCT event_type) FILTER (WHERE event_type <> 'click') FROM events) AS configured_sources, (SELECT count(DISTINCT event_type) FILTER (WHERE event_type NOT IN ('click', 'view')) FROM events) AS healthy_sources
FROM g""")
def _(spark, d):
    kinds = spark.read.parquet(f"{d}/events.parquet").select(F.col("event_type").alias("source_id")).distinct()
    sources = kinds.select((F.col("source_id") != "click").alias("enabled"), F.when(F.col("source_id") == "view", "stale").otherwise("healthy").alias("status"))
    row = L.feed_stats(W.upsert(keyed(spark, d)), "2024-01-02 00:00:00", ["primary_source", "status"], sources=sources)
    shown = lambda c: F.array_sort(F.transform(F.map_entries(c), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))))
    return row.select(
        "total", "new_24h", "new_1h", F.date_format("latest", "yyyy-MM-dd HH:mm:ss").alias("latest"), shown("by_primary_source").alias("by_source"), shown("by_status").alias("by_status"),
        "configured_sources", "healthy_sources",
    )


@query("feed_health", """WITH f AS (SELECT event_type AS source_id, ts, value >= 20 AS ok, CASE WHEN value < 20 THEN 'http 500' END AS error FROM events WHERE ts <= TIMESTAMP '2024-01-20 00:00:00'), g AS (SELECT source_id, max(ts) FILTER (WHERE ok) AS last_ok FROM f GROUP BY 1),
  p AS (SELECT f.source_id, any_value(last_ok) AS last_ok, max(ts) AS last_attempt, arg_max(coalesce(error, ''), ts) AS last_error, count(*) FILTER (WHERE NOT ok AND (last_ok IS NULL OR ts > last_ok)) AS failures FROM f JOIN g USING (source_id) GROUP BY 1), s AS (SELECT DISTINCT event_type AS source_id FROM events)
  SELECT source_id, CASE WHEN failures >= 3 AND last_error <> '' THEN 'error' WHEN epoch(TIMESTAMP '2024-01-20 00:00:00') - epoch(last_ok) > 1800 THEN 'stale' WHEN last_ok IS NOT NULL THEN 'healthy' ELSE 'error' END AS status, coalesce(failures, 0) AS failures FROM s LEFT JOIN p USING (source_id)""")
def _(spark, d):
    events = spark.read.parquet(f"{d}/events.parquet")
    fetches = events.select(F.col("event_type").alias("source_id"), F.col("ts").alias("attempted_at"), (F.col("value") >= 20).alias("ok"), F.when(F.col("value") < 20, "http 500").alias("error"))
    sources = events.select(F.col("event_type").alias("source_id")).distinct().withColumns({"enabled": F.lit(True), "configured": F.lit(True), "cadence_seconds": F.lit(60)})
    return W.health(fetches, sources, "2024-01-20 00:00:00").select("source_id", "status", "failures")


@query("latency", "WITH x AS (SELECT event_id % 100 AS a, event_id % 7 AS b, event_id % 13 AS c FROM events), l AS (SELECT 'ingest' AS step, a::DOUBLE AS s FROM x UNION ALL SELECT 'persist', b FROM x UNION ALL SELECT 'emit', c FROM x) SELECT step, count(*) AS n, quantile_cont(s, 0.5) AS median, quantile_cont(s, 0.95) AS p95 FROM l GROUP BY step")
def _(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet")
    plus = lambda c, n: F.timestamp_seconds(F.unix_timestamp(c) + F.col("event_id") % n)
    e = e.withColumn("source_at", F.timestamp_seconds(F.unix_timestamp("ts"))).withColumn("ingested_at", plus("source_at", 100)).withColumn("persisted_at", plus("ingested_at", 7)).withColumn("emitted_at", plus("persisted_at", 13))
    return W.latency(e)


@query("client_list", "SELECT user_id, event_id FROM (SELECT user_id, arg_max(event_id, (ts, event_id)) AS event_id FROM events GROUP BY 1) ORDER BY event_id DESC, user_id LIMIT 20")
def _(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet").select("user_id", "event_id")
    return W.client_list(e, "user_id", "event_id", 20)


@query("latest_status", "SELECT event_type, arg_max(event_id, (ts, event_id)) AS event_id, arg_max(user_id, (ts, event_id)) AS user_id FROM events GROUP BY event_type")
def _(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet").select("event_type", "ts", "event_id", "user_id")
    return L.latest_by_key(e, "event_type", "ts", "event_id").select("event_type", "event_id", "user_id")


@query("catalogue_upsert", "SELECT user_id, arg_max(event_type, event_id) AS event_type, arg_min(value, event_id) AS value FROM events GROUP BY user_id")
def _(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet").select("user_id", "event_type", "value", "event_id")
    return W.merge_keeping(e, "user_id", "event_id", ["value"]).select("user_id", "event_type", "value")


@query("page_links", f"""WITH {SPLIT}, h AS (SELECT DISTINCT u.url AS page_url, scheme || '://' || host AS base, trim(unnest(regexp_extract_all(html, '(?is)<a\\b[^>]*?\\bhref\\s*=\\s*["'']([^"'']*)["'']', 1))) AS r FROM u JOIN pages USING (page_id))
  SELECT DISTINCT page_url, base || r AS link FROM h WHERE starts_with(r, '/') AND base || r <> regexp_replace(page_url, '#.*$', '')""")
def _(spark, d):
    return R.page_links(spark.read.parquet(f"{d}/pages.parquet").select("url", "html"), https_only=False)


#: Markup around a page: links in remarks, scripts and other attributes, which are none, and links of all shapes; % stands for the page's number, ^ for its host.
BEFORE = """<!-- <a href="/remark/%">x</a> --><script>var s = '<a href="/script/%">';</script><style>a:after{content:'<a href="/style/%">'}</style>"""
AFTER = """<A CLASS=c HREF=/plain/%/x?y=1>x</A><a title="a > b" href="../up/%/./z">x</a><a href='./here/%/..'>x</a><a data-href="/data/%" href="?only=%">x</a><a title="href=/title/%" href = "//^/abs/../%">x</a>
<a href="../../../../top/%">x</a><a href="/first/%" href="/last/%/a//b/../c">x</a><abbr href="/abbr/%">x</abbr><a name=n>x</a><a href>x</a><a/href=/slash/%>x</a><a href="next/%#part">x</a><a href=".">x</a><!-- open <a href="/open/%">"""
REFS = ("/plain/%/x?y=1", "../up/%/./z", "./here/%/..", "?only=%", "//^/abs/../%", "../../../../top/%", "/last/%/a//b/../c", "/slash/%", "next/%#part", ".")


@query("page_link_shapes", f"""
WITH {SPLIT}, h AS (
  SELECT u.*, unnest(regexp_extract_all(html, '(?is)<a\\b[^>]*?\\bhref\\s*=\\s*["'']([^"'']*)["'']', 1)) AS r FROM u JOIN pages USING (page_id)
  UNION ALL SELECT *, replace(replace(unnest({list(REFS)}), '%', page_id::VARCHAR), '^', host) FROM u
), a AS (SELECT *, regexp_extract(trim(r), '^([^?#]*)', 1) AS rp, string_split(regexp_extract(trim(r), '^([^?#]*)', 1), '/') AS steps, string_split(path, '/') AS own FROM h
), b AS (
  SELECT *, CASE WHEN starts_with(rp, '/') THEN steps[2:] ELSE list_filter(list_concat(own[2:len(own) - 1], steps[1:len(steps) - 1]), lambda x: x <> '') || steps[len(steps):] END AS pieces FROM a
), c AS (
  SELECT *, list_reduce(list_concat([''], pieces), lambda acc, seg: CASE WHEN seg = '..' THEN regexp_replace(acc, '/[^/]*$', '') WHEN seg = '.' THEN acc ELSE acc || '/' || seg END) AS folded, pieces[len(pieces)] IN ('.', '..') AS ends FROM b
), d AS (
  SELECT url AS page_url, scheme || ':' || CASE
    WHEN starts_with(r, '//') THEN r
    WHEN rp = '' THEN '//' || host || CASE WHEN path = '' THEN '/' ELSE path END || r
    ELSE '//' || host || CASE WHEN folded = '' THEN '/' WHEN ends THEN folded || '/' ELSE folded END || substr(trim(r), length(rp) + 1) END AS link FROM c
)
SELECT DISTINCT page_url, regexp_replace(link, '#.*$', '') AS link FROM d WHERE regexp_replace(link, '#.*$', '') <> regexp_replace(page_url, '#.*$', '')
""")
def _(spark, d):
    pages = spark.read.parquet(f"{d}/pages.parquet")
    host = F.regexp_extract("url", "://([^/?#]*)", 1)
    around = lambda text: F.replace(F.replace(F.lit(text), F.lit("%"), F.col("page_id").cast("string")), F.lit("^"), host)
    return R.page_links(pages.select("url", F.concat(around(BEFORE), "html", around(AFTER)).alias("html")), https_only=False)


#: A JSON text with a page's URL at several depths, as key, in text, escaped; % stands for the URL, ^ for the page's number.
NESTED = r'''{"%": {"deep": [[{"k": "%", "n": [1, null, true]}, "http:\/\/e.test\/?a=1\u0026id=^"], "not http", [[["https://five.test/^"]]]], "t": "say \"https://in.text/\" now\\"}, "x": "HTTPS://Up.test/^", "http://key.test/": {}, "y" : "a\\"}'''


def _lines(spark, d, *parts):
    """One text a page: parts are texts, or columns."""
    return spark.read.parquet(f"{d}/pages.parquet").select("page_id", F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts]).alias("value"))


@query("indexed_search", "SELECT page_id, url FROM pages WHERE url ILIKE '%the%' AND url ILIKE '%ple.org/e%'")
def _(spark, d):
    pages = spark.read.parquet(f"{d}/pages.parquet").select("page_id", "url")
    found = T.search(pages, T.postings(pages, "page_id", ["url"]), "page_id", "The", ["url"])
    return T.search(found, T.postings(pages, "page_id", ["url"]), "page_id", "PLE.org/e", ["url"])


@query("sitemap", """
WITH u AS (SELECT page_id AS file, unnest([url, 'https://c.test/' || page_id || '?a&b']) AS url, page_id % 3 = 0 AS is_index FROM pages) SELECT * FROM u""")
def _(spark, d):
    tag = F.when(F.col("page_id") % 3 == 0, "sitemapindex").otherwise("urlset")
    files = _lines(spark, d, "<", tag, "><url><loc>\n ", F.replace("url", F.lit("&"), F.lit("&amp;")), " </loc></url><url><loc><![CDATA[https://c.test/", F.col("page_id"), "?a&b]]></loc></url><url><loc>https://third/</loc></url></", tag, ">")
    return R.sitemap_urls(files.withColumnRenamed("page_id", "file"), "file", "value", 2)


@query("feed_items", """
SELECT page_id AS file, unnest([0, 1]) AS place, unnest([url, 'https://alt.test/' || page_id]) AS url FROM pages""")
def _(spark, d):
    link = F.replace("url", F.lit("&"), F.lit("&amp;"))
    files = _lines(spark, d, "<rss><item><title>t</title><link>", link, '</link></item><entry><link rel="self" href="https://no/"/><link rel="alternate" href="https://alt.test/', F.col("page_id"), '"/></entry><item><title>none</title></item></rss>')
    return R.feed_links(files.withColumnRenamed("page_id", "file"), "file", "value")


@query("json_fields", "SELECT url, count(*) AS n FROM (SELECT url FROM pages UNION ALL SELECT 'https://m.test/' || page_id FROM pages WHERE page_id % 2 = 0) GROUP BY url")
def _(spark, d):
    more = F.when(F.col("page_id") % 2 == 0, F.concat(F.lit(',"m":{"link":"https://m.test/'), F.col("page_id").cast("string"), F.lit('"}'))).otherwise("")
    return R.json_field_urls(_lines(spark, d, '{"url":"', F.col("url"), '"', more, "}"), ["url", "m.link"]).groupBy("url").agg(F.count("*").alias("n"))


@query("crawled_pages", "SELECT 's' || page_id % 4 AS source, url FROM pages WHERE page_id % 3 = 0")
def _(spark, d):
    status = F.when(F.col("page_id") % 3 == 0, "200").otherwise("404")
    texts = _lines(spark, d, '{"sources":[{"name":"s', F.col("page_id") % 4, '","first_party_pages_crawled":[{"url":"', F.col("url"), '","status":', status, '},{"url":"ftp://x","status":200}]},{"name":"none"}]}')
    return R.crawled_pages(texts)


@query("inventory", """
WITH r AS (SELECT 'f' || page_id % 5 AS file, url, regexp_extract(url, '://([^/?#]*)', 1) AS domain FROM pages)
SELECT file, count(DISTINCT url) AS n_urls, count(DISTINCT domain) AS n_domains FROM (SELECT * FROM r UNION ALL SELECT '*', url, domain FROM r) GROUP BY file""")
def _(spark, d):
    file = F.concat(F.lit("f"), (F.col("page_id") % 5).cast("string"))
    return R.inventory(spark.read.parquet(f"{d}/pages.parquet").select(file.alias("file"), "url", F.regexp_extract("url", "://([^/?#]*)", 1).alias("domain")), "file", "url", "domain")


@query("verified_online", f"""
WITH {SPLIT}, r AS (SELECT normalized_url, page_id % 3 > 0 AS verified, page_id % 4 > 0 AS online FROM u UNION ALL SELECT normalized_url, true, true FROM u WHERE page_id % 5 = 0),
o AS (SELECT CASE WHEN NOT verified THEN 'not_verified' WHEN NOT online THEN 'not_online' WHEN row_number() OVER (PARTITION BY normalized_url, verified AND online) > 1 THEN 'duplicate' ELSE 'kept' END AS outcome FROM r)
SELECT outcome, count(*) AS n FROM o GROUP BY 1""")
def _(spark, d):
    pages = spark.read.parquet(f"{d}/pages.parquet")
    word = lambda c: F.when(c, "Yes").otherwise("no")
    rows = pages.select("url", word(F.col("page_id") % 3 > 0).alias("verified"), word(F.col("page_id") % 4 > 0).alias("online"))
    again = pages.filter("page_id % 5 = 0").select("url", F.lit("yes").alias("verified"), F.lit("YES").alias("online"))
    return R.verified_online(rows.unionByName(again), "url")[1]


@query("labelled_feed", "SELECT url, 1 AS label, 'feed' AS source FROM pages WHERE page_id % 4 > 0")
def _(spark, d):
    value = F.when(F.col("page_id") % 4 == 0, "  ").otherwise(F.col("url"))
    return R.labelled_feed(_lines(spark, d, value), "feed")[0].select("url", "label", "source")


@query("dictionary_labels", """
WITH w AS (SELECT page_id, ['benign', 'phishing', 'malware', 'odd'][page_id % 4 + 1] AS class FROM pages) SELECT class, count(*) AS n, class <> 'odd' AS included FROM w GROUP BY class""")
def _(spark, d):
    word = F.element_at(F.array(*[F.lit(w) for w in (" Benign", "PHISHING ", "malware", "odd")]), (F.col("page_id") % 4 + 1).cast("int"))
    return R.dictionary_labels(_lines(spark, d, word), "value", {"benign": 0, "phishing": 1, "malware": 1})[1]


@query("first_nonempty", "SELECT page_id FROM pages WHERE page_id % 4 = (SELECT min(page_id % 4) FROM pages WHERE page_id % 4 > 1)")
def _(spark, d):
    return R.first_nonempty(spark.read.parquet(f"{d}/pages.parquet").select("page_id", (F.col("page_id") % 4).alias("rank")).filter("rank > 1"), "rank").select("page_id")


@query("lookup", "SELECT event_id, user_id FROM events WHERE event_id = 17 OR user_id = 17")
def _(spark, d):
    return L.lookup(spark.read.parquet(f"{d}/events.parquet").select("event_id", "user_id"), "17", "event_id", "user_id")


@query("since_cursor", "SELECT event_id, event_type FROM events WHERE event_id > 40 ORDER BY event_id LIMIT 25")
def _(spark, d):
    return L.since(spark.read.parquet(f"{d}/events.parquet").select("event_id", "event_type"), "40", 25, "event_id")


@query("json_harvest", rf"""
WITH v AS (SELECT page_id, replace(replace('{NESTED}', '%', url), '^', page_id::VARCHAR) || CASE WHEN page_id % 7 = 3 THEN '}}' ELSE '' END AS value FROM pages),
s AS (SELECT page_id, j.atom ->> '$' AS url FROM v, json_tree(CASE WHEN json_valid(value) THEN value ELSE 'null' END::JSON) AS j WHERE j.type = 'VARCHAR')
SELECT url, count(*) AS n FROM s WHERE regexp_matches(url, '(?i)^https?://') GROUP BY url
""")
def _(spark, d):
    text = F.replace(F.replace(F.lit(NESTED), F.lit("%"), F.col("url")), F.lit("^"), F.col("page_id").cast("string"))
    broken = F.when(F.col("page_id") % 7 == 3, F.lit("}")).otherwise("")
    return R.harvested(spark.read.parquet(f"{d}/pages.parquet").select(F.concat(text, broken).alias("value"))).groupBy("url").agg(F.count("*").alias("n"))


@query("plain_feed", """WITH l AS (SELECT page_id, CASE WHEN page_id % 4 = 0 THEN '# ' || url WHEN page_id % 4 = 1 THEN regexp_replace(url, '^https?://', '') WHEN page_id % 4 = 2 THEN '  ' || url || ' ' ELSE '' END AS value FROM pages) SELECT CASE WHEN regexp_matches(trim(value), '^https?://') THEN trim(value) ELSE 'http://' || trim(value) END AS url, 'openphish' AS source, 0.9::DOUBLE AS confidence
  FROM l WHERE trim(value) <> '' AND NOT starts_with(trim(value), '#')""")
def _(spark, d):
    i = F.col("page_id") % 4
    line = F.when(i == 0, F.concat(F.lit("# "), F.col("url"))).when(i == 1, F.regexp_replace("url", "^https?://", "")).when(i == 2, F.concat(F.lit("  "), F.col("url"), F.lit(" "))).otherwise("")
    return R.PARSERS["openphish"](spark.read.parquet(f"{d}/pages.parquet").select(line.alias("value"))).select("url", "source", "confidence")


@query("malware_csv", """SELECT url, CASE WHEN page_id % 2 = 0 THEN 'online' ELSE 'active' END AS status, page_id::VARCHAR AS source_id, strftime(TIMESTAMP '2024-01-01 00:00:00' + to_seconds(page_id), '%Y-%m-%d %H:%M:%S') AS at, 'malware_download' AS threat_type, ['elf', 't' || page_id % 3] AS tags FROM pages WHERE page_id % 5 <> 0""")
def _(spark, d):
    pages = spark.read.parquet(f"{d}/pages.parquet")
    at = F.date_format(F.timestamp_seconds(F.lit(1704067200) + F.col("page_id")), "yyyy-MM-dd HH:mm:ss")
    cells = [F.col("page_id").cast("string"), at, F.col("url"), F.when(F.col("page_id") % 2 == 0, "online").otherwise("unknown"), F.lit(""), F.lit(""), F.concat(F.lit("elf, none ,t"), (F.col("page_id") % 3).cast("string")), F.lit("http://ref"), F.lit("bot")]
    line = F.concat_ws(",", *[F.concat(F.lit('"'), c, F.lit('"')) for c in cells])
    lines = pages.select(F.when(F.col("page_id") % 5 == 0, F.concat(F.lit("# "), line)).otherwise(line).alias("value"))
    return R.malware_csv(lines).select("url", "status", "source_id", F.date_format("source_timestamp", "yyyy-MM-dd HH:mm:ss").alias("at"), "threat_type", "tags")


@query("malware_json", "SELECT url, page_id::VARCHAR AS source_id, CASE page_id % 3 WHEN 0 THEN ['elf', 'mirai'] WHEN 1 THEN ['x'] ELSE []::VARCHAR[] END AS tags FROM pages")
def _(spark, d):
    tags = F.when(F.col("page_id") % 3 == 0, F.lit('"elf, none,mirai"')).when(F.col("page_id") % 3 == 1, F.lit('["x","none"]')).otherwise(F.lit("null"))
    item = F.concat(F.lit('{"id":'), F.col("page_id").cast("string"), F.lit(',"url":"'), F.col("url"), F.lit('","tags":'), tags, F.lit("}"))
    shape = F.col("page_id") % 4
    text = F.when(shape == 0, F.concat(F.lit('{"urls":['), item, F.lit("]}"))).when(shape == 1, F.concat(F.lit('{"a":['), item, F.lit("]}"))).when(shape == 2, F.concat(F.lit('{"b":'), item, F.lit("}"))).otherwise(F.concat(F.lit("["), item, F.lit("]")))
    return R.malware_json(spark.read.parquet(f"{d}/pages.parquet").select(text.alias("value"))).select("url", "source_id", "tags")


@query("verified_json", "SELECT url, CASE WHEN page_id % 2 = 0 THEN 'verified' ELSE 'unverified' END AS status, CASE WHEN page_id % 2 = 0 THEN 0.96::DOUBLE ELSE 0.8::DOUBLE END AS confidence, CASE WHEN page_id % 3 = 0 THEN 'targeted_phish: Bank' ELSE 'phishing_url' END AS threat_type FROM pages")
def _(spark, d):
    text = F.concat(F.lit('[{"phish_id":'), F.col("page_id").cast("string"), F.lit(',"url":"'), F.col("url"), F.lit('","verified":"'), F.when(F.col("page_id") % 2 == 0, "yes").otherwise("no"), F.lit('"'), F.when(F.col("page_id") % 3 == 0, ',"target":"Bank"').otherwise(""), F.lit("}]"))
    return R.verified_json(spark.read.parquet(f"{d}/pages.parquet").select(text.alias("value"))).select("url", "status", "confidence", "threat_type")


@query("advisories", "SELECT DISTINCT 'CIAD-2024-' || lpad((page_id % 40)::VARCHAR, 4, '0') AS source_id FROM pages")
def _(spark, d):
    text = F.concat(F.lit("see CIAD-2024-"), F.lpad((F.col("page_id") % 40).cast("string"), 4, "0"), F.lit(" and again CIAD-2024-"), F.lpad((F.col("page_id") % 40).cast("string"), 4, "0"))
    return R.advisories(spark.read.parquet(f"{d}/pages.parquet").select(text.alias("value"))).select("source_id")


@query("flexible_timestamps", "SELECT event_id, strftime(CASE event_id % 4 WHEN 0 THEN date_trunc('second', ts) WHEN 1 THEN date_trunc('second', ts) WHEN 2 THEN date_trunc('day', ts) END, '%Y-%m-%d %H:%M:%S') AS at FROM events")
def _(spark, d):
    e, i = spark.read.parquet(f"{d}/events.parquet"), F.col("event_id") % 4
    text = F.when(i == 0, F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'")).when(i == 1, F.date_format("ts", "yyyy-MM-dd HH:mm:ss 'UTC'")).when(i == 2, F.date_format("ts", "yyyy-MM-dd")).otherwise("soon")
    return e.select("event_id", F.date_format(R.flexible_timestamp(text), "yyyy-MM-dd HH:mm:ss").alias("at"))


QUERIES, ORACLE_SQL = Q, S
