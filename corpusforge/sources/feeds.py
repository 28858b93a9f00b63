"""Readers of labelled files and indicator feeds, as projections from raw rows to one record form.

A record has url, source, indicator_type, status, source_id, source_timestamp, threat_type, tags, confidence
and metadata. Parsers take a DataFrame of raw text or columns, so the same code serves batch and stream.
PARSERS is the registry.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusforge.operators.scratch import materialise

RECORD = ("url", "source", "indicator_type", "status", "source_id", "source_timestamp", "threat_type", "tags", "confidence", "metadata")
FORMATS = ("yyyy-MM-dd'T'HH:mm:ss'Z'", "yyyy-MM-dd'T'HH:mm:ssXXX", "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "yyyy-MM-dd'T'HH:mm:ss.SSSXXX", "yyyy-MM-dd HH:mm:ss 'UTC'", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd")


def flexible_timestamp(text: Column) -> Column:
    """The first of the known formats that fits; without a zone it is UTC (the session's zone must be UTC); else NULL."""
    t = F.trim(text)
    return F.coalesce(*[F.try_to_timestamp(t, F.lit(f)) for f in FORMATS])


def record(url, source, kind, status, source_id, at, threat, tags, confidence, metadata) -> list[Column]:
    return [c.alias(n) for n, c in zip(RECORD, (url, source, kind, status, source_id, at, threat, tags, confidence, metadata))]


def text_map(**entries: Column) -> Column:
    pairs = F.array(*[F.struct(F.lit(k).alias("key"), v.cast("string").alias("value")) for k, v in entries.items()])
    return F.map_from_entries(F.filter(pairs, lambda e: e["value"].isNotNull()))


def split_tags(text: Column) -> Column:
    return F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), ","), lambda t: F.trim(t)), lambda t: (t != "") & (F.lower(t) != "none"))


def _malware(url, status, source_id, at, threat, tags, reporter, link) -> list[Column]:
    status, threat = F.lower(status), F.coalesce(F.nullif(F.trim(threat), F.lit("")), F.lit("malware_download"))
    return record(F.trim(url), F.lit("urlhaus"), F.lit("malware_url"), F.when(status.isin("online", "offline"), status).otherwise("active"), source_id, flexible_timestamp(at), threat, tags, F.lit(0.95),
                  text_map(reporter=F.nullif(F.trim(reporter), F.lit("")), urlhaus_reference=F.nullif(F.trim(link), F.lit("")), threat_desc=threat))


CSV_COLUMNS = "id string, dateadded string, url string, url_status string, last_online string, threat string, tags string, link string, reporter string"


def malware_csv(lines: DataFrame, column: str = "value") -> DataFrame:
    """Comment-aware CSV lines of nine columns; rows without an http(s) URL are left out."""
    rows = lines.filter((F.trim(column) != "") & ~F.col(column).startswith("#")).select(F.from_csv(F.col(column), CSV_COLUMNS).alias("c")).select("c.*")
    rows = rows.filter(F.trim("url").rlike("^https?://"))
    return rows.select(_malware(F.col("url"), F.trim(F.coalesce("url_status", F.lit("online"))), F.trim("id"), F.col("dateadded"), F.col("threat"), split_tags(F.col("tags")), F.col("reporter"), F.col("link")))


def malware_json(payloads: DataFrame, column: str = "value") -> DataFrame:
    """JSON payloads of the shapes {urls: [...]}, {key: [...]}, {key: {url}} and [...]; tags are a text or a list."""
    v = payloads.select(F.try_parse_json(F.col(column)).alias("v")).filter("v IS NOT NULL")
    top = v.sparkSession.sql("""
      WITH top AS (SELECT v, schema_of_variant(v) LIKE 'ARRAY%' AS is_list, try_variant_get(v, '$.urls', 'array<variant>') AS urls FROM {payloads}),
      lists AS (SELECT explode(urls) AS item FROM top WHERE urls IS NOT NULL
        UNION ALL SELECT explode(try_variant_get(v, '$', 'array<variant>')) FROM top WHERE is_list
        UNION ALL SELECT explode(coalesce(try_variant_get(e.value, '$', 'array<variant>'), array(e.value))) FROM (SELECT v FROM top WHERE urls IS NULL AND NOT is_list) t, LATERAL variant_explode(t.v) e)
      SELECT item FROM lists WHERE try_variant_get(item, '$.url', 'string') IS NOT NULL
    """, payloads=v)
    get = lambda *names: F.coalesce(*[F.try_variant_get("item", f"$.{n}", "string") for n in names])
    listed = F.filter(F.try_variant_get("item", "$.tags", "array<string>"), lambda t: (t != "") & (F.lower(t) != "none"))
    tags = F.coalesce(listed, split_tags(get("tags")))
    return top.select(_malware(get("url"), F.coalesce(get("url_status"), F.lit("online")), get("id"), get("dateadded", "date_added"), get("threat"), tags, get("reporter"), get("urlhaus_reference", "urlhaus_link")))


VERIFIED = "array<struct<phish_id: string, url: string, submission_time: string, verified: string, target: string, phish_detail_url: string>>"


def verified_json(payloads: DataFrame, column: str = "value") -> DataFrame:
    """A JSON list of reports with verified yes or no and a target brand."""
    rows = payloads.select(F.explode(F.from_json(column, VERIFIED)).alias("i")).select("i.*").filter("url IS NOT NULL AND url <> ''")
    yes = F.lower(F.coalesce("verified", F.lit("yes"))) == "yes"
    status, target = F.when(yes, "verified").otherwise("unverified"), F.nullif("target", F.lit(""))
    return rows.select(record(F.trim("url"), F.lit("phishtank"), F.lit("phishing_url"), status, F.col("phish_id"), flexible_timestamp(F.col("submission_time")), F.coalesce(F.concat(F.lit("targeted_phish: "), target), F.lit("phishing_url")),
                              F.array_compact(F.array(F.lit("phishtank"), status, target)), F.when(yes, 0.96).otherwise(0.80), text_map(phish_id=F.col("phish_id"), target_brand=target, phish_detail_url=F.col("phish_detail_url"))))


def plain_feed(source: str, tags: tuple[str, ...], comments: tuple[str, ...] = ("#",), confidence: float = 0.9, threat: str = "credential_phish"):
    """A parser of one URL per line; blank and comment lines go, a missing scheme becomes http://."""

    def parse(lines: DataFrame, column: str = "value") -> DataFrame:
        text = F.trim(column)
        rows = lines.filter(text != "")
        for mark in comments:
            rows = rows.filter(~text.startswith(mark))
        url = F.when(text.rlike("(?i)^https?://"), text).otherwise(F.concat(F.lit("http://"), text))
        return rows.select(record(url, F.lit(source), F.lit("phishing_url"), F.lit("active"), F.lit(None).cast("string"), F.lit(None).cast("timestamp"), F.lit(threat), F.array(*[F.lit(t) for t in tags]), F.lit(confidence), text_map(feed_resource=F.lit(source))))

    return parse


def advisories(pages: DataFrame, column: str = "value") -> DataFrame:
    """Advisory ids in page text, each once, with the place of its first sighting in its page."""
    found = pages.select(F.posexplode(F.array_distinct(F.regexp_extract_all(F.col(column), F.lit(r"(CI[A-Z]{2}-\d{4}-\d{4})")))).alias("place", "id"))
    ids = found.groupBy("id").agg(F.min("place").alias("place"))
    return ids.select(record(F.concat(F.lit("https://www.cert-in.org.in/advisories/"), "id"), F.lit("cert_in"), F.lit("scam_campaign_url"), F.lit("verified"), F.col("id"), F.lit(None).cast("timestamp"), F.lit("governmental_cyber_advisory"),
                             F.array(F.lit("cert_in"), F.lit("advisory"), F.lit("official_alert"), F.lower("id")), F.lit(1.0), text_map(advisory_id=F.col("id"), agency=F.lit("CERT-In (MeitY)"))))


PARSERS = {
    "malware_csv": malware_csv, "malware_json": malware_json, "verified_json": verified_json, "openphish": plain_feed("openphish", ("phishing", "openphish")),
    "community": plain_feed("phishing_database", ("phishing", "community_feed"), ("#", "//")), "advisories": advisories,
}


def first_nonempty(snapshots: DataFrame, rank: str) -> DataFrame:
    """Of landed snapshots only the one with the lowest rank that has rows."""
    best = snapshots.agg(F.min(rank).alias("_best"))
    return snapshots.join(F.broadcast(best), F.col(rank) == F.col("_best")).drop("_best")


def labelled_csv(spark: SparkSession, path: str, url: str, label: str, source: str, invert: bool = False) -> DataFrame:
    """url and label of a CSV file with a header; rows whose label is not 0 or 1 go; invert swaps the classes."""
    rows = spark.read.csv(path, header=True).select(F.col(url).alias("url"), F.expr(f"try_cast(`{label}` AS int)").alias("label"))
    rows = rows.filter(F.col("label").isin(0, 1))
    y = (1 - F.col("label")) if invert else F.col("label")
    return rows.select("url", y.alias("label"), F.lit(source).alias("source"), F.lit(None).cast("date").alias("collection_date"))


def labelled_feed(lines: DataFrame, source: str, column: str = "value", label: int = 1) -> tuple[DataFrame, DataFrame]:
    """url, label, source and collection_date of a feed of one URL per line, blank lines left out; and the counts n_lines, blank_lines."""
    blank = F.coalesce(F.trim(F.col(column)), F.lit("")) == ""
    rows = lines.filter(~blank).select(F.col(column).alias("url"), F.lit(label).alias("label"), F.lit(source).alias("source"), F.lit(None).cast("date").alias("collection_date"))
    return rows, lines.agg(F.count("*").alias("n_lines"), F.count_if(blank).alias("blank_lines"))


#: Columns of a file that mixed_csvs looks at.
MOST_COLUMNS = 256
LABEL_NAMES = ("label", "class", "result", "type", "status")


def _files(spark: SparkSession, paths: list[str]) -> tuple[list[tuple[str, str, str]], list[str]]:
    """(path, URI with one slash after its scheme, given path) of the files at or right under the paths, and the paths that are missing."""
    found, missing = [], []
    for given in paths:
        path = spark._jvm.org.apache.hadoop.fs.Path(given)
        fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
        if not fs.exists(path):
            missing.append(given)
            continue
        listed = [s.getPath() for s in fs.listStatus(path) if s.isFile() and s.getPath().getName()[0] not in "._"]
        found += [(p.toString(), re.sub("^([^:/]+):/+", r"\1:/", p.toUri().toString()), given) for p in listed]
    return found, missing


def mixed_csvs(spark: SparkSession, paths: list[str]) -> tuple[DataFrame | None, list[str]]:
    """Rows (url, label, file) of files with different headers, and the files that have no usable header or are missing.

    The URL column is the first whose name holds url, the label column the first of label, class, result, type, status.
    All files are read as one: the first row of each is its header, and a table of headers tells every row where its columns are,
    so that a plan for a thousand files is that for one.
    """
    files, skipped = _files(spark, paths)
    if not files:
        return None, skipped
    schema = ", ".join(f"c{i} string" for i in range(MOST_COLUMNS))
    raw = spark.read.schema(schema).option("enforceSchema", True).csv([f for f, _, _ in files], header=False)
    place = F.struct(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row"))
    rows = raw.select(F.regexp_replace("_metadata.file_path", "^([^:/]+):/+", "$1:/").alias("_path"), place.alias("_place"), F.array(*[f"c{i}" for i in range(MOST_COLUMNS)]).alias("_cells"))
    names = F.transform("_header", lambda n: F.lower(F.regexp_replace(F.coalesce(n, F.lit("")), "^\ufeff", "")))
    heads = rows.groupBy("_path").agg(F.min("_place").alias("_first"), F.min_by("_cells", "_place").alias("_header")).withColumn("_header", names)
    url = F.array_position(F.transform("_header", lambda n: n.contains("url")), F.lit(True))
    label = F.coalesce(*[F.nullif(F.array_position("_header", F.lit(n)), F.lit(0)) for n in LABEL_NAMES], F.lit(0))
    heads = heads.select("_path", "_first", url.alias("_url"), label.alias("_label"))
    given = spark.createDataFrame([(uri, path) for _, uri, path in files], "_path string, file string")
    usable = [r["file"] for r in given.join(heads.filter("_url > 0 AND _label > 0"), "_path").select("file").distinct().collect()]  # at most the given paths
    good = set(usable)
    skipped = [p for p in paths if p in set(skipped) or p not in good]
    if not good:
        return None, skipped
    found = rows.join(heads.join(given, "_path").filter("_url > 0 AND _label > 0"), "_path").filter(F.col("_place") != F.col("_first"))
    return found.select(F.get("_cells", F.col("_url").cast("int") - 1).alias("url"), F.get("_cells", F.col("_label").cast("int") - 1).alias("label"), "file"), skipped


def dictionary_labels(df: DataFrame, column: str, words: dict[str, int]) -> tuple[DataFrame, DataFrame]:
    """Rows whose class word is known, with label; and a report (class, n, included) of all words."""
    marked = df.withColumn("_class", F.lower(F.trim(column)))
    marked = marked.withColumn("label", F.try_element_at(F.create_map(*[x for k, v in words.items() for x in (F.lit(k), F.lit(v))]), "_class"))
    report = marked.groupBy(F.col("_class").alias("class")).agg(F.count("*").alias("n"), F.bool_and(F.col("label").isNotNull()).alias("included"))
    return marked.filter("label IS NOT NULL").drop("_class"), report


def url_list(spark: SparkSession, path: str) -> DataFrame:
    """URLs of a file whose column is the first of normalized_url, url, urls, link, else the first; a header that is a URL is data."""
    raw = spark.read.csv(path, header=False)
    head = raw.first()
    names = [str(h).strip().lower() if h is not None else "" for h in (head or [])]
    column = next((i for n in ("normalized_url", "url", "urls", "link") for i, x in enumerate(names) if x == n), 0)
    is_header = bool(names) and not names[column].startswith(("http://", "https://"))
    urls = raw.select(F.col(f"_c{column}").alias("url"))
    return urls.filter(F.col("url") != head[column]) if is_header and head[column] is not None else urls


def existing_urls(spark: SparkSession, path: str) -> DataFrame:
    """The distinct canonical URLs (url) of a file's URL column, of those that a collector accepts."""
    from corpusforge.functions import urls as U

    good = url_list(spark, path).withColumn("_why", U.collector_check(F.col("url"))).filter("_why IS NULL")
    return good.select(U.collector_url(F.col("url")).alias("url")).distinct()


#: The named entities that URLs and feeds hold; numbered ones are decoded by their number.
ENTITIES = (("lt", "<"), ("gt", ">"), ("quot", '"'), ("apos", "'"), ("nbsp", "\u00a0"), ("amp", "&"))


def unescaped(text: Column) -> Column:
    """text with its character references decoded, each once: &amp;lt; becomes &lt;."""
    pieces = F.split(text, "&")
    named = F.create_map(*[F.lit(x) for e in ENTITIES for x in e])

    def one(piece: Column) -> Column:
        name, rest = F.regexp_extract(piece, "^(#[0-9]{1,7}|#[xX][0-9a-fA-F]{1,6}|[a-zA-Z]+);", 1), F.regexp_replace(piece, "^[^;]*;", "")
        code = F.when(name.rlike("^#[xX]"), F.conv(F.substring(name, 3, 6), 16, 10)).when(name.startswith("#"), F.substring(name, 2, 7)).cast("int")
        # the four bytes of the number are the character in UTF-32
        char = F.when((code > 0) & (code < 0x110000) & ~code.between(0xD800, 0xDFFF), F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32"))
        found = F.coalesce(char, F.try_element_at(named, name))
        return F.coalesce(F.concat(found, rest), F.concat(F.lit("&"), piece))

    return F.concat(F.get(pieces, F.lit(0)), F.array_join(F.transform(F.slice(pieces, F.lit(2), F.greatest(F.size(pieces) - 1, F.lit(0))), one), ""))


#: What a page is made of, as far as its links go: remarks, scripts and styles, whose content is no markup, and start tags, whose quoted values may hold >.
MARKUP = r"""(?is)<!--.*?(?:-->|\z)|<(?:script|style)\b[^>]*+>.*?(?:</(?:script|style)\s*>|\z)|<%s(?=[\s/])((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>"""
#: One attribute: a name, and perhaps = and a value in quotes or up to the next space.
ATTRIBUTE = r"""(?s)([^\s/=>]++(?:\s*+=\s*+(?:"[^"]*+"|'[^']*+'|[^\s"'][^\s]*+)?)?)"""


def tag_attributes(html: Column, tag: str, attribute: str) -> Column:
    """The values of an attribute of all start tags of a kind, character references decoded; of a repeated attribute the last."""

    def value(attributes: Column) -> Column:
        named = F.filter(F.regexp_extract_all(attributes, F.lit(ATTRIBUTE)), lambda a: a.rlike(rf"(?is)^{attribute}\s*="))
        raw = F.regexp_replace(F.try_element_at(named, F.lit(-1)), r"(?s)^[^=]*=\s*", "")
        return F.trim(unescaped(F.when(raw.rlike("^[\"']"), F.substring(raw, F.lit(2), F.length(raw) - 2)).otherwise(raw)))

    found = F.filter(F.regexp_extract_all(html, F.lit(MARKUP % tag), F.lit(1)), lambda a: F.coalesce(a, F.lit("")) != "")
    return F.filter(F.transform(found, value), lambda v: v.isNotNull())


def page_links(pages: DataFrame, url: str = "url", html: str = "html", https_only: bool = True, suffixes: DataFrame | None = None) -> DataFrame:
    """(page_url, link): distinct links of a page to other pages of its registered domain under suffixes.

    Links are the href of <a> tags outside remarks, scripts and styles, quoted or not. Relative ones are resolved, with
    dot segments; fragments-only, javascript:, mailto: and tel: links go.
    """
    from corpusforge.functions import urls as U

    suffixes = suffixes if suffixes is not None else U.suffix_table(pages.sparkSession)
    refs = pages.select(F.col(url).alias("page_url"), F.explode(F.array_distinct(tag_attributes(F.col(html), "a", "href"))).alias("_r"))
    refs = refs.filter(~F.col("_r").rlike("(?i)^(?:#|javascript:|mailto:|tel:|$)"))
    refs = refs.distinct().withColumn("_page", U.parts(F.col("page_url")))
    p, full = F.col("_page"), U.resolved(F.col("_page"), F.col("_r"))
    rows = U.normalize(refs.select("page_url", F.regexp_replace(p["host"], r"\.+$", "").alias("_from"), full.alias("_full")), "_full", "link", "_why").filter("link IS NOT NULL")
    rows = rows.withColumn("link", F.regexp_replace("link", "#.*$", "")).filter(F.col("link") != F.regexp_replace("page_url", "#.*$", ""))
    if https_only:
        rows = rows.filter(F.col("link").startswith("https://"))
    # most links stay on their host, so only the others ask for registered domains; all are written once, or each branch would parse every page again
    rows = materialise(rows.select("page_url", "_from", "link").distinct().withColumn("_to", U.host_of(F.col("link"))))
    away = U.registered_domains(U.registered_domains(rows.filter("_from <> _to"), "_from", suffixes, "_d1"), "_to", suffixes, "_d2").filter("_d1 = _d2")
    return rows.filter("_from = _to").select("page_url", "link").unionByName(away.select("page_url", "link"))


def sitemap_urls(files: DataFrame, file: str, xml: str, cap: int) -> DataFrame:
    """(file, url, is_index): <loc> entries, CDATA and entities resolved, at most cap of a file in order."""
    loc = F.regexp_extract_all(F.col(xml), F.lit(r"(?is)<loc>\s*(?:<!\[CDATA\[)?\s*(.*?)\s*(?:\]\]>)?\s*</loc>"))
    return files.select(file, F.explode(F.slice(F.transform(loc, unescaped), 1, cap)).alias("url"), F.col(xml).rlike("(?i)<sitemapindex").alias("is_index"))


def feed_links(files: DataFrame, file: str, xml: str) -> DataFrame:
    """(file, url): of each item or entry the first link href whose rel is absent or alternate, else the link's text."""
    items = files.select(file, F.posexplode(F.regexp_extract_all(F.col(xml), F.lit(r"(?is)<(?:item|entry)\b[^>]*>(.*?)</(?:item|entry)>"))).alias("place", "_i"))
    links = F.regexp_extract_all("_i", F.lit(r"(?is)(<link\b[^>]*>)"))
    good = F.filter(links, lambda x: x.rlike("(?i)href=") & (~x.rlike("(?i)rel=") | x.rlike("(?i)rel=[\"']alternate[\"']")))
    href = F.regexp_extract(F.try_element_at(good, F.lit(1)), r"""(?i)href=["']([^"']*)["']""", 1)
    text = F.regexp_extract("_i", r"(?is)<link\b[^>]*>\s*(?:<!\[CDATA\[)?\s*([^<\]]+?)\s*(?:\]\]>)?\s*</link>", 1)
    url = F.coalesce(F.nullif(href, F.lit("")), F.nullif(text, F.lit("")))
    return items.select(file, "place", unescaped(url).alias("url")).filter("url IS NOT NULL")


def json_field_urls(lines: DataFrame, fields: list[str], column: str = "value") -> DataFrame:
    """The URL fields of JSON lines, one row each."""
    return lines.select(F.explode(F.array_compact(F.array(*[F.get_json_object(column, f"$.{f}") for f in fields]))).alias("url"))


#: A string of a JSON text, and the colon after it if it is a key. Strings are the only place for quotes in JSON, so their order tells where each ends.
JSON_STRING = r"""(?s)("[^"\\]*+(?:\\.[^"\\]*+)*+"(?:\s*+:)?)"""


def harvested(lines: DataFrame, column: str = "value") -> DataFrame:
    """Every string value of JSON texts that starts with http(s), at any depth, escapes decoded; keys and texts that are not JSON give none."""
    # as the one member of an array, since the parser does not mind what follows a whole value
    alone = F.size(F.try_parse_json(F.concat(F.lit("["), F.col(column), F.lit("]"))).cast("array<variant>")) == 1
    texts = lines.select(F.explode(F.regexp_extract_all(F.when(alone, F.col(column)), F.lit(JSON_STRING))).alias("s"))
    value = F.get(F.from_json(F.concat(F.lit("["), F.col("s"), F.lit("]")), "array<string>"), F.lit(0))
    return texts.filter(F.col("s").endswith('"')).select(value.alias("url")).filter(F.col("url").rlike("(?i)^https?://"))


MANIFEST = "sources array<struct<name: string, source_records: array<struct<name: string>>, first_party_pages_crawled: array<struct<url: string, status: int>>>>"


def crawled_pages(manifests: DataFrame, column: str = "value") -> DataFrame:
    """Pages of recorded crawls with status 200 and an http(s) URL."""
    sources = manifests.select(F.explode(F.from_json(column, MANIFEST)["sources"]).alias("s"))
    pages = sources.select(F.col("s.name").alias("source"), F.explode("s.first_party_pages_crawled").alias("p")).select("source", "p.*")
    return pages.filter((F.col("status") == 200) & F.col("url").rlike("^https?://")).select("source", "url")


def inventory(rows: DataFrame, file: str, url: str, domain: str) -> DataFrame:
    """Distinct URLs and domains of each file, and of all under the name *."""
    marked = rows.select(F.explode(F.array(F.col(file), F.lit("*"))).alias("file"), F.col(url).alias("u"), F.col(domain).alias("d"))
    return marked.groupBy("file").agg(F.countDistinct("u").alias("n_urls"), F.countDistinct("d").alias("n_domains"))


def verified_online(rows: DataFrame, url: str) -> tuple[DataFrame, DataFrame]:
    """Rows with verified and online yes and a URL, once per URL; and counts by outcome."""
    from corpusforge.functions import urls as U

    df = U.normalize(rows, url)
    outcome = F.when(F.lower("verified") != "yes", "not_verified").when(F.lower("online") != "yes", "not_online").when(F.col("reject_reason").isNotNull(), F.col("reject_reason"))
    marked = df.withColumn("_o", outcome).withColumn("_n", F.when(F.col("_o").isNull(), F.row_number().over(Window.partitionBy("normalized_url", F.col("_o").isNull()).orderBy(url))))
    marked = marked.withColumn("outcome", F.coalesce("_o", F.when(F.col("_n") > 1, "duplicate").otherwise("kept"))).drop("_o", "_n")
    return marked.filter("outcome = 'kept'"), marked.groupBy("outcome").agg(F.count("*").alias("n"))


def write_once(df: DataFrame, path: str, kind: str = "parquet", partition_by: list[str] | None = None) -> None:
    """Write, or fail if the output is there; nested columns become JSON in CSV files."""
    if kind == "csv":
        df = df.select(*[F.to_json(c).alias(c) if t.startswith(("array", "struct", "map")) else F.col(c) for c, t in df.dtypes])
    writer = df.write.mode("errorifexists").partitionBy(*(partition_by or []))
    writer.option("header", True).csv(path) if kind == "csv" else getattr(writer, kind)(path)
