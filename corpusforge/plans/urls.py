"""Queries over the URLs of pages: normalisation, features, cohorts, domains and splits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusforge.functions import cohorts as C
from corpusforge.functions import features as X
from corpusforge.functions import urls as U


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")


def canonical(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pages with normalized_url, analysis_url, host and registered_domain."""
    df = U.normalize(pages(spark, sf_dir))
    df = df.withColumn("analysis_url", U.analysis_url(F.col("normalized_url"))).withColumn("host", U.host_of(F.col("normalized_url")))
    return U.registered_domains(df, "host", U.suffix_table(spark))


#: The same in SQL, for the shapes of URL that pages has: no userinfo, port, IP or escape.
SPLIT = r"""
s AS (SELECT page_id, url, regexp_extract(url, '(?s)^([A-Za-z][A-Za-z0-9+.\-]*)://([^/?#]*)([^?#]*)(?:\?([^#]*))?(?:#(.*))?$', ['scheme', 'netloc', 'path', 'query', 'fragment']) AS p FROM pages),
t AS (SELECT page_id, url, lower(p.scheme) AS scheme, lower(p.netloc) AS host, p.path AS path, p.query AS query, p.fragment AS fragment FROM s),
u AS (SELECT *, scheme || '://' || host || path || CASE WHEN query <> '' THEN '?' || query ELSE '' END || CASE WHEN fragment <> '' THEN '#' || fragment ELSE '' END AS normalized_url,
      scheme || '://' || regexp_replace(host, '^www\.', '') || CASE WHEN path = '/' THEN '' ELSE path END || CASE WHEN query <> '' THEN '?' || query ELSE '' END || CASE WHEN fragment <> '' THEN '#' || fragment ELSE '' END AS analysis_url,
      array_to_string(list_slice(string_split(host, '.'), -2, -1), '.') AS registered_domain,
      list_transform(list_filter(string_split(query, '&'), lambda x: x <> ''), lambda x: lower(regexp_extract(x, '^([^=]*)', 1))) AS keys,
      list_filter(string_split(lower(path), '/'), lambda x: x <> '') AS segs, path IN ('', '/') AS bare FROM t)
"""


def split_profile(spark, sf_dir):
    df = X.url_features(canonical(spark, sf_dir)).withColumn("split", U.split_of(U.hash_bucket(F.col("registered_domain"))))
    return df.groupBy("split").agg(
        F.count("*").alias("n_urls"), F.countDistinct("registered_domain").alias("n_domains"), F.sum("URLLength").alias("sum_length"), F.sum("PathLength").alias("sum_path"),
        F.sum("QueryLength").alias("sum_query"), F.sum("PathSegmentCount").alias("sum_segments"), F.sum("QueryParameterCount").alias("sum_parameters"),
    )


BUCKET = "(('0x' || substr(sha256({}), 1, 8))::BIGINT % 100)"
SPLIT_CASE = "CASE WHEN {0} < 70 THEN 'train' WHEN {0} < 80 THEN 'calibration' WHEN {0} < 90 THEN 'validation' ELSE 'test' END"
SPLIT_PROFILE = f"""WITH {SPLIT}, f AS (SELECT *, 'http' || substr(analysis_url, strpos(analysis_url, '://')) AS neutral, {SPLIT_CASE.format(BUCKET.format('registered_domain'))} AS split FROM u)
SELECT split, count(*) AS n_urls, count(DISTINCT registered_domain) AS n_domains, sum(length(neutral))::BIGINT AS sum_length, sum(length(CASE WHEN path = '/' THEN '' ELSE path END))::BIGINT AS sum_path, sum(length(query))::BIGINT AS sum_query,
  sum(len(segs))::BIGINT AS sum_segments, sum(len(list_distinct(keys)))::BIGINT AS sum_parameters FROM f GROUP BY split"""


def url_keys(spark, sf_dir):
    df = canonical(spark, sf_dir)
    return df.select(
        "page_id", "normalized_url", "reject_reason", "analysis_url", "host", "registered_domain", U.fallback_domain(F.col("host")).alias("fallback_domain"), U.lenient_url(F.col("url")).alias("lenient_url"),
        U.redacted(F.col("url")).alias("redacted_url"), U.indicator_hash(F.col("normalized_url")).alias("indicator_hash"), (U.hash_fraction(F.col("analysis_url")) < 0.2).alias("held_out"), U.hash_bucket(F.col("registered_domain")).alias("bucket"),
        U.collector_check(F.col("url")).alias("collector_reason"), U.collector_url(F.col("url")).alias("collector_url"),
    )


URL_KEYS = f"""WITH {SPLIT} SELECT page_id, normalized_url, NULL::VARCHAR AS reject_reason, analysis_url, host, registered_domain, registered_domain AS fallback_domain,
  scheme || '://' || host || CASE WHEN path = '' THEN '/' ELSE path END || substr(normalized_url, length(scheme || '://' || host || path) + 1) AS lenient_url, scheme || '://' || host || path AS redacted_url, sha256(normalized_url) AS indicator_hash,
  ('0x' || substr(sha256(analysis_url), 1, 8))::BIGINT::DOUBLE / 4294967295.0 < 0.2 AS held_out, {BUCKET.format('registered_domain')} AS bucket, NULL::VARCHAR AS collector_reason,
  scheme || '://' || host || CASE WHEN rtrim(path, '/') = '' THEN '/' ELSE rtrim(path, '/') END || substr(normalized_url, length(scheme || '://' || host || path) + 1) AS collector_url FROM u"""


def safe_urls(spark, sf_dir):
    return U.safe_normalize(pages(spark, sf_dir)).select("page_id", "normalized_url", "hostname")


SAFE_URLS = f"WITH {SPLIT} SELECT page_id, normalized_url, host AS hostname FROM u"


def url_features(spark, sf_dir):
    df = X.url_features(U.normalize(pages(spark, sf_dir)))
    return df.select("page_id", *[F.round(c, 9).alias(c) if c in ("DigitRatioInURL", "LetterRatioInURL", "URLEntropy") else c for c in X.FEATURES])


def entropy_sql(text: str) -> str:
    return (f"CASE WHEN length({text}) = 0 THEN 0.0 ELSE list_sum(list_transform(list_distinct(string_split({text}, '')), lambda c: -((length({text}) - length(replace({text}, c, '')))::DOUBLE / length({text}))"
            f" * log2((length({text}) - length(replace({text}, c, '')))::DOUBLE / length({text})))) END")  # fmt: skip


TOKENS_SQL = "[" + ", ".join(f"'{t}'" for t in X.SUSPICIOUS_TOKENS) + "]"
COUNT = "(length(n) - length(replace(n, '{}', '')))::INT"
URL_FEATURES = f"""WITH {SPLIT}, f AS (SELECT *, regexp_replace(host, '^www\\.', '') AS h, CASE WHEN path = '/' THEN '' ELSE path END AS pa, 'http' || substr(analysis_url, strpos(analysis_url, '://')) AS n FROM u),
g AS (SELECT *, len(regexp_extract_all(n, '\\p{{Nd}}')) AS d, len(regexp_extract_all(n, '\\p{{L}}')) AS l, CASE WHEN list_has_any(regexp_split_to_array(lower(h || ' ' || pa || ' ' || query || ' ' || fragment), '[^a-z0-9]+'), {TOKENS_SQL}) THEN 1 ELSE 0 END AS tok,
  greatest(len(string_split(h, '.')) - 2, 0)::INT AS depth FROM f)
SELECT page_id, length(n)::INT AS "URLLength", length(h)::INT AS "HostnameLength", length(pa)::INT AS "PathLength", length(query)::INT AS "QueryLength", length(fragment)::INT AS "FragmentLength", len(segs)::INT AS "PathSegmentCount",
  len(list_distinct(keys))::INT AS "QueryParameterCount", (length(h) - length(replace(h, '.', '')))::INT AS "DotCount", depth AS "SubdomainDepth", depth AS "NoOfSubDomain", d::INT AS "NoOfDigitsInURL", round(d / length(n), 9) AS "DigitRatioInURL",
  l::INT AS "NoOfLettersInURL", round(l / length(n), 9) AS "LetterRatioInURL", {COUNT.format('=')} AS "NoOfEqualsInURL", {COUNT.format('?')} AS "NoOfQMarkInURL", {COUNT.format('&')} AS "NoOfAmpersandInURL", {COUNT.format('@')} AS "NoOfAtInURL",
  {COUNT.format('-')} AS "NoOfHyphenInURL", {COUNT.format('_')} AS "NoOfUnderscoreInURL", {COUNT.format('%')} AS "URLPercentEncodingCount", CASE WHEN contains(n, '%') THEN 1 ELSE 0 END AS "HasObfuscation", 0 AS "HasUserInfo", 0 AS "HasPort",
  CASE WHEN scheme = 'https' THEN 1 ELSE 0 END AS "IsHTTPS", 0 AS "IsDomainIP", 0 AS "IsShortened", 0 AS "HasSuspiciousTLD", tok AS "HasSuspiciousToken", tok AS "HasSuspiciousWord",
  CASE WHEN regexp_matches(h, '\\.(com|org|net|edu|gov)$') THEN 1 ELSE 0 END AS "IsTrustedTLD", round({entropy_sql('n')}, 9) AS "URLEntropy", length(h)::INT AS "DomainLength", 0 AS "HasTrustedBrand", 0 AS "HasTrustedBrandToken" FROM g"""

COMPONENTS = ("PathToUrlRatio", "QueryToUrlRatio", "QueryParametersToUrlRatio", "HostToQueryLengthRatio", "UniqueQueryKeyCount", "RepeatedQueryKeyCount", "QueryEncodedCharRatio", "PathEncodedCharRatio", "HostnameEntropy", "PathEntropy",
              "QueryEntropy", "FragmentEntropy", "SuspiciousHostTokenCount", "SuspiciousPathTokenCount", "SuspiciousQueryTokenCount", "SuspiciousTokenHostOnly", "SuspiciousTokenPathOnly", "SuspiciousTokenQueryOnly", "RepeatedPunctuationCount")


def component_features(spark, sf_dir):
    return X.component_features(pages(spark, sf_dir)).select("page_id", *[F.round(c, 9).alias(c) for c in COMPONENTS])


def _bad(text: str) -> str:
    return f"len(list_intersect(list_distinct(regexp_split_to_array(lower({text}), '[^a-z0-9]+')), {TOKENS_SQL}))"


COMPONENT_FEATURES = f"""WITH {SPLIT} SELECT page_id, round(length(path) / length(url), 9) AS "PathToUrlRatio", round(length(query) / length(url), 9) AS "QueryToUrlRatio", round(len(keys) / length(url), 9) AS "QueryParametersToUrlRatio",
  round(length(host) / greatest(length(query), 1), 9) AS "HostToQueryLengthRatio", len(list_distinct(keys))::DOUBLE AS "UniqueQueryKeyCount", len(list_filter(list_distinct(keys), lambda k: len(list_filter(keys, lambda x: x = k)) > 1))::DOUBLE AS "RepeatedQueryKeyCount",
  0.0::DOUBLE AS "QueryEncodedCharRatio", 0.0::DOUBLE AS "PathEncodedCharRatio", round({entropy_sql('host')}, 9) AS "HostnameEntropy", round({entropy_sql('path')}, 9) AS "PathEntropy", round({entropy_sql('query')}, 9) AS "QueryEntropy", round({entropy_sql('fragment')}, 9) AS "FragmentEntropy",
  {_bad('host')}::DOUBLE AS "SuspiciousHostTokenCount", {_bad('path')}::DOUBLE AS "SuspiciousPathTokenCount", {_bad('query')}::DOUBLE AS "SuspiciousQueryTokenCount",
  ({_bad('host')} > 0)::INT::DOUBLE AS "SuspiciousTokenHostOnly", ({_bad('path')} > 0)::INT::DOUBLE AS "SuspiciousTokenPathOnly", ({_bad('query')} > 0)::INT::DOUBLE AS "SuspiciousTokenQueryOnly", 1.0::DOUBLE AS "RepeatedPunctuationCount" FROM u"""

HOST_COLUMNS = ("RegisteredDomainLength", "HostLength", "HostEntropy", "HostDigitRatio", "HostHyphenRatio", "HostMaxCharShare", "HostDiversity", "HostVowelRatio", "HostConsonantRatio", "HostDepth", "HostPunycode", "HostNonAscii", "HostTriple", "HostOddChar")


def host_features(spark, sf_dir):
    return X.host_features(canonical(spark, sf_dir)).select("page_id", *[F.round(F.col(c).cast("double"), 9).alias(c) for c in HOST_COLUMNS], X.random_token(F.col("url")).alias("random_token"))


HOST_FEATURES = f"""WITH {SPLIT}, h AS (SELECT *, len(regexp_extract_all(host, '[aeiou]')) AS v FROM u) SELECT page_id, length(registered_domain)::DOUBLE AS "RegisteredDomainLength", length(host)::DOUBLE AS "HostLength", round({entropy_sql('host')}, 9) AS "HostEntropy",
  round(len(regexp_extract_all(host, '[0-9]')) / length(host), 9) AS "HostDigitRatio", round((length(host) - length(replace(host, '-', ''))) / length(host), 9) AS "HostHyphenRatio",
  round(list_max(list_transform(list_distinct(string_split(host, '')), lambda c: length(host) - length(replace(host, c, '')))) / length(host), 9) AS "HostMaxCharShare", round(len(list_distinct(string_split(host, ''))) / length(host), 9) AS "HostDiversity",
  round(v / length(host), 9) AS "HostVowelRatio", round((length(host) - v) / length(host), 9) AS "HostConsonantRatio", greatest(len(string_split(host, '.')) - 2, 0)::DOUBLE AS "HostDepth", 0.0::DOUBLE AS "HostPunycode", 0.0::DOUBLE AS "HostNonAscii",
  (len(list_filter(range(1, length(host)::BIGINT - 1), lambda i: host[i] = host[i + 1] AND host[i] = host[i + 2])) > 0)::INT::DOUBLE AS "HostTriple", 0.0::DOUBLE AS "HostOddChar",
  len(list_filter(regexp_split_to_array(url, '[^A-Za-z0-9]+'), lambda t: length(t) >= 8 AND regexp_matches(t, '[0-9A-Z]') AND {entropy_sql('t')} >= 3.2)) > 0 AS random_token FROM h"""


def tag_query(name: str):
    def query(spark, sf_dir):
        tags = C.tagged(pages(spark, sf_dir), name).select("page_id", "tags")
        if name == "realworld":
            tags = tags.withColumn("primary_cohort", C.primary(F.col("tags")))
        if name == "strata":
            tags = tags.withColumn("weight", C.complexity_weight(F.col("tags")))
        return tags

    return query


def words(values) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


def has(column: str, *values: str) -> str:
    return f"list_has_any({column}, {words(values)})"


_HOME, _Q, _LOWPATH = "(bare AND query = '' AND fragment = '')", "query <> ''", "lower(path)"
_TRACK = "regexp_matches(query, '(?i)(^|&)(utm_[^=]*|gclid|fbclid|yclid|mc_[^=]*)=')"
_REDIR = "regexp_matches(query, '(?i)(^|&)(url|redirect|redirect_url|return|returnto|next|continue|target|dest|destination|out)=')"
_UTM = "len(list_filter(keys, lambda k: starts_with(k, 'utm_'))) > 0"
_TOK = f"list_has_any(regexp_split_to_array(lower(host || ' ' || path || ' ' || query || ' ' || fragment), '[^a-z0-9]+'), {TOKENS_SQL})"
_ESC = "regexp_matches(url, '%[0-9a-fA-F]{2}')"
#: The conditions of each taxonomy in SQL, in the same order.
TAGS_SQL: dict[str, list[tuple[str, str]]] = {
    "basic": [("homepage", "len(segs) = 0 AND len(keys) = 0 AND fragment = ''"), ("content_path", "len(segs) > 0"), ("query", "len(keys) > 0"), ("search", f"{has('keys', *C.SEARCH_KEYS)} OR {has('segs', 'search', 'results', 'find')}"),
              ("multiple_query_parameters", "len(keys) > 1"), ("query_heavy", "len(keys) > 1"), ("encoded", "contains(url, '%')"), ("fragment", "fragment <> ''")],
    "realworld": [("homepage", "trim(path, '/') = '' AND query = '' AND fragment = ''"), ("content_path", "trim(path, '/') <> ''"), ("query", _Q), ("multiple_parameters", "len(list_distinct(keys)) > 1"), ("encoding", "contains(url, '%')"), ("fragment", "fragment <> ''"),
                  ("search", f"{has('segs', 'search')} OR {has('keys', 'search', 'q', 'query', 'search_query')}"), ("tracking", has("keys", "utm_source", "utm_medium", "utm_campaign", "gclid", "fbclid", "ref", "source")),
                  ("pagination", f"{has('keys', 'page', 'page_number', 'p', 'offset', 'cursor', 'start')} OR {has('segs', 'page')}"), ("login_account", "regexp_matches(host || chr(10) || lower(path), 'login|signin|sign-in|account|auth')"),
                  ("docs", "regexp_matches(host || chr(10) || lower(path), 'docs|documentation|reference|manual|guide')"), ("api_endpoint", f"{has(chr(115) + 'tring_split(host, ' + chr(39) + '.' + chr(39) + ')', 'api')} OR {has('segs', 'api', 'openapi', 'swagger')}"),
                  ("long_url", "length(url) >= 250"), ("long_query", "length(query) >= 100")],
    "structures": [("primary_homepage", "bare AND query = ''"), ("primary_query_only", "bare AND query <> ''"), ("primary_path_plus_query", "NOT bare AND query <> ''"), ("primary_path_only", "NOT bare AND query = ''"), ("homepage", _HOME), ("path", "NOT bare"), ("query", _Q),
                   ("path_plus_query", "NOT bare AND query <> ''"), ("multiple_query_params", "len(keys) > 1"), ("pagination", has("keys", "page", "offset", "start", "cursor", "p")), ("encoded", "contains(url, '%')"), ("fragment", "fragment <> ''"),
                   ("tracking", f"{_UTM} OR {has('keys', 'gclid', 'fbclid', 'yclid', 'mc_cid', 'mc_eid')}"), ("login_account", "regexp_matches(lower(host || path), 'login|log-in|signin|sign-in|account|register|signup')"), ("docs", "regexp_matches(lower(host || path), 'doc|documentation|reference|manual')"),
                   ("api", f"starts_with(host, 'api.') OR contains({_LOWPATH}, '/api/') OR ends_with({_LOWPATH}, '/api.php')"), ("long_query", "length(query) > 100"), ("long_url", "length(url) > 200"), ("search", "regexp_matches(lower(path || '?' || query), 'search|query|find')")],
    "dynamic": [("homepage", _HOME), ("path_only", "NOT bare AND query = ''"), ("query_only", "bare AND query <> ''"), ("path_plus_query", "NOT bare AND query <> ''"), ("fragment", "fragment <> ''"), ("encoded", _ESC), ("multiple_query_params", "len(keys) > 1"), ("long_query", "length(query) > 100"),
                ("long_url", "length(url) > 200"), ("tracking_utm_parameters", _TRACK), ("search", "regexp_matches(host || path || '?' || query, '(?i)search|query')"), ("docs", "regexp_matches(host || path || '?' || query, '(?i)(^|[./_-])docs?($|[./_-])|documentation')"),
                ("login_account", "regexp_matches(host || path || '?' || query, '(?i)login|sign.?in|account')")],
    "masks": [("homepage", _HOME), ("path_only", "NOT bare AND query = ''"), ("query_only", "bare AND query <> ''"), ("path_plus_query", "NOT bare AND query <> ''"), ("long_query_over_100_chars", "length(query) > 100"), ("multiple_query_parameters", "len(keys) > 1"), ("encoded_characters", _ESC),
              ("long_url_over_200_chars", "length(url) > 200"), ("high_entropy_over_4", f"{entropy_sql('url')} > 4"), ("redirect_or_tracking_parameter", f"{_TRACK} OR {_REDIR}"), ("fragment", "fragment <> ''"), ("repeated_punctuation", "regexp_matches(host || path || '?' || query || '#' || fragment, '//|[?][?]|##|&&|==|--|[.][.]|[?]#*$' ) AND regexp_matches(host || path || '?' || query || '#' || fragment, '//|[?][?]|##|&&|==|--|[.][.]')")],
    "bias": [("homepage", _HOME), ("path_only", "NOT bare AND query = ''"), ("query_only", "bare AND query <> ''"), ("path_plus_query", "NOT bare AND query <> ''"), ("fragment", "fragment <> ''"), ("encoded", _ESC), ("multiple_query_params", "len(keys) > 1"), ("long_query", "length(query) > 100"), ("long_url", "length(url) > 200"),
             ("tracking_utm_parameters", _TRACK), ("suspicious_token_present", _TOK), ("suspicious_token_absent", f"NOT {_TOK}"), ("digits_present", "regexp_matches(url, '\\p{Nd}')"), ("digits_absent", "NOT regexp_matches(url, '\\p{Nd}')")],
    "strata": [("short_dynamic", "length(url) <= 80 AND (NOT bare OR query <> '')"), ("medium_dynamic", "length(url) > 80 AND length(url) <= 120 AND (NOT bare OR query <> '')"), ("long_dynamic_120", "length(url) > 120 AND length(url) <= 200"), ("very_long_dynamic_200", "length(url) > 200"),
               ("query_urls", "query <> '' AND fragment = ''"), ("multi_param_urls", "len(list_distinct(keys)) >= 3"), ("tracking_param_urls", has("keys", "utm_source", "utm_medium", "utm_campaign", "utm_content", "utm_term", "ref", "referrer", "fbclid", "gclid", "yclid", "msclkid", "affiliate_id", "source", "medium", "campaign", "clickid")),
               ("fragment_urls", "fragment <> ''"), ("multi_path_urls", "len(segs) >= 3"), ("encoded_urls", "contains(url, '%')"), ("numeric_id_urls", "regexp_matches(path, '/[0-9]{3,}')"), ("search_urls", has("keys", "q", "query", "search", "s", "keyword", "keywords", "term", "find", "text", "kw"))],
    "hard_phishing": [("pathless", "bare"), ("short", "length(url) <= 60"), ("https", "scheme = 'https'"), ("no_suspicious_token", f"NOT {_TOK}"), ("no_suspicious_tld", "NOT regexp_matches(host, '\\.(tk|ml|ga|cf|xyz|top)$')"), ("no_digits", "NOT regexp_matches(url, '[0-9]')"),
                      ("no_ip", "NOT regexp_matches(host, '^[0-9]{1,3}(\\.[0-9]{1,3}){3}$')"), ("ordinary_looking_domain", f"NOT ({_TOK} OR regexp_matches(host, '\\.(tk|ml|ga|cf|xyz|top)$'))")],
    "legitimate": [("homepage", _HOME), ("has_path", "NOT bare"), ("has_query", _Q), ("has_fragment", "fragment <> ''"), ("multiple_parameters", "len(keys) > 1"), ("two_segments", "len(segs) >= 2"), ("three_segments", "len(segs) >= 3"), ("over_120", "length(url) > 120"), ("over_200", "length(url) > 200")],
    "held_out": [("query_strings", _Q), ("paths", "NOT bare"), ("login_parameters", "len(list_filter(keys, lambda k: regexp_matches(k, 'login|signin|user|pass|account'))) > 0"), ("encoded_values", _ESC), ("long_urls_over_200", "length(url) > 200"), ("redirect_parameters", has("keys", *C.REDIRECT_KEYS)),
                 ("brand_like_hostnames", "regexp_matches(host, 'google|paypal|microsoft|apple|amazon|facebook|netflix|outlook')")],
    "training": [("homepage", "len(segs) = 0 AND query = '' AND fragment = ''"), ("path", "len(segs) > 0"), ("query", _Q), ("search", f"{has('keys', *C.TRAINING_SEARCH)} OR {has('segs', 'search', 'find', 'results')}"), ("multiple_parameters", "len(keys) > 1"), ("encoded", "contains(url, '%')"), ("fragment", "fragment <> ''"),
                 ("pagination", f"{has('keys', *C.COLLECTOR_PAGES)} OR len(list_filter(segs, lambda x: starts_with(x, 'page-'))) > 0"), ("tracking", f"{_UTM} OR {has('keys', *C.COLLECTOR_TRACKING)}"),
                 ("documentation", f"{has('segs', 'docs', 'doc', 'documentation', 'reference', 'manual', 'guide', 'guides', 'tutorial')} OR regexp_matches(host, '^(docs|developer|developers)\\.')"),
                 ("login_account", f"{has('segs', 'login', 'signin', 'sign-in', 'log-in', 'logon', 'sso', 'oauth', 'oauth2', 'authorize', 'auth', 'signup', 'sign-up', 'register', 'account', 'accounts', 'myaccount', 'my-account', 'billing', 'dashboard')} OR regexp_matches(host, '^(login|signin|sso|auth)\\.')"), ("long_url", "length(url) > 200")],
}


def tags_sql(name: str) -> str:
    tags = ", ".join(f"CASE WHEN {c} THEN '{t}' END" for t, c in TAGS_SQL[name])
    base = f"WITH {SPLIT}, g AS (SELECT page_id, list_filter([{tags}], lambda x: x IS NOT NULL) AS tags FROM u)"
    if name == "realworld":
        first = ", ".join(f"CASE WHEN list_contains(tags, '{t}') THEN '{t}' END" for t in C.PRIORITY)
        return f"{base} SELECT page_id, tags, coalesce({first}, 'content_path') AS primary_cohort FROM g"
    if name == "strata":
        hard = " * ".join(f"CASE WHEN list_contains(tags, '{t}') THEN 1.5::DOUBLE ELSE 1.0::DOUBLE END" for t in ("very_long_dynamic_200", "encoded_urls", "multi_path_urls", "multi_param_urls"))
        return f"{base} SELECT page_id, tags, CASE WHEN len(tags) >= 2 THEN 3.0::DOUBLE ELSE 1.0::DOUBLE END * {hard} AS weight FROM g"
    return f"{base} SELECT page_id, tags FROM g"


def benign_classes(spark, sf_dir):
    df = C.split(pages(spark, sf_dir))
    return df.select("page_id", C.benign_class(F.col("_s")).alias("class"))


BENIGN_CLASSES = f"""WITH {SPLIT} SELECT page_id, CASE WHEN len(list_filter(keys, lambda k: regexp_matches(k, '{'|'.join(C.SECRET_PARTS)}'))) > 0 THEN NULL WHEN {_UTM} OR {has('keys', 'gclid', 'fbclid', 'yclid')} THEN 'tracking_parameters'
  WHEN {has('keys', *C.REDIRECT_KEYS)} THEN 'redirect_style' WHEN contains(query, '%') THEN 'encoded_query' WHEN length(query) > 100 THEN 'long_query' WHEN len(string_split(query, '&')) > 1 THEN 'multiple_query_parameters' WHEN fragment <> '' THEN 'fragment'
  WHEN NOT bare AND query <> '' THEN 'path_query' WHEN query <> '' THEN 'query_only' WHEN NOT bare THEN CASE WHEN length(url) > 200 THEN 'long_legitimate_url' WHEN {entropy_sql('path')} >= 4.0 THEN 'high_entropy_legitimate' ELSE 'path_only' END END AS class FROM u"""

def training_category(spark, sf_dir):
    classes = C.split(pages(spark, sf_dir)).select("page_id", "url", C.benign_class(F.col("_s")).alias("class"))
    return C.tagged(classes, "training").select("page_id", C.training_category(F.col("tags"), F.col("class")).alias("category"))


TRAINING_CATEGORY = (
    f"WITH c AS ({BENIGN_CLASSES}), t AS ({tags_sql('training')}) SELECT page_id, coalesce(class, "
    + ", ".join(f"CASE WHEN list_contains(tags, '{t}') THEN '{t}' END" for t in ("homepage", "documentation", "login_account", "search", "path")) + ", 'other_observed') AS category FROM c JOIN t USING (page_id)"
)

#: URLs of hard shapes by page_id, from a page's host: userinfo, ports, addresses, suffixes of two labels, other scripts, escapes, other schemes.
EDGES = (
    ("'HTTP://User:Pw@' || host || ':80/A%2fb?x=1#'", "'http://User:Pw@' || host || '/A%2fb?x=1'", None, "registered_domain", "userinfo_in_url", None),
    ("'https://' || host || ':8443/p/'", "'https://' || host || ':8443/p/'", None, "registered_domain", None, "'https://' || host || ':8443/p'"),
    ("'https://' || host || ':99999/'", None, "invalid_url", None, "parse_error", None),
    ("'http://192.168.1.9/x'", "'http://192.168.1.9/x'", None, "'192.168.1.9'", "private_or_reserved_ip", None),
    ("'http://8.8.8.8/x'", "'http://8.8.8.8/x'", None, "'8.8.8.8'", "ip_literal_host", None),
    ("'https://www.shop.co.uk/a'", "'https://www.shop.co.uk/a'", None, "'shop.co.uk'", None, "'https://www.shop.co.uk/a'"),
    ("'https://b\u00fccher.example.net/\u00fc?q=\u00e4'", "'https://xn--bcher-kva.example.net/\u00fc?q=\u00e4'", None, "'example.net'", None, "'https://xn--bcher-kva.example.net/%C3%BC?q=%C3%A4'"),
    ("'https://' || host || '/a%zz'", None, "invalid_url", None, None, "'https://' || host || '/a%zz'"),
    ("'ftp://' || host || '/file'", None, "unsupported_scheme", None, "non_http_scheme", None),
    ("'https://[2001:DB8:0:0::1]/x'", "'https://[2001:db8::1]/x'", None, "'2001:db8::1'", "private_or_reserved_ip", None),
    ("'https://host.localdomain/x'", "'https://host.localdomain/x'", None, "'host.localdomain'", "internal_host", None),
    ("'https://' || host || '/ok path'", None, "invalid_url", None, "malformed_chars", None),
    ("'https://' || host || ':0/%c3%bc'", None, "invalid_url", None, "bad_port", None),
)


def url_edges(spark, sf_dir):
    base = pages(spark, sf_dir).select("page_id", F.regexp_extract("url", "^[a-z]+://([^/?#]*)", 1).alias("host"))
    url = F.expr("CASE page_id % " + str(len(EDGES)) + " " + " ".join(f"WHEN {i} THEN {e[0]}" for i, e in enumerate(EDGES)) + " END")
    df = U.normalize(base.select("page_id", url.alias("url"))).withColumn("host", U.host_of(F.col("normalized_url")))
    df = U.registered_domains(df, "host", U.suffix_table(spark)).withColumn("collector_reason", U.collector_check(F.col("url")))
    return df.select("page_id", "normalized_url", "reject_reason", F.when(F.col("normalized_url").isNotNull(), F.col("registered_domain")).alias("registered_domain"), "collector_reason",
                     F.when(F.col("collector_reason").isNull(), U.collector_url(F.col("url"))).alias("collector_url"))


def _edge(column: int, quote: bool = False) -> str:
    value = lambda v: "NULL::VARCHAR" if v is None else f"'{v}'" if quote else v
    return "CASE page_id % " + str(len(EDGES)) + " " + " ".join(f"WHEN {i} THEN {value(e[column])}" for i, e in enumerate(EDGES)) + " END"


URL_EDGES = f"WITH {SPLIT} SELECT page_id, {_edge(1)} AS normalized_url, {_edge(2, True)} AS reject_reason, {_edge(3)} AS registered_domain, {_edge(4, True)} AS collector_reason, {_edge(5)} AS collector_url FROM u"

#: Rules of all three kinds: plain, wildcard and exception.
RULES = ("com", "net", "org", "uk", "co.uk", "ck", "*.ck", "!www.ck", "jp", "*.kawasaki.jp", "!city.kawasaki.jp", "au", "com.au", "io", "github.io")
#: Hosts around the first label of a page's host, which % stands for.
HOSTS = (
    "%.ck", "a.%.ck", "x.a.%.ck", "www.ck", "%.www.ck", "%.kawasaki.jp", "a.%.kawasaki.jp", "x.a.%.kawasaki.jp", "city.kawasaki.jp", "%.city.kawasaki.jp", "kawasaki.jp",
    "%.co.uk", "www.%.co.uk", "co.uk", "%.uk", "shop.%.com.au", "com.au", "%.github.io", "a.%.github.io", "github.io", "%.unknown", "%", "192.0.2.1", "2001:db8::1", "www.www.com",
)


def suffix_rules(spark, sf_dir):
    label = F.regexp_extract("url", "://([^./:?#]*)", 1)
    forms = F.array(*[F.replace(F.lit(h), F.lit("%"), label) for h in HOSTS])
    hosts = pages(spark, sf_dir).select("page_id", F.posexplode(forms).alias("form", "host"))
    return U.registered_domains(hosts, "host", U.suffix_table(spark, RULES))


SUFFIX_RULES = f"""
WITH k AS (
  SELECT regexp_replace(rule, '^(!|\\*\\.)', '') AS tail, CASE WHEN starts_with(rule, '!') THEN 1 WHEN starts_with(rule, '*.') THEN -1 ELSE 0 END AS mark FROM (SELECT unnest({list(RULES)}) AS rule)
), f AS (
  SELECT page_id, i - 1 AS form, replace({list(HOSTS)}[i], '%', regexp_extract(url, '://([^./:?#]*)', 1)) AS host FROM pages, unnest(range(1, {len(HOSTS) + 1})) AS u(i)
), p AS (SELECT *, regexp_replace(host, '^www\\.', '') AS plain, string_split(regexp_replace(host, '^www\\.', ''), '.') AS labels FROM f
), t AS (
  SELECT page_id, form, mark, i + mark AS pos FROM (SELECT *, unnest(range(1, len(labels) + 1)) AS i FROM p WHERE NOT regexp_matches(plain, ':|^[0-9.]+$'))
  JOIN k ON array_to_string(labels[i:], '.') = tail WHERE mark >= 0 OR i > 1
), b AS (SELECT page_id, form, coalesce(min(pos) FILTER (mark = 1), min(pos)) AS pos FROM t GROUP BY ALL)
SELECT page_id, form::INT AS form, host, CASE WHEN pos > 1 THEN array_to_string(labels[pos - 1:], '.') ELSE plain END AS registered_domain FROM p LEFT JOIN b USING (page_id, form)
"""
WORDS = (" Phishing ", "BENIGN", "malicious", "Safe", "0", "1", "legitimate", "fraud", "phish", "suspicious", "odd", "")


def label_words(spark, sf_dir):
    word = F.element_at(F.array(*[F.lit(w) for w in WORDS]), (F.col("page_id") % len(WORDS) + 1).cast("int"))
    return pages(spark, sf_dir).select("page_id", U.label_of(word).alias("label"), U.label_of(word, U.AUDIT_PHISHING).alias("audit"), U.label_of(word, U.FEED_PHISHING).alias("feed"))


LABEL_WORDS = f"""
WITH w AS (SELECT page_id, lower(trim({list(WORDS)}[page_id % {len(WORDS)} + 1])) AS w FROM pages), z AS (SELECT page_id, w, w IN ('0', 'legitimate', 'benign', 'safe') AS good FROM w)
SELECT page_id, CASE WHEN good THEN 0 WHEN w IN ('1', 'phishing', 'malicious') THEN 1 END AS label, CASE WHEN good THEN 0 WHEN w IN ('1', 'phishing', 'malicious', 'fraud', 'suspicious') THEN 1 END AS audit,
  CASE WHEN good THEN 0 WHEN w IN ('1', 'phishing', 'malicious', 'phish') THEN 1 END AS feed FROM z
"""


def finite_check(spark, sf_dir):
    i = F.col("page_id")
    bad = {"none": F.length("url"), "nulls": F.when(i % 3 > 0, F.length("url")), "nans": F.when(i % 5 == 0, float("nan")).otherwise(1.0), "both": F.when(i % 7 == 0, float("-inf")).when(i % 7 == 1, None).otherwise(2.0)}
    return X.finite_violations(pages(spark, sf_dir).select(*[c.alias(n) for n, c in bad.items()]), tuple(bad))


FINITE_CHECK = """
SELECT unnest(['none', 'nulls', 'nans', 'both']) AS feature, unnest([0, count(*) FILTER (WHERE page_id % 3 = 0), count(*) FILTER (WHERE page_id % 5 = 0), count(*) FILTER (WHERE page_id % 7 < 2)])::BIGINT AS bad FROM pages
"""


def host_categories(spark, sf_dir):
    rules = spark.createDataFrame([("example.org", "reference"), ("blog.example.org", "blog"), ("net", "network")], "suffix string, category string")
    hosts = pages(spark, sf_dir).select("page_id", F.regexp_replace(F.regexp_extract("url", "://([^/?#]*)", 1), r"^(m|blog)\.[^.]*", "$1").alias("host"), F.lit("other").alias("fallback"))
    return C.host_category(hosts, "host", rules, "fallback").select("page_id", "host", "category")


HOST_CATEGORIES = r"""
WITH h AS (SELECT page_id, regexp_replace(regexp_extract(url, '://([^/?#]*)', 1), '^(m|blog)\.[^.]*', '\1') AS host FROM pages)
SELECT page_id, host, CASE WHEN host = 'blog.example.org' OR ends_with(host, '.blog.example.org') THEN 'blog' WHEN host = 'example.org' OR ends_with(host, '.example.org') THEN 'reference' ELSE 'other' END AS category FROM h
"""
QUERIES = {
    "training_category": training_category, "url_edges": url_edges, "suffix_rules": suffix_rules, "label_words": label_words, "finite_check": finite_check, "host_categories": host_categories,
    "split_profile": split_profile, "url_keys": url_keys, "safe_urls": safe_urls, "url_features": url_features, "component_features": component_features, "host_features": host_features, "benign_classes": benign_classes,
    **{f"tags_{t}": tag_query(t) for t in C.TAXONOMIES},
}
ORACLE_SQL = {
    "training_category": TRAINING_CATEGORY, "url_edges": URL_EDGES, "suffix_rules": SUFFIX_RULES, "label_words": LABEL_WORDS, "finite_check": FINITE_CHECK, "host_categories": HOST_CATEGORIES,
    "split_profile": SPLIT_PROFILE, "url_keys": URL_KEYS, "safe_urls": SAFE_URLS, "url_features": URL_FEATURES, "component_features": COMPONENT_FEATURES, "host_features": HOST_FEATURES, "benign_classes": BENIGN_CLASSES,
    **{f"tags_{t}": tags_sql(t) for t in TAGS_SQL},
}
