"""Structural cohorts of URLs. Each taxonomy is a function from a split URL to ordered (tag, condition) pairs.

The same word means different things in different taxonomies (long_url is 120, 200 or 250 characters;
several parameters are pairs or distinct keys), so they are kept apart and named.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusforge.functions import features as X
from corpusforge.functions import urls as U

Tags = list[tuple[str, Column]]
#: Query keys and path segments by meaning.
SEARCH_KEYS = ("q", "query", "search", "search_query", "keyword", "keywords", "term", "k", "s")
COLLECTOR_SEARCH = ("q", "query", "search", "search_query", "searchterm", "keyword", "keywords", "k", "_nkw", "term", "wd")
COLLECTOR_PAGES = ("page", "p", "pg", "paged", "pagenum", "start", "offset", "skip", "cursor", "after")
COLLECTOR_TRACKING = (
    "fbclid", "gclid", "msclkid", "dclid", "yclid", "igshid", "mc_cid", "mc_eid", "_ga", "_gl", "ref", "ref_src", "ref_url", "referrer", "trk", "trkid", "trackingid", "tracking_id", "spm", "scid", "sc_cid",
    "ocid", "ito", "xtor", "cmpid", "si", "feature", "pf_rd_r", "pf_rd_p", "pd_rd_r", "pd_rd_w", "pd_rd_wg", "ved", "ei", "sxsrf", "sca_esv", "source", "src", "campaign",
)
REDIRECT_KEYS = ("url", "redirect", "redirect_url", "return", "returnto", "next", "continue", "target", "dest", "destination", "out")
SECRET_PARTS = ("token", "password", "passwd", "secret", "session", "auth", "credential", "email")
TRAINING_SEARCH = ("q", "query", "search", "search_query", "searchterm", "keyword", "keywords", "term")
TRACKING_QUERY = r"(?i)(?:^|&)(?:utm_[^=]*|gclid|fbclid|yclid|mc_[^=]*)="
REDIRECT_QUERY = r"(?i)(?:^|&)(?:url|redirect|redirect_url|return|returnto|next|continue|target|dest|destination|out)="
ESCAPE = "%[0-9a-fA-F]{2}"


def split(df: DataFrame, url: str = "url") -> DataFrame:
    """df with the struct _s of what the taxonomies read, computed once."""
    df = df.withColumn("_p", U.parts(F.col(url)))
    p = F.col("_p")
    pairs = U.query_pairs(p["query"])
    return df.withColumn("_s", F.struct(
        F.col(url).alias("url"), F.regexp_replace(p["host"], r"\.+$", "").alias("host"), p["path"].alias("path"), F.lower(p["path"]).alias("low"), p["query"].alias("query"), p["fragment"].alias("fragment"),
        pairs.alias("pairs"), F.transform(pairs, lambda x: F.lower(x["key"])).alias("keys"), U.segments(F.lower(p["path"])).alias("segs"),
    )).drop("_p")


def has(array: Column, *values: str) -> Column:
    return F.arrays_overlap(array, F.array(*[F.lit(v) for v in values]))


def bare(s: Column) -> Column:
    return s["path"].isin("", "/")


def taxonomy_basic(s: Column) -> Tags:
    full, many = F.size(s["segs"]) > 0, F.size(s["pairs"]) > 1
    return [
        ("homepage", ~full & (F.size(s["pairs"]) == 0) & (s["fragment"] == "")), ("content_path", full), ("query", F.size(s["pairs"]) > 0),
        ("search", has(s["keys"], *SEARCH_KEYS) | has(s["segs"], "search", "results", "find")), ("multiple_query_parameters", many), ("query_heavy", many),
        ("encoded", s["url"].contains("%")), ("fragment", s["fragment"] != ""),
    ]


PRIORITY = ("homepage", "login_account", "long_query", "tracking", "pagination", "encoding", "fragment", "search", "multiple_parameters", "query", "api_endpoint", "docs", "long_url", "content_path")


#: The tags, their order, and the words of their rules.
def taxonomy_realworld(s: Column) -> Tags:
    path, where = F.trim(s["path"], F.lit("/")) != "", F.concat_ws("\n", s["host"], s["low"])
    any_of = lambda words: where.rlike("|".join(words))
    return [
        ("homepage", ~path & (s["query"] == "") & (s["fragment"] == "")), ("content_path", path), ("query", s["query"] != ""), ("multiple_parameters", F.size(F.array_distinct(s["keys"])) > 1),
        ("encoding", s["url"].contains("%")), ("fragment", s["fragment"] != ""), ("search", has(s["segs"], "search") | has(s["keys"], "search", "q", "query", "search_query")),
        ("tracking", has(s["keys"], "utm_source", "utm_medium", "utm_campaign", "gclid", "fbclid", "ref", "source")), ("pagination", has(s["keys"], "page", "page_number", "p", "offset", "cursor", "start") | has(s["segs"], "page")),
        ("login_account", any_of(("login", "signin", "sign-in", "account", "auth"))), ("docs", any_of(("docs", "documentation", "reference", "manual", "guide"))),
        ("api_endpoint", has(F.split(s["host"], r"\."), "api") | has(s["segs"], "api", "openapi", "swagger")), ("long_url", F.length(s["url"]) >= 250), ("long_query", F.length(s["query"]) >= 100),
    ]


def primary(tags: Column, priority: tuple[str, ...] = PRIORITY, default: str = "content_path") -> Column:
    """The first tag of the priority list that a row has."""
    return F.coalesce(*[F.when(F.array_contains(tags, t), t) for t in priority], F.lit(default))


def training_category(tags: Column, detected: Column) -> Column:
    """The category of a collected URL: what the collector detects (its class, or NULL), else the first of a few training tags."""
    named = [F.when(F.array_contains(tags, t), t) for t in ("homepage", "documentation", "login_account", "search", "path")]
    return F.coalesce(detected, *named, F.lit("other_observed"))


#: The tags, their order, and the words of their rules.
def taxonomy_structures(s: Column) -> Tags:
    query, where = s["query"] != "", F.lower(F.concat(s["host"], s["path"]))
    return [
        ("primary_homepage", bare(s) & ~query), ("primary_query_only", bare(s) & query), ("primary_path_plus_query", ~bare(s) & query), ("primary_path_only", ~bare(s) & ~query),
        ("homepage", bare(s) & ~query & (s["fragment"] == "")), ("path", ~bare(s)), ("query", query), ("path_plus_query", ~bare(s) & query), ("multiple_query_params", F.size(s["pairs"]) > 1),
        ("pagination", has(s["keys"], "page", "offset", "start", "cursor", "p")), ("encoded", s["url"].contains("%")), ("fragment", s["fragment"] != ""),
        ("tracking", F.exists(s["keys"], lambda k: k.startswith("utm_")) | has(s["keys"], "gclid", "fbclid", "yclid", "mc_cid", "mc_eid")),
        ("login_account", where.rlike("login|log-in|signin|sign-in|account|register|signup")), ("docs", where.rlike("doc|documentation|reference|manual")),
        ("api", s["host"].startswith("api.") | s["low"].contains("/api/") | s["low"].endswith("/api.php")), ("long_query", F.length(s["query"]) > 100), ("long_url", F.length(s["url"]) > 200),
        ("search", F.lower(F.concat_ws("?", s["path"], s["query"])).rlike("search|query|find")),
    ]


#: The tags, their order, and the words of their rules.
def taxonomy_training(s: Column) -> Tags:
    full = F.size(s["segs"]) > 0
    return [
        ("homepage", ~full & (s["query"] == "") & (s["fragment"] == "")), ("path", full), ("query", s["query"] != ""), ("search", has(s["keys"], *TRAINING_SEARCH) | has(s["segs"], "search", "find", "results")),
        ("multiple_parameters", F.size(s["pairs"]) > 1), ("encoded", s["url"].contains("%")), ("fragment", s["fragment"] != ""), ("pagination", has(s["keys"], *COLLECTOR_PAGES) | F.exists(s["segs"], lambda x: x.startswith("page-"))),
        ("tracking", F.exists(s["keys"], lambda k: k.startswith("utm_")) | has(s["keys"], *COLLECTOR_TRACKING)),
        ("documentation", has(s["segs"], "docs", "doc", "documentation", "reference", "manual", "guide", "guides", "tutorial") | s["host"].rlike(r"^(?:docs|developer|developers)\.")),
        ("login_account", has(s["segs"], "login", "signin", "sign-in", "log-in", "logon", "sso", "oauth", "oauth2", "authorize", "auth", "signup", "sign-up", "register", "account", "accounts", "myaccount", "my-account", "billing", "dashboard") | s["host"].rlike(r"^(?:login|signin|sso|auth)\.")), ("long_url", F.length(s["url"]) > 200),
    ]


#: The tags, their order, and the words of their rules.
def taxonomy_collector(s: Column) -> Tags:
    segs, keys, host, low = s["segs"], s["keys"], s["host"], s["low"]
    values = F.transform(s["pairs"], lambda p: p["value"])
    last = F.coalesce(F.try_element_at(segs, F.lit(-1)), F.lit(""))
    extension = F.regexp_extract(last, r"\.([^.]*)$", 1)
    path = F.when(s["path"] == "", "/").otherwise(s["path"])
    return [
        ("homepage", (F.size(segs) == 0) & (s["query"] == "") & (s["fragment"] == "")), ("path", F.size(segs) > 0), ("multi_path", F.size(segs) >= 2), ("deep_path", F.size(segs) >= 3), ("query", s["query"] != ""),
        ("multi_query", F.size(s["pairs"]) >= 2), ("tracking", F.exists(keys, lambda k: k.startswith("utm_")) | has(keys, *COLLECTOR_TRACKING)), ("fragment", s["fragment"] != ""), ("encoded", s["url"].rlike(ESCAPE)),
        ("long_url", F.length(s["url"]) > 120), ("very_long_url", F.length(s["url"]) > 200),
        ("numeric_id", F.exists(segs, lambda x: x.rlike("^[0-9]{3,}$") & ~x.rlike("^(?:19|20)[0-9]{2}$")) | path.rlike("[0-9]{5,}") | F.exists(values, lambda v: v.rlike("^[0-9]{3,}$"))),
        ("search", has(keys, *COLLECTOR_SEARCH) | low.rlike("(?:^|/)(?:search|find|results)(?:/|$)") | host.startswith("search.")),
        ("article", F.concat(low, F.lit("/")).rlike("/(?:news|article|articles|blog|blogs|story|stories|post|posts|wiki|press|press-releases|magazine|opinion|world|science|technology|business|politics)(?:/|$)")
            | F.concat(low, F.lit("/")).rlike("/(?:19|20)[0-9]{2}/[0-9]{1,2}(?:/[0-9]{1,2})?(?:/|$)")),
        ("product", has(segs, "dp", "product", "products", "item", "itm", "ip", "sku", "listing", "listings")),
        ("profile", F.coalesce(F.try_element_at(segs, F.lit(1)).isin("user", "users", "u", "profile", "profiles", "in", "channel", "c", "people", "author", "authors", "member", "members"), F.lit(False))
            | F.exists(segs, lambda x: x.startswith("@")) | (host.rlike(r"(?:github|gitlab)\.com$") & (F.size(segs) == 1))),
        ("documentation", has(segs, "docs", "doc", "documentation", "reference", "manual", "guide", "guides", "tutorial", "tutorials", "learn", "handbook", "howto", "library")
            | host.rlike(r"^(?:docs|developer|developers|learn)\.") | host.contains("readthedocs")),
        ("repository", (host.rlike(r"(?:github\.com|gitlab\.com|bitbucket\.org|huggingface\.co)$") & (F.size(segs) >= 2)) | has(segs, "tree", "blob", "commit", "commits", "pull", "pulls", "issues", "releases", "tags")
            | (host.endswith("pypi.org") & F.coalesce(F.try_element_at(segs, F.lit(1)) == "project", F.lit(False))) | (host.endswith("npmjs.com") & F.coalesce(F.try_element_at(segs, F.lit(1)) == "package", F.lit(False)))),
        ("login", has(segs, "login", "signin", "sign-in", "log-in", "logon", "sso", "oauth", "oauth2", "authorize", "auth", "signup", "sign-up", "register") | host.rlike(r"^(?:login|signin|sso|auth)\.")),
        ("account", has(segs, "account", "accounts", "myaccount", "my-account", "billing", "dashboard", "subscription", "subscriptions") | host.rlike(r"^(?:account|accounts|myaccount)\.")),
        ("settings", has(segs, "settings", "setting", "preferences", "preference", "options", "privacy-settings", "config", "configuration")),
        ("media", (F.size(segs) > 0) & (has(segs, "watch", "video", "videos", "embed", "track", "tracks", "album", "playlist", "podcast", "podcasts", "shorts", "reel", "reels", "photo", "photos", "image", "images", "audio", "live", "clip", "clips", "episode", "episodes", "stream")
            | extension.isin("mp4", "mp3", "webm", "m4a", "mov", "jpg", "jpeg", "png", "gif", "webp", "svg", "wav", "ogg", "m3u8") | host.rlike(r"(?:youtu\.be|youtube\.com|vimeo\.com|twitch\.tv|soundcloud\.com|spotify\.com|tiktok\.com|instagram\.com)$"))),
        ("pagination", has(keys, *COLLECTOR_PAGES) | low.rlike("/page[/-][0-9]+")),
        ("api_like", has(segs, "api", "rest", "graphql", "ajax", "oembed", "wp-json", "_api") | low.rlike(r"/v[0-9]+(?:\.[0-9]+)?(?:/|$)") | extension.isin("json", "xml") | host.startswith("api.") | has(keys, "callback", "jsonp")),
    ]


def benign_class(s: Column) -> Column:
    """One class by ordered rules; NULL for home pages and where a key looks like a secret."""
    raw = F.when(s["query"] == "", F.array().cast("array<string>")).otherwise(F.split(s["query"], "&"))
    keys = F.transform(raw, lambda x: F.lower(F.regexp_extract(x, "(?s)^([^=]*)", 1)))
    secret = F.exists(keys, lambda k: k.rlike("|".join(SECRET_PARTS)))
    query, path = s["query"] != "", ~bare(s)
    return (
        F.when(secret, None).when(F.exists(keys, lambda k: k.startswith("utm_") | k.isin("gclid", "fbclid", "yclid")), "tracking_parameters").when(F.exists(keys, lambda k: k.isin(*REDIRECT_KEYS)), "redirect_style")
        .when(s["query"].contains("%"), "encoded_query").when(F.length(s["query"]) > 100, "long_query").when(F.size(raw) > 1, "multiple_query_parameters").when(s["fragment"] != "", "fragment")
        .when(path & query, "path_query").when(query, "query_only")
        .when(path, F.when(F.length(s["url"]) > 200, "long_legitimate_url").when(U.shannon_entropy(s["path"]) >= 4.0, "high_entropy_legitimate").otherwise("path_only"))
    )


def taxonomy_dynamic(s: Column) -> Tags:
    query = s["query"] != ""
    where = F.concat(s["host"], s["path"], F.lit("?"), s["query"])
    return [
        ("homepage", bare(s) & ~query & (s["fragment"] == "")), ("path_only", ~bare(s) & ~query), ("query_only", bare(s) & query), ("path_plus_query", ~bare(s) & query), ("fragment", s["fragment"] != ""),
        ("encoded", s["url"].rlike(ESCAPE)), ("multiple_query_params", F.size(s["pairs"]) > 1), ("long_query", F.length(s["query"]) > 100), ("long_url", F.length(s["url"]) > 200),
        ("tracking_utm_parameters", s["query"].rlike(TRACKING_QUERY)), ("search", where.rlike("(?i)search|query")), ("docs", where.rlike("(?i)(?:^|[./_-])docs?(?:$|[./_-])|documentation")), ("login_account", where.rlike("(?i)login|sign.?in|account")),
    ]


def taxonomy_masks(s: Column) -> Tags:
    query = s["query"] != ""
    return [
        ("homepage", bare(s) & ~query & (s["fragment"] == "")), ("path_only", ~bare(s) & ~query), ("query_only", bare(s) & query), ("path_plus_query", ~bare(s) & query), ("long_query_over_100_chars", F.length(s["query"]) > 100),
        ("multiple_query_parameters", F.size(s["pairs"]) > 1), ("encoded_characters", s["url"].rlike(ESCAPE)), ("long_url_over_200_chars", F.length(s["url"]) > 200), ("high_entropy_over_4", U.shannon_entropy(s["url"]) > 4),
        ("redirect_or_tracking_parameter", s["query"].rlike(TRACKING_QUERY) | s["query"].rlike(REDIRECT_QUERY)), ("fragment", s["fragment"] != ""),
        ("repeated_punctuation", F.concat(s["host"], s["path"], F.lit("?"), s["query"], F.lit("#"), s["fragment"]).rlike(X.REPEATED_MARK)),
    ]


def taxonomy_bias(s: Column) -> Tags:
    query = s["query"] != ""
    token = F.size(X.suspicious(F.concat_ws(" ", s["host"], s["path"], s["query"], s["fragment"]))) > 0
    digits = s["url"].rlike(r"\p{Nd}")
    return [
        ("homepage", bare(s) & ~query & (s["fragment"] == "")), ("path_only", ~bare(s) & ~query), ("query_only", bare(s) & query), ("path_plus_query", ~bare(s) & query), ("fragment", s["fragment"] != ""), ("encoded", s["url"].rlike(ESCAPE)),
        ("multiple_query_params", F.size(s["pairs"]) > 1), ("long_query", F.length(s["query"]) > 100), ("long_url", F.length(s["url"]) > 200), ("tracking_utm_parameters", s["query"].rlike(TRACKING_QUERY)),
        ("suspicious_token_present", token), ("suspicious_token_absent", ~token), ("digits_present", digits), ("digits_absent", ~digits),
    ]


def taxonomy_strata(s: Column) -> Tags:
    n, keys, dynamic = F.length(s["url"]), F.transform(s["pairs"], lambda p: p["key"]), ~bare(s) | (s["query"] != "")
    return [
        ("short_dynamic", (n <= 80) & dynamic), ("medium_dynamic", (n > 80) & (n <= 120) & dynamic), ("long_dynamic_120", (n > 120) & (n <= 200)), ("very_long_dynamic_200", n > 200),
        ("query_urls", (s["query"] != "") & (s["fragment"] == "")), ("multi_param_urls", F.size(F.array_distinct(keys)) >= 3),
        ("tracking_param_urls", has(keys, "utm_source", "utm_medium", "utm_campaign", "utm_content", "utm_term", "ref", "referrer", "fbclid", "gclid", "yclid", "msclkid", "affiliate_id", "source", "medium", "campaign", "clickid")),
        ("fragment_urls", s["fragment"] != ""), ("multi_path_urls", F.size(s["segs"]) >= 3), ("encoded_urls", s["url"].contains("%")), ("numeric_id_urls", s["path"].rlike("/[0-9]{3,}")),
        ("search_urls", has(keys, "q", "query", "search", "s", "keyword", "keywords", "term", "find", "text", "kw")),
    ]


def taxonomy_hard_phishing(s: Column, short: int = 60) -> Tags:
    token = F.size(X.suspicious(F.concat_ws(" ", s["host"], s["path"], s["query"], s["fragment"]))) > 0
    tld, ip = s["host"].rlike(rf"\.(?:{'|'.join(X.SUSPICIOUS_TLDS)})$"), s["host"].contains(":") | s["host"].rlike(r"^[0-9]{1,3}(?:\.[0-9]{1,3}){3}$")
    return [
        ("pathless", bare(s)), ("short", F.length(s["url"]) <= short), ("https", F.lower(s["url"]).startswith("https:")), ("no_suspicious_token", ~token), ("no_suspicious_tld", ~tld), ("no_digits", ~s["url"].rlike("[0-9]")),
        ("no_ip", ~ip), ("ordinary_looking_domain", ~(token | tld | ip)),
    ]


def taxonomy_legitimate(s: Column) -> Tags:
    return [
        ("homepage", bare(s) & (s["query"] == "") & (s["fragment"] == "")), ("has_path", ~bare(s)), ("has_query", s["query"] != ""), ("has_fragment", s["fragment"] != ""), ("multiple_parameters", F.size(s["pairs"]) > 1),
        ("two_segments", F.size(s["segs"]) >= 2), ("three_segments", F.size(s["segs"]) >= 3), ("over_120", F.length(s["url"]) > 120), ("over_200", F.length(s["url"]) > 200),
    ]


def taxonomy_held_out(s: Column) -> Tags:
    return [
        ("query_strings", s["query"] != ""), ("paths", ~bare(s)), ("login_parameters", F.exists(s["keys"], lambda k: k.rlike("login|signin|user|pass|account"))), ("encoded_values", s["url"].rlike(ESCAPE)),
        ("long_urls_over_200", F.length(s["url"]) > 200), ("redirect_parameters", has(s["keys"], *REDIRECT_KEYS)), ("brand_like_hostnames", s["host"].rlike("google|paypal|microsoft|apple|amazon|facebook|netflix|outlook")),
    ]


TAXONOMIES: dict[str, Callable[[Column], Tags]] = {
    "basic": taxonomy_basic, "realworld": taxonomy_realworld, "structures": taxonomy_structures, "training": taxonomy_training, "collector": taxonomy_collector, "dynamic": taxonomy_dynamic, "masks": taxonomy_masks,
    "bias": taxonomy_bias, "strata": taxonomy_strata, "hard_phishing": taxonomy_hard_phishing, "legitimate": taxonomy_legitimate, "held_out": taxonomy_held_out,
}


def tagged(df: DataFrame, taxonomy: str, url: str = "url", out: str = "tags") -> DataFrame:
    """df with the array of tags that a taxonomy gives each URL, in the taxonomy's order."""
    df = split(df, url)
    pairs = TAXONOMIES[taxonomy](F.col("_s"))
    return df.withColumn(out, F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), t) for t, c in pairs]))).drop("_s")


def complexity_weight(tags: Column, high: float = 3.0) -> Column:
    """Weight of a hard negative: ``high`` from two strata on, and 1.5 more for each of the four hardest."""
    weight = F.when(F.size(tags) >= 2, high).otherwise(1.0)
    for t in ("very_long_dynamic_200", "encoded_urls", "multi_path_urls", "multi_param_urls"):
        weight = weight * F.when(F.array_contains(tags, t), 1.5).otherwise(1.0)
    return weight


def host_category(df: DataFrame, host: str, categories: DataFrame, default: str, out: str = "category") -> DataFrame:
    """df with the category of the longest listed suffix of the host (table suffix, category), else the default column."""
    hosts = df.select(F.col(host).alias("_host")).distinct()
    labels = F.split("_host", r"\.")
    tails = hosts.select("_host", F.posexplode(F.transform(F.sequence(F.lit(1), F.greatest(F.size(labels) - 1, F.lit(1))), lambda i: F.concat_ws(".", F.slice(labels, i, F.size(labels))))).alias("_i", "_tail"))
    best = tails.join(categories, F.col("_tail") == F.col("suffix")).groupBy("_host").agg(F.min_by("category", "_i").alias("_found"))
    return df.join(best, F.col(host) == F.col("_host"), "left").withColumn(out, F.coalesce("_found", default)).drop("_host", "_found")
