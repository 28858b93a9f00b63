"""Lexical features of URLs as native columns: 35 of the whole URL, 19 of its components, 14 of its host."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusforge.functions import urls as U

#: Fixed values.
SUSPICIOUS_TLDS = ("tk", "ml", "ga", "cf", "xyz", "top")
SHORTENERS = ("bit.ly", "tinyurl.com", "t.co", "goo.gl", "is.gd", "ow.ly")
SUSPICIOUS_TOKENS = ("login", "verify", "update", "bank", "secure", "account", "free", "bonus", "signin", "confirm", "password", "wallet", "crypto", "pay", "winner", "claim", "security", "verifyaccount")
FEATURES = (
    "URLLength", "HostnameLength", "PathLength", "QueryLength", "FragmentLength", "PathSegmentCount", "QueryParameterCount", "DotCount", "SubdomainDepth", "NoOfSubDomain",
    "NoOfDigitsInURL", "DigitRatioInURL", "NoOfLettersInURL", "LetterRatioInURL", "NoOfEqualsInURL", "NoOfQMarkInURL", "NoOfAmpersandInURL", "NoOfAtInURL", "NoOfHyphenInURL",
    "NoOfUnderscoreInURL", "URLPercentEncodingCount", "HasObfuscation", "HasUserInfo", "HasPort", "IsHTTPS", "IsDomainIP", "IsShortened", "HasSuspiciousTLD", "HasSuspiciousToken",
    "HasSuspiciousWord", "IsTrustedTLD", "URLEntropy", "DomainLength", "HasTrustedBrand", "HasTrustedBrandToken",
)
EXCLUDED = ("IsHTTPS", "DomainLength", "NoOfSubDomain", "HasSuspiciousWord", "HasTrustedBrand", "HasTrustedBrandToken")
MODEL_FEATURES = tuple(f for f in FEATURES if f not in EXCLUDED)


def times(text: Column, char: str) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(char)))


def flag(condition: Column) -> Column:
    return F.when(condition, 1).otherwise(0)


def suspicious(text: Column) -> Column:
    """The distinct suspicious tokens of a text."""
    return F.array_intersect(U.tokens(text), F.array(*[F.lit(t) for t in SUSPICIOUS_TOKENS]))


def url_features(df: DataFrame, normalized: str = "normalized_url") -> DataFrame:
    """df with the 35 features of a normalised URL and features_ok; a NULL URL has zeros and features_ok = false.

    The URL is split once, in a projection of its own.
    """
    a = U.analysis_url(F.col(normalized))
    df = df.withColumn("_a", F.coalesce(a, F.lit(""))).withColumn("_f", U.parts(F.col("_a"))).withColumn("_n", U.neutral_url(F.col("_a")))
    p, n = F.col("_f"), F.col("_n")
    host = F.regexp_replace(p["host"], r"^\.+|\.+$", "")
    is_ip = host.contains(":") | host.rlike(r"^[0-9]{1,3}(?:\.[0-9]{1,3}){3}$")
    depth = F.when((host == "") | is_ip, 0).otherwise(F.greatest(F.size(F.split(host, r"\.")) - 2, F.lit(0)))
    digits, letters = F.regexp_count(n, F.lit(r"\p{Nd}")), F.regexp_count(n, F.lit(r"\p{L}"))
    size = F.greatest(F.length(n), F.lit(1))
    token = flag(F.size(suspicious(F.concat_ws(" ", host, p["path"], p["query"], p["fragment"]))) > 0)
    found = {
        "URLLength": F.length(n), "HostnameLength": F.length(host), "PathLength": F.length(p["path"]), "QueryLength": F.length(p["query"]), "FragmentLength": F.length(p["fragment"]),
        "PathSegmentCount": F.size(U.segments(p["path"])), "QueryParameterCount": F.size(F.array_distinct(U.query_keys(p["query"], lower=False))), "DotCount": times(host, "."),
        "SubdomainDepth": depth, "NoOfSubDomain": depth, "NoOfDigitsInURL": digits, "DigitRatioInURL": digits / size, "NoOfLettersInURL": letters, "LetterRatioInURL": letters / size,
        "NoOfEqualsInURL": times(n, "="), "NoOfQMarkInURL": times(n, "?"), "NoOfAmpersandInURL": times(n, "&"), "NoOfAtInURL": times(n, "@"), "NoOfHyphenInURL": times(n, "-"),
        "NoOfUnderscoreInURL": times(n, "_"), "URLPercentEncodingCount": times(n, "%"), "HasObfuscation": flag(n.contains("%") | p["userinfo"].isNotNull()), "HasUserInfo": flag(p["userinfo"].isNotNull()),
        "HasPort": flag(p["port"].isNotNull()), "IsHTTPS": flag(p["scheme"] == "https"), "IsDomainIP": flag(is_ip), "IsShortened": flag(host.isin(*SHORTENERS)),
        "HasSuspiciousTLD": flag(host.rlike(rf"\.(?:{'|'.join(SUSPICIOUS_TLDS)})$")), "HasSuspiciousToken": token, "HasSuspiciousWord": token,
        "IsTrustedTLD": flag(host.rlike(r"\.(?:com|org|net|edu|gov)$")), "URLEntropy": U.shannon_entropy(n), "DomainLength": F.length(host), "HasTrustedBrand": F.lit(0), "HasTrustedBrandToken": F.lit(0),
    }
    return df.withColumns(found | {"features_ok": F.col(normalized).isNotNull()}).drop("_a", "_f", "_n")


def finite_violations(df: DataFrame, columns: tuple[str, ...] = FEATURES) -> DataFrame:
    """One row per column with the number of null or non-finite values."""
    bad = lambda c: F.count_if(F.col(c).isNull() | F.isnan(F.col(c).cast("double")) | (F.abs(F.col(c).cast("double")) == float("inf")))
    counts = df.agg(*[bad(c).alias(c) for c in columns])
    return counts.select(F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).alias("bad")) for c in columns])).alias("r")).select("r.*")


REPEATED_MARK = r"([^\w\s])\1+"


def component_features(df: DataFrame, url: str = "url") -> DataFrame:
    """df with the 19 ratios, entropies and token counts of a URL's components."""
    df = df.withColumn("_p", U.parts(F.col(url))).withColumn("_k", U.query_keys(F.col("_p")["query"]))
    p, keys = F.col("_p"), F.col("_k")
    total, path, query = F.greatest(F.length(F.col(url)), F.lit(1)), p["path"], p["query"]
    one = lambda c: F.greatest(F.length(c), F.lit(1))
    escaped = lambda c: F.regexp_count(c, F.lit("%[0-9a-fA-F]{2}")) * 3 / one(c)
    bad = {w: F.size(suspicious(p[c])) for w, c in (("Host", "host"), ("Path", "path"), ("Query", "query"))}
    repeated = F.size(F.filter(F.array_distinct(keys), lambda k: F.size(F.filter(keys, lambda x: x == k)) > 1))
    found = {
        "PathToUrlRatio": F.length(path) / total, "QueryToUrlRatio": F.length(query) / total, "QueryParametersToUrlRatio": F.size(keys) / total, "HostToQueryLengthRatio": F.length(p["host"]) / one(query),
        "UniqueQueryKeyCount": F.size(F.array_distinct(keys)).cast("double"), "RepeatedQueryKeyCount": repeated.cast("double"), "QueryEncodedCharRatio": escaped(query), "PathEncodedCharRatio": escaped(path),
        "HostnameEntropy": U.shannon_entropy(p["host"]), "PathEntropy": U.shannon_entropy(path), "QueryEntropy": U.shannon_entropy(query), "FragmentEntropy": U.shannon_entropy(p["fragment"]),
    }
    found |= {f"Suspicious{w}TokenCount": n.cast("double") for w, n in bad.items()} | {f"SuspiciousToken{w}Only": (n > 0).cast("double") for w, n in bad.items()}
    found["RepeatedPunctuationCount"] = F.regexp_count(F.col(url), F.lit(REPEATED_MARK)).cast("double")
    return df.withColumns(found).drop("_p", "_k")


def host_features(df: DataFrame, url: str = "url", registered: str = "registered_domain") -> DataFrame:
    """df with 14 numbers of the host name; where there is no host, of the registered domain."""
    df = df.withColumn("_h", F.regexp_replace(U.parts(F.col(url))["host"], r"^\.+|\.+$", ""))
    df = df.withColumn("_c", F.when(F.col("_h") == "", F.col(registered)).otherwise(F.col("_h")))
    h, c = F.col("_h"), F.col("_c")
    n = F.greatest(F.length(c), F.lit(1))
    distinct = F.array_distinct(F.split(c, ""))
    vowels = F.regexp_count(c, F.lit("[aeiou]"))
    most = F.coalesce(F.array_max(F.transform(distinct, lambda x: F.length(c) - F.length(F.replace(c, x)))), F.lit(0))
    return df.withColumns({
        "RegisteredDomainLength": F.length(registered), "HostLength": F.length(h), "HostEntropy": U.shannon_entropy(c), "HostDigitRatio": F.regexp_count(c, F.lit("[0-9]")) / n, "HostHyphenRatio": times(c, "-") / n,
        "HostMaxCharShare": most / n, "HostDiversity": F.size(distinct) / n, "HostVowelRatio": vowels / n, "HostConsonantRatio": (F.length(c) - vowels) / n,
        "HostDepth": F.greatest(F.size(F.split(h, r"\.")) - 2, F.lit(0)), "HostPunycode": flag(h.contains("xn--")), "HostNonAscii": flag(F.col(url).rlike(r"[^\x00-\x7F]")),
        "HostTriple": flag(c.rlike(r"(.)\1\1")), "HostOddChar": flag(c.rlike(r"[^\p{L}\p{N}.\-]")),
    }).drop("_h", "_c")


def random_token(url: Column) -> Column:
    """Whether a token of eight or more characters has an entropy of 3.2 bits or more and a digit or a capital."""
    parts = F.split(url, "[^A-Za-z0-9]+")
    return F.exists(parts, lambda t: (F.length(t) >= 8) & t.rlike("[0-9A-Z]") & (U.shannon_entropy(t) >= 3.2))
