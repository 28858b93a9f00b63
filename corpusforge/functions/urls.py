"""URL column functions: splitting, normalising with reasons, hosts, registered domains, query pairs, hashing.

Everything is a column expression; only the compression of IPv6 literals runs in an Arrow UDF, and only on
rows that hold one. A rejected URL is never dropped: it comes back as NULL with a reason beside it.
"""

from __future__ import annotations

import ipaddress
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: RFC 3986 parts; unlike parse_url it never raises and accepts underscores in hosts.
PARTS = r"(?s)^([A-Za-z][A-Za-z0-9+.\-]*)://([^/?#]*)([^?#]*)(?:\?([^#]*))?(?:#(.*))?$"
LABEL = r"[a-z0-9](?:[a-z0-9-]{0,61}[a-z0-9])?"
IPV4 = r"^(?:(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])\.){3}(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])$"
#: Suffixes of the small built-in table; a full list can be passed instead.
SUFFIXES = ("com", "org", "net", "edu", "gov", "io", "dev", "in", "uk", "de", "co.uk", "org.uk", "ac.uk", "gov.uk", "co.in", "gov.in", "nic.in", "ac.in", "github.io")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with the value computed once, however often the body uses it; the optimiser would copy a plain expression to each use."""
    return F.transform(F.array(value), body)[0]


def parts(url: Column) -> Column:
    """struct(scheme, netloc, userinfo, host, port, path, query, fragment) of a URL; host is lower case without brackets."""
    names = ("scheme", "netloc", "path", "query", "fragment")
    groups = let(url, lambda u: F.struct(*[F.coalesce(F.regexp_extract(u, PARTS, i), F.lit("")).alias(n) for i, n in enumerate(names, 1)]))

    def of(g: Column) -> Column:
        place = F.regexp_replace(g["netloc"], r"(?s)^.*@", "")
        host = F.when(place.startswith("["), F.regexp_extract(place, r"^\[([^\]]*)\]", 1)).otherwise(F.regexp_replace(place, r":[^:]*$", ""))
        port = F.regexp_extract(F.regexp_replace(place, r"^\[[^\]]*\]", ""), r":([^:]*)$", 1)
        return F.struct(
            F.lower(g["scheme"]).alias("scheme"), g["netloc"].alias("netloc"), F.when(g["netloc"].contains("@"), F.regexp_extract(g["netloc"], r"(?s)^(.*)@", 1)).alias("userinfo"), F.lower(host).alias("host"),
            F.nullif(port, F.lit("")).alias("port"), g["path"].alias("path"), g["query"].alias("query"), g["fragment"].alias("fragment"),
        )

    return let(groups, of)


@F.pandas_udf(T.StringType())  # type: ignore[call-overload]
def compressed_ipv6(host: pd.Series) -> pd.Series:
    def one(h):
        try:
            return ipaddress.IPv6Address(h).compressed
        except ValueError:
            return None

    return host.map(one, na_action="ignore")


def _join(scheme: Column, netloc: Column, path: Column, query: Column, fragment: Column) -> Column:
    tail = lambda mark, c: F.when(c != "", F.concat(F.lit(mark), c)).otherwise("")
    return F.concat(scheme, F.lit("://"), netloc, path, tail("?", query), tail("#", fragment))


def normalize(df: DataFrame, url: str = "url", out: str = "normalized_url", reason: str = "reject_reason") -> DataFrame:
    """df with the strict canonical URL, or NULL and one of empty_url, unsupported_scheme, invalid_url.

    Scheme and host become lower case, trailing dots, default ports and empty ? and # go, IPv6 is compressed
    and names become ASCII; userinfo, the case of the path, query and fragment stay.
    """
    value = F.regexp_replace(F.col(url), r"^\s+|\s+$", "")
    df = df.withColumn("_v", value).withColumn("_p", parts(F.col("_v")))
    p = F.col("_p")
    bare = F.regexp_replace(p["host"], r"\.+$", "")
    literal = F.regexp_replace(p["netloc"], r"(?s)^.*@", "").startswith("[")
    named = F.when(bare.rlike(r"^[\x00-\x7F]*$"), bare).otherwise(F.lower(F.try_reflect(F.lit("java.net.IDN"), F.lit("toASCII"), bare)))
    df = df.withColumn("_6", F.when(literal, bare)).withColumn("_h", F.when(literal, compressed_ipv6("_6")).otherwise(named))
    ok_host = F.when(literal, F.col("_h").isNotNull()).otherwise(F.col("_h").rlike(rf"^{LABEL}(?:\.{LABEL})*$") & (F.length("_h") <= 253))
    port = p["port"].try_cast("int") if hasattr(p["port"], "try_cast") else p["port"].cast("int")
    ok_port = p["port"].isNull() | (p["port"].rlike(r"^[0-9]+$") & port.between(1, 65535))
    scheme = F.coalesce(F.lower(F.regexp_extract("_v", r"^([A-Za-z][A-Za-z0-9+.\-]*):", 1)), F.lit(""))
    why = (
        F.when(F.col("_v").isNull() | (F.col("_v") == ""), "empty_url")
        .when(F.col("_v").rlike(r"[\s\x00-\x1f\x7f\x85\xa0]") | F.col("_v").rlike(r"%(?![0-9a-fA-F]{2})"), "invalid_url")
        .when(~scheme.isin("http", "https"), F.when(F.col("_v").contains("://"), "unsupported_scheme").otherwise("invalid_url"))
        .when((p["scheme"] == "") | (bare == "") | ~F.coalesce(ok_host, F.lit(False)) | ~ok_port, "invalid_url")
    )
    default = ((p["scheme"] == "http") & (port == 80)) | ((p["scheme"] == "https") & (port == 443))
    netloc = F.concat(
        F.coalesce(F.concat(p["userinfo"], F.lit("@")), F.lit("")), F.when(literal, F.concat(F.lit("["), F.col("_h"), F.lit("]"))).otherwise(F.col("_h")),
        F.when(p["port"].isNotNull() & ~default, F.concat(F.lit(":"), port.cast("string"))).otherwise(""),
    )
    df = df.withColumn(reason, why)
    good = _join(p["scheme"], netloc, p["path"], p["query"], p["fragment"])
    return df.withColumn(out, F.when(F.col(reason).isNull(), good)).drop("_v", "_p", "_6", "_h")


def analysis_url(normalized: Column) -> Column:
    """The comparison key of a normalised URL: without one leading www. and without a bare / as path."""
    no_www = F.regexp_replace(normalized, r"^([a-z]+://(?:[^/?#]*@)?)www\.", "$1")
    return F.regexp_replace(no_www, r"^([a-z]+://[^/?#]*)/(?=[?#]|$)", "$1")


def neutral_url(analysis: Column) -> Column:
    return F.regexp_replace(analysis, "^https://", "http://")


def lenient_url(url: Column) -> Column:
    """For deduplication only: http:// is assumed, the host is lower case, default ports go, the path is / at least; '' if unusable."""
    value = let(F.trim(url), lambda v: F.when(v.rlike("(?i)^[a-z][a-z0-9+.-]*://"), v).otherwise(F.concat(F.lit("http://"), v)))

    def of(p: Column) -> Column:
        keep = p["port"].isNotNull() & ~(((p["scheme"] == "http") & (p["port"] == "80")) | ((p["scheme"] == "https") & (p["port"] == "443")))
        netloc = F.concat(p["host"], F.when(keep, F.concat(F.lit(":"), p["port"])).otherwise(""))
        path = F.when(p["path"] == "", "/").otherwise(p["path"])
        good = p["scheme"].isin("http", "https") & (p["host"] != "")
        return F.when(F.coalesce(good, F.lit(False)), _join(p["scheme"], netloc, path, p["query"], p["fragment"])).otherwise("")

    return let(parts(value), of)


#: Top-level names that are never public.
INTERNAL = ("local", "localhost", "internal", "lan", "home", "corp", "intranet", "test", "example", "invalid", "localdomain", "arpa", "onion", "private", "lab")


#: Characters that the collector's quoting leaves as they are.
UNQUOTED = r"[A-Za-z0-9/%:@!$&'()*+,;=\-._~]"


def quoted(text: Column, more: str = "") -> Column:
    """text with every character outside the fixed set (and ``more``) as the escapes of its UTF-8 bytes."""
    chars = F.filter(F.split(text, ""), lambda c: c != "")
    escaped = lambda c: F.regexp_replace(F.hex(F.encode(c, "UTF-8")), "(..)", "%$1")
    return F.array_join(F.transform(chars, lambda c: F.when(c.rlike(UNQUOTED) | (c == more), c).otherwise(escaped(c))), "")


def collector_ascii(url: Column) -> Column:
    """A URL in ASCII: internationalised names by IDN, the rest quoted; NULL where the name cannot be encoded."""
    tail = lambda mark, c: F.when(c != "", F.concat(F.lit(mark), quoted(c, "?"))).otherwise("")

    def of(p: Column) -> Column:
        name = F.when(~p["netloc"].rlike(r"^\.|\.\."), F.try_reflect(F.lit("java.net.IDN"), F.lit("toASCII"), p["netloc"]))
        return F.concat(p["scheme"], F.lit("://"), name, quoted(p["path"]), tail("?", p["query"]), tail("#", p["fragment"]))

    return let(F.trim(url), lambda v: F.when(v.rlike(r"^[\x00-\x7F]*$"), v).otherwise(let(parts(v), of)))


#: IPv6 blocks that are not global: loopback, mapped, discard, protocol assignments, documentation, 6to4, unique local, link local.
RESERVED_IPV6 = r"^(?:::1?$|::ffff:|64:ff9b:1:|100::|2001:(?:0*(?:1?[0-9a-f]{1,2})?|0?db8):|2002:|3fff:0?[0-9a-f]{1,3}:|f[cd]|fe[89ab])"


def collector_check(url: Column) -> Column:
    """The reason why a collector refuses a URL, or NULL; the first that holds counts."""
    def of(x: Column) -> Column:
        url, raw, v, p, host = x["url"], x["raw"], x["v"], x["p"], x["host"]
        private = host.rlike(r"^(?:10\.|127\.|0\.|169\.254\.|192\.168\.|172\.(?:1[6-9]|2[0-9]|3[01])\.|100\.(?:6[4-9]|[7-9][0-9]|1[01][0-9]|12[0-7])\.|192\.0\.[02]\.|198\.1[89]\.|198\.51\.100\.|203\.0\.113\.|(?:2[4-5][0-9])\.)")
        port = p["port"].try_cast("long")
        return (
            F.when(url.isNull() | (url == ""), "empty").when(F.length(raw) < 10, "too_short").when(F.length(raw) > 2048, "too_long")
            .when(~raw.rlike("(?i)^https?://"), "non_http_scheme").when(v.isNull(), "encoding_error").when(v.rlike(r'[\s\x00-\x1f\x7f<>"\\{}^`]'), "malformed_chars")
            .when(p["port"].isNotNull() & (~p["port"].rlike("^[0-9]+$") | port.isNull() | (port > 65535)), "parse_error").when(host == "", "no_host")
            .when(p["netloc"].contains("@"), "userinfo_in_url").when(port == 0, "bad_port")
            .when(host.rlike(IPV4) | host.contains(":"), F.when(private | host.rlike(RESERVED_IPV6), "private_or_reserved_ip").otherwise("ip_literal_host"))
            .when(~host.contains(".") | (F.length(host) > 253) | ~host.rlike(rf"^(?:{LABEL}\.)+(?:[a-z]{{2,63}}|xn--[a-z0-9-]{{1,59}})$"), "bad_host")
            .when(F.element_at(F.split(host, r"\."), -1).isin(*INTERNAL), "internal_host")
        )

    texts = let(url, lambda u: F.struct(u.alias("url"), F.trim(u).alias("raw"), collector_ascii(u).alias("v")))
    split = let(texts, lambda t: F.struct(t["url"].alias("url"), t["raw"].alias("raw"), t["v"].alias("v"), parts(t["v"]).alias("p")))
    return let(let(split, lambda t: F.struct(t["url"].alias("url"), t["raw"].alias("raw"), t["v"].alias("v"), t["p"].alias("p"), F.regexp_replace(t["p"]["host"], r"\.+$", "").alias("host"))), of)


def upper_escapes(text: Column) -> Column:
    """%xx in upper case: every piece after a % has its first two characters raised if they are hexadecimal."""
    pieces = F.split(text, "%")
    up = lambda x: F.when(x.rlike("^[0-9a-fA-F]{2}"), F.concat(F.upper(F.substring(x, 1, 2)), F.substring(x, 3, 1 << 20))).otherwise(x)
    rest = F.transform(F.slice(pieces, F.lit(2), F.greatest(F.size(pieces) - 1, F.lit(0))), up)
    return F.concat_ws("%", F.concat(F.slice(pieces, 1, 1), rest))


def collector_url(url: Column) -> Column:
    """The collector's canonical form of an accepted URL: upper-case escapes, no trailing / on a path, no default port."""

    def of(p: Column) -> Column:
        keep = p["port"].isNotNull() & ~(((p["scheme"] == "http") & (p["port"] == "80")) | ((p["scheme"] == "https") & (p["port"] == "443")))
        netloc = F.concat(F.regexp_replace(p["host"], r"\.+$", ""), F.when(keep, F.concat(F.lit(":"), p["port"])).otherwise(""))
        path = F.regexp_replace(upper_escapes(p["path"]), "/+$", "")
        return _join(p["scheme"], netloc, F.when(path == "", "/").otherwise(path), upper_escapes(p["query"]), upper_escapes(p["fragment"]))

    return let(let(collector_ascii(url), parts), of)


def safe_normalize(df: DataFrame, url: str = "url") -> DataFrame:
    """df with normalized_url and hostname: the strict form, else scheme and netloc in lower case without the fragment; the host defaults to unknown."""
    df = normalize(df, url, "_strict", "_why")
    whole = F.trim(F.col(url))
    plain = let(parts(whole), lambda p: F.when(p["scheme"] != "", _join(p["scheme"], F.lower(p["netloc"]), p["path"], p["query"], F.lit(""))).otherwise(whole))
    df = df.withColumn("normalized_url", F.coalesce("_strict", plain))
    return df.withColumn("hostname", F.coalesce(F.nullif(parts(F.col("normalized_url"))["host"], F.lit("")), F.lit("unknown"))).drop("_strict", "_why")


def redacted(url: Column) -> Column:
    """A URL without userinfo, query and fragment."""
    return F.regexp_replace(F.regexp_replace(url, r"(?s)[?#].*$", ""), r"^([A-Za-z][A-Za-z0-9+.\-]*://)[^/]*@", "$1")


def host_of(normalized: Column) -> Column:
    return F.regexp_replace(parts(normalized)["host"], r"\.+$", "")


def fallback_domain(host: Column, row_id: Column | None = None) -> Column:
    """The last two labels of a host; an IP as it is; for no host a group of its own where row_id is given."""
    labels = F.split(host, r"\.")
    two = F.concat_ws(".", F.slice(labels, F.greatest(F.size(labels) - 1, F.lit(1)), F.lit(2)))
    missing = F.concat(F.lit("__missing_domain_"), row_id.cast("string")) if row_id is not None else F.lit("")
    return F.when(F.coalesce(host, F.lit("")) == "", missing).when(host.rlike(IPV4) | host.contains(":"), host).otherwise(two)


def resolved(page: Column, ref: Column) -> Column:
    """A reference as an absolute URL; page is the struct of parts of the URL that it stands in.

    References with a scheme stay as they are, and so do those with an authority, which take the page's scheme; the
    paths of others are merged with the page's, and segments . and .. are folded away.
    """
    scheme, tail = F.concat(page["scheme"], F.lit(":")), r"(?s)^[^?#]*"
    origin = F.concat(scheme, F.lit("//"), page["netloc"])
    path, rest = F.regexp_extract(ref, r"(?s)^([^?#]*)", 1), F.regexp_replace(ref, tail, "")
    own_query = F.when(page["query"] != "", F.concat(F.lit("?"), page["query"])).otherwise("")
    own = F.when(page["path"] == "", "/").otherwise(page["path"])
    # empty segments within a merged path go, those of a path from the root stay
    folder = F.slice(F.split(page["path"], "/"), F.lit(2), F.greatest(F.size(F.split(page["path"], "/")) - 2, F.lit(0)))
    steps = F.split(path, "/")
    merged = F.concat(F.filter(F.concat(folder, F.slice(steps, F.lit(1), F.size(steps) - 1)), lambda s: s != ""), F.slice(steps, F.lit(-1), F.lit(1)))
    whole = F.when(path.startswith("/"), F.slice(steps, F.lit(2), F.size(steps))).otherwise(merged)
    return (
        F.when(ref.rlike("(?i)^[a-z][a-z0-9+.-]*:"), ref).when(ref.startswith("//"), F.concat(scheme, ref)).when(path != "", F.concat(origin, without_dots(whole), rest))
        .when(ref.startswith("?"), F.concat(origin, own, ref)).otherwise(F.concat(origin, own, own_query, ref))
    )


def without_dots(segments: Column) -> Column:
    """The path of an array of segments, without those that are . or .. and those that .. leaves."""

    def step(path: Column, s: Column) -> Column:
        return F.when(s == "..", F.slice(path, F.lit(1), F.greatest(F.size(path) - 1, F.lit(0)))).when(s == ".", path).otherwise(F.concat(path, F.array(s)))

    kept = F.aggregate(segments, F.array().cast("array<string>"), step)
    return F.concat(F.lit("/"), F.array_join(kept, "/"), F.when(F.element_at(segments, -1).isin(".", "..") & (F.size(kept) > 0), "/").otherwise(""))


def suffix_table(spark, suffixes=SUFFIXES) -> DataFrame:
    """Rules of a public suffix list in its own form: co.uk, *.ck for all names below, !www.ck for an exception."""
    return spark.createDataFrame([(s,) for s in suffixes], "suffix string")


def suffix_file(spark, path: str) -> DataFrame:
    """The rules of a list file: a rule ends at the first space, lines that begin with // are remarks, names become ASCII."""
    rule = F.lower(F.regexp_extract("value", r"^\s*(\S+)", 1))
    lines = spark.read.text(path).select(rule.alias("rule")).filter((F.col("rule") != "") & ~F.col("rule").startswith("//"))
    mark, name = F.regexp_extract("rule", r"^(!|\*\.)?", 1), F.regexp_replace("rule", r"^(?:!|\*\.)", "")
    plain = F.when(name.rlike(r"^[\x00-\x7F]*$"), name).otherwise(F.lower(F.try_reflect(F.lit("java.net.IDN"), F.lit("toASCII"), name)))
    return lines.select(F.concat(mark, plain).alias("suffix")).filter("suffix IS NOT NULL").distinct()


def registered_domains(df: DataFrame, host: str, suffixes: DataFrame, out: str = "registered_domain") -> DataFrame:
    """df with the registered domain: one label more than the public suffix; IPs, hosts without a rule and suffixes themselves stay as they are.

    Of the rules that match a host an exception wins, which takes its first label off, else the one with most
    labels, a wildcard counting as a label. Computed once for each distinct host: its label suffixes are exploded and equi-joined to the table.
    """
    mark = F.when(F.col("suffix").startswith("!"), 1).when(F.col("suffix").startswith("*."), -1).otherwise(0)
    rules = suffixes.select(F.regexp_replace("suffix", r"^(?:!|\*\.)", "").alias("_suffix"), mark.alias("_mark"))
    hosts = df.select(F.col(host).alias("_host")).distinct()
    plain = F.regexp_replace("_host", r"^www\.", "")
    labels = F.split(plain, r"\.")
    cut = F.when(plain.rlike(IPV4) | plain.contains(":"), F.array().cast("array<int>")).otherwise(F.sequence(F.lit(1), F.greatest(F.size(labels), F.lit(1))))
    tails = hosts.select("_host", plain.alias("_plain"), labels.alias("_labels"), F.explode_outer(cut).alias("_i"))
    tail = lambda i: F.concat_ws(".", F.slice("_labels", i, F.size("_labels")))
    found = tails.withColumn("_tail", F.when(F.col("_i") > 0, tail(F.col("_i")))).join(rules, F.col("_tail") == F.col("_suffix"), "left")
    # where the public suffix begins: at the rule's first label, one before it for a wildcard, one after it for an exception
    begin = F.when(F.col("_mark").isNotNull() & ((F.col("_mark") >= 0) | (F.col("_i") > 1)), F.struct((F.col("_mark") < 1).alias("plain"), (F.col("_i") + F.col("_mark")).alias("at")))
    best = found.groupBy("_host").agg(F.min(begin).alias("_begin"), F.first("_plain").alias("_plain"), F.first("_labels").alias("_labels"))
    at = F.col("_begin.at")
    best = best.select("_host", F.when(at > 1, tail(F.greatest(at - 1, F.lit(1)))).otherwise(F.col("_plain")).alias(out))
    return df.join(best, F.col(host).eqNullSafe(F.col("_host")), "left").drop("_host")


def query_pairs(query: Column) -> Column:
    """Decoded (key, value) pairs in order, blank values kept, empty segments skipped."""
    decoded = lambda c: F.coalesce(F.try_url_decode(c), c)
    pair = lambda s: F.struct(decoded(F.regexp_extract(s, "(?s)^([^=]*)", 1)).alias("key"), decoded(F.regexp_extract(s, "(?s)=(.*)$", 1)).alias("value"))
    return F.transform(F.filter(F.split(query, "&"), lambda s: s != ""), pair)


def query_keys(query: Column, lower: bool = True) -> Column:
    """The decoded keys of all pairs, repeats kept."""
    return F.transform(query_pairs(query), lambda p: F.lower(p["key"]) if lower else p["key"])


def segments(path: Column) -> Column:
    return F.filter(F.split(path, "/"), lambda s: s != "")


def tokens(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), "[^a-z0-9]+"), lambda t: t != "")


def shannon_entropy(text: Column) -> Column:
    """Bits per character: log2(n) - sum c log2 c / n over the counts c; 0 for empty text."""
    chars = F.split(text, "")
    n = F.length(text)
    counts = F.transform(F.array_distinct(chars), lambda c: n - F.length(F.replace(text, c)))
    total = F.aggregate(F.array_sort(counts), F.lit(0.0), lambda s, c: s + c * F.log2(c.cast("double")))
    return F.when(n > 0, F.greatest(F.log2(n.cast("double")) - total / n, F.lit(0.0))).otherwise(F.lit(0.0))


def indicator_hash(url: Column) -> Column:
    return F.sha2(F.trim(url), 256)


def hash_fraction(text: Column) -> Column:
    """The first 32 bits of SHA-256 as a number from 0 to 1."""
    return F.conv(F.substring(F.sha2(text, 256), 1, 8), 16, 10).cast("double") / F.lit(4294967295.0)


def hash_bucket(text: Column, buckets: int = 100) -> Column:
    return F.conv(F.substring(F.sha2(text, 256), 1, 8), 16, 10).cast("long") % buckets


def split_of(bucket: Column, cuts: tuple[tuple[str, int], ...] = (("train", 70), ("calibration", 80), ("validation", 90), ("test", 100))) -> Column:
    out = F.when(bucket < cuts[0][1], cuts[0][0])
    for name, below in cuts[1:]:
        out = out.when(bucket < below, name)
    return out


#: Label words by meaning.
LEGITIMATE, PHISHING = ("0", "legitimate", "benign", "safe"), ("1", "phishing", "malicious")
AUDIT_PHISHING, FEED_PHISHING = (*PHISHING, "fraud", "suspicious"), (*PHISHING, "phish")


def label_of(text: Column, phishing: tuple[str, ...] = PHISHING) -> Column:
    """0 or 1 for a label word in any case, NULL for an unknown one."""
    word = F.lower(F.trim(text))
    return F.when(word.isin(*LEGITIMATE), 0).when(word.isin(*phishing), 1)
