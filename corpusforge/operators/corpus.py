"""Building a labelled corpus: reasons, deduplication, conflicts, overlap, membership and audits.

Spark has no row order, so every operator that keeps a first row takes the column that orders the input;
ties are broken by all key columns given. Windows are partitioned by the key, aggregates run map-side
first, and semi and anti joins are left to the planner, which broadcasts a side only if it is small.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusforge.operators.percentiles import percentiles


def keep_first(df: DataFrame, keys: list[str], *order: str | Column) -> DataFrame:
    """The first row of each key in the order given.

    The filter on the number lets Spark keep one row a key in every map task (WindowGroupLimit), so a hot key shuffles a row a task.
    """
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("_n = 1").drop("_n")


#: Parts into which rows of a key that are not its first are dealt.
SALTS = 64


def mark_first(df: DataFrame, keys: list[str], order: str, name: str, among: Column | None = None) -> DataFrame:
    """df with a boolean: whether a row is the first of its key (among the rows of a condition, if one is given).

    The least order of each key is merged before the shuffle and joined back, where adaptive execution splits a hot key.
    Only rows that tie for the first place meet in one window; the others of a key are dealt into SALTS parts.
    """
    among = F.lit(True) if among is None else among
    least = df.filter(among).groupBy(F.struct(*keys).alias("_key")).agg(F.struct(F.min(order).alias("o"), F.count_if(F.col(order).isNull()).alias("n")).alias("_least"))
    rows = df.withColumn("_key", F.struct(*keys)).join(least, "_key", "left")
    # as in ascending order, a null comes first
    tied = among & F.when(F.col("_least.n") > 0, F.col(order).isNull()).otherwise(F.col(order) == F.col("_least.o"))
    rows = rows.withColumn("_tied", F.coalesce(tied, F.lit(False)))
    part = F.when(F.col("_tied"), -1).otherwise(F.pmod(F.xxhash64(order), F.lit(SALTS)))
    number = F.row_number().over(Window.partitionBy("_key", part).orderBy(F.col(order)))
    return rows.withColumn(name, F.col("_tied") & (number == 1)).drop("_key", "_least", "_tied")


def rank_of(column: str, ranked: list[str]) -> Column:
    """Place of a value in a priority list; others come last."""
    place = F.lit(len(ranked))
    for i in reversed(range(len(ranked))):
        place = F.when(F.col(column) == ranked[i], i).otherwise(place)
    return place


def keep_best(df: DataFrame, keys: list[str], source: str, priority: list[str], order: str) -> DataFrame:
    """Of each key the row of the best source, then the first."""
    return keep_first(df, keys, rank_of(source, priority), order)


def conflicts(df: DataFrame, keys: list[str], label: str = "label") -> DataFrame:
    """Keys with more than one label: keys, n_rows, labels."""
    found = df.groupBy(*keys).agg(F.count("*").alias("n_rows"), F.array_sort(F.collect_set(label)).alias("labels"))
    return found.filter(F.size("labels") > 1)


def drop_conflicts(df: DataFrame, keys: list[str], label: str = "label") -> DataFrame:
    """Rows whose key has one label only; every copy of the others goes."""
    return df.join(conflicts(df, keys, label).select(*keys), keys, "left_anti")


def require_no_conflicts(df: DataFrame, keys: list[str], label: str = "label", examples: int = 5) -> DataFrame:
    """df, or an error that names the first conflicting keys."""
    bad = conflicts(df, keys, label).orderBy(*keys).limit(examples).collect()
    if bad:
        raise ValueError(f"conflicting labels: {[tuple(r[k] for k in keys) for r in bad]}")
    return df


def merge_membership(df: DataFrame, key: str, source: str, priority: list[str], order: str, keep: list[str]) -> DataFrame:
    """One row per key: the kept columns of its best source's first row, and all its sources, sorted."""
    first = F.struct(rank_of(source, priority), order)
    return df.groupBy(key).agg(*[F.min_by(c, first).alias(c) for c in keep], F.array_sort(F.collect_set(source)).alias("memberships"))


def incremental(df: DataFrame, key: str, order: str, existing: DataFrame) -> DataFrame:
    """df with outcome added, duplicate (of an earlier row) or existing (in an earlier corpus with the same key)."""
    known = existing.select(F.col(key).alias("_k")).distinct().withColumn("_known", F.lit(True))
    marked = mark_first(df, [key], order, "_first").join(known, F.col(key) == F.col("_k"), "left")
    return marked.withColumn("outcome", F.when(F.col("_known"), "existing").when(~F.col("_first"), "duplicate").otherwise("added")).drop("_first", "_k", "_known")


def duplicate_examples(df: DataFrame, key: str, value: str, order: str, limit: int = 20) -> DataFrame:
    """The first pairs (first, duplicate) of one key in input order."""
    marked = mark_first(df.select(key, value, order), [key], order, "_first")
    firsts = marked.filter("_first").select(F.struct(key).alias("_key"), F.col(value).alias("first"))
    # only the earliest duplicates look for their first row
    rest = marked.filter("NOT _first").select(F.struct(key).alias("_key"), F.col(value).alias("duplicate"), F.col(order).alias("line")).orderBy("line").limit(limit)
    return rest.join(firsts, "_key").select(F.col("_key")[key].alias(key), "first", "duplicate", "line").orderBy("line")


def uniqueness(df: DataFrame, **layers: Column) -> DataFrame:
    """rows, and the distinct values of each layer."""
    return df.agg(F.count("*").alias("n_rows"), *[F.countDistinct(c).alias(f"n_{name}") for name, c in layers.items()])


def staged_dedup(df: DataFrame, exact: str, normal: str, order: str) -> DataFrame:
    """df with stage: exact_duplicate, normalized_duplicate or kept. Exact copies are found before normalised ones."""
    df = mark_first(df, [exact], order, "_e")
    df = mark_first(df, [normal], order, "_n", among=F.col("_e"))
    return df.withColumn("stage", F.when(~F.col("_e"), "exact_duplicate").when(~F.col("_n"), "normalized_duplicate").otherwise("kept")).drop("_e", "_n")


def overlap(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    return left.join(right.select(key).distinct(), key, "left_semi")


def remainder(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    return left.join(right.select(key).distinct(), key, "left_anti")


def remove_overlaps(df: DataFrame, key: str, existing: DataFrame, holdout: DataFrame) -> tuple[DataFrame, DataFrame]:
    """df without keys of the existing corpus, then without keys of the external holdout; and the counts
    n_rows, removed_existing, removed_holdout, kept in one row."""
    mark = lambda t, name: t.select(F.col(key).alias(f"_{name}")).distinct()
    marked = df.join(mark(existing, "e"), F.col(key) == F.col("_e"), "left").join(mark(holdout, "h"), F.col(key) == F.col("_h"), "left")
    old, held = F.col("_e").isNotNull(), F.col("_h").isNotNull()
    counts = marked.agg(F.count("*").alias("n_rows"), F.count_if(old).alias("removed_existing"), F.count_if(~old & held).alias("removed_holdout"), F.count_if(~old & ~held).alias("kept"))
    return marked.filter(~old & ~held).drop("_e", "_h"), counts


def identity_guard(df: DataFrame, identities: DataFrame, identity: str, url: str, order: str) -> tuple[DataFrame, DataFrame]:
    """Legitimate rows whose identity no phishing row has, the first of each URL; and the counts
    n_rows, conflicts, duplicates, kept in one row. Firsts are merged before the shuffle."""
    marked = df.join(identities.select(F.col(identity).alias("_i")).distinct(), F.col(identity) == F.col("_i"), "left")
    clean = marked.filter("_i IS NULL").drop("_i")
    row = F.struct(*df.columns)
    kept = clean.groupBy(F.col(url).alias("_url")).agg(F.min_by(row, F.struct(F.col(order), F.xxhash64(row))).alias("_r")).select("_r.*")
    counts = marked.groupBy().agg(F.count("*").alias("n_rows"), F.count_if(F.col("_i").isNotNull()).alias("conflicts"))
    counts = counts.crossJoin(F.broadcast(kept.agg(F.count("*").alias("kept"))))  # one row
    return kept, counts.select("n_rows", "conflicts", (F.col("n_rows") - F.col("conflicts") - F.col("kept")).alias("duplicates"), "kept")


def cross_class(df: DataFrame, url: str, domain: str, label: str = "label") -> DataFrame:
    """df with conflict: url (the legitimate copy of a URL of both classes), domain (any row of a domain of both), or NULL.

    A phishing row whose domain has legitimate rows only through the same URL still counts as domain.
    """
    both = lambda c: df.groupBy(c).agg(F.countDistinct(label).alias("_n")).filter("_n > 1").select(F.col(c).alias("_k"))
    marked = df.join(both(url).withColumn("_u", F.lit(True)), F.col(url) == F.col("_k"), "left").drop("_k")
    marked = marked.join(both(domain).withColumn("_d", F.lit(True)), F.col(domain) == F.col("_k"), "left").drop("_k")
    return marked.withColumn("conflict", F.when(F.col("_u") & (F.col(label) == 0), "url").when(F.col("_d"), "domain")).drop("_u", "_d")


def skip_list(sources: DataFrame, key: str, order: str, used: DataFrame, reserved: DataFrame) -> DataFrame:
    """sources with decision: already_used, reserved, duplicate or approved; the first that holds.

    The first row of a key is a minimum merged before the shuffle; keys are joined to it, so a hot one is split.
    """
    mark = lambda t, name: t.select(F.col(key).alias(f"_{name}")).distinct()
    df = sources.join(mark(used, "used"), F.col(key) == F.col("_used"), "left").join(mark(reserved, "reserved"), F.col(key) == F.col("_reserved"), "left")
    firsts = sources.groupBy(F.col(key).alias("_key")).agg(F.min(order).alias("_first"))
    df = df.join(firsts, F.col(key).eqNullSafe(F.col("_key")), "left")
    decision = F.when(F.col("_used").isNotNull(), "already_used").when(F.col("_reserved").isNotNull(), "reserved").when(F.col(order) > F.col("_first"), "duplicate").otherwise("approved")
    return df.withColumn("decision", decision).drop("_used", "_reserved", "_key", "_first")


def enrich(df: DataFrame, lookup: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """df with the lookup's columns and matched."""
    found = lookup.select(F.col(key).alias("_k"), *columns, F.lit(True).alias("matched"))
    return df.join(found, F.col(key) == F.col("_k"), "left").drop("_k").withColumn("matched", F.coalesce("matched", F.lit(False)))


def group_overlap(df: DataFrame, group: str, key: str) -> DataFrame:
    """Pairs of groups that share keys, and how many; empty when all are disjoint. Keys are merged first, so only shared ones spread."""
    shared = df.groupBy(key).agg(F.array_sort(F.collect_set(group)).alias("_g")).filter(F.size("_g") > 1)
    pairs = shared.select(key, F.posexplode("_g").alias("_i", "left_group"), F.col("_g")).select(key, "left_group", F.explode(F.slice("_g", F.col("_i") + 2, F.size("_g"))).alias("right_group"))
    return pairs.groupBy("left_group", "right_group").agg(F.count("*").alias("n_shared"))


def category_urls(domains: DataFrame, paths: DataFrame) -> DataFrame:
    """Reference URLs of each category: its domains (category, domain) times its paths (category, path), once each."""
    return domains.join(paths, "category").select("category", F.concat(F.lit("https://"), "domain", "path").alias("url")).distinct()


def label_sets(df: DataFrame, source: str, expected: dict[str, list[int]], label: str = "label") -> DataFrame:
    """One row per source: labels, expected, ok."""
    want = F.create_map(*[x for k, v in expected.items() for x in (F.lit(k), F.array(*[F.lit(i) for i in v]))])
    found = df.groupBy(source).agg(F.array_sort(F.collect_set(label)).alias("labels"))
    return found.withColumn("expected", F.try_element_at(want, F.col(source))).withColumn("ok", F.coalesce(F.col("labels") == F.col("expected"), F.lit(False)))


def label_violations(df: DataFrame, label: str) -> Column:
    """Why a raw label is not 0 or 1, or NULL."""
    number = F.expr(f"try_cast(`{label}` AS double)")
    return F.when(F.col(label).isNull(), "null").when(number.isNull(), "not_numeric").when(number != F.floor(number), "not_integral").when(~number.isin(0.0, 1.0), "not_binary")


#: The fields that every observation has.
REQUIRED = ("url", "normalized_url", "label", "source", "collection_method", "verification_status", "registered_domain", "source_page_url", "verified_final_url", "verified_content_type", "collection_date", "provenance")


def provenance_errors(df: DataFrame, suffixes: DataFrame | None = None) -> DataFrame:
    """df with errors: missing fields alone, else malformed alone, else every rule that a complete observation breaks.

    An observation is malformed if its URL is not valid, its status holds no number after http_, or its date is
    no ISO date. Domains are registered domains under suffixes (the built-in table if none is given).
    """
    from corpusforge.functions import urls as U

    suffixes = suffixes if suffixes is not None else U.suffix_table(df.sparkSession)
    missing = F.array_compact(F.array(*[F.when(F.col(c).isNull() | (F.col(c).cast("string") == ""), F.concat(F.lit("missing:"), F.lit(c))) for c in REQUIRED]))
    out = U.normalize(df, "url", "_good", "_why").withColumn("_missing", missing)
    of = {"_row": F.col("_good"), "_from": F.col("source_page_url"), "_to": F.col("verified_final_url")}
    out = out.withColumn("_hosts", F.struct(*[F.regexp_replace(U.host_of(c), r"^www\.", "").alias(n) for n, c in of.items()]))
    # the domains of all hosts at once, then looked up for each
    hosts = out.select(F.explode(F.array(*[F.col(f"_hosts.{n}") for n in of])).alias("_any"))
    domains = U.registered_domains(hosts.distinct(), "_any", suffixes, "_domain")
    for name in of:
        found = domains.select(F.col("_any").alias("_a"), F.col("_domain").alias(name))
        out = out.join(found, F.col(f"_hosts.{name}") == F.col("_a"), "left").drop("_a")
    status = F.regexp_extract("verification_status", "^[^_]*_ *([+-]?[0-9]+) *(?:_|$)", 1).try_cast("int")
    day = F.when(F.col("collection_date").cast("string").rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}$"), F.col("collection_date").cast("string").try_cast("date"))
    malformed = F.col("_good").isNull() | status.isNull() | day.isNull()
    secure = lambda c: F.coalesce(F.lower(c).startswith("https://"), F.lit(False))
    rules = [
        ("label_not_zero", F.col("label") != 0), ("not_normalized", (F.col("url") != F.col("_good")) | (F.col("normalized_url") != F.col("_good"))),
        ("domain_mismatch", F.col("registered_domain") != F.coalesce("_row", F.lit(""))),
        ("leaves_first_party_domain", ~(F.col("_from").eqNullSafe(F.col("_row")) & F.col("_to").eqNullSafe(F.col("_row")))),
        ("not_https", ~(secure(F.col("url")) & secure(F.col("source_page_url")) & secure(F.col("verified_final_url")))),
        ("not_2xx", ~status.between(200, 299)), ("not_same_domain", ~F.col("verification_status").endswith("_same_registered_domain")),
    ]
    broken = F.array_compact(F.array(*[F.when(c, n) for n, c in rules]))
    errors = F.when(F.size("_missing") > 0, F.col("_missing")).when(malformed, F.array(F.lit("malformed"))).otherwise(broken)
    return out.withColumn("errors", errors).select(*df.columns, "errors")


def official(host: Column, domains: list[str]) -> Column:
    """Whether a host is one of the domains or under it."""
    return F.exists(F.array(*[F.lit(d) for d in domains]), lambda d: (host == d) | host.endswith(F.concat(F.lit("."), d)))


def official_url(url: Column, domains: list[str]) -> Column:
    """The URL of an official source in its canonical form, or NULL: https, a host that is official, and no user or password."""
    from corpusforge.functions import urls as U

    def of(p: Column) -> Column:
        tail = lambda mark, c: F.when(c != "", F.concat(F.lit(mark), c)).otherwise("")
        port = F.when(p["port"].isNotNull() & (p["port"] != "443"), F.concat(F.lit(":"), p["port"])).otherwise("")
        good = (p["scheme"] == "https") & official(p["host"], domains) & (F.coalesce(p["userinfo"], F.lit("")) == "")
        path = F.when(p["path"] == "", "/").otherwise(p["path"])
        return F.when(good, F.concat(F.lit("https://"), p["host"], port, path, tail("?", p["query"]), tail("#", p["fragment"])))

    return U.let(U.parts(F.trim(url)), of)


def preparation_report(df: DataFrame, source: str, exact: str, analysis: str, domain: str, reason: str, label: str = "label") -> DataFrame:
    """One pass over each source: rows, invalid, distinct at two layers, labels, domains."""
    ok = F.col(reason).isNull()
    return df.groupBy(source).agg(
        F.count("*").alias("n_rows"), F.count_if(~ok).alias("n_invalid"), F.countDistinct(F.when(ok, F.col(exact))).alias("n_normalized"), F.countDistinct(F.when(ok, F.col(analysis))).alias("n_analysis"),
        F.count_if(ok & (F.col(label) == 0)).alias("n_legitimate"), F.count_if(ok & (F.col(label) == 1)).alias("n_phishing"), F.countDistinct(F.when(ok, F.col(domain))).alias("n_domains"),
    )


def split_summary(df: DataFrame, split: str, domain: str, source: str, label: str = "label") -> DataFrame:
    """Rows, labels, domains and sources of each split, and whether both classes are there."""
    found = df.groupBy(split).agg(F.count("*").alias("n_rows"), F.count_if(F.col(label) == 0).alias("n_legitimate"), F.count_if(F.col(label) == 1).alias("n_phishing"), F.countDistinct(domain).alias("n_domains"), F.array_sort(F.collect_set(source)).alias("sources"))
    return found.withColumn("both_classes", (F.col("n_legitimate") > 0) & (F.col("n_phishing") > 0))


def structure_rates(df: DataFrame, groups: list[str], tags: str, names: list[str], medians: list[str]) -> DataFrame:
    """Share of rows with each tag, and exact medians, by group."""
    rates = [F.avg(F.array_contains(tags, n).cast("double")).alias(f"rate_{n}") for n in names]
    out = df.groupBy(*groups).agg(F.count("*").alias("n_rows"), *rates)
    for m in medians:
        found = percentiles(df, groups, m, {f"median_{m}": 0.5}).withColumnsRenamed({g: f"_{g}" for g in groups})
        same = reduce(lambda a, b: a & b, [F.col(g).eqNullSafe(F.col(f"_{g}")) for g in groups])
        out = out.join(found, same).drop(*[f"_{g}" for g in groups])
    return out


def tag_counts(df: DataFrame, tags: str, label: str = "label") -> DataFrame:
    """Rows of each tag and label, and their percentage within the label, rounded to six places."""
    totals = df.groupBy(label).agg(F.count("*").alias("_total"))
    counts = df.select(label, F.explode(tags).alias("tag")).groupBy("tag", label).agg(F.count("*").alias("n"))
    return counts.join(totals, label).select("tag", label, "n", F.round(100 * F.col("n") / F.col("_total"), 6).alias("pct"))


def tag_overlap(df: DataFrame, tags: str, label: str = "label") -> DataFrame:
    """Rows of each unordered pair of tags, a tag with itself included, by label."""
    ordered = df.select(label, F.array_sort(tags).alias("_t"))
    pairs = ordered.select(label, F.posexplode("_t").alias("_i", "first"), "_t").select(label, "first", F.explode(F.slice("_t", F.col("_i") + 1, F.size("_t"))).alias("second"))
    return pairs.groupBy("first", "second", label).agg(F.count("*").alias("n"))


def required_tags(df: DataFrame, tags: str, required: list[str]) -> DataFrame:
    """Required tags with their number of rows; missing ones have 0."""
    want = df.sparkSession.createDataFrame([(t,) for t in required], "tag string")
    found = df.select(F.explode(tags).alias("tag")).groupBy("tag").agg(F.count("*").alias("n"))
    return want.join(found, "tag", "left").select("tag", F.coalesce("n", F.lit(0)).alias("n"), F.col("n").isNull().alias("missing"))


def claimed_counts(observed: DataFrame, claimed: DataFrame) -> DataFrame:
    """Observed (tag, n) beside earlier claims (tag, claimed)."""
    both = observed.join(claimed, "tag", "full_outer")
    return both.select("tag", F.coalesce("n", F.lit(0)).alias("n"), "claimed", F.col("n").isNull().alias("missing"), (F.coalesce("n", F.lit(0)) - F.coalesce("claimed", F.lit(0))).alias("difference"))


def mixed_domains(df: DataFrame, domain: str, label: str = "label") -> DataFrame:
    """Domains with both labels: rows of each."""
    found = df.groupBy(domain).agg(F.count_if(F.col(label) == 0).alias("n_legitimate"), F.count_if(F.col(label) == 1).alias("n_phishing"))
    return found.filter("n_legitimate > 0 AND n_phishing > 0")


def top_domains(df: DataFrame, domain: str, n: int = 10) -> DataFrame:
    return df.groupBy(domain).agg(F.count("*").alias("n_rows")).orderBy(F.desc("n_rows"), domain).limit(n)


def admissibility(df: DataFrame, dataset: str, url: str, label: str, expected: DataFrame | None = None) -> DataFrame:
    """One status per candidate dataset of legitimate rows: the first failure, or valid; expected names datasets that may have no row."""
    why = label_violations(df, label)
    counts = df.groupBy(dataset).agg(
        F.count("*").alias("n_rows"), F.count_if(why == "null").alias("_null"), F.count_if(why.isin("not_numeric", "not_integral")).alias("_odd"), F.count_if(why.isNull() & (F.expr(f"try_cast(`{label}` AS double)") != 0)).alias("_other"),
        F.count_if(F.coalesce(F.trim(F.col(url)), F.lit("")) == "").alias("_blank"),
    )
    if expected is not None:
        counts = expected.select(F.col(dataset)).distinct().join(counts, dataset, "full_outer").withColumn("n_rows", F.coalesce("n_rows", F.lit(0)))
    status = F.when(F.col("n_rows") == 0, "missing").when(F.col("_null") > 0, "null_labels").when(F.col("_odd") > 0, "non_integer_labels").when(F.col("_other") > 0, "labels_not_all_zero").when(F.col("_blank") > 0, "invalid_url_data").otherwise("valid")
    return counts.select(dataset, "n_rows", status.alias("status"))


def composition(df: DataFrame, split: str, category: str, quota: DataFrame) -> DataFrame:
    """Rows of each split and category beside quota (split, category, quota), with the shortfall."""
    counts = df.groupBy(F.col(split).alias("split"), F.col(category).alias("category")).agg(F.count("*").alias("n_rows"))
    both = counts.join(quota, ["split", "category"], "full_outer").withColumn("n_rows", F.coalesce("n_rows", F.lit(0)))
    return both.select("split", "category", "n_rows", "quota", F.greatest(F.coalesce("quota", F.lit(0)) - F.col("n_rows"), F.lit(0)).alias("shortfall"))


def readiness(rows: DataFrame, used: DataFrame, required: list[str], url: str, domain: str, tags: str, status: str) -> DataFrame:
    """One row of counts: rows, distinct URLs and domains, those that used has too, required tags without a row, rows by HTTP status class."""
    code = F.regexp_extract(status, "(?i)http_([1-5])[0-9]{2}", 1)
    counts = rows.agg(
        F.count("*").alias("n_rows"), F.countDistinct(url).alias("n_urls"), F.countDistinct(domain).alias("n_domains"), *[F.count_if(code == str(k)).alias(f"n_{k}xx") for k in (2, 3, 4, 5)],
        F.count_if(code == "").alias("n_without_status"),
    )
    shared = lambda c, name: rows.select(c).distinct().join(used.select(c).distinct(), c, "left_semi").agg(F.count("*").alias(name))
    lacking = required_tags(rows, tags, required).agg(F.array_sort(F.collect_list(F.when(F.col("missing"), F.col("tag")))).alias("missing_tags"))
    for one in (shared(url, "overlapping_urls"), shared(domain, "overlapping_domains"), lacking):  # one row each
        counts = counts.crossJoin(F.broadcast(one))
    return counts


def fingerprint(df: DataFrame, columns: list[str], groups: list[str]) -> DataFrame:
    """An order-free fingerprint of rows, with counts by group."""
    h = F.xxhash64(*columns)
    return df.groupBy(*groups).agg(F.count("*").alias("n_rows"), F.bit_xor(h).alias("xor"), F.sum(h.cast("decimal(38,0)")).alias("total"))
