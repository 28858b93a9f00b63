"""Splits, samples, quotas and weights, all fixed by hashes, so that runs agree and no task sorts everything.

Where a seeded random order would be drawn, rows are ordered by a digest of their key and the seed; the
contracts (disjoint parts, exact sizes, both classes) are kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusforge.functions import urls as U


def stable(key: str | Column, seed: str = "") -> Column:
    """Hexadecimal digest that orders rows; comparing the text compares the 256-bit number."""
    key = F.col(key) if isinstance(key, str) else key
    return F.sha2(F.concat(F.lit(seed), key.cast("string")) if seed else key.cast("string"), 256)


#: Hexadecimal digits of a digest that name a bucket: 65,536 buckets, whose counts are all that comes together.
DIGITS = 4


def first_part(df: DataFrame, groups: list[str], key: str, take: Column, seed: str = "", flag: str = "_in") -> DataFrame:
    """df with flag: whether a row is among the first ``take`` of its group by digest, then key; take may use _size, the rows of the group.

    Rows are counted by digest bucket first, merged before the shuffle, so a rank is a sum over buckets and a
    rank within one: a group of a third of all rows spreads over its buckets.
    """
    df = df.withColumn("_bucket", F.substring(stable(key, seed), 1, DIGITS))
    counts = df.groupBy(*groups, "_bucket").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*groups).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).withColumn("_size", F.sum("_n").over(Window.partitionBy(*groups))).drop("_n")
    same = None
    for c in [*groups, "_bucket"]:
        counts = counts.withColumnRenamed(c, f"_k_{c}")
        cond = F.col(c).eqNullSafe(F.col(f"_k_{c}"))
        same = cond if same is None else same & cond
    within = F.row_number().over(Window.partitionBy(*groups, "_bucket").orderBy(stable(key, seed), key))
    out = df.join(counts, same).withColumn(flag, F.col("_before") + within <= take)
    return out.drop("_bucket", "_before", "_size", *[f"_k_{c}" for c in [*groups, "_bucket"]])


def _cut_scores(domains: DataFrame, places: list[int]) -> dict[int, str]:
    """The scores (_s) at the given places (from 1) in the order of (_s, _d): counts by bucket, then only the buckets that hold a place are sorted."""
    bucket = F.substring("_s", 1, DIGITS)
    seen, wanted = 0, {}
    for row in domains.groupBy(bucket.alias("b")).agg(F.count("*").alias("n")).orderBy("b").collect():  # at most 16 ** DIGITS rows
        for at in places:
            if seen < at <= seen + row.n:
                wanted[at] = (row.b, at - seen)
        seen += row.n
    if not wanted:
        return {}
    inside = domains.withColumn("_b", bucket).filter(F.col("_b").isin(sorted({b for b, _ in wanted.values()})))
    inside = inside.withColumn("_n", F.row_number().over(Window.partitionBy("_b").orderBy("_s", "_d")))
    hit = F.array(*[F.struct(F.lit(b).alias("b"), F.lit(n).alias("n")) for b, n in wanted.values()])
    found = {(r["_b"], r["_n"]): r["_s"] for r in inside.filter(F.array_contains(hit, F.struct(F.col("_b").alias("b"), F.col("_n").alias("n")))).collect()}
    return {at: found[where] for at, where in wanted.items()}


def fraction_split(df: DataFrame, domain: str, reference: Column, seed: str, fractions: tuple[tuple[str, float], ...]) -> DataFrame:
    """df with split: cut-offs at the ranks of the reference rows' domains, all domains placed by their score.

    Each part gets at least one reference domain if there are enough.
    """
    score = stable(domain, f"{seed}:split:")
    domains = df.filter(reference).select(F.col(domain).alias("_d"), F.substring(score, 1, 16).alias("_s")).distinct()
    n = domains.count()
    bounds, upto = [], 0.0
    for i, (name, share) in enumerate(fractions[:-1]):
        upto += share
        bounds.append((name, min(max(round(upto * n), i + 1), max(n - (len(fractions) - 1 - i), i + 1))))
    # cut-offs: the score of the first domain of the next part
    cut = _cut_scores(domains, [b + 1 for _, b in bounds])
    place = F.lit(fractions[-1][0])
    for name, b in reversed(bounds):
        if b + 1 in cut:
            place = F.when(F.substring(score, 1, 16) < cut[b + 1], name).otherwise(place)
        else:
            place = F.lit(name)
    return df.withColumn("split", place)


def rank_split(df: DataFrame, domain: str, salt: str, fractions: tuple[tuple[str, float], ...] = (("train", 0.35), ("calibration", 0.15), ("validation", 0.15), ("test", 0.35))) -> DataFrame:
    """df with split: domains in the order of a salted digest, each part round(share * domains) of them, the last the rest."""
    score = stable(domain, f"{salt}:")
    domains = df.select(F.col(domain).alias("_d"), score.alias("_s")).distinct()
    n = domains.count()
    ends, upto = [], 0
    for name, share in fractions[:-1]:
        upto += round(n * share)
        ends.append((name, upto))
    cut = _cut_scores(domains, [e + 1 for _, e in ends])
    place = F.lit(fractions[-1][0])
    for name, end in reversed(ends):
        place = F.when(score < cut[end + 1], name).otherwise(place) if end + 1 in cut else F.lit(name)
    return df.withColumn("split", place)


def group_split(df: DataFrame, group: str, seed: int, fractions: tuple[tuple[str, float], ...], label: str = "label", tries: int = 100) -> DataFrame:
    """df with split: whole groups, placed by hash, the first seed from ``seed`` on that leaves both classes in each part."""
    cuts, upto = [], 0.0
    for name, share in fractions:
        upto += share
        cuts.append((name, round(upto * 10_000)))
    classes = df.groupBy(group).agg(F.count_if(F.col(label) == 0).alias("_a"), F.count_if(F.col(label) == 1).alias("_b"))
    classes.persist()
    try:
        for s in range(seed, seed + tries):
            split = U.split_of(U.hash_bucket(F.concat(F.lit(f"{s}:"), F.col(group)), 10_000), tuple(cuts))
            parts = classes.groupBy(split.alias("split")).agg(F.sum("_a").alias("a"), F.sum("_b").alias("b")).filter("a > 0 AND b > 0").count()
            if parts == len(fractions):
                return df.withColumn("split", split)
    finally:
        classes.unpersist()
    raise ValueError(f"no seed from {seed} on leaves both classes in every part")


HEAD = 10_000


def balanced_split(df: DataFrame, domain: str, fractions: dict[str, float], seed: str = "", head: int = HEAD) -> DataFrame:
    """df with split: the largest ``head`` domains go one by one to the part with most room, the others by hash.

    Only the head, whose size is fixed, comes to the driver; its assignment is joined back.
    """
    counts = df.groupBy(domain).agg(F.count("*").alias("_n"))
    total = df.count()
    room = {k: v * total for k, v in fractions.items()}
    placed = []
    for row in counts.orderBy(F.desc("_n"), stable(domain, seed)).limit(head).collect():
        best = max(room, key=lambda k: room[k])
        room[best] -= row["_n"]
        placed.append((row[domain], best))
    table = df.sparkSession.createDataFrame(placed, "_d string, _s string")
    left = {k: max(v, 0.0) for k, v in room.items()}
    scale = sum(left.values()) or 1.0
    cuts, upto = [], 0.0
    for k in fractions:
        upto += left[k] / scale
        cuts.append((k, round(upto * 10_000)))
    cuts[-1] = (cuts[-1][0], 10_000)
    tail = U.split_of(U.hash_bucket(F.col(domain), 10_000), tuple(cuts))
    return df.join(F.broadcast(table), F.col(domain) == F.col("_d"), "left").withColumn("split", F.coalesce("_s", tail)).drop("_d", "_s")


def holdout_by_size(df: DataFrame, domain: str, share: float = 0.15) -> DataFrame:
    """df with held_out: domains largest first until they hold at least ``share`` of the rows.

    Domains are ranked by size in two levels: totals by size class, then within the class on the edge.
    """
    counts = df.groupBy(domain).agg(F.count("*").alias("_n"))
    sizes = counts.groupBy("_n").agg(F.sum("_n").alias("_t"))
    before = Window.orderBy(F.desc("_n")).rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select("_n", F.coalesce(F.sum("_t").over(before), F.lit(0)).alias("_before"))
    within = Window.partitionBy("_n").orderBy(domain)
    ranked = counts.join(sizes, "_n").withColumn("_before", F.col("_before") + F.col("_n") * (F.row_number().over(within) - 1))
    total = df.agg(F.count("*").alias("_all"))
    chosen = ranked.crossJoin(F.broadcast(total)).filter(F.col("_before") < share * F.col("_all")).select(F.col(domain).alias("_d"))
    return df.join(chosen.withColumn("_h", F.lit(True)), F.col(domain) == F.col("_d"), "left").withColumn("held_out", F.coalesce("_h", F.lit(False))).drop("_d", "_h")


def stratified_split(df: DataFrame, strata: list[str], key: str, share: float = 0.2) -> DataFrame:
    """df with test: in each stratum floor(share * n) rows, the first by hash."""
    return first_part(df, strata, key, F.floor(F.col("_size") * share), flag="test")


def sample(df: DataFrame, key: str, n: int, seed: str = "") -> DataFrame:
    return df.orderBy(stable(key, seed), key).limit(n)


def quotas(sizes: DataFrame, stratum: str, size: str, hard: str, target: int, boost: float = 1.25, key: str | None = None) -> DataFrame:
    """sizes with quota: proportional, hard strata boosted, none above its size, largest remainders to the exact target.

    Strata are few; they are filled on the driver, water-filling style.
    """
    rows = [r.asDict() for r in sizes.orderBy(stratum).collect()]
    capped, quota = set(), {}
    for _ in range(len(rows) + 1):
        left = target - sum(r[size] for i, r in enumerate(rows) if i in capped)
        weight = {i: r[size] * (boost if r[hard] else 1.0) for i, r in enumerate(rows) if i not in capped}
        free = sum(weight.values())
        quota = {i: weight[i] * left / free if i in weight and free > 0 else (float(r[size]) if i in capped else 0.0) for i, r in enumerate(rows)}
        new = {i for i in weight if free > 0 and quota[i] >= rows[i][size]}
        if not new:
            break
        capped |= new
    base = {i: min(int(quota[i]), rows[i][size]) for i in range(len(rows))}
    short = target - sum(base.values())
    for i in sorted(base, key=lambda i: (-(quota[i] - base[i]), rows[i][stratum])):
        if short > 0 and base[i] < rows[i][size]:
            base[i] += 1
            short -= 1
    table = df_of(sizes.sparkSession, [(r[stratum], base[i]) for i, r in enumerate(rows)], sizes.schema[stratum].dataType.simpleString())
    return sizes.join(F.broadcast(table), F.col(stratum) == F.col("_stratum")).drop("_stratum")


def df_of(spark, rows, kind: str) -> DataFrame:
    return spark.createDataFrame(rows, f"_stratum {kind}, quota long")


def systematic(df: DataFrame, stratum: str, quota: DataFrame, *order: str, offset: float = 0.5) -> DataFrame:
    """In each stratum, quota rows at even steps through the given order: rows floor((i + offset) n / quota)."""
    r = F.row_number().over(Window.partitionBy(stratum).orderBy(*order)) - 1
    n = F.count("*").over(Window.partitionBy(stratum))
    rows = df.withColumn("_r", r).withColumn("_size", n).join(quota.select(F.col(stratum).alias("_q"), "quota"), F.col(stratum) == F.col("_q"))
    step = lambda x: F.ceil(x * F.col("quota") / F.col("_size") - offset)
    return rows.filter(step(F.col("_r") + 1) - step(F.col("_r")) >= 1).drop("_r", "_size", "_q", "quota")


def cohort_quota(df: DataFrame, cohort: str, domain: str, key: str, per_domain: int, quota: int, label: str = "label", ratio: int = 1) -> DataFrame:
    """Per cohort as many rows of each class, at most quota (times ratio for label 1), hash order, at most per_domain of a domain."""
    h = stable(key)
    capped = df.withColumn("_d", F.row_number().over(Window.partitionBy(cohort, label, domain).orderBy(h, key))).filter(F.col("_d") <= per_domain)
    n = capped.groupBy(cohort).agg(F.count_if(F.col(label) == 0).alias("_0"), F.count_if(F.col(label) == 1).alias("_1"))
    zero, one = F.least("_0", F.lit(quota)), F.least("_1", F.lit(quota * ratio))
    if ratio == 1:
        zero = one = F.least(zero, one)
    take = F.when(F.col(label) == 0, zero).otherwise(one)
    ranked = first_part(capped.join(n, cohort), [cohort, label], key, take)
    return ranked.filter("_in").drop("_d", "_in", "_0", "_1")


def top_by_hash(df: DataFrame, groups: list[str], key: str, k: int) -> DataFrame:
    """The k rows of each group with the smallest digest. Spark prunes to k a task before the shuffle."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*groups).orderBy(stable(key), key))).filter(F.col("_n") <= k).drop("_n")


def rare_first(df: DataFrame, category: str, domain: str, key: str, quota: dict[str, int]) -> DataFrame:
    """quota rows of each category, a domain once in all, the rarest category first; an error where rows are short."""
    n = {r[category]: r["n"] for r in df.groupBy(category).agg(F.countDistinct(domain).alias("n")).collect() if r[category] in quota}
    used, parts = None, []
    for c in sorted(quota, key=lambda c: (n.get(c, 0), c)):
        rows = df.filter(F.col(category) == c)
        if used is not None:
            rows = rows.join(used, domain, "left_anti")
        one = rows.withColumn("_n", F.row_number().over(Window.partitionBy(domain).orderBy(stable(key), key))).filter("_n = 1").drop("_n")
        chosen = sample(one, key, quota[c]).persist()
        if chosen.count() < quota[c]:
            raise ValueError(f"{c}: {chosen.count()} of {quota[c]} rows")
        parts.append(chosen)
        mine = chosen.select(domain)
        used = mine if used is None else used.union(mine)
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def first_per_domain(df: DataFrame, domain: str, order: str, key: str, n: int, reserved: DataFrame) -> DataFrame:
    """The first row of each domain that is not reserved, then n of them by hash."""
    first = df.join(reserved.select(domain).distinct(), domain, "left_anti").withColumn("_n", F.row_number().over(Window.partitionBy(domain).orderBy(order))).filter("_n = 1").drop("_n")
    return sample(first, key, n)


def capped(df: DataFrame, category: str, key: str, per_category: int, overall: int) -> DataFrame:
    return sample(top_by_hash(df, [category], key, per_category), key, overall)


def class_weights(df: DataFrame, label: str = "label") -> DataFrame:
    """df with weight n / (2 n_class); counts are two rows."""
    n = df.groupBy(label).agg(F.count("*").alias("_c"))
    total = df.agg(F.count("*").alias("_t"))
    return df.join(n, label).crossJoin(F.broadcast(total)).withColumn("weight", F.col("_t") / (2 * F.col("_c"))).drop("_c", "_t")


def source_class_weights(df: DataFrame, source: str, label: str = "label") -> DataFrame:
    """df with weight 1 / (k * n) for n rows of a source and label and k sources of the label: each class sums to 1."""
    n = df.groupBy(label, source).agg(F.count("*").alias("_n"))
    n = n.withColumn("_k", F.count("*").over(Window.partitionBy(label)))
    return df.join(n, [label, source]).withColumn("weight", 1 / (F.col("_k") * F.col("_n"))).drop("_n", "_k")


def domain_weights(df: DataFrame, domain: str, label: str = "label") -> DataFrame:
    """df with weight 1 / rows of its domain and label, scaled so that each class holds half of all rows."""
    n = df.groupBy(label, domain).agg(F.count("*").alias("_n"))
    totals = n.groupBy(label).agg(F.count("*").cast("double").alias("_w"))  # a domain's weights sum to 1
    rows = df.agg(F.count("*").alias("_t"))
    scaled = n.join(totals, label).crossJoin(F.broadcast(rows)).withColumn("weight", F.col("_t") / (2 * F.col("_w")) / F.col("_n")).drop("_n", "_w", "_t")
    return df.join(scaled, [label, domain])


def capped_source_weights(df: DataFrame, source: str, sources: list[str], label: str = "label", share: float = 0.5) -> DataFrame:
    """df with weight 1, or for the named sources at most share * phishing rows / their rows."""
    counts = df.groupBy(source).agg(F.count("*").alias("_n"))
    phishing = df.agg(F.count_if(F.col(label) == 1).alias("_p"))
    w = F.when(F.col(source).isin(*sources), F.least(F.lit(1.0), share * F.col("_p") / F.col("_n"))).otherwise(1.0)
    return df.join(counts, source).crossJoin(F.broadcast(phishing)).withColumn("weight", w).drop("_n", "_p")
