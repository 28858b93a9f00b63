"""Scan-log analytics, faceted search, catalogues and paging."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def verdict_totals(log: DataFrame, verdict: str, verdicts: list[str]) -> DataFrame:
    """One row: total, counts, and percentages to one decimal, NULL for an empty log."""
    out = log.agg(F.count("*").alias("total"), *[F.count_if(F.col(verdict) == v).alias(f"n_{v}") for v in verdicts])
    return out.select("*", *[F.when(F.col("total") > 0, F.bround(F.col(f"n_{v}") * 100 / F.col("total"), 1)).alias(f"pct_{v}") for v in verdicts])


def daily_trend(log: DataFrame, at: str, verdict: str, verdicts: list[str], last_day: str, days: int = 7) -> DataFrame:
    """One row a day for the days up to last_day, zeros included. The date range reaches the scan as a filter on ``at``."""
    last = F.to_date(F.lit(last_day))
    kept = log.filter((F.col(at) >= F.date_sub(last, days - 1).cast("timestamp")) & (F.col(at) < F.date_add(last, 1).cast("timestamp")))
    counts = kept.groupBy(F.to_date(at).alias("day")).agg(*[F.count_if(F.col(verdict) == v).alias(v) for v in verdicts])
    calendar = log.sparkSession.range(1).select(F.explode(F.sequence(F.date_sub(last, days - 1), last)).alias("day"))
    out = calendar.join(counts, "day", "left").select("day", *[F.coalesce(v, F.lit(0)).alias(v) for v in verdicts])
    return out.withColumn("total", reduce(lambda a, b: a + b, [F.col(v) for v in verdicts]))


#: Values of a facet that its count map may hold.
MAP_VALUES = 10_000
DAY, HOUR = 24 * 3600, 3600


def stat_counts(indicators: DataFrame, as_of: str, facets: list[str], first_seen: str = "first_seen_at", ingested: str = "ingested_at", sign: int = 1) -> DataFrame:
    """(facet, value, n): what statistics need, in a form that can be added up: counts, the seconds of the last day, and the latest time.

    With sign -1 the rows are taken away; the latest time, which only rises, is then left out.
    """
    since = F.unix_timestamp(F.to_timestamp(F.lit(as_of))) - DAY
    second = F.unix_seconds(F.col(first_seen).cast("timestamp"))
    one = lambda facet, value, n=sign: F.struct(F.lit(facet).alias("facet"), value.alias("value"), F.lit(n).cast("long").alias("n") if isinstance(n, int) else n.alias("n"))
    entries = [one("total", F.lit(None).cast("string")), *[one(f, F.col(f).cast("string")) for f in facets], F.when(second >= since, one("second", second.cast("string")))]
    if sign > 0:
        entries.append(one("latest", F.lit(None).cast("string"), F.unix_micros(F.col(ingested).cast("timestamp"))))
    return stat_sum(indicators.select(F.explode(F.array_compact(F.array(*entries))).alias("e")).select("e.*"), as_of)


def stat_sum(counts: DataFrame, as_of: str) -> DataFrame:
    """Counts of several parts as one; seconds that have left the day before as_of go."""
    since = F.unix_timestamp(F.to_timestamp(F.lit(as_of))) - DAY
    # a sum over the latest times would leave 64 bits after some thousand of them
    n = F.when(F.col("facet") == "latest", F.max("n")).otherwise(F.sum(F.when(F.col("facet") != "latest", F.col("n")))).alias("n")
    return counts.groupBy("facet", "value").agg(n).filter((F.col("n") != 0) & ((F.col("facet") != "second") | (F.try_to_number("value", F.lit("99999999999")) >= since)))


def stat_row(counts: DataFrame, as_of: str, facets: list[str], sources: DataFrame | None = None) -> DataFrame:
    """One row: total, latest, new in 24 hours and one hour before as_of, and a count map for each facet, of MAP_VALUES values at most.

    With sources (enabled, status) the counts of enabled and of healthy ones among them follow.
    """
    now = F.unix_timestamp(F.to_timestamp(F.lit(as_of)))
    recent = lambda span: F.coalesce(F.sum(F.when((F.col("facet") == "second") & (F.col("value").cast("long") >= now - span), F.col("n"))), F.lit(0))
    out = counts.filter(F.col("facet").isin("total", "latest", "second")).agg(
        F.coalesce(F.sum(F.when(F.col("facet") == "total", F.col("n"))), F.lit(0)).alias("total"), F.timestamp_micros(F.max(F.when(F.col("facet") == "latest", F.col("n")))).alias("latest"),
        recent(DAY).alias("new_24h"), recent(HOUR).alias("new_1h"),
    )
    for f in facets:  # one row each
        few = counts.filter(F.col("facet") == f).limit(MAP_VALUES + 1).agg(F.array_sort(F.collect_list(F.struct("value", "n"))).alias("e"))
        many = F.raise_error(F.lit(f"facet {f} has more than {MAP_VALUES} values")).cast("map<string,bigint>")
        named = F.filter("e", lambda x: x["value"].isNotNull())
        out = out.crossJoin(F.broadcast(few.select(F.when(F.size("e") > MAP_VALUES, many).otherwise(F.map_from_entries(named)).alias(f"by_{f}"))))
    if sources is not None:
        health = sources.filter("enabled").agg(F.count("*").alias("configured_sources"), F.count_if(F.col("status") == "healthy").alias("healthy_sources"))
        out = out.crossJoin(F.broadcast(health))
    return out


def feed_stats(indicators: DataFrame, as_of: str, facets: list[str], first_seen: str = "first_seen_at", ingested: str = "ingested_at", sources: DataFrame | None = None) -> DataFrame:
    """The statistics of a whole state, as stat_row gives them; as_of counts in whole seconds."""
    return stat_row(stat_counts(indicators, as_of, facets, first_seen, ingested), as_of, facets, sources)


def facet_counts(df: DataFrame, facets: list[str]) -> DataFrame:
    """(facet, value, n) of all facets from one scan."""
    long = df.select(F.explode(F.array(*[F.struct(F.lit(f).alias("facet"), F.col(f).cast("string").alias("value")) for f in facets])).alias("x")).select("x.*")
    return long.groupBy("facet", "value").agg(F.count("*").alias("n"))


def search_condition(text: str | None, columns: list[str], arrays: list[str] = (), raw_like: bool = False) -> Column:
    """Case-insensitive substring over columns and array members; % and _ are literal unless raw_like."""
    if not (text or "").strip():
        return F.lit(True)
    t = text.strip()
    pattern = t if raw_like else t.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_")
    like = lambda c: F.coalesce(F.ilike(c, F.lit(f"%{pattern}%")), F.lit(False))
    found = [like(F.col(c)) for c in columns] + [F.coalesce(F.exists(a, like), F.lit(False)) for a in arrays]
    return reduce(lambda a, b: a | b, found)


def faceted(df: DataFrame, facets: dict[str, str | None], text: str | None = None, columns: list[str] = (), arrays: list[str] = (), source: str | None = None, raw_like: bool = False) -> DataFrame:
    """Rows that meet every facet; a blank value or all is no filter; source matches primary_source or a member of sources."""
    wanted = lambda v: bool((v or "").strip()) and v.strip().lower() != "all"
    for c, v in facets.items():
        if wanted(v):
            df = df.filter(F.col(c) == v.strip())
    if wanted(source):
        df = df.filter((F.col("primary_source") == source.strip()) | F.array_contains("sources", source.strip()))
    return df.filter(search_condition(text, list(columns), list(arrays), raw_like))


def page(df: DataFrame, number: int, limit: int, *order: str | Column, most: int = 200) -> DataFrame:
    """A page of df with the total and the number of pages on each row. The limit is clamped to 1..most."""
    limit, number = max(1, min(limit, most)), max(1, number)
    total = df.agg(F.count("*").alias("total"))
    rows = df.orderBy(*order).offset((number - 1) * limit).limit(limit)
    return rows.crossJoin(F.broadcast(total)).withColumn("total_pages", F.ceil(F.col("total") / limit))


def since(df: DataFrame, cursor, limit: int, key: str = "id", most: int = 200) -> DataFrame:
    """Rows after a cursor in ascending order; a cursor that is no number counts as 0."""
    try:
        cursor = int(cursor)
    except (TypeError, ValueError):
        cursor = 0
    return df.filter(F.col(key) > cursor).orderBy(key).limit(max(1, min(limit, most)))


def older(df: DataFrame, last: int | None, limit: int, key: str = "id", most: int = 200) -> DataFrame:
    """The page of rows before a key, newest first, or the newest without one: deep paging that never counts off earlier pages."""
    rows = df if last is None else df.filter(F.col(key) < last)
    return rows.orderBy(F.desc(key)).limit(max(1, min(limit, most)))


def nested_search(df: DataFrame, text: str, scalars: list[str], arrays: list[str] = (), maps: str | None = None, fields: list[str] = ()) -> DataFrame:
    """Rows with the text in a scalar, in a member of an array, or in a field of an array of maps."""
    t = text.lower()
    has = lambda c: F.coalesce(F.lower(c).contains(t), F.lit(False))
    found = [has(F.col(c)) for c in scalars] + [F.coalesce(F.exists(a, has), F.lit(False)) for a in arrays]
    if maps:
        found += [F.coalesce(F.exists(maps, lambda m, f=f: has(F.try_element_at(m, F.lit(f)))), F.lit(False)) for f in fields]
    return df.filter(reduce(lambda a, b: a | b, found))


def search_all(catalogues: dict[str, tuple[DataFrame, int]], text: str | None, key: str, columns: list[str]) -> DataFrame:
    """(catalogue, key) of all matches, or for a blank text the first rows of each catalogue, as many as it says."""
    out = None
    for name, (df, first) in catalogues.items():
        part = df.filter(search_condition(text, columns)).select(F.lit(name).alias("catalogue"), F.col(key))
        if not (text or "").strip():
            part = part.withColumn("_n", F.row_number().over(Window.partitionBy("catalogue").orderBy(key))).filter(F.col("_n") <= first).drop("_n")
        out = part if out is None else out.unionByName(part)
    return out


def lookup(df: DataFrame, value, *keys: str) -> DataFrame:
    return df.filter(reduce(lambda a, b: a | b, [F.col(k).cast("string") == str(value) for k in keys]))


def newest(df: DataFrame, n: int, *order: str | Column) -> DataFrame:
    return df.orderBy(*order).limit(n)


def latest_by_key(df: DataFrame, key: str, *order: str) -> DataFrame:
    """The last row of each key in the order given: a full replacement per key."""
    value = F.struct(*[F.col(c) for c in df.columns if c != key])
    return df.groupBy(key).agg(F.max_by(value, F.struct(*order)).alias("_v")).select(key, "_v.*")
