"""The indicator feed: keyed upserts from many sources, a change feed, replay, health, and their streaming forms.

State is one row per indicator. A batch is folded into it by one aggregation over the key, with first and
last values chosen by (ingested_at, ordinal); the stream does the same fold in foreachBatch. It asks the state
only for the keys of the batch, in the buckets that hold them, and writes only their rows, as the next version;
now and then a version is written whole. A batch that is repeated after a failure gives the same version.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusforge.functions import urls as U
from corpusforge.operators import log as L
from corpusforge.operators.percentiles import percentiles

STATE = ("indicator_hash", "url", "normalized_url", "hostname", "indicator_type", "primary_source", "sources", "first_seen_at", "last_seen_at", "source_timestamp", "status", "threat_type", "tags", "metadata", "ingested_at")


def keyed(records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Records with indicator_hash, normalized_url and hostname; and those without a usable URL.

    A URL comes with every sighting of its indicator, and taking it apart costs more than a join, so it is done once a distinct
    URL; only in a stream, which cannot join itself, once a record.
    """
    good = F.coalesce(F.trim("url"), F.lit("")) != ""
    found = records.filter(good)
    with_keys = lambda df: U.safe_normalize(df).withColumn("indicator_hash", U.indicator_hash(F.col("normalized_url")))
    if records.isStreaming:
        return with_keys(found), records.filter(~good)
    keys = with_keys(found.select("url").distinct())
    return found.join(keys, "url").select(*records.columns, "normalized_url", "hostname", "indicator_hash"), records.filter(~good)


def upsert(records: DataFrame, state: DataFrame | None = None) -> DataFrame:
    """The state after keyed records (with ingested_at and ordinal).

    First values stay: url, type, primary_source, first_seen, threat_type, ingested_at, and the first timestamp
    that is not null. Last values win: last_seen, status that is not empty, metadata of each source. Sources and
    tags are kept in order of arrival, each once.
    """
    o = F.struct("ingested_at", F.col("ordinal").cast("long").alias("ordinal"))
    none = F.create_map().cast("map<string,map<string,string>>")
    first = F.struct(o.alias("o"), "url", "normalized_url", "hostname", "indicator_type", F.col("source").alias("primary_source"), F.col("ingested_at").alias("first_seen_at"), "threat_type", "ingested_at")
    # one row a source of a key, all but the tags from one pass, so that a key with very many records gathers only what is distinct
    seen = records.groupBy("indicator_hash", "source").agg(
        F.min(first).alias("first"), F.max(o).alias("last"), F.min(F.when(F.col("source_timestamp").isNotNull(), F.struct(o.alias("o"), "source_timestamp"))).alias("timed"),
        F.max(F.when(F.coalesce("status", F.lit("")) != "", F.struct(o.alias("o"), "status"))).alias("stated"), F.max_by(F.coalesce("metadata", F.create_map().cast("map<string,string>")), o).alias("metadata"),
    )
    place = lambda at, n, i, k: F.struct(at.alias("ingested_at"), n.alias("ordinal"), i.alias("i"), k.alias("k"))
    rows = seen.select(
        "indicator_hash", "first", F.struct(F.col("last").alias("o"), F.col("last.ingested_at").alias("last_seen_at")).alias("last"), "timed", "stated", F.array(place(F.col("first.o.ingested_at"), F.col("first.o.ordinal"), F.lit(0), F.col("source"))).alias("sources"),
        F.struct("source", "metadata").alias("entry"), F.lit(None).cast("map<string,map<string,string>>").alias("known"),
    )
    tags = records.select("indicator_hash", "ingested_at", F.col("ordinal").cast("long").alias("ordinal"), F.posexplode("tags").alias("i", "k"))
    if state is not None:
        # what was there comes before everything new
        times = F.lit("0001-01-01").cast("timestamp").cast(records.schema["ingested_at"].dataType).alias("ingested_at"), F.lit(-1).cast("long").alias("ordinal")
        before = F.struct(*times)
        old = state.select(
            "indicator_hash", F.struct(before.alias("o"), "url", "normalized_url", "hostname", "indicator_type", "primary_source", "first_seen_at", "threat_type", "ingested_at").alias("first"), F.struct(before.alias("o"), "last_seen_at").alias("last"),
            F.when(F.col("source_timestamp").isNotNull(), F.struct(before.alias("o"), "source_timestamp")).alias("timed"), F.when(F.coalesce("status", F.lit("")) != "", F.struct(before.alias("o"), "status")).alias("stated"),
            F.transform("sources", lambda k, i: place(*times, i, k)).alias("sources"), F.lit(None).cast(rows.schema["entry"].dataType).alias("entry"), F.col("metadata").alias("known"),
        )
        rows = rows.unionByName(old)
        tags = tags.unionByName(state.select("indicator_hash", *times, F.posexplode("tags").alias("i", "k")))
    out = rows.groupBy("indicator_hash").agg(
        F.min("first").alias("first"), F.max("last").alias("last"), F.min("timed").alias("timed"), F.max("stated").alias("stated"),
        F.array_sort(F.flatten(F.collect_list("sources"))).alias("sources"), F.map_from_entries(F.collect_list("entry")).alias("new"), F.coalesce(F.any_value("known", F.lit(True)), none).alias("known"),
    )
    kept = F.map_filter("known", lambda k, _: ~F.map_contains_key("new", k))
    firsts = tags.groupBy("indicator_hash", "k").agg(F.min(F.struct("ingested_at", "ordinal", "i")).alias("f"))
    tags = firsts.groupBy("indicator_hash").agg(F.transform(F.array_sort(F.collect_list(F.struct("f", "k"))), lambda e: e["k"]).alias("tags"))
    out = out.select("indicator_hash", "first.*", "last.last_seen_at", "timed.source_timestamp", "stated.status", F.array_distinct(F.transform("sources", lambda e: e["k"])).alias("sources"), F.map_concat(kept, "new").alias("metadata"))
    return out.join(tags, "indicator_hash", "left").withColumn("tags", F.coalesce("tags", F.array().cast("array<string>"))).select(*STATE)


def changes(records: DataFrame, state: DataFrame | None = None) -> DataFrame:
    """One event per record: indicator.new at the first sight of its key, else indicator.update."""
    # the first record of a key is a minimum that is merged before the shuffle; a hot key is split in the join
    firsts = records.groupBy(F.col("indicator_hash").alias("_h")).agg(F.min(F.struct("ingested_at", "ordinal")).alias("_first"))
    if state is not None:
        firsts = firsts.join(state.select(F.col("indicator_hash").alias("_h")), "_h", "left_anti")
    df = records.join(firsts, F.col("indicator_hash") == F.col("_h"), "left")
    event = F.when(F.struct("ingested_at", "ordinal") == F.col("_first"), "indicator.new").otherwise("indicator.update")
    return df.withColumn("event", event).drop("_first", "_h")


def health(fetches: DataFrame, sources: DataFrame, as_of: str) -> DataFrame:
    """One status per source from its fetch log (source_id, attempted_at, ok, error) at as_of."""
    now = F.to_timestamp(F.lit(as_of))
    log = fetches.filter(F.col("attempted_at") <= now)
    good = log.filter("ok").groupBy("source_id").agg(F.max("attempted_at").alias("last_ok"))
    marked = log.join(good, "source_id", "left")
    per = marked.groupBy("source_id").agg(
        F.max("attempted_at").alias("last_attempt"), F.max("last_ok").alias("last_ok"), F.max_by("error", "attempted_at").alias("last_error"),
        F.count_if(~F.col("ok") & (F.col("last_ok").isNull() | (F.col("attempted_at") > F.col("last_ok")))).alias("failures"),
    )
    age = F.unix_timestamp(now) - F.unix_timestamp("last_ok")
    status = (
        F.when(~F.col("configured"), "awaiting_config").when(~F.col("enabled"), "disabled").when(F.col("last_error").rlike("(?i)429|rate"), "rate_limited")
        .when(F.col("last_error").isNotNull() & (F.col("failures") >= 3), "error").when(age > F.greatest(F.col("cadence_seconds") * 3, F.lit(1800)), "stale").when(F.col("last_ok").isNotNull(), "healthy")
        .when(F.col("last_attempt").isNull(), "healthy").otherwise("error")
    )
    return sources.join(per, "source_id", "left").select("source_id", status.alias("status"), F.coalesce("failures", F.lit(0)).alias("failures"), "last_ok")


def latency(events: DataFrame) -> DataFrame:
    """Median and 95th percentile seconds between source, ingested, persisted and emitted times."""
    gap = lambda a, b: F.col(b).cast("double") - F.col(a).cast("double")
    steps = {"ingest": ("source_at", "ingested_at"), "persist": ("ingested_at", "persisted_at"), "emit": ("persisted_at", "emitted_at")}
    long = events.select(F.explode(F.array(*[F.struct(F.lit(k).alias("step"), gap(*v).alias("seconds")) for k, v in steps.items()])).alias("x")).select("x.*")
    return percentiles(long, ["step"], "seconds", {"median": 0.5, "p95": 0.95}, F.count("seconds").alias("n"))


def merge_keeping(rows: DataFrame, key: str, order: str, first: list[str]) -> DataFrame:
    """One row per key with the last values, but the first values of the columns in ``first``."""
    rest = [c for c in rows.columns if c != key and c not in first]
    return rows.groupBy(key).agg(*[F.max_by(c, order).alias(c) for c in rest], *[F.min_by(c, order).alias(c) for c in first])


def client_list(events: DataFrame, key: str, order: str, most: int = 200) -> DataFrame:
    """The latest version of each key, the newest first."""
    return L.latest_by_key(events, key, order).orderBy(F.desc(order), key).limit(most)


class Snapshots:
    """Versions of the state under a folder: v=n has the rows that version n changed, full=n the whole state.

    Both are sorted by the key and hold its first hexadecimal digits as bucket, so a read for few keys skips most of a file.
    """

    BUCKET = "substring(indicator_hash, 1, 2)"

    def __init__(self, spark: SparkSession, path: str, whole_every: int = 50):
        self.spark, self.path, self.whole_every = spark, path, whole_every

    def _found(self, kind: str) -> list[int]:
        path = self.spark._jvm.org.apache.hadoop.fs.Path
        fs = path(self.path).getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not fs.exists(path(self.path)):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(path(self.path))]
        return sorted(int(n.split("=")[1]) for n in names if n.startswith(f"{kind}=") and fs.exists(path(f"{self.path}/{n}/_SUCCESS")))

    def versions(self) -> list[int]:
        return sorted({*self._found("v"), *self._found("full")})

    def read(self, version: int | None = None, keys: DataFrame | None = None) -> DataFrame | None:
        """The state at a version (the last one if none is given), or only its rows of keys (indicator_hash)."""
        upto = [v for v in self.versions() if version is None or v <= version]
        if not upto:
            return None
        whole = [v for v in self._found("full") if v <= upto[-1]]
        base = whole[-1] if whole else 0
        changed = [v for v in self._found("v") if base < v <= upto[-1]]
        wanted = None
        if keys is not None:
            wanted = [r.b for r in keys.select(F.expr(self.BUCKET).alias("b")).distinct().collect()]  # at most 256

        def part(kind: str, numbers: list[int]) -> DataFrame:
            rows = self.spark.read.option("basePath", self.path).parquet(*[f"{self.path}/{kind}={n}" for n in numbers])
            if wanted is not None:
                rows = rows.filter(F.col("bucket").isin(wanted)).join(keys.select("indicator_hash").distinct(), "indicator_hash", "left_semi")
            return rows

        out = part("full", [base]).select(*STATE) if whole else None
        if changed:
            value = F.struct(*STATE)
            latest = part("v", changed).groupBy("indicator_hash").agg(F.max_by(value, "v").alias("_s")).select("_s.*")
            out = latest if out is None else out.join(latest.select("indicator_hash"), "indicator_hash", "left_anti").select(*STATE).unionByName(latest)
        return out

    def _write(self, rows: DataFrame, name: str) -> None:
        rows = rows.select(*STATE, F.expr(self.BUCKET).alias("bucket")).repartitionByRange("indicator_hash").sortWithinPartitions("indicator_hash")
        rows.write.mode("overwrite").parquet(f"{self.path}/{name}")

    def changed(self, version: int) -> DataFrame:
        """The rows that a version changed, as they are in it."""
        return self.spark.read.parquet(f"{self.path}/v={version}").select(*STATE)

    def write(self, state: DataFrame, version: int) -> None:
        """A whole state as a version."""
        self._write(state, f"full={version}")

    def write_changed(self, rows: DataFrame, version: int) -> None:
        """The rows that a version changes; every whole_every versions the whole state follows."""
        self._write(rows, f"v={version}")
        if version % self.whole_every == 0:
            self.write(self.read(version), version)

    def truncate(self) -> None:
        """An empty version after the last."""
        found = self.versions()
        if found:
            self.write(self.read().limit(0), found[-1] + 1)


class Statistics:
    """Statistics of the state after each batch, kept up by what the batch changed: old rows taken away, new rows added.

    path_counts/batch=n has the sums, path/batch=n the row of them. A batch reads the sums of the one before and no
    state; only where those are missing are the rows of the whole version counted. as_of must not go back.
    """

    FACETS = ("primary_source", "indicator_type", "status")

    def __init__(self, spark: SparkSession, path: str, as_of: Callable[[int], str], sources: Callable[[int], DataFrame] | None = None):
        self.spark, self.path, self.as_of, self.sources = spark, path.rstrip("/"), as_of, sources

    def counts(self, number: int) -> DataFrame | None:
        folder = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}_counts/batch={number}/_SUCCESS")
        found = folder.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(folder)
        return self.spark.read.parquet(f"{self.path}_counts/batch={number}") if found else None

    def advance(self, number: int, old: DataFrame | None, snapshots: Snapshots) -> None:
        """After version number + 1 is written; old has the rows of its keys in the version before."""
        at, facets = self.as_of(number), list(self.FACETS)
        before = self.counts(number - 1)
        if before is None:
            now = L.stat_counts(snapshots.read(number + 1), at, facets)
        else:
            now = before.unionByName(L.stat_counts(snapshots.changed(number + 1), at, facets))
            if old is not None:
                now = now.unionByName(L.stat_counts(old, at, facets, sign=-1))
            now = L.stat_sum(now, at)
        now.coalesce(1).write.mode("overwrite").parquet(f"{self.path}_counts/batch={number}")
        row = L.stat_row(self.counts(number), at, facets, self.sources(number) if self.sources else None)
        row.write.mode("overwrite").parquet(f"{self.path}/batch={number}")


def run_feed(
    records: DataFrame, snapshots: Snapshots, events: str, checkpoint: str, as_of: Callable[[int], str] | None = None, stats: str | None = None, quarantine: str | None = None,
    sources: Callable[[int], DataFrame] | None = None,
):
    """Start the stream: each micro-batch becomes version batch + 1 of the state, its change events, and (if asked for) statistics of the whole state.

    Records without a usable URL go to the quarantine folder (beside the events where none is named). sources gives the
    sources (enabled, status) whose health the statistics of a batch count.
    """
    aside = quarantine or f"{events.rstrip('/')}_quarantine"
    kept = Statistics(snapshots.spark, stats, as_of, sources) if stats and as_of else None

    def fold(batch: DataFrame, number: int) -> None:
        batch = batch.persist()
        good, bad = keyed(batch)
        good = good.persist()
        try:
            bad.write.mode("overwrite").parquet(f"{aside}/batch={number}")
            state = snapshots.read(number, good)
            changes(good, state).write.mode("overwrite").parquet(f"{events}/batch={number}")
            snapshots.write_changed(upsert(good, state), number + 1)
            if kept:
                kept.advance(number, state, snapshots)
        finally:
            good.unpersist()
            batch.unpersist()

    return records.writeStream.foreachBatch(fold).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def run_scoring(urls: DataFrame, score: Callable[[DataFrame], DataFrame], path: str, checkpoint: str):
    """Score a stream of URLs and append redacted rows to the scan log."""
    scored = score(urls)
    out = scored.withColumn("url", U.redacted(F.col("url")))
    return out.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def expiring(records: DataFrame, at: str, delay: str) -> DataFrame:
    """Our addition, off by default: the first record of each key within a watermark; later ones count as new again."""
    return records.withWatermark(at, delay).dropDuplicatesWithinWatermark(["indicator_hash"])
