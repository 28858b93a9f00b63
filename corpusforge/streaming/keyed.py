"""The keyed upsert as a stateful stream: one key's value, list and map state in a state store, no table read per batch.

Beside the versions of module feed, which keep the whole state as tables, this form keeps it in RocksDB by key and gives
each micro-batch's changed rows. What a key holds is bounded by its distinct sources, tags and metadata, not by its
records: a batch is folded to the first and last of each before it meets the state.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from corpusforge.streaming.feed import STATE

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Stands for a missing time, since a column of numbers with gaps would become floats.
NO_TIME = -(2**63)
#: First values stay: the first record's, null or not.
KEPT = ("url", "normalized_url", "hostname", "indicator_type", "source", "threat_type")
SCALARS = ", ".join(f"{c} string" for c in KEPT) + ", first_seen long, last_seen long, source_time long, status string"
OUTPUT = SCALARS.replace("source string", "primary_source string") + ", indicator_hash string, sources array<string>, tags array<string>, metadata string, fresh boolean"


def text(x) -> str | None:
    return x if isinstance(x, str) else None


class Fold:
    """The records of one key in one batch, taken chunk by chunk."""

    def __init__(self) -> None:
        self.first: tuple | None = None
        self.last_seen = NO_TIME
        self.source_time: tuple | None = None
        self.status: tuple | None = None
        self.sources: dict[str, tuple] = {}
        self.tags: dict[str, tuple] = {}
        self.metadata: dict[str, tuple] = {}

    def add(self, at: tuple, row) -> None:
        if self.first is None or at < self.first[0]:
            self.first = (at, tuple(text(getattr(row, c)) for c in KEPT))
        self.last_seen = max(self.last_seen, at[0])
        if row.source_us != NO_TIME and (self.source_time is None or at < self.source_time[0]):
            self.source_time = (at, row.source_us)
        if text(row.status) and (self.status is None or at > self.status[0]):
            self.status = (at, row.status)
        if row.source not in self.sources or at < self.sources[row.source]:
            self.sources[row.source] = at
        for i, tag in enumerate(row.tags):
            if tag not in self.tags or (*at, i) < self.tags[tag]:
                self.tags[tag] = (*at, i)
        if row.source not in self.metadata or at > self.metadata[row.source][0]:
            self.metadata[row.source] = (at, row.metadata)


class KeyedUpsert(StatefulProcessor):
    """A key's scalars, its sources and tags in order of arrival, and the last metadata of each source."""

    def __init__(self, ttl_ms: int | None = None) -> None:
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.scalars = handle.getValueState("scalars", SCALARS, self.ttl_ms)
        self.lists = {name: handle.getListState(name, "value string", self.ttl_ms) for name in ("sources", "tags")}
        self.metadata = handle.getMapState("metadata", "source string", "metadata string", self.ttl_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        new = Fold()
        for chunk in rows:
            for row in chunk.itertuples(index=False):
                new.add((row.at_us, row.ordinal), row)
        old = self.scalars.get() if self.scalars.exists() else None
        earliest, values = new.first
        status = new.status[1] if new.status else None
        source_time = new.source_time[1] if new.source_time else NO_TIME
        if old is None:
            now = (*values, earliest[0], new.last_seen, source_time, status)
        else:  # what was there comes before everything new
            *kept, first_seen, last_seen, known_time, known = tuple(old)
            now = (*kept, first_seen, max(last_seen, new.last_seen), known_time if known_time != NO_TIME else source_time, status or known)
        self.scalars.update(now)
        shown = {}
        for name, found in (("sources", new.sources), ("tags", new.tags)):
            there = [x[0] for x in self.lists[name].get()] if self.lists[name].exists() else []
            more = [x for x in sorted(found, key=lambda x: (found[x], x)) if x not in set(there)]
            if more and self.ttl_ms is None:
                self.lists[name].appendList([(x,) for x in more])
            elif there or more:  # with a time to live all of a key's state lives as long as its last record
                self.lists[name].put([(x,) for x in there + more])
            shown[name] = there + more
        for source, (_, metadata) in new.metadata.items():
            self.metadata.updateValue((source,), (metadata,))
        held = {k[0]: json.loads(v[0]) for k, v in self.metadata.iterator()}
        yield pd.DataFrame([(*now, key[0], shown["sources"], shown["tags"], json.dumps(held, sort_keys=True), old is None)], columns=[x.split()[0] for x in OUTPUT.split(", ")])

    def close(self) -> None:
        pass


def upserted(records: DataFrame, ttl_ms: int | None = None) -> DataFrame:
    """The rows that each micro-batch of keyed records changes, as module feed's upsert gives them, with event indicator.new or .update.

    After ttl_ms without a record a key is forgotten and would count as new again; by default none is. Records whose
    ingested_at is null cannot be ordered and take no part.
    """
    spark: SparkSession = records.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    micros = lambda c: F.coalesce(F.unix_micros(F.col(c).cast("timestamp")), F.lit(NO_TIME))
    rows = records.filter("ingested_at IS NOT NULL").select(
        "indicator_hash", micros("ingested_at").alias("at_us"), F.coalesce(F.col("ordinal").cast("long"), F.lit(NO_TIME)).alias("ordinal"), *KEPT, micros("source_timestamp").alias("source_us"), "status",
        F.coalesce("tags", F.array().cast("array<string>")).alias("tags"), F.coalesce(F.to_json("metadata"), F.lit("{}")).alias("metadata"),
    )
    mode = "None" if ttl_ms is None else "ProcessingTime"
    out = rows.groupBy("indicator_hash").transformWithStateInPandas(KeyedUpsert(ttl_ms), OUTPUT, "Update", mode)
    at = lambda c: F.when(F.col(c) != NO_TIME, F.timestamp_micros(c))
    shown = {
        "first_seen_at": at("first_seen"), "last_seen_at": at("last_seen"), "source_timestamp": at("source_time"), "ingested_at": at("first_seen"),
        "metadata": F.from_json("metadata", "map<string,map<string,string>>"),
    }
    return out.select(*[shown[c].alias(c) if c in shown else F.col(c) for c in STATE], F.when(F.col("fresh"), "indicator.new").otherwise("indicator.update").alias("event"))


def run_keyed(records: DataFrame, path: str, checkpoint: str, ttl_ms: int | None = None):
    """Start the stream: the changed rows of batch n go to path/batch=n. A repeated batch is written over, so each counts once."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return upserted(records, ttl_ms).writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
