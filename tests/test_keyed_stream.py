"""The stateful stream and the statistics kept up by deltas, beside the batch fold and full recounts."""

import datetime
import random

from pyspark.sql import functions as F

from corpusforge.operators import log as L
from corpusforge.streaming import feed as W
from corpusforge.streaming import keyed as K
from tests.test_feeds import FEED

AT = datetime.datetime(2026, 10, 9, 12)


def records(n, seed=1):
    rng = random.Random(seed)
    names = ["urlhaus", "openphish", "community"]
    out = []
    for i in range(n):
        at = AT + datetime.timedelta(minutes=20 * i + rng.randrange(3))
        out.append((f"http://h{rng.randrange(n // 6)}.test/", rng.choice(names), rng.choice(["malware_url", "phishing_url"]), rng.choice(["online", "", None, "offline"]), rng.choice([at, None]), rng.choice(["m", None]), rng.choice([["a", "b"], ["b", "c", "a"], [], None]), rng.choice([{"k": str(i)}, None]), at, i))
    return out


def landed(spark, folder, rows, parts):
    for i in range(parts):
        spark.createDataFrame(rows[i::parts] if i else rows[::parts], FEED).coalesce(1).write.parquet(f"{folder}/part={i}")
    return spark.readStream.schema(FEED).option("maxFilesPerTrigger", 1).parquet(f"{folder}/*")


def shown(rows):
    return sorted((r.hostname, r.url, r.indicator_type, r.primary_source, list(r.sources), list(r.tags), r.status, r.threat_type, r.source_timestamp, r.first_seen_at, r.last_seen_at, r.ingested_at, sorted((k, sorted(v.items())) for k, v in r.metadata.items())) for r in rows)


def test_stateful_stream_equals_batch_over_a_restart(spark, tmp_path):
    rows = records(60)
    third = len(rows) // 3
    for i in range(2):
        spark.createDataFrame(rows[i * third : (i + 1) * third], FEED).coalesce(1).write.parquet(f"{tmp_path}/in/part={i}")
    stream = lambda: W.keyed(spark.readStream.schema(FEED).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*"))[0]
    old = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    try:
        K.run_keyed(stream(), f"{tmp_path}/out", f"{tmp_path}/check").awaitTermination(200)
        spark.createDataFrame(rows[2 * third :], FEED).coalesce(1).write.parquet(f"{tmp_path}/in/part=2")
        K.run_keyed(stream(), f"{tmp_path}/out", f"{tmp_path}/check").awaitTermination(200)
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", old)
    state, seen = {}, set()
    for n in range(3):
        for r in spark.read.parquet(f"{tmp_path}/out/batch={n}").collect():
            assert r.event == ("indicator.update" if r.indicator_hash in seen else "indicator.new")
            seen.add(r.indicator_hash)
            state[r.indicator_hash] = r
        batch = W.upsert(W.keyed(spark.createDataFrame(rows[: (n + 1) * third], FEED))[0])
        assert shown(state.values()) == shown(batch.collect()), n
    assert len(state) < len(rows)


def test_statistics_by_deltas_equal_a_recount(spark, tmp_path):
    rows = records(48, 2)
    quarter = len(rows) // 4
    for i in range(4):
        spark.createDataFrame(rows[i * quarter : (i + 1) * quarter], FEED).coalesce(1).write.parquet(f"{tmp_path}/in/part={i}")
    stream = spark.readStream.schema(FEED).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    as_of = lambda n: (AT + datetime.timedelta(hours=9 * (n + 1))).strftime("%Y-%m-%d %H:%M:%S")
    sources = lambda n: spark.createDataFrame([(True, "healthy"), (True, "error"), (False, "healthy")], "enabled boolean, status string")
    snapshots, stats = W.Snapshots(spark, f"{tmp_path}/state", whole_every=2), f"{tmp_path}/stats"
    W.run_feed(stream, snapshots, f"{tmp_path}/events", f"{tmp_path}/check", as_of, stats, sources=sources).awaitTermination(200)
    kept = W.Statistics(spark, stats, as_of, sources)
    for n in range(4):
        state = snapshots.read(n + 1)
        row = spark.read.parquet(f"{stats}/batch={n}").first()
        assert row == L.feed_stats(state, as_of(n), list(kept.FACETS), sources=sources(n)).first()
        plain = state.collect()
        now = AT + datetime.timedelta(hours=9 * (n + 1))
        within = lambda hours: sum(r.first_seen_at >= now - datetime.timedelta(hours=hours) for r in plain)
        assert (row.total, row.new_24h, row.new_1h, row.latest) == (len(plain), within(24), within(1), max(r.ingested_at for r in plain))
        assert row.by_status == {s: sum(r.status == s for r in plain) for s in {r.status for r in plain} if s} and (row.configured_sources, row.healthy_sources) == (2, 1)
    # a batch that is repeated gives the same row, and no plan of an advance reads a whole version
    before = spark.read.parquet(f"{stats}/batch=3").first()
    good = W.keyed(spark.createDataFrame(rows[3 * quarter :], FEED))[0]
    kept.advance(3, snapshots.read(3, good), snapshots)
    assert spark.read.parquet(f"{stats}/batch=3").first() == before


def test_statistics_of_nothing_and_of_too_many_values(spark, monkeypatch):
    state = W.upsert(W.keyed(spark.createDataFrame(records(12), FEED))[0])
    empty = L.feed_stats(state.limit(0), "2026-10-10 00:00:00", ["status"]).first()
    assert (empty.total, empty.latest, empty.new_24h, empty.by_status) == (0, None, 0, {})
    monkeypatch.setattr(L, "MAP_VALUES", 1)
    try:
        L.feed_stats(state, "2026-10-10 00:00:00", ["hostname"]).collect()
        raise AssertionError("no error")
    except Exception as e:
        assert "more than 1 values" in str(e)
    assert F is not None
