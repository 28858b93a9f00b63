import datetime

import pytest
from pyspark.sql import functions as F

from corpusforge.sources import feeds as R
from corpusforge.streaming import feed as W


def lines(spark, *values):
    return spark.createDataFrame([(v,) for v in values], "value string")


def test_timestamps(spark):
    texts = ["2026-10-09T14:30:00Z", "2026-10-09 14:30:00 UTC", "2026-10-09T16:30:00+02:00", "2026-10-09", "", None, "soon"]
    got = [r.t for r in lines(spark, *texts).select(R.flexible_timestamp(F.col("value")).alias("t")).collect()]
    assert got[:4] == [datetime.datetime(2026, 10, 9, 14, 30)] * 3 + [datetime.datetime(2026, 10, 9)] and got[4:] == [None] * 3


def test_payloads(spark):
    text = '{"query_status":"ok","urls":[{"id":"2837482","url":"http://192.168.1.1/malware.bin","url_status":"online","threat":"malware_download","tags":"elf,mirai","dateadded":"2026-10-09 10:15:30 UTC","reporter":"abuse_bot"}]}'
    (row,) = R.malware_json(lines(spark, text, "not json", "{}", "[1]")).collect()
    assert row.source_timestamp == datetime.datetime(2026, 10, 9, 10, 15, 30) and row.tags == ["elf", "mirai"] and row.metadata["reporter"] == "abuse_bot" and row.status == "online"
    plain = R.PARSERS["openphish"](lines(spark, "# comment", "http://login-appleid-verify.com/auth", " secure-bank-update.xyz/token ", "")).collect()
    assert [r.url for r in plain] == ["http://login-appleid-verify.com/auth", "http://secure-bank-update.xyz/token"]
    assert R.PARSERS["community"](lines(spark, "// x", "# y", "a.com")).count() == 1
    (row,) = R.malware_csv(lines(spark, "# c", '"1","2026-10-09 10:15:30","http://x/y","strange","","","none, a","l","r"', '"2","x","ftp://x"')).collect()
    assert (row.status, row.threat_type, row.tags) == ("active", "malware_download", ["a"])


def test_files(spark, tmp_path):
    (tmp_path / "a.csv").write_text("Full_URL,Class\nhttp://a,Benign\nhttp://b,odd\n")
    (tmp_path / "b.csv").write_text("link,other\nhttp://c,1\n")
    rows, skipped = R.mixed_csvs(spark, [str(tmp_path / n) for n in ("a.csv", "b.csv", "none.csv")])
    assert rows.count() == 2 and [s.rsplit("/", 1)[1] for s in skipped] == ["b.csv", "none.csv"]
    known, report = R.dictionary_labels(rows, "label", {"benign": 0, "phishing": 1})
    assert [r.label for r in known.collect()] == [0] and {r["class"]: r.included for r in report.collect()} == {"benign": True, "odd": False}
    (tmp_path / "c.csv").write_text("URL,label\nhttp://a,1\nhttp://b,0\nhttp://c,x\nhttp://d,3\n")
    assert [(r.url, r.label) for r in R.labelled_csv(spark, str(tmp_path / "c.csv"), "URL", "label", "s", invert=True).collect()] == [("http://a", 0), ("http://b", 1)]
    (tmp_path / "d.csv").write_text("https://first.example/\nhttps://second.example/\n")
    assert R.url_list(spark, str(tmp_path / "d.csv")).count() == 2
    R.write_once(rows, str(tmp_path / "out"))
    with pytest.raises(Exception, match="PATH_ALREADY_EXISTS"):
        R.write_once(rows, str(tmp_path / "out"))


def test_links(spark):
    html = '<a href="/b?x=1&amp;y=2#f">x</a> <A class=z HREF=\'c\'> <a href="https://other.org/">o</a> <a href="#top"> <a href="mailto:a@b.c"> <a href="//sub.example.com/d"> <a href="https://www.example.com/a/page">self</a>'
    df = spark.createDataFrame([("https://www.example.com/a/page", html)], "url string, html string")
    assert sorted(r.link for r in R.page_links(df).collect()) == ["https://sub.example.com/d", "https://www.example.com/a/c", "https://www.example.com/b?x=1&y=2"]
    xml = "<urlset><url><loc>https://a/1?x&amp;y</loc></url><url><loc><![CDATA[https://a/2]]></loc></url><url><loc>https://a/3</loc></url></urlset>"
    files = spark.createDataFrame([("f", xml)], "file string, xml string")
    assert [r.url for r in R.sitemap_urls(files, "file", "xml", 2).collect()] == ["https://a/1?x&y", "https://a/2"]
    rss = '<rss><item><link>https://a/1</link></item><entry><link rel="self" href="no"/><link rel="alternate" href="https://a/2"/></entry><item></item></rss>'
    assert [r.url for r in R.feed_links(spark.createDataFrame([("f", rss)], "file string, xml string"), "file", "xml").collect()] == ["https://a/1", "https://a/2"]
    assert sorted(r.url for r in R.harvested(lines(spark, '{"a":["http://x",{"b":"https://y"}],"http://key":1,"c":"see http://z"}')).collect()) == ["http://x", "https://y"]
    assert [r.url for r in R.json_field_urls(lines(spark, '{"url":"u1","m":{"l":"u2"}}', "{}"), ["url", "m.l"]).collect()] == ["u1", "u2"]


FEED = "url string, source string, indicator_type string, status string, source_timestamp timestamp, threat_type string, tags array<string>, metadata map<string,string>, ingested_at timestamp, ordinal long"


def rows():
    at = datetime.datetime(2026, 10, 9, 12)
    return [
        ("http://Evil.test/a", "urlhaus", "malware_url", "online", at, "malware", ["emotet", "malware"], {"k": "1"}, at, 1), ("http://evil.test/a", "openphish", "phishing_url", "", None, "phish", ["banking", "phishing", "malware"], {"k": "2"}, at, 2),
        ("http://other.test/", "openphish", "phishing_url", "active", None, "phish", None, None, at, 3), (" ", "openphish", "x", "x", None, "x", None, None, at, 4), (None, "openphish", "x", "x", None, "x", None, None, at, 5),
    ]


def test_upsert_and_changes(spark):
    good, bad = W.keyed(spark.createDataFrame(rows(), FEED))
    assert bad.count() == 2
    state = {r.hostname: r for r in W.upsert(good).collect()}
    evil = state["evil.test"]
    assert evil.sources == ["urlhaus", "openphish"] and evil.tags == ["emotet", "malware", "banking", "phishing"] and evil.primary_source == "urlhaus" and evil.status == "online" and evil.threat_type == "malware"
    assert evil.source_timestamp == datetime.datetime(2026, 10, 9, 12) and evil.metadata == {"urlhaus": {"k": "1"}, "openphish": {"k": "2"}}
    assert [r.event for r in W.changes(good).orderBy("ordinal").collect()] == ["indicator.new", "indicator.update", "indicator.new"]


def test_a_feed_of_repeated_urls(spark):
    at = datetime.datetime(2026, 10, 9, 12)
    sources = ("a", "b", "c")
    many = [(f"http://H{i % 7}.test/", sources[i * i % 5 % 3], "t", ("", None, f"s{i}")[i % 3], at if i % 4 == 0 else None, f"x{i}", [f"k{i % 11}", None, f"k{i % 3}"] if i % 6 else None, {"i": str(i)}, at + datetime.timedelta(seconds=i * 37 % 50), i) for i in range(300)]
    df = spark.createDataFrame(many, FEED).repartition(5)
    good, _ = W.keyed(df)
    # a URL is taken apart once, before it meets its records
    plan = good._jdf.queryExecution().optimizedPlan().toString()
    assert "Join Inner" in plan and "Aggregate [url" in plan and good.columns[:10] == df.columns
    # the records are exploded for their tags only
    assert W.upsert(good)._jdf.queryExecution().optimizedPlan().toString().count("Generate") == 1
    cut = at + datetime.timedelta(seconds=20)
    first = W.upsert(good.filter(F.col("ingested_at") < cut))
    for state in (W.upsert(good), W.upsert(good.filter(F.col("ingested_at") >= cut), first)):
        found = {r.url: r for r in state.collect()}
        assert len(found) == 7
        for url, r in found.items():
            mine = sorted((x for x in many if x[0] == url), key=lambda x: (x[8], x[9]))
            tags = list(dict.fromkeys(t for x in mine for t in x[6] or []))
            stated, timed = [x[3] for x in mine if x[3]], [x[4] for x in mine if x[4]]
            assert (r.sources, r.tags, r.status) == (list(dict.fromkeys(x[1] for x in mine)), tags, stated[-1] if stated else None)
            assert (r.primary_source, r.threat_type, r.first_seen_at, r.last_seen_at, r.source_timestamp) == (mine[0][1], mine[0][5], mine[0][8], mine[-1][8], timed[0] if timed else None)
            assert r.metadata == {x[1]: x[7] for x in mine}


def test_stream_equals_batch(spark, tmp_path):
    source = tmp_path / "in"
    for i, r in enumerate(rows()[:3]):
        spark.createDataFrame([r], FEED).coalesce(1).write.parquet(f"{source}/part={i}")
    stream = spark.readStream.schema(FEED).option("maxFilesPerTrigger", 1).parquet(f"{source}/*")
    snapshots = W.Snapshots(spark, str(tmp_path / "state"))
    W.run_feed(stream, snapshots, str(tmp_path / "events"), str(tmp_path / "check"), as_of=lambda n: "2026-10-09 12:30:00", stats=str(tmp_path / "stats")).awaitTermination(120)
    batch = W.upsert(W.keyed(spark.createDataFrame(rows(), FEED))[0])
    show = lambda d: sorted((r.hostname, r.primary_source, sorted(r.sources), sorted(r.tags), sorted(r.metadata)) for r in d.collect())
    assert show(snapshots.read()) == show(batch) and snapshots.versions() == [1, 2, 3]
    events = [r.event for r in spark.read.parquet(f"{tmp_path}/events/batch=*").collect()]
    assert sorted(events) == ["indicator.new", "indicator.new", "indicator.update"]
    assert spark.read.parquet(f"{tmp_path}/stats/batch=2").first().total == 2
    # a version holds only the keys of its batch, and an empty state written whole holds none
    changed = [spark.read.parquet(f"{tmp_path}/state/v={n}").count() for n in (1, 2, 3)]
    assert changed == [1, 1, 1] and snapshots.read(1).count() == 1 and snapshots.read(2).count() == 1
    key = snapshots.read().filter("hostname = 'evil.test'").select("indicator_hash")
    assert snapshots.read(keys=key).count() == 1
    snapshots.truncate()
    assert snapshots.read().count() == 0 and snapshots.read(3).count() == 2


def test_versions_written_whole(spark, tmp_path):
    good, _ = W.keyed(spark.createDataFrame(rows(), FEED))
    snapshots = W.Snapshots(spark, str(tmp_path), whole_every=2)
    for n, ordinal in enumerate((1, 2, 3), 1):
        batch = good.filter(F.col("ordinal") == ordinal)
        snapshots.write_changed(W.upsert(batch, snapshots.read(n - 1, batch)), n)
    assert snapshots._found("full") == [2] and snapshots.versions() == [1, 2, 3]
    show = lambda d: sorted((r.hostname, r.sources, r.tags, r.status) for r in d.collect())
    assert show(snapshots.read()) == show(W.upsert(good)) and snapshots.read(0) is None


def test_quarantine_is_kept(spark, tmp_path):
    spark.createDataFrame(rows(), FEED).coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(FEED).parquet(f"{tmp_path}/in")
    W.run_feed(stream, W.Snapshots(spark, f"{tmp_path}/state"), f"{tmp_path}/events", f"{tmp_path}/check").awaitTermination(120)
    assert spark.read.parquet(f"{tmp_path}/events_quarantine/batch=0").count() == 2


def test_first_sightings_within_a_watermark(spark, tmp_path):
    at = datetime.datetime(2026, 10, 9, 12)
    spark.createDataFrame([("a", at), ("a", at), ("b", at)], "indicator_hash string, at timestamp").coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("indicator_hash string, at timestamp").parquet(f"{tmp_path}/in")
    q = W.expiring(stream, "at", "1 hour").writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/check").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted(r.indicator_hash for r in spark.read.parquet(f"{tmp_path}/out").collect()) == ["a", "b"]


def test_readers_without_a_query(spark, tmp_path):
    good, counts = R.labelled_feed(lines(spark, "http://a", " ", "", "http://b "), "feed")
    assert [(r.url, r.label, r.source) for r in good.collect()] == [("http://a", 1, "feed"), ("http://b ", 1, "feed")] and tuple(counts.first()) == (4, 2)
    (tmp_path / "e.csv").write_text("name,link\nx,https://Example.com/a/\ny,ftp://no\nz,https://example.com/a\n")
    assert [r.url for r in R.existing_urls(spark, str(tmp_path / "e.csv")).collect()] == ["https://example.com/a"]
    snaps = spark.createDataFrame([(2, "b"), (2, "c"), (3, "d")], "rank int, url string")
    assert sorted(r.url for r in R.first_nonempty(snaps, "rank").collect()) == ["b", "c"]
    manifest = '{"sources":[{"name":"s","first_party_pages_crawled":[{"url":"https://a/","status":200},{"url":"https://b/","status":404},{"url":"ftp://c","status":200}]}]}'
    assert [tuple(r) for r in R.crawled_pages(lines(spark, manifest)).collect()] == [("s", "https://a/")]
    files = spark.createDataFrame([("f", "u1", "d"), ("f", "u1", "d"), ("g", "u2", "d")], "file string, url string, domain string")
    assert {r.file: (r.n_urls, r.n_domains) for r in R.inventory(files, "file", "url", "domain").collect()} == {"f": (1, 1), "g": (1, 1), "*": (2, 1)}
    seen = spark.createDataFrame([("https://a.com/", "yes", "yes"), ("https://A.com/", "yes", "yes"), ("https://b.com/", "no", "yes"), ("https://c.com/", "yes", "no"), ("nope", "yes", "yes")], "url string, verified string, online string")
    kept, outcomes = R.verified_online(seen, "url")
    assert kept.count() == 1 and {r.outcome: r.n for r in outcomes.collect()} == {"kept": 1, "duplicate": 1, "not_verified": 1, "not_online": 1, "invalid_url": 1}


def test_character_references(spark):
    texts = {"a&amp;lt;b": "a&lt;b", "x&#38;y": "x&y", "&#x26;&#X3C;": "&<", "&": "&", "a&b;c": "a&b;c", "&#0;&#99999999;": "&#0;&#99999999;", "&quot;&apos;": "\"'", "&#128512;": "\U0001f600", "plain": "plain", "": ""}
    got = {r.value: r.t for r in lines(spark, *texts).select("value", R.unescaped(F.col("value")).alias("t")).collect()}
    assert got == texts


def test_links_stay_within_the_registered_domain(spark):
    html = '<a href="https://other.co.uk/x">o</a><a href="https://www.shop.co.uk/y?a=1&#38;b=2">y</a>'
    df = spark.createDataFrame([("https://shop.co.uk/", html)], "url string, html string")
    assert [r.link for r in R.page_links(df).collect()] == ["https://www.shop.co.uk/y?a=1&b=2"]


def test_stream_scoring_redacts(spark, tmp_path):
    spark.createDataFrame([("https://u:p@a.com/x?secret=1#f",)], "url string").write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("url string").parquet(f"{tmp_path}/in")
    W.run_scoring(stream, lambda d: d.withColumn("p", F.lit(0.5)), f"{tmp_path}/log", f"{tmp_path}/check").awaitTermination(120)
    assert [(r.url, r.p) for r in spark.read.parquet(f"{tmp_path}/log").collect()] == [("https://a.com/x", 0.5)]


def test_health(spark):
    t = lambda h: datetime.datetime(2026, 1, 1, h)
    log = [("bad", t(1), True, None), *[("bad", t(2 + i), False, "http 500") for i in range(3)], ("limited", t(1), False, "429"), ("old", t(1), True, None), ("fresh", t(9), True, None), ("failed", t(9), False, "boom")]
    fetches = spark.createDataFrame(log, "source_id string, attempted_at timestamp, ok boolean, error string")
    sources = spark.createDataFrame([(s, True, True, 600) for s in ("bad", "limited", "old", "fresh", "failed", "never")] + [("off", False, True, 600), ("new", True, False, 600)], "source_id string, enabled boolean, configured boolean, cadence_seconds int")
    got = {r.source_id: r.status for r in W.health(fetches, sources, "2026-01-01 09:10:00").collect()}
    assert got == {"bad": "error", "limited": "rate_limited", "old": "stale", "fresh": "healthy", "failed": "error", "never": "healthy", "off": "disabled", "new": "awaiting_config"}
