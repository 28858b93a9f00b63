import datetime

import pytest
from pyspark.sql import functions as F

from corpusforge.operators import corpus as O
from corpusforge.operators import log as L
from corpusforge.operators import metrics as M
from corpusforge.operators import sampling as X


def labelled(spark):
    rows = [(1, "https://example.test/a", 0, "s1", "example.test"), (2, "https://example.test/a", 1, "s1", "example.test"), (3, "https://b.test/", 0, "s2", "b.test"), (4, "https://b.test/", 0, "s1", "b.test")]
    return spark.createDataFrame(rows, "ordinal int, url string, label int, source string, domain string")


def test_conflicts_fail_or_drop(spark):
    df = labelled(spark)
    with pytest.raises(ValueError, match="example.test/a"):
        O.require_no_conflicts(df, ["url"])
    assert [r.ordinal for r in O.drop_conflicts(df, ["url"]).orderBy("ordinal").collect()] == [3, 4]
    assert O.keep_best(df, ["url"], "source", ["s2", "s1"], "ordinal").filter("domain = 'b.test'").first().ordinal == 3
    assert O.merge_membership(df, "url", "source", ["s1"], "ordinal", ["ordinal"]).filter("url LIKE '%b.test%'").first().memberships == ["s1", "s2"]


def test_order_of_rows_does_not_matter(spark):
    df = labelled(spark)
    a, b = O.keep_first(df, ["url"], "ordinal"), O.keep_first(df.orderBy(F.desc("ordinal")).repartition(3), ["url"], "ordinal")
    assert sorted(a.collect()) == sorted(b.collect())


def test_provenance(spark):
    good = dict(url="https://a.example.com/x", normalized_url="https://a.example.com/x", label=0, source="s", collection_method="m", verification_status="http_200_same_registered_domain", category=None, cohorts=None,
                registered_domain="example.com", source_page_url="https://example.com/", verified_final_url="https://www.example.com/y", verified_content_type="text/html", collection_date="2024-01-01", provenance="p")
    cases = [
        ({}, []), ({"verified_final_url": "https://other.org/", "verification_status": "http_404_same_registered_domain"}, ["leaves_first_party_domain", "not_2xx"]), ({"source_page_url": "http://example.com/"}, ["not_https"]),
        ({"source_page_url": "https://evilexample.com/x", "verification_status": "http_301"}, ["leaves_first_party_domain", "not_2xx", "not_same_domain"]), ({"url": None, "provenance": ""}, ["missing:url", "missing:provenance"]),
        ({"url": "https://A.example.com/x"}, ["not_normalized"]), ({"label": 1, "registered_domain": "a.example.com"}, ["label_not_zero", "domain_mismatch"]), ({"verification_status": "ok"}, ["malformed"]),
        ({"collection_date": "yesterday", "label": 1}, ["malformed"]), ({"url": "https://a b/"}, ["malformed"]), ({"category": None, "verified_content_type": "application/pdf"}, []),
    ]
    schema = ", ".join(f"{c} {'int' if c == 'label' else 'string'}" for c in good) + ", n int"
    df = spark.createDataFrame([(*(good | change).values(), n) for n, (change, _) in enumerate(cases)], schema)
    out = O.provenance_errors(df)
    assert out.columns == [*df.columns, "errors"]
    assert {r.n: r.errors for r in out.collect()} == {n: want for n, (_, want) in enumerate(cases)}


def test_overlaps_and_identities_are_counted(spark):
    df = labelled(spark)
    used, held = df.filter("ordinal = 1"), df.filter("ordinal = 3")
    kept, counts = O.remove_overlaps(df, "url", used, held)
    assert kept.count() == 0 and tuple(counts.first()) == (4, 2, 2, 0)
    kept, counts = O.identity_guard(df.filter("label = 0"), df.filter("label = 1"), "url", "url", "ordinal")
    assert [r.ordinal for r in kept.collect()] == [3] and tuple(counts.first()) == (3, 1, 1, 1) and kept.columns == df.columns


def test_candidates_stop_without_improvement(spark):
    trials = {"a": (5.0, 90.0, 80.0), "b": (4.0, 90.5, 80.0), "c": (4.0, 98.5, 80.0), "d": (3.9, 98.4, 80.0), "e": (3.9, 97.0, 80.0), "f": (3.95, 98.6, 90.0), "g": (0.0, 99.0, 99.0)}
    winner, reason, table = M.candidate_loop(list("abcdefg"), lambda n: trials[n], (5.0, 90.0, 80.0), spark)
    assert (winner, reason) == (2, "no_meaningful_improvement")
    assert [(r.trial, r.improves, r.against) for r in table.orderBy("trial").collect()] == [(0, False, None), (1, True, None), (2, True, 1), (3, False, 2), (4, False, 2), (5, False, 2)]
    assert M.candidate_loop([], None, (0.0, 0.0, 0.0), spark)[:2] == (None, "candidates_exhausted")


def test_perfect_separation(spark):
    df = spark.createDataFrame([(0, 0.1), (0, 0.4), (1, 0.7), (1, 0.9)], "label int, p double")
    m = M.confusion(df, 0.5).first()
    assert (m.tn, m.fp, m.fn, m.tp) == (2, 0, 0, 2) and m.f1 == 1 and m.fpr == 0
    assert tuple(M.ranking(df).first()) == (1.0, 1.0)
    one = df.filter("label = 1")
    assert M.ranking(one).first().roc_auc is None and M.confusion(one, 0.5).first().fpr is None
    assert M.calibration_error(df).first().ece == pytest.approx(0.225)


def test_bins_follow_double_edges(spark):
    df = spark.createDataFrame([(0.3,), (0.6,), (1.0,), (0.0,)], "p double")
    assert [r.b for r in df.select(M.score_bin().alias("b")).collect()] == [2, 5, 9, 0]


def test_thresholds_are_cleaned():
    assert M.clean_thresholds("x", None) == (0.45, 0.85) and M.clean_thresholds(0.9, 0.2) == (0.9, 1.0) and M.clean_thresholds(1, 1) == (0.8, 0.85) and M.clean_thresholds(float("nan"), 2) == (0.45, 1.0)


def test_route_policy(spark):
    urls = ["https://netflix.com/browse", "https://netflix.com.evil.test/browse", "https://netflix.com/browse?next=https://evil.test", "https://sub.netflix.com/browse", "http://127.0.0.1/", "http://a.localhost/x", "https://netflix.com/other", "http://netflix.com/browse", "https://u@netflix.com/browse"]
    df = spark.createDataFrame([(u, 0.999) for u in urls], "normalized_url string, p double")
    policy = spark.createDataFrame([("netflix.com", "/browse")], "host string, path_pattern string")
    got = {r.normalized_url: (r.policy_applied, r.effective_p < 0.45) for r in M.route_policy(df, policy, 0.45).collect()}
    assert {u for u, v in got.items() if v == (True, True)} == {urls[0], urls[4], urls[5]} and len(got) == len(urls)


def test_weights(spark):
    rows = [(0, s) for s in ("large", "large", "small")] + [(1, s) for s in ("feed", "feed", "feed", "other")]
    df = X.source_class_weights(spark.createDataFrame(rows, "label int, source string"), "source")
    mass = {(r.label, r.source): r.w for r in df.groupBy("label", "source").agg(F.sum("weight").alias("w")).collect()}
    assert all(w == pytest.approx(0.5) for w in mass.values())


def test_splits(spark):
    df = spark.createDataFrame([(f"d{i % 40}", i % 2 if i % 40 < 30 else 0, i) for i in range(400)], "domain string, label int, id int")
    out = X.group_split(df, "domain", 1, (("train", 0.5), ("calibration", 0.25), ("test", 0.25)))
    assert O.group_overlap(out, "split", "domain").count() == 0
    with pytest.raises(ValueError):
        X.group_split(spark.createDataFrame([("a", 0), ("b", 1)], "domain string, label int"), "domain", 1, (("x", 0.5), ("y", 0.5)), tries=5)
    sizes = {r.split: r.n for r in X.balanced_split(df, "domain", {"train": 0.7, "test": 0.3}).groupBy("split").agg(F.count("*").alias("n")).collect()}
    assert sizes == {"train": 280, "test": 120}
    quota = X.quotas(df.groupBy("label").agg(F.count("*").alias("size")).withColumn("hard", F.col("label") == 1), "label", "size", "hard", 100)
    assert sum(r.quota for r in quota.collect()) == 100
    assert X.systematic(df, "label", quota, "id").count() == 100


def test_scan_log(spark):
    verdicts = ["SAFE", "SUSPICIOUS", "PHISHING"]
    rows = [(i, datetime.datetime(2024, 5, 1 + i % 7, 12), verdicts[i % 3]) for i in range(107)]
    log = spark.createDataFrame(rows, "id int, at timestamp, verdict string")
    t = L.verdict_totals(log, "verdict", verdicts).first()
    assert (t.n_SAFE, t.n_SUSPICIOUS, t.n_PHISHING) == (36, 36, 35) and (t.pct_SAFE, t.pct_PHISHING) == (33.6, 32.7)
    days = L.daily_trend(log, "at", "verdict", verdicts, "2024-05-07").collect()
    assert len(days) == 7 and sum(d.total for d in days) == 107
    none = log.filter("false")
    assert L.verdict_totals(none, "verdict", verdicts).first().pct_SAFE is None
    assert [d.total for d in L.daily_trend(none, "at", "verdict", verdicts, "2024-05-07").collect()] == [0] * 7


def test_search(spark):
    df = spark.createDataFrame([(1, "100% sure", ["x"]), (2, "100 sure", ["PayPal"]), (3, None, None)], "id int, url string, tags array<string>")
    ids = lambda d: sorted(r.id for r in d.collect())
    assert ids(L.faceted(df, {}, "0%", ["url"])) == [1] and ids(L.faceted(df, {}, "0%s", ["url"], raw_like=True)) == [1, 2]
    assert ids(L.faceted(df, {}, "paypal", ["url"], ["tags"])) == [2] and ids(L.faceted(df, {"url": "all"}, " ")) == [1, 2, 3]
    assert ids(L.since(df, "x", 500, "id")) == [1, 2, 3] and ids(L.lookup(df, 2, "id", "url")) == [2]
    assert L.page(df, 0, 0, "id").count() == 1
    assert [r.id for r in L.older(df, 3, 5).collect()] == [2, 1] and [r.id for r in L.older(df, None, 1).collect()] == [3]


def test_tfidf_and_trees_are_not_cut(spark, tmp_path, monkeypatch):
    import random

    from corpusforge.plans import models as P

    rng = random.Random(1)
    urls = ["https://" + "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(60)) for _ in range(40)]
    spark.createDataFrame(list(enumerate(urls * 2)), "page_id long, url string").write.parquet(f"{tmp_path}/pages.parquet")
    grams = [{u[i : i + n] for n in (3, 4, 5) for i in range(len(u) - n + 1)} for u in urls]
    assert len(set().union(*grams)) > 2000
    got = {r.page_id: (r.n_terms, r.norm) for r in P.Q["tfidf"](spark, str(tmp_path)).collect()}
    assert got == {i: (len(grams[i % 40]), 1.0) for i in range(80)}
    seen, fitted = [], P.fitted
    monkeypatch.setattr(P, "fitted", lambda s, d, e: (seen.append(e), fitted(s, d))[1])
    P.Q["tree_models"](spark, "/root/testdata/sf0.001")
    assert [seen[0].getNumTrees(), seen[1].getMaxIter(), seen[1].getMaxDepth()] == [80, 100, 5]
