import zlib

import numpy as np
import zstandard
from pyspark.sql import functions as F

from corpusforge.llm import langid as G
from corpusforge.llm import quality as Q
from tests.llm.data import SCHEMA, docs, prose

SF = "/root/testdata/sf0.01"


def test_held_out_language_accuracy(spark):
    from corpusforge.llm.langid import op6_language_id

    got = op6_language_id(spark, SF).join(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in got if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 for r in got)
    assert len(held) > 100 and np.mean([r.lang == r.lang_pred for r in held]) >= 0.97


def test_predictions_are_the_smallest_of_plain_compressions(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet").filter("doc_id < 150")
    contents = G.dictionaries(rows.filter(G.fold() != 0))
    got = rows.select("text", G.identify(spark, contents, F.col("text")).alias("r")).collect()
    assert len(contents) > 1 and len(got) > 50
    for text, r in got:
        data = b" ".join("".join(c if c.isascii() and c.isalpha() or ord(c) > 127 else " " for c in (text or "").lower()).encode().split(b" ")).strip()
        data = b" ".join(data.split())
        if not any(c.isalpha() for c in text or ""):
            assert r.lang_pred == "und"
            continue
        sizes = {}
        for lang, content in contents.items():
            prepared = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            sizes[lang] = len(zstandard.ZstdCompressor(level=G.LEVEL, dict_data=prepared, write_content_size=False, write_checksum=False, write_dict_id=False).compress(data))
        least, second = sorted(sizes.values())[:2]
        assert sizes[r.lang_pred] == least and r.rejected == (second - least < max(G.MARGIN_BYTES, G.MARGIN_SHARE * least))
        assert abs(r.score - 1 / sum(2.0 ** -min(x - least, 1000) for x in sizes.values())) < 1e-12


def test_dictionaries_sample_whole_texts(spark):
    words = [f"w{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(600)]
    long = " ".join(words * 40)
    df = docs(spark, [(1, long), (2, "short one"), (2, "short one"), (3, None), (4, "123"), (None, "no id")], extra=True)
    found = G.dictionaries(df, sample=50, size=100)
    assert list(found) == ["en"] and found["en"].count(b" ") > 50 * 15 and len(found["en"]) <= 50 * 101
    assert G.dictionaries(df.repartition(3), sample=50, size=100) == found
    places = sorted(long.find(found["en"][k * 101 : k * 101 + 40].decode().strip()[:30]) for k in range(0, 40, 8))
    assert places[-1] > 0
    every = G.dictionaries(df, sample=10**6, size=100)["en"]
    assert sum(every.count(w.encode()) for w in words[:50]) >= 50 * 30 and b"short one" in every and b"no id" in every


def test_ties_are_settled_by_name(spark):
    contents = {"b": b"the same thing " * 20, "a": b"the same thing " * 20}
    df = docs(spark, [(1, "the same thing"), (1, "the same thing"), (2, "zq")])
    got = df.select(G.identify(spark, contents, F.col("text")).alias("r")).select("r.*").collect()
    assert all((r.lang_pred, r.score, r.rejected) == ("a", 0.5, True) for r in got)


def test_language_edge_cases(spark):
    contents = {"en": b"the thing and that with " * 50, "de": b"der die das und nicht " * 50}
    df = docs(spark, [(1, None), (2, ""), (3, "123 !!"), (4, "the thing and that with the thing and that with"), (5, "DER DIE DAS und nicht " * 9000), (6, "q")])
    got = {r.doc_id: r.r for r in df.select("doc_id", G.identify(spark, contents, F.col("text")).alias("r")).collect()}
    assert [got[i].lang_pred for i in (1, 2, 3)] == ["und"] * 3 and got[1].score == 0 and got[1].rejected
    assert (got[4].lang_pred, got[5].lang_pred) == ("en", "de") and got[6].rejected
    none = df.select(G.identify(spark, {}, F.col("text")).alias("r")).select("r.*").distinct().collect()
    assert [tuple(r) for r in none] == [("und", 0.0, True)]
    assert G.dictionaries(docs(spark, [])) == {}


def test_held_out_quality(spark):
    got = Q.op9_quality(spark, SF).join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").collect()
    held = [r for r in got if r.held_out]
    good, bad = [r.score for r in held if r.quality == 1], [r.score for r in held if r.quality == 0]
    assert np.mean([g > b for g in good for b in bad]) >= 0.95
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got)
    assert np.mean([g >= 0.3 for g in good]) >= 0.97


def test_quality_edge_cases(spark):
    assert Q.passages("").shape == (1, Q.FEATURES) and Q.passages("  \n ").shape == (1, Q.FEATURES)
    assert Q.passages(prose(1000, 1)).shape[0] == 16
    assert np.isfinite(Q.passages("éß!! \U0001f600")).all()
    nobody = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    df = docs(spark, [(1, None), (2, prose(50, 2)), (None, "x")], extra=True)
    assert Q.fit(df, nobody).score([Q.passages("x")]).tolist() == [0.5]
    one = spark.createDataFrame([(1, 1, 0), (2, 1, 0), (3, None, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    assert Q.fit(df, one).prior in (1.0, 0.5)
    out = Q.keep_good(df, one)
    assert out.columns == df.columns and out.count() == 3
    assert Q.keep_good(spark.createDataFrame([], SCHEMA), nobody).count() == 0


def test_scores_match_a_plain_computation(spark):
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(60)], "doc_id long, quality int, toxic int")
    rows = [(i, prose(40 + 7 * i, i) if i % 2 else prose(30 + 9 * i, i).replace("a", "#!")) for i in range(60)] + [(60, None), (61, ""), (5, "again ## x"), (None, "no id")]
    df = docs(spark, rows, extra=True)
    model = Q.fit(df, labels)
    sigmoid = lambda x: 1 / (1 + np.exp(-x))

    def plain(text):
        w, weighted, total = model.w, np.zeros(Q.HIDDEN), 0.0
        for x in Q.passages(text or ""):
            h = np.tanh([sum((x[i] - w["mean"][i]) / w["scale"][i] * w["W"][i, j] for i in range(Q.FEATURES)) + w["b"][j] for j in range(Q.HIDDEN)])
            e = np.exp(sum(w["a"][g] * np.tanh(h @ w["V"][:, g]) * sigmoid(h @ w["U"][:, g]) for g in range(Q.GATE)))
            weighted, total = weighted + e * h, total + e
        return sigmoid(weighted / total @ w["c"] + w["d"])

    got = df.select("text", Q.quality_score(spark, model, F.col("text")).alias("score")).collect()
    assert len(got) == len(rows) and all(abs(r.score - plain(r.text)) < 1e-9 for r in got)
    assert Q.keep_good(df, labels).columns == df.columns


def test_attention_finds_the_bad_passage():
    rng = np.random.default_rng(0)
    bags, labels = [], []
    for i in range(300):
        bag = rng.normal(0, 1, (rng.integers(1, 6), Q.FEATURES))
        if i % 2:
            bag[rng.integers(len(bag)), 3] += 8
        bags.append(bag)
        labels.append(1 - i % 2)
    model = Q.train(bags[:200], np.array(labels[:200], float))
    assert np.mean((model.score(bags[200:]) >= 0.5) == np.array(labels[200:])) >= 0.9
