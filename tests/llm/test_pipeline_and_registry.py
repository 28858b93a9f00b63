import subprocess
import sys
from pathlib import Path

from pyspark.sql import functions as F

import corpus_pipeline as P
from corpusforge.llm import quality, registry
from tests.llm.test_near_dedup import brute
from tests.llm.data import SCHEMA, edited, prose

ROOT = Path(__file__).parents[2]


def write(spark, path, rows, labels):
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return str(path)


def test_stages_take_effect(spark, tmp_path):
    bad = lambda i: " ".join(w + "###" for w in prose(60, i).split())
    texts = [prose(60, i) for i in range(150)] + [bad(i) for i in range(60)]
    texts += ["  ".join(texts[3].split(" ")), edited(prose(400, 900), 300, 1), prose(400, 900)]
    rows = [(i, t, "en", f"s{i % 4}", len(t)) for i, t in enumerate(texts)]
    sf = write(spark, tmp_path, rows, [(i, int(not 150 <= i < 210), 0) for i in range(210)])
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    model = quality.fit(docs, spark.read.parquet(f"{sf}/labels.parquet"))
    kept = {r[0] for r in rows if model.score([quality.passages(r[1])])[0] >= quality.THRESHOLD}
    stages = []
    for _, stage in P.STAGES:
        docs = P.materialise(stage(spark, docs, sf))
        stages.append(docs)
    assert all(d.columns == [c.split()[0] for c in SCHEMA.split(", ")] for d in stages[:-1])
    ids = [sorted(r.doc_id for r in d.collect()) for d in stages]
    assert ids[0] == sorted(kept) and kept >= set(range(150)) and not kept & set(range(150, 210))
    texts_of = {i: " ".join(t.split()) for i, t, *_ in rows}
    first = {}
    for i in sorted(kept):
        first.setdefault(texts_of[i], i)
    assert ids[1] == sorted(first.values())
    assert ids[2] == [i for i, _, _, keep in brute([(i, rows[i][1]) for i in ids[1]], 5) if keep]
    assert set(ids[3]) <= set(ids[2]) and ids[4] == ids[3]
    assert sorted(map(str, P.run(spark, sf).collect())) == sorted(map(str, stages[-1].collect()))


def test_pipeline_on_an_empty_table(spark, tmp_path):
    assert P.run(spark, write(spark, tmp_path, [], [])).count() == 0


def test_every_operator_has_a_query():
    names = sorted(int(n[2:].split("_")[0]) for n in registry.QUERIES)
    assert names == list(range(1, 14)) and set(registry.ORACLE_SQL) <= set(registry.QUERIES)


def test_the_entry_module_works_without_this_subpackage():
    code = """
import sys
class No:
    def find_spec(self, name, path=None, target=None):
        if name == 'corpus_pipeline' or name == 'corpusforge.llm' or name.startswith('corpusforge.llm.'):
            raise ModuleNotFoundError(name, name=name)
sys.meta_path.insert(0, No())
import __spark_entry__ as e
assert 'pipeline' not in e.queries() and not any(n.startswith('op1_') for n in e.queries()) and e.oracle_sql()
"""
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True)


def test_pipeline_with_nulls_repeats_and_further_columns(spark, tmp_path):
    texts = [prose(60, i) for i in range(60)] + [" ".join(w + "###" for w in prose(60, i).split()) for i in range(30)]
    rows = [(i, t, "en", f"s{i % 3}", len(t)) for i, t in enumerate(texts)]
    rows += [(200, None, None, None, None), (None, prose(70, 900), "en", "s1", None), (None, prose(70, 901), None, None, None), (5, texts[5], "en", "s2", None), (5, texts[5], "en", "s2", None), (201, "", "en", "s0", 0)]
    df = spark.createDataFrame(rows, SCHEMA)
    for name in ("digest", "keep_id", "row", "kept", "size", "key", "id", "hash", "gone", "score", "component_id", "n_tokens", "ids"):
        df = df.withColumn(name, F.lit("x"))
    df.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, int(i < 60), 0) for i in range(90)] + [(None, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs, sizes = spark.read.parquet(f"{tmp_path}/documents.parquet"), []
    for _, stage in P.STAGES[:-1]:
        docs = P.materialise(stage(spark, docs, str(tmp_path)))
        assert docs.columns == df.columns
        sizes.append(docs.count())
    assert sizes[0] >= sizes[1] >= sizes[2]
    kept = [r.doc_id for r in docs.collect()]
    assert not set(kept) & set(range(60, 90)) and kept.count(5) <= 3
    out = P.run(spark, str(tmp_path))
    assert out.columns == ["doc_id", "source", "n_tokens", "ids_sha256", "decoded_sha256"] and out.count() == sizes[3]
