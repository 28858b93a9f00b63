from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from corpusforge.llm import common as C


def session(master, **conf):
    return SimpleNamespace(conf=SimpleNamespace(get=lambda k, d=None: conf.get(k.replace(".", "_"), d)), sparkContext=SimpleNamespace(master=master))


def test_scratch_is_a_shared_folder():
    assert C.scratch_dir(session("yarn", spark_checkpoint_dir="hdfs://a/b")) == "hdfs://a/b"
    assert C.scratch_dir(session("yarn", spark_sql_warehouse_dir="s3a://w/")) == "s3a://w/corpusforge-scratch"
    for own in ("file:/x/spark-warehouse", "/x/spark-warehouse", "spark-warehouse"):
        with pytest.raises(ValueError, match="spark.checkpoint.dir"):
            C.scratch_dir(session("spark://host:7077", spark_sql_warehouse_dir=own))


def test_marks_miss_no_key(spark, monkeypatch):
    monkeypatch.setattr(C, "BITMAP_ROWS", 8)  # nearly full
    rows, known = spark.range(2000), spark.range(0, 2000, 3).withColumnRenamed("id", "k")
    found = C.marked(rows, F.col("id"), known, F.col("k"), "m")
    assert found.filter("id % 3 = 0 AND NOT m").isEmpty() and found.count() == 2000
    kept = C.without(rows, "id", known.withColumnRenamed("k", "id"))
    assert sorted(r.id for r in kept.collect()) == [i for i in range(2000) if i % 3]
    assert C.marked(rows, F.col("id"), known.limit(0), F.col("k"), "m").filter("m").isEmpty()


def test_null_ids_come_back_exact(spark):
    big = (1 << 60) + 1
    df = spark.createDataFrame([(big,), (None,), (big + 2,)], "i long").coalesce(1)
    back = C.with_null(C.without_null(df, "i").mapInPandas(lambda batches: batches, "i long, none boolean"), "i")
    assert sorted(str(r.i) for r in back.collect()) == sorted([str(big), "None", str(big + 2)])
