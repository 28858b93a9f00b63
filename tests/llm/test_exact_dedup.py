import hashlib
import re

from corpusforge.llm import exact_dedup as E
from tests.llm.data import docs


def brute(rows):
    groups = {}
    for i, t in rows:
        groups.setdefault(hashlib.sha256(re.sub(r"[\x20\x09-\x0d]+", " ", t or "").encode()).hexdigest(), []).append(i)
    out = []
    for i, t in rows:
        h = hashlib.sha256(re.sub(r"[\x20\x09-\x0d]+", " ", t or "").encode()).hexdigest()
        ids = [x for x in groups[h] if x is not None]
        out.append((i, min(ids, default=None), len(groups[h]), i == min(ids, default=None), h))
    return sorted(out, key=str)


def test_groups_match_brute_force_with_hot_groups_nulls_and_repeats(spark):
    rows = [(i, "hot  copy") for i in range(40, 400)] + [(i, f"text {i % 90}") for i in range(400, 700)] + [(1, None), (2, ""), (3, " "), (4, "a b"), (5, "a b"), (6, "a\t\nb"), (None, "a b"), (None, "only null"), (7, "twice"), (7, "twice")]
    got = [tuple(r) for r in E.exact_groups(docs(spark, rows), support=1 / 16).collect()]
    assert sorted(got, key=str) == brute(rows)


def test_dedup_keeps_one_row_of_each_group_and_all_columns(spark):
    rows = [(3, "x  y"), (1, "x y"), (1, "x y"), (2, "z"), (9, None), (8, "")] + [(i, "hot") for i in range(100, 200)]
    df = docs(spark, rows, extra=True)
    out = E.exact_dedup(df, support=1 / 4)
    assert out.columns == df.columns
    assert sorted(r.doc_id for r in out.collect()) == [1, 2, 8, 100]


def test_empty_and_long(spark):
    assert E.exact_groups(docs(spark, [])).count() == 0
    assert E.exact_dedup(docs(spark, [])).count() == 0
    long = "word " * 200_000
    assert sorted(r.doc_id for r in E.exact_dedup(docs(spark, [(5, long), (2, long.replace(" ", "\n")), (3, long + "x")])).collect()) == [2, 3]


def test_main_path_is_native(spark):
    plan = E.exact_groups(docs(spark, ["a", "b"]))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
