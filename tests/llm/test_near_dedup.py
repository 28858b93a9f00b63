import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusforge.llm import near_dedup as N
from corpusforge.llm.components import components
from tests.llm.data import docs, edited, prose


def sets_of(rows, k):
    out = {}
    for i, t in rows:
        w = bytes(t or "", "utf-8").translate(N.LOWER).split()
        out[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())
    return out


def brute(rows, k, percent=80):
    sets = sets_of(rows, k)
    ids, root = sorted(sets), {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return sorted((i, len(sets[i]), find(i), find(i) == i) for i in ids)


def chain(seed, n, every):
    """Texts of which each is near the one before, but not the first."""
    out, text = [], prose(120, seed)
    for i in range(n):
        out.append(text)
        text = edited(text, every, seed + i)
    return out


@pytest.mark.parametrize("k", [4, 5])
def test_matches_brute_force(spark, k):
    base = prose(150, 1)
    texts = [edited(base, random.Random(i).choice([25, 40, 80]), i) for i in range(90)] + chain(7, 12, 60) + [prose(40, 300 + i) for i in range(30)] + [base, base.upper(), base]
    texts += [None, "", " \n", "a", "A", "a b", "x y z", prose(6000, 9), edited(prose(6000, 9), 200, 1)]
    rows = list(enumerate(texts))
    got = sorted(tuple(r)[:4] for r in N.near_groups(docs(spark, rows).repartition(3), shingle=k).select("doc_id", "n_shingles", "component_id", "kept").collect())
    assert got == brute(rows, k)


def test_stays_one_of_each_group(spark):
    base = prose(200, 3)
    df = docs(spark, [(9, base), (4, edited(base, 150, 1)), (6, prose(50, 8)), (None, base), (11, None)], extra=True)
    out = N.near_dedup(df)
    assert out.columns == df.columns
    assert sorted(str(r.doc_id) for r in out.collect()) == ["11", "4", "6", "None"]
    assert N.near_groups(docs(spark, [])).count() == 0 and N.near_dedup(docs(spark, [])).count() == 0


def test_repeated_ids(spark):
    a, b = prose(60, 1), prose(60, 2)
    got = sorted((r.doc_id, r.component_id) for r in N.near_groups(docs(spark, [(5, a), (5, b), (3, b), (7, a), (7, a)])).collect())
    assert got == [(3, 3), (5, 3), (5, 5), (7, 5), (7, 5)]


def test_a_near_copy_of_one_row_of_a_repeated_id(spark):
    a, b, d = prose(200, 1), prose(200, 2), prose(200, 4)
    near, again = edited(b, 150, 3), edited(d, 150, 5)
    df = docs(spark, [(5, a), (5, b), (3, near), (8, d), (8, again), (9, " " + d), (6, a + " x")])
    got = [(r.doc_id, r.component_id, r.kept) for r in N.near_groups(df).collect()]
    assert sorted(got) == [(3, 3, True), (5, 3, False), (5, 5, True), (6, 5, False), (8, 8, False), (8, 8, True), (9, 8, False)]
    kept = [(r.doc_id, r.text) for r in N.near_dedup(df).collect()]
    assert len(kept) == 3 and {(3, near), (5, a)} <= set(kept) and sum(t in (d, again) for _, t in kept) == 1


def test_a_large_group_of_near_copies_is_joined_with_few_pairs(spark, monkeypatch):
    base, seen = prose(80, 5), []
    rows = [(i, edited(base, random.Random(i).choice([12, 18, 30]), i)) for i in range(500)]
    of = N.meetings

    def counted(*args):
        found = N.materialise(of(*args))
        seen.append(found.count())
        return found

    monkeypatch.setattr(N, "meetings", counted)
    got = sorted(tuple(r) for r in N.near_groups(docs(spark, rows).repartition(5)).select("doc_id", "n_shingles", "component_id", "kept").collect())
    assert got == brute(rows, 5)
    assert len(seen) > 1 and sum(seen) < 20 * len(rows)


def test_parity_limit_lets_pairs_at_the_threshold_pass(spark):
    rng = np.random.default_rng(3)
    bits = lambda x, y: sum(int(v).bit_count() for v in (x ^ y).view(np.uint64))
    for n in (9, 90, 450, 1800, 9000):
        both = spark.createDataFrame([(2 * n,)], "n int").select(N.parity_limit(F.col("n"), 80)).first()[0]
        for _ in range(40):
            common, own = rng.integers(-(2**63), 2**63, n - n // 9), rng.integers(-(2**63), 2**63, (2, n // 9))
            assert bits(*(N.parity(np.concatenate([common, x])) for x in own)) <= both


def test_sketches():
    assert 2 * N.SAMPLES > N.sketch_limit(80) > 2 * 0.2 * N.SAMPLES
    rng = np.random.default_rng(1)
    a = np.unique(rng.integers(0, 2**63, 900, dtype=np.uint64))
    b = np.unique(np.concatenate([a[:800], rng.integers(0, 2**63, 60, dtype=np.uint64)]))
    bits = lambda x, y: sum(int(v).bit_count() for v in (x ^ y).view(np.uint64))
    assert bits(N.parity(a.view(np.int64)), N.parity(b.view(np.int64))) <= len(np.setxor1d(a, b))
    with np.errstate(over="ignore"):
        x, y = N.samples(a), N.samples(b)
        assert bits(N.odd_sketch(x), N.odd_sketch(y)) <= 2 * (x != y).sum()
        assert 0.7 < (x == y).mean() < 0.97


def test_components(spark):
    rng = random.Random(5)
    links = [(i, i + 1) for i in range(300)] + [(1000, 1000 + i) for i in range(1, 50)] + [(rng.randrange(2000, 2100), rng.randrange(2000, 2100)) for _ in range(60)]
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    root = {x: x for p in links for x in p}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    assert got == {x: find(x) for x in root}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_texts_are_taken_in_parts_of_bounded_size():
    import pyarrow as pa

    from corpusforge.llm import near_dedup as N

    texts = ["a b c d e f g", "", "long " * 300_000 + "end", *[f"w{i} " * 2000 + f"v{i}" for i in range(600)], "é ß"]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], names=["id", "text"])
    made = list(N._sets(4)(iter([batch])))
    # what a worker makes of a batch leaves it part by part, each row once and in order
    assert len(made) > 3 and [i for m in made for i in m["id"].to_pylist()] == list(range(len(texts)))
    words = N.Words()
    with np.errstate(over="ignore"):
        assert [f for m in made for f in m["found"].to_pylist()] == [N.shingles(t, words, 4).view(np.int64).tolist() for t in texts]
    assert list(N._sets(4)(iter([batch.slice(0, 0)]))) == []
