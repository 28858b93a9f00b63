import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusforge.llm import line_dedup as L
from tests.llm.data import docs


def brute(rows, run):
    lines = {i: [" ".join(x.split(" ")) for raw in (t or "").split("\n") if (x := " ".join(raw.split()))] for i, t in rows}
    seen, gone = {}, {}
    for i in sorted(lines, key=lambda x: (x is None, x)):
        for s in range(len(lines[i]) - run + 1):
            key = tuple(lines[i][s : s + run])
            if key in seen:
                gone.setdefault(i, set()).update(range(s, s + run))
            seen.setdefault(key, (i, s))
    return {i: (len(lines[i]), sorted(gone.get(i, ()))) for i in lines}


@pytest.mark.parametrize("run", [1, 2, 3])
def test_matches_brute_force(spark, run):
    rng = random.Random(run)
    rows = [(i, "\n".join(rng.choice(["alpha beta", "gamma", " delta  x", "", "omega", f"own {i}"]) for _ in range(rng.randrange(14)))) for i in range(80)]
    rows += [(900, None), (901, ""), (902, "one"), (None, "alpha beta\ngamma\nomega"), (903, "same\n" * 30)]
    got = {r.doc_id: (r.n_lines, r.removed) for r in L.repeated_lines(docs(spark, rows).repartition(3), run=run).collect()}
    assert got == brute(rows, run)


def test_text_without_repeats(spark):
    df = docs(spark, [(1, "a\nb\n\nc"), (2, "x\na\n b \nc"), (3, "a")], extra=True)
    out = L.dedup_lines(df)
    assert out.columns == df.columns
    assert {r.doc_id: r.text for r in out.collect()} == {1: "a\nb\n\nc", 2: "x", 3: "a"}
    assert L.dedup_lines(docs(spark, [])).count() == 0


def test_repeated_rows_and_ids(spark):
    df = docs(spark, [(1, "a\nb\nx"), (1, "a\nb\nx"), (2, "a\nb"), (3, "q\nr"), (3, "r\nq\nr")])
    got = sorted((r.doc_id, r.n_lines, r.removed) for r in L.repeated_lines(df).collect())
    assert got[:3] == [(1, 3, []), (1, 3, []), (2, 2, [0, 1])]
    assert sorted(len(r[2]) for r in got[3:]) == [0, 2]
    assert sorted(r.text for r in L.dedup_lines(df).collect())[0] == ""


def test_runs_name_their_source(spark):
    lines = [f"line {i}" for i in range(40)]
    df = docs(spark, [(1, "\n".join(lines)), (2, "\n".join(["own", *lines[5:25], "other", *lines[30:33]])), (3, "\n".join(lines[7:12]))])
    got = sorted((r.doc_id, r.start, r.length, r.source_id, r.source_start) for r in L.repeated_runs(df, run=3).collect())
    assert got == [(2, 1, 20, 1, 5), (2, 22, 3, 1, 30), (3, 0, 5, 1, 7)]


def test_very_long_texts(spark):
    own = "\n".join(f"line {i}" for i in range(200_000))
    df = docs(spark, [(1, "same\n" * 200_000), (2, own), (3, "first\n" + own)])
    got = {r.doc_id: r for r in L.repeated_lines(df).select("doc_id", "n_lines", "n_runs", F.size("removed").alias("n")).collect()}
    assert [(got[i].n_lines, got[i].n, got[i].n_runs) for i in (1, 2, 3)] == [(200_000, 199_999, 1), (200_000, 0, 0), (200_001, 200_000, 1)]


@pytest.mark.parametrize("run", [1, 2, 5])
def test_every_window_selects_a_print(run):
    rng = np.random.default_rng(run)
    hashes = rng.integers(0, 4, 200)
    at, first, last = L.winnow(hashes, run)
    chosen = {s: a for a, x, y in zip(at, first, last) for s in range(x, y + 1)}
    assert sorted(chosen) == list(range(200 - run + 1))
    assert all(chosen[s] == max(i for i in range(s, s + run) if hashes[i] == hashes[s : s + run].min()) for s in chosen)


def test_large_ids_beside_a_null_id(spark):
    big, text = 1 << 60, "first line of this\nsecond line of this\nthird line"
    df = docs(spark, [(big + 3, text), (None, text), (big + 1, text), (big + 5, "another")]).coalesce(1)
    got = sorted((str(r.doc_id), list(r.removed)) for r in L.repeated_lines(df).collect())
    assert got == sorted([(str(big + 1), []), (str(big + 3), [0, 1, 2]), (str(big + 5), []), ("None", [0, 1, 2])])
