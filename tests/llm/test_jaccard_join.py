import random

import numpy as np
import pytest

from corpusforge.llm import jaccard_join as J
from corpusforge.llm import near_dedup as N
from tests.llm.data import docs, edited, prose
from tests.llm.test_near_dedup import brute, chain


def got(df, **more):
    return sorted(tuple(r) for r in J.jaccard_groups(df, **more).select("doc_id", "n_shingles", "component_id", "kept").collect())


@pytest.mark.parametrize("percent", [90, 80])
def test_matches_brute_force(spark, percent):
    base = prose(150, 1)
    texts = [edited(base, random.Random(i).choice([20, 40, 80, 160]), i) for i in range(90)] + chain(7, 12, 90) + [prose(40, 300 + i) for i in range(30)] + [base, base.upper(), base]
    texts += [None, "", " \n", "a", "A", "a b", "b a", "x y z", prose(6000, 9), edited(prose(6000, 9), 200, 1)]
    # short sets, of which neighbours differ in few n-grams, so that levels and spare fragments matter
    texts += [prose(60, 77)[: 40 + 9 * i] for i in range(40)] + [edited(prose(n, 78), 60, n) for n in range(3, 60)]
    rows = list(enumerate(texts))
    assert got(docs(spark, rows).repartition(3), percent=percent) == brute(rows, 3, percent)


def test_nulls_repeats_and_clashing_columns(spark):
    a, b = prose(200, 1), prose(200, 2)
    near, big = edited(b, 190, 3), 1 << 60
    df = docs(spark, [(5, a), (5, b), (3, near), (None, a), (big + 1, a + " x"), (big + 3, a + " x y"), (7, None), (7, None)], extra=True).coalesce(1)
    rows = [(r.doc_id, r.component_id) for r in J.jaccard_groups(df).collect()]
    assert sorted(rows, key=str) == sorted([(5, 5), (5, 3), (3, 3), (None, None), (big + 1, 5), (big + 3, 5), (7, 7), (7, 7)], key=str)
    assert J.jaccard_groups(docs(spark, [])).count() == 0


@pytest.mark.parametrize("percent", [80, 90, 95])
def test_pairs_at_the_threshold_share_a_print(percent):
    rng = np.random.default_rng(percent)
    with np.errstate(over="ignore"):
        for n in [1, 2, 5, 9, 10, 11, 19, 20, 25, 40, 77, 130, 500, 2000] * 12:
            x = np.unique(rng.integers(0, 2**63, n, dtype=np.uint64) * np.uint64(2))
            larger = int(rng.integers(0, n * (100 - percent) // percent + 1))
            # as far apart as the threshold lets them: of the n, ``gone`` are replaced
            total = 2 * len(x) + larger
            gone = (J.differing(total, percent) - larger) // 2
            y = np.unique(np.concatenate([x[rng.permutation(len(x))[max(0, gone) :]], rng.integers(0, 2**63, larger + max(0, gone), dtype=np.uint64)]))
            common = len(np.intersect1d(x, y))
            if 100 * common >= percent * (len(x) + len(y) - common) and len(np.setxor1d(x, y)):
                assert set(J.prints(x, percent)) & set(J.prints(y, percent)), (n, larger)


def test_levels():
    for percent in (80, 90):
        for y in range(1, 600):
            for x in range(-(-percent * y // 100), y + 1):
                assert J.level_of(y, percent) - J.level_of(x, percent) in (0, 1)
        for level in range(60):
            fragments, spare = J.cuts(level, percent)
            assert fragments - spare == J.differing(2 * (J.lowest(level + 1, percent) - 1), percent) and spare >= 1
    assert J.bounds(np.array([0, 1, 2**63, 2**64 - 1], np.uint64), 2).tolist() == [0, 2, 4]


def test_sets_with_empty_segments_leave_prints_of_them():
    level = J.level_of(12, 90)
    fragments, spare = J.cuts(level, 90)
    low = np.arange(12, dtype=np.uint64)  # all in the first fragment
    with np.errstate(over="ignore"):
        first, second = J.prints(low, 90), J.prints(np.concatenate([low[:11], [np.uint64(99)]]), 90)
    assert fragments - 1 >= spare and set(first) & set(second)
