import hashlib
import random

import numpy as np
import pytest

from corpusforge.llm import suffix_dedup as S
from tests.llm.data import docs, edited, prose


def brute(rows, length=S.LENGTH):
    order = lambda i: (i is None, i or 0)
    first = {}
    for i, t in rows:
        b = (t or "").encode()
        for p in range(len(b) - length + 1):
            w = b[p : p + length]
            if w not in first or order(i) < order(first[w]):
                first[w] = i
    out = []
    for i, t in rows:
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        for p in range(len(b) - length + 1):
            if order(first[b[p : p + length]]) < order(i):
                gone[p : p + length] = True
        kept = np.frombuffer(b, np.uint8)[~gone].tobytes()
        out.append((i, len(b), int(gone.sum()), len(S.spans_of(gone)[0]), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("small", [False, True])
def test_matches_brute_force(spark, monkeypatch, small):
    if small:
        monkeypatch.setattr(S, "BLOCK_BYTES", 4000)
        monkeypatch.setattr(S, "ANCHORS_PER_BUCKET", 64)
        monkeypatch.setattr(S, "CHUNK_BYTES", 2000)
    base, passage, rng = prose(120, 1), prose(14, 2), random.Random(4)
    texts = [edited(base, 30, i) for i in range(12)] + [prose(rng.randrange(30), 50 + i) + passage + prose(20, 80 + i) for i in range(15)] + [base, base]
    texts += [None, "", "x" * 49, "x" * 50, "x" * 51, "x" * 300, "ab" * 200, "é" * 60, "é" * 40 + passage, "\x00" * 80, "\x00" * 70 + passage]
    rows = [(rng.randrange(1000), t) for t in texts] + [(None, base), (None, passage), (1001, passage[:49]), (1001, passage)]
    got = [tuple(r) for r in S.repeated_bytes(docs(spark, rows).repartition(3)).collect()]
    assert sorted(got, key=str) == brute(rows)


def test_spans_and_empty(spark):
    passage = prose(30, 5)
    df = docs(spark, [(1, "aa " + passage), (2, "bbbb " + passage + " c")], extra=True)
    (span,) = S.repeated_spans(df).collect()
    assert (span.doc_id, span.start, span.end) == (2, 4, 5 + len(passage))
    assert S.repeated_bytes(docs(spark, [])).count() == 0


def test_intervals_of_a_stack_scan(monkeypatch):
    monkeypatch.setattr(S, "LENGTH", 6)
    monkeypatch.setattr(S, "PLACES", 6)
    text = b"banana"
    rows = np.array([list(text[i:].ljust(6, b"\0")) for i in range(6)], np.uint8)
    order, common = S.suffix_array(rows)
    assert order.tolist() == [5, 3, 1, 0, 4, 2] and common.tolist()[1:3] == [1, 3]
    length = np.array([6, 5, 4, 3, 2, 1])
    common = np.array([0] + [min(c, length[a], length[b]) for c, a, b in zip(common[1:], order, order[1:])])
    before = np.array([0, *text[:-1]])
    found = {text[order[lo] : order[lo] + n].decode(): (parent, sorted(order[lo:hi].tolist()), diverse, least) for n, parent, lo, hi, diverse, least in S.common_prefix_intervals(order, common, before, np.arange(6))}
    assert found == {"ana": (1, [1, 3], True, 1), "a": (0, [1, 3, 5], True, 1), "na": (0, [2, 4], False, 2)}


def hot_rows(n):
    """A short line between other texts in each document, of which each third is also copied."""
    line = "all rights reserved by the"
    texts = [prose(6, 2 * i) + "\n" + line + "\n" + prose(6, 2 * i + 1) for i in range(n)]
    return [(7 * i % 1009, t) for i, t in enumerate(texts)] + [(2000 + i, t[5:] + "x") for i, t in enumerate(texts[::3])] + [(None, texts[0])]


@pytest.mark.parametrize("hot", [0, 3, 40])
def test_hot_grams_match_brute_force(spark, monkeypatch, hot):
    monkeypatch.setattr(S, "BLOCK_BYTES", 4000)
    monkeypatch.setattr(S, "HOT", hot)
    rows = hot_rows(120) + [(3000 + i, t) for i, t in enumerate(["\x00" * 90, "x" * 49, "x" * 50, "x" * 300, "ab" * 100, "é" * 60] * 2)]
    got = [tuple(r) for r in S.repeated_bytes(docs(spark, rows).repartition(3)).collect()]
    assert sorted(got, key=str) == brute(rows)


def test_a_hot_gram_is_split():
    import pandas as pd

    frame = pd.DataFrame([(i or S.NO_ID, 0, t.encode()) for i, t in hot_rows(300)], columns=["id", "mark", "data"])
    asked = S.ask(1)((0,), frame)
    answers = S.answer(50)((0,), asked)
    sent = S.send(1)((0,), frame, answers)
    fragments = sent[sent["bucket"] < 1]
    _, anchors = np.unique(np.concatenate([S.keys_of(0, k) for k in fragments["keys"]]), return_counts=True)
    assert anchors.max() <= 50
    windows = [len(S.zstandard.decompress(t)) // S.LENGTH for t in sent[sent["bucket"] >= 1]["texts"]]
    assert len(windows) == S.SPREAD and max(windows) < 3 * np.mean(windows)


def test_very_long_texts(spark):
    passage, long = prose(40, 7), prose(60_000, 8)
    rows = [(1, long), (2, passage + long[200_000:260_000]), (3, prose(30_000, 9) + passage), (3, "x" * 400_000)]
    got = {(r.doc_id, r.n_bytes): (r.n_removed, r.n_spans) for r in S.repeated_bytes(docs(spark, rows).repartition(2)).collect()}
    assert got[2, len(rows[1][1])] == (60_000, 1) and got[3, 400_000] == (0, 0) and got[1, len(long)] == (0, 0)
    assert got[3, len(rows[2][1])] == (len(passage), 1)
