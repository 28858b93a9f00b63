import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from corpusforge.llm import source_audit as S

SCHEMA = "doc_id long, text string, lang string, source string"
TERM = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")
LOWER = {c: c + 32 for c in range(65, 91)}
WORDS = ["a", "Zb", "eight8x", "abcdefgh", "abcdefghi", "sixteen_letters_", "abcdefghijklmnop", "abcdefghijklmnopq", "Äpfel", "größe", "日本語の文章", "é" * 8, "é" * 9, "x" * 300, "naïve", "C3PO", "don't"]


def brute(rows, least=10, top=10):
    count, docs, groups = defaultdict(Counter), defaultdict(Counter), set()
    for text, lang, source in rows:
        lang, source = lang or "", source or ""
        groups.add((lang, source))
        terms = TERM.findall((text or "").translate(LOWER))
        count[lang, source].update(terms)
        docs[lang].update(set(terms))
    out = []
    for lang in {g[0] for g in groups}:
        kept = [t for t, n in docs[lang].items() if n >= least]
        whole = Counter()
        for g in groups:
            if g[0] == lang:
                whole.update({t: count[g][t] for t in kept})
        share = lambda c, own: 1 + 10**9 * (own[c] + 2) // (sum(own[t] for t in kept) + 2 * len(kept))
        p = {g: {t: share(t, count[g]) for t in kept} for g in groups if g[0] == lang}
        q = {t: share(t, whole) for t in kept}
        f = lambda x, y: (x - y) ** 2 // (x + y)
        for g in p:
            pairs = [(-sum(f(p[g][t], p[h][t]) for t in kept), h[1].encode(), h[1]) for h in p if h != g]
            terms = [(-f(p[g][t], q[t]), t.encode(), t) for t in kept if count[g][t] and p[g][t] > q[t]]
            out += [(*g, "pair", x, -v, r + 1) for r, (v, _, x) in enumerate(sorted(pairs))]
            out += [(*g, "term", x, -v, r + 1) for r, (v, _, x) in enumerate(sorted(terms)[:top])]
    return sorted(out)


def got(df, **more):
    return sorted(tuple(r) for r in S.audit(df, **more).collect())


def table(spark, rows):
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], SCHEMA).repartition(3)


@pytest.mark.parametrize("sizes", [(1 << 23, 4096, 32), (64, 3, 2)])
def test_matches_brute_force(spark, monkeypatch, sizes):
    monkeypatch.setattr(S, "TERMS_PER_BLOCK", sizes[1])
    monkeypatch.setattr(S, "TILE", sizes[2])
    rng = random.Random(1)
    line = lambda words, n: rng.choice([" ", ", ", "-1-", "\n"]).join(rng.choice(words) for _ in range(n))
    rows = [(line(WORDS[s % 5 :], rng.choice([0, 1, 9, 60])), rng.choice(["en", "en", "de", None]), rng.choice(["hot", "hot", f"s{s}", None, ""])) for s in range(7) for _ in range(40)]
    rows += [(None, "en", "nothing"), ("", "fr", "a"), ("1 2 3", "fr", "b"), ("rare", "de", "z"), (line(WORDS, 30_000), "en", "s1")] + [("same same", "it", "a"), ("same", "it", "b")] * 6
    assert got(table(spark, rows)) == brute(rows)
    assert got(table(spark, rows), least=1, top=3) == brute(rows, 1, 3)


def test_empty_and_clashing_columns(spark):
    assert got(table(spark, [])) == []
    rows = [("Ab cd", "en", "a")] * 10 + [("ab", "en", "b"), (None, None, None)]
    df = table(spark, rows).withColumns({c: F.lit("x") for c in ("term", "count", "docs", "n", "v", "i", "p", "none", "tile", "block", "all")})
    assert got(df) == brute(rows)


@pytest.mark.parametrize("block", [1, 100, 1 << 23])
def test_blocks_count_as_a_whole_table_does(monkeypatch, block):
    monkeypatch.setattr(S, "BLOCK_BYTES", block)
    rng = random.Random(2)
    rows = [(" ".join(rng.choice(WORDS) for _ in range(rng.randrange(20))), rng.choice("xy"), rng.choice("ab")) for _ in range(50)]
    batch = pa.record_batch({n: pa.array([r[k] for r in rows]) for n, k in (("text", 0), ("lang", 1), ("source", 2))})
    count, docs = Counter(), Counter()
    for part in S.count_terms(iter([batch.slice(3, 20), batch.slice(23), batch.slice(0, 3), batch.slice(0, 0)])):
        for r in part.to_pylist():
            count[r["lang"], r["source"], r["term"]] += r["count"]
            docs[r["lang"], r["source"], r["term"]] += r["docs"]
    want, held = Counter(), Counter()
    for text, lang, source in rows:
        terms = [(lang, source, t) for t in TERM.findall(text.translate(LOWER))]
        want.update(terms)
        held.update(set(terms))
    assert count == want and docs == held


def test_radix_order_is_stable_and_by_bytes():
    rng = np.random.default_rng(1)
    high, low = rng.integers(0, 3, 500, dtype=np.uint64) << np.uint64(60), rng.integers(0, 2**20, 500, dtype=np.uint64)
    assert S.radix_order([low, high]).tolist() == np.lexsort((low, high)).tolist()
    data = np.frombuffer("abé abc".encode(), np.uint8)
    words = S.packed(data, np.array([0, 5]), np.array([4, 3]), 0)
    assert [int(w).to_bytes(8, "big").rstrip(b"\0").decode() for w in words] == ["abé", "abc"]
