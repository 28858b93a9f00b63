import gzip
import hashlib
from pathlib import Path

import pytest

from corpusforge.llm import warc as W


def pages(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string")


def round_trip(spark, tmp_path, rows):
    path = str(tmp_path / "warc")
    W.write_archives(pages(spark, rows), path)
    return path, sorted((tuple(r) for r in W.resolve(W.read_archives(spark, path)).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()), key=str)


def test_round_trip(spark, tmp_path):
    big, odd = "x" * 150, "\r\n\r\nWARC/1.1\r\nContent-Length: 5\r\n\r\n" * 4 + "é\U0001f600\x00"
    rows = [(3, "http://a", big), (1, "http://b\r\nX: y", big), (2, None, big), (4, "u", None), (5, "u", ""), (6, "u", "small"), (7, "u", "small"), (8, "u", odd), (9, "u", odd), (None, "u", big), (10, "u", "w " * 200_000)]
    path, got = round_trip(spark, tmp_path, rows)
    firsts = {}
    for i, _, h in rows:
        if i is not None and len((h or "").encode()) >= 100:
            firsts[h] = min(firsts.get(h, i), i)
    want = []
    for i, _, h in rows:
        first = firsts.get(h or "")
        again = first is not None and first != i and sum(x[2] == h for x in rows) > 1
        want.append((i, len((h or "").encode()), hashlib.sha256((h or "").encode()).hexdigest(), "revisit" if again else "response", first if again else None))
    assert got == sorted(want, key=str)
    size = 0
    for f in Path(path).glob("*.gz"):
        for head, block in W.parse(gzip.decompress(f.read_bytes())):
            assert head["WARC-Type"] in ("response", "revisit") and (head["WARC-Type"] == "response" or block == W.HTTP.encode())
            size += 1
    assert size == len(rows)


def test_empty(spark, tmp_path):
    assert round_trip(spark, tmp_path, [])[1] == []


def test_repeated_rows(spark, tmp_path):
    _, got = round_trip(spark, tmp_path, [(1, "u", "y" * 120), (1, "u", "y" * 120), (2, "u", "y" * 120)])
    assert [r[3:] for r in got] == [("response", None), ("response", None), ("revisit", 1)]


def test_clashing_columns(spark, tmp_path):
    df = pages(spark, [(1, "u", "z" * 200), (2, "v", "z" * 200)]).selectExpr("*", "'x' AS digest", "'x' AS body", "'x' AS first_id", "'x' AS bytes", "'x' AS value")
    W.write_archives(df, str(tmp_path / "w"))
    got = sorted((r.page_id, r.url, r.record_type, r.refers_to) for r in W.resolve(W.read_archives(spark, str(tmp_path / "w"))).collect())
    assert got == [(1, "u", "response", None), (2, "v", "revisit", 1)]


def test_damaged_archives_are_errors():
    good = b"WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    assert [block for _, block in W.parse(good * 2)] == [b"abc"] * 2
    for bad in (good + b"junk", good[:-6], good.replace(b"abc", b"ab")):
        with pytest.raises(ValueError):
            list(W.parse(bad))


def test_large_ids_beside_nulls(spark, tmp_path):
    big, text = 1 << 60, "z" * 150
    _, got = round_trip(spark, tmp_path, [(big + 1, "u", text), (big + 3, "u", text), (None, "u", text), (big + 5, "u", "short")])
    assert [(r[0], r[1], r[3], r[4]) for r in got] == [(big + 1, 150, "response", None), (big + 3, 150, "revisit", big + 1), (big + 5, 5, "response", None), (None, 150, "revisit", big + 1)]


def test_files_are_bounded_by_bytes(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(W, "SHELVES", ((100, 4), (1000, 2), (1 << 62, 1)))
    rows = [(i, "u", chr(97 + i) * n) for i, n in enumerate([5] * 6 + [500] * 5 + [5000] * 3)] + [(20, "u", "l" * 5000)]
    path = str(tmp_path / "w")
    W.write_archives(pages(spark, rows).coalesce(1), path)
    held = sorted(sorted(len(block) - len(W.HTTP) for _, block in W.parse(gzip.decompress(f.read_bytes()))) for f in Path(path).glob("*.gz"))
    assert [x for x in held if x] == sorted([[0]] + [[5] * 2, [5] * 4] + [[500], [500] * 2, [500] * 2] + [[5000]] * 3, key=lambda x: (x[0], len(x)))
    got = sorted((r.page_id, r.payload_bytes) for r in W.resolve(W.read_archives(spark, path)).collect())
    assert got == [(i, len(h)) for i, _, h in rows]
