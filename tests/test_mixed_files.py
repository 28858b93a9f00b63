"""Files of different headers read as one, and URLs of official sources."""

from pyspark.sql import functions as F

from corpusforge.operators import corpus as O
from corpusforge.sources import feeds as R


def test_many_files_are_one_scan(spark, tmp_path):
    headers = ["url,label", "id,Page_URL,Class", "﻿URL,x,Type,label", "label,link_url,class", "status,other", "urls"]
    want, lacking = [], []
    for i in range(120):
        head = headers[i % len(headers)]
        columns = head.replace("﻿", "").lower().split(",")
        cells = [f"http://h{i}/" if "url" in c else f"{c}{i}" for c in columns]
        quoted = ",".join(f'"{c}"' for c in cells)
        (tmp_path / f"f {i}.csv").write_text(f"{head}\n{quoted}\n\n{head if i % 7 == 0 else ''}\n", encoding="utf-8")
        if "url" in head.lower() and any(n in columns for n in R.LABEL_NAMES):
            label = next(n for n in R.LABEL_NAMES if n in columns)
            want.append((f"http://h{i}/", f"{label}{i}", f"f {i}.csv"))
            if i % 7 == 0:  # a row that looks like the header is data
                want.append((next(c for c in head.split(",") if "url" in c.lower()).lstrip("\ufeff"), next(c for c in head.split(",") if c.lower() == label), f"f {i}.csv"))
        else:
            lacking.append(f"f {i}.csv")
    (tmp_path / "empty.csv").write_text("")
    paths = [str(tmp_path / f"f {i}.csv") for i in range(120)] + [str(tmp_path / "none.csv"), str(tmp_path / "empty.csv")]
    rows, skipped = R.mixed_csvs(spark, paths)
    name = lambda p: p.rsplit("/", 1)[1]
    assert sorted((r.url.lstrip("﻿"), r.label, name(r.file)) for r in rows.collect()) == sorted(want)
    assert sorted(map(name, skipped)) == sorted([*lacking, "none.csv", "empty.csv"])
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation [") <= 2 and "Union" not in plan  # rows and headers, however many files
    assert R.mixed_csvs(spark, [str(tmp_path / "none.csv")]) == (None, [str(tmp_path / "none.csv")])


def test_official_urls(spark):
    want = {
        " https://www.rbi.test/a?b#c ": "https://www.rbi.test/a?b#c", "HTTPS://RBI.test": "https://rbi.test/", "https://rbi.test:443/x": "https://rbi.test/x", "https://rbi.test:444/": "https://rbi.test:444/", "http://rbi.test/": None,
        "https://u@rbi.test/": None, "https://u:p@rbi.test/": None, "https://notrbi.test/": None, "https://rbi.test.evil.org/": None, "rbi.test": None, "": None,
    }
    got = spark.createDataFrame([(u,) for u in [*want, None]], "u string").select("u", O.official_url(F.col("u"), ["rbi.test"]).alias("o")).collect()
    assert {r.u: r.o for r in got} == {**want, None: None}
