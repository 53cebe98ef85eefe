"""P1-P3, P6-P10, P14, P18 on hostile literal rows against plain Python."""

import html as pyhtml
import re

from pyspark.sql import functions as F

from cartograph.functions import html as H
from cartograph.functions import text as T

PAGES = [
    ("http://a.com/1", "<html><head><title> Hello &amp; World </title></head><body><a href='/x'>x</a></body>"),
    ("http://a.com/2", "<html><head></head><body>no title <a href=/y>y</a><a href>empty</a></body>"),
    ("http://a.com/3", "<title></title><a href=\"/z\">z</a>"),
    ("http://a.com/4", "<title>A <b>bold</b> title</title>"),
    ("http://a.com/5", "<title>   </title>"),
    ("http://a.com/6", "<script>var t='</title><a href=\"/bad\">';</script><title>S</title>"
                       "<!-- <a href='/commented'>c</a> --><a class=k href = \"/ok\">ok</a>"),
    ("http://a.com/7", "<TITLE>Upper &quot;q&quot; &#233;t&#xE9; &am &amp</TITLE><A HREF='/UP'>u</A>"),
    ("http://a.com/8", "<title>cut off"),
    ("http://a.com/9", "<style>a{}</style><title> nbsp </title><a data-href='/no' href='/yes'>y</a>"),
]


def test_titles_states_and_links(spark):
    df = spark.createDataFrame(PAGES, "url string, html string").withColumn("clean", H.clean_html("html"))
    got = {r.url: (r.state, r.title, r.hrefs) for r in df.select(
        "url", H.title_state("clean").alias("state"), H.extract_title("clean", "url").alias("title"),
        H.extract_hrefs("clean").alias("hrefs")).collect()}
    assert got["http://a.com/1"] == ("ok", "Hello & World", ["/x"])
    assert got["http://a.com/2"] == ("absent", "http://a.com/2", ["/y", ""])
    assert got["http://a.com/3"][:2] == ("empty", None)
    assert got["http://a.com/4"][:2] == ("nested", None)
    assert got["http://a.com/5"][:2] == ("ok", "")
    assert got["http://a.com/6"] == ("ok", "S", ["/ok"])
    assert got["http://a.com/7"] == ("ok", 'Upper "q" été &am &', ["/UP"])
    assert got["http://a.com/8"][:2] == ("absent", "http://a.com/8")
    assert got["http://a.com/9"] == ("ok", "nbsp", ["/yes"])


def test_entity_decoding(spark):
    cases = ["a &amp; b", "&lt;x&gt;", "&#65;&#x42;", "&amp;lt;", "&unknown; &", "&quot;q&quot;", "&apos;",
             "caf&eacute; &copy; 2024 &hellip; &mdash; &rsquo;s", "&#0;"]
    df = spark.createDataFrame([(c,) for c in cases], "s string")
    got = [r[0] for r in df.select(H.decode_entities("s")).collect()]
    assert got == ["a & b", "<x>", "AB", "&lt;", "&unknown; &", '"q"', "'", "café © 2024 … — ’s", "\ufffd"]


HOSTILE = ["/p?id=3&lang=en", "&image=1&part=2&sub=3&real=4&sum=5", "&copy2024", "&notit;", "&lpar;x&rpar;", "&#146;&#150;&#x80;",
           "&#00000065;", "&#x110000;", "&#xD800;", "&#1;&#127;&#xFFFE;", "&ampamp;", "&amp", "&lt", "&ltx", "&;", "&#;", "&#x;", "&&amp;&",
           "&NotEqualTilde;", "&nbsp&nbsp;", "&frac12x", "&CounterClockwiseContourIntegral;", "&#99999999999999999999;", "&#x0000000041;",
           "&Tab;&NewLine;", "&fjlig;", "&notin", "&notin;", "&am p;", "&#13;", "a&b<c>&d"]


def test_entities_agree_with_the_standard_library(spark):
    import html.entities
    import random
    rng = random.Random(2)
    names = sorted(html.entities.html5)
    cases = HOSTILE + ["".join(rng.choice(["&" + rng.choice(names), "&", ";", "=", "x", " ", f"&#{rng.randint(0, 1200000)}", "&#x9f;"])
                               for _ in range(rng.randint(1, 6))) for _ in range(400)] + ["&" + n for n in names[::7]]
    df = spark.createDataFrame(list(enumerate(cases)), "i int, s string")
    got = {r.i: r.d for r in df.select("i", H.decode_entities("s").alias("d")).collect()}
    bad = [(c, got[i], pyhtml.unescape(c)) for i, c in enumerate(cases) if got[i] != pyhtml.unescape(c)]
    assert bad == []


def test_hrefs_agree_with_html_parser(spark):
    import random
    from html.parser import HTMLParser
    rng = random.Random(4)
    attrs = ['href="/a"', "href='/b c'", "href=/bare", "href", 'HREF = "/U&amp;v"', 'title="a > b"', "class='x'", "data-href=/no", "id=7",
             "x-href='q'", "href=''", 'alt="<b>"', "disabled", 'title="it\'s"']
    tags = ['<a title="a > b" href="/q">', "<a class='x'href='/n'>", "<a>", "<a/>", "<abbr href=/no>", "<A HREF=/up>", "<a\nhref=/nl>",
            "<a href=/one href=/two>", "<article href='/no'>"]
    for _ in range(200):
        parts = [rng.choice(attrs) for _ in range(rng.randint(0, 4))]
        tags.append(f"<a {rng.choice([' ', chr(10), chr(9)]).join(parts)}{rng.choice(['', ' ', '/', ' /'])}>")
    tags = [t for t in tags if not t.endswith("/>") or "=/" not in t.split()[-1]]      # "=/bare/>": the slash belongs to the value

    class Links(HTMLParser):
        def handle_starttag(self, tag, attrs):
            if tag == "a":
                self.out += [v or "" for k, v in attrs if k == "href"][:1]
        handle_startendtag = handle_starttag

    df = spark.createDataFrame(list(enumerate(tags)), "i int, s string")
    got = {r.i: r.d for r in df.select("i", H.extract_hrefs("s").alias("d")).collect()}
    for i, t in enumerate(tags):
        p = Links()
        p.out = []
        p.feed(t + "text</a>")
        p.close()
        assert got[i] == p.out, t


def test_anchors_on_broken_pages_stay_linear(spark):
    pages = ["<a " * 50000, "<a href=" + "x" * 200000, "<a " + "y='" * 30001, "<a " + "b=1 " * 20000 + "href=/end>"]
    df = spark.createDataFrame(list(enumerate(pages)), "i int, s string")
    got = {r.i: r.d for r in df.select("i", H.extract_hrefs("s").alias("d")).collect()}
    assert got[0] == [] and got[3] == ["/end"]


def test_whitespace_title_case_capitalize(spark):
    samples = ["  a \t b\n c  ", "　x y\x1c", "plain"]
    df = spark.createDataFrame([(s,) for s in samples], "s string")
    rows = df.select(T.py_strip("s").alias("st"), T.collapse_ws("s").alias("cw")).collect()
    assert [r.st for r in rows] == [s.strip() for s in samples]
    assert [r.cw for r in rows] == [re.sub(r"\s+", " ", s) for s in samples]


def test_code_fence_excerpt_signed(spark):
    docs = ["```markdown\n# A\n\nbody\n```", "```\n# A\n", "  # plain  ", "```", "```md\nx\n```  \n"]
    df = spark.createDataFrame([(d,) for d in docs], "d string")

    want = ["# A\n\nbody", "# A", "# plain", "", "x"]
    assert [r[0] for r in df.select(T.strip_code_fence("d")).collect()] == want
    long = "x" * 700
    row = spark.createDataFrame([(long, 1.26, -0.04, 0.0)], "t string, a double, b double, c double").select(
        T.excerpt("t").alias("e"), T.signed("a").alias("sa"), T.signed("b").alias("sb"), T.signed("c").alias("sc")).first()
    assert row.e == long[:500] + "..."
    assert (row.sa, row.sb, row.sc) == ("+1.3", "-0.0", "0.0")
    assert F is not None


def test_status_filter_and_lowest_page_id(spark):
    from cartograph.sources import pages as P
    rows = [(1, "http://a.com/x", "<title>late</title>", 200), (0, "http://a.com/x", "<title>first</title>", 200),
            (2, "http://a.com/y", "<title>gone</title>", 404), (3, "http://a.com/z", "<title>z</title>", 200)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, status int")
    got = {r.url: (r.page_id, r.title) for r in P.page_index(df).collect()}
    assert got == {"http://a.com/x": (0, "first"), "http://a.com/z": (3, "z")}


def test_duckdb_entity_twin_matches_spark(spark):
    import duckdb

    from cartograph.plans import duck as D
    cases = ["a &amp; b", "&lt;x&gt;", "&#65;&#x42;", "&amp;lt;", "&unknown; &", "&apos;&nbsp;",
             "caf&eacute; &copy; 2024 &hellip; &mdash; &rsquo;s", "&amp", "&ampx", "&#0;", "plain"]
    df = spark.createDataFrame([(c,) for c in cases], "s string")
    want = [r[0] for r in df.select(H.decode_entities("s")).collect()]
    con = duckdb.connect()
    con.execute("create table t(i int, s varchar)")
    con.executemany("insert into t values (?, ?)", list(enumerate(cases)))
    got = [r[0] for r in con.execute(f"select {D.decode_entities('s')} from t order by i").fetchall()]
    assert got == want
