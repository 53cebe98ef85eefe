"""R1 against a plain-Python rendering; C1-C9 on literal documents; round trip."""

import re
from collections import defaultdict

from conftest import SF_SMALL
from pyspark.sql import Window
from pyspark.sql import functions as F

from cartograph.operators import carry as CARRY
from cartograph.operators import conform as C
from cartograph.operators import sitemap as SM
from cartograph.sources import pages as P


GOLDEN_PAGES = [
    ("http://www.shop.example", "http://www.shop.example/", "Start", 0),
    ("http://www.shop.example", "http://www.shop.example/news/long-item-name", "Long  item", 1),
    ("http://www.shop.example", "http://www.shop.example/news/b", "Two\n lines", 2),
    ("http://www.shop.example", "http://www.shop.example/news/a", "One", 3),
    ("http://www.shop.example", "http://www.shop.example/about-us_x/team", "Team", 4),
    ("http://localhost", "http://localhost/Zed", "Z", 5),
    ("http://localhost", "http://localhost/abc", "A", 6),
]
GOLDEN = {
    "http://www.shop.example": """# Example

> Site map of Example (http://www.shop.example), auto-generated for LLM context.

## Home

- [Start](http://www.shop.example/)

## About Us X

- [Team](http://www.shop.example/about-us_x/team)

## News

- [Two lines](http://www.shop.example/news/b)
- [One](http://www.shop.example/news/a)
- [Long item](http://www.shop.example/news/long-item-name)

""".replace("# Example", "# Shop").replace("map of Example", "map of Shop"),
    "http://localhost": """# localhost

> Site map of localhost (http://localhost), auto-generated for LLM context.

## Zed

- [Z](http://localhost/Zed)

## Abc

- [A](http://localhost/abc)

""",
}


def test_documents_and_lines_are_the_golden_text(spark):
    ranked = spark.createDataFrame(GOLDEN_PAGES, "site string, url string, title string, rank long")
    docs = {r.site: r.doc for r in SM.render_documents(ranked).collect()}
    assert docs == GOLDEN
    lines = defaultdict(list)
    for r in SM.map_lines(ranked).orderBy("site", "section_ord", "link_ord").collect():
        lines[r.site].append(r.line)
    assert {k: "\n".join(v) + "\n" for k, v in lines.items()} == GOLDEN


def test_documents_hold_every_kept_page_in_order(spark):
    ix = P.page_index(P.read_table(spark, SF_SMALL, "pages"))
    ranked = SM.corpus_ranked(ix)
    docs = {r.site: r.doc for r in SM.render_documents(ranked).collect()}
    urls = defaultdict(set)
    for r in ranked.collect():
        urls[r.site].add(r.url)
    assert set(docs) == set(urls)
    for site, doc in docs.items():
        sections = doc.split("\n## ")[1:]
        assert {u for u in urls[site] if f"]({u})\n" in doc} == urls[site]
        assert doc.count("\n- [") == len(urls[site])
        for text in sections:
            lengths = [len(line.rsplit("](", 1)[1]) for line in text.split("\n") if line.startswith("- [")]
            assert lengths == sorted(lengths) and lengths


def test_round_trip_and_self_preservation(spark):
    ix = P.page_index(P.read_table(spark, SF_SMALL, "pages"))
    ranked = SM.corpus_ranked(ix)
    docs = SM.render_documents(ranked)
    lines = C.line_table(docs, ["site"])
    got = sorted((r.site, r.url, r.title) for r in lines.filter("kind = 'link'").collect())
    want = sorted((r.site, r.url, re.sub(r"\s+", " ", r.title)) for r in ranked.collect())
    assert got == want
    pres = C.url_preservation(lines, lines, ["site"]).collect()
    assert all(r.n_lost == 0 and r.n_invented == 0 for r in pres)


GOOD = """# Site

> A short summary.

Some context.

## Programs

- [One](https://s.edu/one): First program page
- [Two](https://s.edu/two): Second program page

## Optional

- [Three](https://s.edu/three): Extra material
"""

BAD = """```markdown
# Site
# Again

### Deep

## Programs

- [One](https://s.edu/one)
- [Two](https://s.edu/two): """ + " ".join(["w"] * 15) + """
- plain bullet

## Optional

- [One](https://s.edu/one): dup

## Later

```"""


def test_conformance_rules(spark):
    docs = spark.createDataFrame([("good", GOOD), ("bad", BAD)], "site string, doc string")
    lines = C.line_table(docs, ["site"])
    res = {r.site: r for r in C.conformance(lines, ["site"]).collect()}
    g, b = res["good"], res["bad"]
    assert g.ok and g.n_h1 == 1 and g.h1_first and g.n_quote_blocks == 1 and g.n_h2 == 2
    assert g.has_optional and g.optional_last and g.n_long_desc == 0 and g.n_links == 3
    assert not b.ok
    assert (b.n_h1, b.h1_first, b.n_deep, b.n_intro_headings, b.n_fence) == (2, False, 1, 3, 2)
    assert (b.n_links_no_desc, b.n_long_desc, b.n_bullets) == (1, 1, 1)
    assert b.has_optional and not b.optional_last
    dups = C.exact_duplicates(lines, ["site"]).collect()
    assert [(r.site, r.url, r.n_entries) for r in dups] == [("bad", "https://s.edu/one", 2)]


def test_rules_of_a_document_that_spans_bins(spark):
    import random
    rnd = random.Random(7)
    kinds = ["# T", "## S", "### D", "> q", "", "- [A](http://a.com/a): d", "text", "```"]
    rows = [(s, n, rnd.choice(kinds if s else kinds[4:5] * 30 + kinds)) for s in range(3) for n in range(1, 3 * CARRY.BIN, 5)]
    df = spark.createDataFrame(rows, "site int, line_no int, line string")
    table = C.lines_of_rows(df, ["site"])
    got = {r.site: r for r in C.conformance(table, ["site"]).collect()}
    narrow = {r.site: r for r in C.conformance(table, ["site"], width=6).collect()}     # one or two lines a bin
    assert narrow == got
    sections = {(r.site, r.line_no): r.section for r in table.collect()}
    assert len(sections) == len(rows)
    for s in range(3):
        section, prev, above, n_start, n_below, n_intro = None, "", "", 0, 0, 0
        for _, n, line in [r for r in rows if r[0] == s]:
            n_start += line == "> q" and prev != "> q"
            n_below += line == "> q" and above == "# T"
            n_intro += line in ("# T", "### D") and n > 1 and section is None
            section = "S" if line == "## S" else section
            prev, above = line, line or above
            assert sections[s, n] == section
        want = (n_start, n_below, n_intro)
        for res in (got, narrow):
            assert (res[s].n_quote_blocks, res[s].n_quotes_below_h1, res[s].n_intro_headings) == want


def test_string_documents_give_the_lines_of_rows(spark):
    docs = ["", "## A", "## A\nx\n\n## B", "x\n## A \n## \n##\ny\n", "# T\n\n> q\n\n## S\n\n- [A](http://a.com)\n\n", "\n\n"]
    df = spark.createDataFrame([(i, d) for i, d in enumerate(docs)] + [(99, None)], "site int, doc string")
    rows = spark.createDataFrame([(i, n, x) for i, d in enumerate(docs) for n, x in enumerate(d.split("\n"), 1)],
                                 "site int, line_no int, line string")
    key = lambda r: (r.site, r.line_no)
    want = sorted(C.lines_of_rows(rows, ["site"]).collect(), key=key)
    assert sorted(C.line_table(df, ["site"]).collect(), key=key) == want and len(want) == rows.count()
    assert "Exchange" not in C.line_table(df, ["site"])._jdf.queryExecution().executedPlan().toString()


def test_carry_last_matches_a_window_and_keeps_rows_without_a_value(spark):
    rows = [(k, n, v) for k in "ab" for n, v in enumerate([None, "x", None, None, "y", None, None, None, None, "z", None])]
    df = spark.createDataFrame(rows, "k string, n int, v string")
    w = Window.partitionBy("k").orderBy("n")
    for above, frame in [(False, w.rowsBetween(Window.unboundedPreceding, 0)), (True, w.rowsBetween(Window.unboundedPreceding, -1))]:
        want = {(r.k, r.n): r.last for r in df.select("k", "n", F.last("v", True).over(frame).alias("last")).collect()}
        for width in (1, 2, 3, 100):
            got = CARRY.carry_last(df, ["k"], "n", {"last": F.col("v")}, above, width).collect()
            assert {(r.k, r.n): r["last"] for r in got} == want and len(got) == len(rows)
    assert CARRY.carry_last(df.filter("n < 0"), ["k"], "n", {"last": F.col("v")}).collect() == []


def test_no_window_spans_a_document(spark):
    df = spark.createDataFrame([("s", 1, "# T")], "site string, line_no int, line string")
    plan = C.conformance(C.lines_of_rows(df, ["site"]), ["site"])._jdf.queryExecution().optimizedPlan().toString()
    windows = [x for x in plan.split("\n") if "Window [" in x]
    # windows over lines are cut into bins; the others see one row per bin
    assert windows and all("_bin" in x for x in windows)


def test_near_duplicate_keys(spark):
    rows = [("s", "http://A.com/x/?utm_source=f#top"), ("s", "http://a.com/x"), ("s", "http://a.com/x.html"),
            ("s", "http://a.com/y?page=2"), ("s", "http://a.com/y?page=3")]
    df = spark.createDataFrame(rows, "site string, url string").selectExpr("site", "'link' AS kind", "url")
    got = C.near_duplicates(df, ["site"]).collect()
    assert [(r.url_key, r.n_urls) for r in got] == [("http://a.com/x", 3)]


def test_urls_with_brackets_are_links(spark):
    doc = "# T\n\n- [Foo](http://a.com/wiki/Foo_(bar))\n- [G](http://a.com/g_(x): A note (short)\n- [H](http://a.com/h): See: (this)\n"
    df = spark.createDataFrame([("s", doc)], "site string, doc string")
    got = [(r.title, r.url, r.description) for r in C.line_table(df, ["site"]).filter("kind = 'link'").orderBy("line_no").collect()]
    assert got == [("Foo", "http://a.com/wiki/Foo_(bar)", ""), ("G", "http://a.com/g_(x", "A note (short)"),
                   ("H", "http://a.com/h", "See: (this)")]


def test_quote_position_and_text_in_sections(spark):
    late = GOOD.replace("> A short summary.\n\n", "") + "\n> Too late\n"
    loose = GOOD.replace("- [Two]", "A loose sentence.\n- [Two]")
    docs = spark.createDataFrame([("good", GOOD), ("late", late), ("loose", loose)], "site string, doc string")
    res = {r.site: r for r in C.conformance(C.line_table(docs, ["site"]), ["site"]).collect()}
    assert res["good"].ok and (res["good"].n_quotes_below_h1, res["good"].n_section_text) == (1, 0)
    assert not res["late"].ok and (res["late"].n_quote_blocks, res["late"].n_quotes_below_h1) == (1, 0)
    assert not res["loose"].ok and res["loose"].n_section_text == 1


def test_merge_and_similar_titles(spark):
    doc = ("# T\n\n## S\n\n- [Guide to the big city](http://a.com/x)\n- [The big city guide to](http://a.com/y)\n"
           "- [Else](http://a.com/x/): A note\n- [Else](http://a.com/z)\n")
    lines = C.line_table(spark.createDataFrame([("s", doc)], "site string, doc string"), ["site"])
    kept = C.merge_duplicates(lines, ["site"]).filter("kind = 'link'").orderBy("line_no").collect()
    assert [(r.url, r.description) for r in kept] == [("http://a.com/x", "A note"), ("http://a.com/y", ""), ("http://a.com/z", "")]
    assert [(r.line_a, r.line_b, r.similarity) for r in C.similar_titles(lines, ["site"]).orderBy("line_a").collect()] == [(5, 6, 1.0), (7, 8, 1.0)]


def _entries(spark, titles, urls=None):
    rows = [("s", i + 1, "- x", "link", None, t, urls[i] if urls else f"http://a.com/{i}", "") for i, t in enumerate(titles)]
    return spark.createDataFrame(rows, "site string, line_no int, line string, kind string, section string, title string, url string, description string")


def test_equal_titles_are_one_class(spark):
    got = C.similar_title_classes(_entries(spark, ["The same title"] * 300), ["site"]).collect()
    assert len(got) == 300 and {r["class_line"] for r in got} == {1}


def test_similar_classes_equal_brute_force(spark):
    import random
    rng = random.Random(4)
    words = ["the", "of", "guide", *[f"w{i}" for i in range(14)]]
    titles = [" ".join(rng.sample(words, rng.randint(1, 9))) for _ in range(250)]
    titles += [t + " the" for t in titles[:60]] + ["", "!!"]
    sets = {i + 1: frozenset(t.split()) - {"!!"} for i, t in enumerate(titles)}
    first = {}
    for i, w in sets.items():
        first.setdefault(w, i)
    for least in (0.5, 0.8, 1.0):
        rows = C.similar_title_classes(_entries(spark, titles), ["site"], least).collect()
        assert {(r["line_no"], r["class_line"]) for r in rows if r["line_no"]} == {(i, first[w]) for i, w in sets.items() if w}
        reps = sorted((i, w) for w, i in first.items() if w)
        want = {(a, b): len(x & y) / len(x | y) for k, (a, x) in enumerate(reps) for b, y in reps[k + 1:] if len(x & y) / len(x | y) >= least}
        assert {(r["class_line"], r["similar_class"]): r["similarity"] for r in rows if r["similar_class"]} == want


def test_chains_of_duplicates_become_one_entry(spark):
    # 1 ~ 2 by title, 2 ~ 3 by URL, 3 ~ 4 by title; 5 stands alone; no words link nothing
    titles = ["one two three four", "one two three four five", "other name", "name other", "alone", "!", "?"]
    urls = ["http://a.com/1", "http://a.com/2", "http://a.com/2.html", "http://a.com/4", "http://a.com/5", "http://a.com/6", "http://a.com/7"]
    kept = C.merge_similar(_entries(spark, titles, urls), ["site"]).orderBy("line_no").collect()
    assert [r["line_no"] for r in kept] == [1, 5, 6, 7]


def test_long_chain_of_components(spark):
    edges = spark.createDataFrame([("s", i + 1, i) for i in range(1, 200)] + [("t", 5, 9)], "site string, a int, b int")
    got = {(r["site"], r["node"]): r["root"] for r in C.connected(edges, ["site"]).collect()}
    assert got == {("s", i): 1 for i in range(1, 201)} | {("t", 5): 5, ("t", 9): 5}


def test_a_line_does_not_carry_its_section(spark):
    # with the section's array beside every line, a section of n lines took memory by n squared
    import re
    docs = spark.createDataFrame([("s", "# x\n## a\n- [t](http://s/1)\n\n## b\ny")], "site string, doc string")
    lines = C.line_table(docs, ["site"])
    plan = lines._jdf.queryExecution().executedPlan().toString()
    kept = re.findall(r"Generate posexplode\([^\n]*?\), \[([^\]]*)\], false, \[_pos#", plan)
    assert len(kept) == 1 and not re.search(r"\b_(p|lines)#", kept[0])
    assert [(r["line_no"], r["section"], r["line"]) for r in lines.orderBy("line_no").collect()] == [
        (1, None, "# x"), (2, "a", "## a"), (3, "a", "- [t](http://s/1)"), (4, "a", ""), (5, "b", "## b"), (6, "b", "y")]


def test_variants_of_one_site_are_dealt_to_several_tasks(spark):
    from cartograph.sources import fixtures as FX
    docs = spark.createDataFrame([("http://s", "http://s", "# x\n\n## a\n\n- [t](http://s/1)\n")], "site string, base_url string, doc string").coalesce(1)
    made = FX.planted_variants(docs).withColumn("part", F.spark_partition_id()).collect()
    assert len({r["variant"] for r in made}) == len(made) == 11
    assert len({r["part"] for r in made}) > 1
