"""Whole-corpus parity at sf0.01: titles and links against Python's html.parser,
resolved links against urllib's urljoin."""

from html.parser import HTMLParser
from urllib.parse import urljoin

from conftest import SF_ORACLE
from cartograph.sources import pages as P


class _Extract(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.title_parts, self.in_title, self.title_done, self.nested = None, False, False, False
        self.hrefs = []

    def handle_starttag(self, tag, attrs):
        if self.in_title:
            self.nested = True
        if tag == "title" and not self.title_done and self.title_parts is None:
            self.title_parts, self.in_title = [], True
        if tag == "a":
            for k, v in attrs:
                if k == "href":
                    self.hrefs.append(v or "")
                    break

    def handle_endtag(self, tag):
        if tag == "title" and self.in_title:
            self.in_title, self.title_done = False, True

    def handle_data(self, data):
        if self.in_title:
            self.title_parts.append(data)


def python_extract(html):
    p = _Extract()
    p.feed(html)
    p.close()
    if p.title_parts is None:
        return "absent", None, p.hrefs
    if p.nested:
        return "nested", None, p.hrefs
    text = "".join(p.title_parts)
    return ("empty" if text == "" else "ok"), text.strip(), p.hrefs


def test_titles_and_links_match_html_parser(spark):
    raw = P.read_table(spark, SF_ORACLE, "pages").collect()
    ix = {r.url: r for r in P.page_index(P.read_table(spark, SF_ORACLE, "pages")).collect()}
    first = {}
    for r in sorted(raw, key=lambda r: r.page_id):
        first.setdefault(r.url, r)
    bad = []
    for url, r in first.items():
        state, title, hrefs = python_extract(r.html)
        got = ix[url]
        want_title = url if state == "absent" else title
        if (got.title_state, got.title, list(got.hrefs)) != (state, want_title, hrefs):
            bad.append((url, got.title_state, got.title, state, want_title))
    assert bad == []


def test_resolved_links_match_urljoin(spark):
    ix = P.page_index(P.read_table(spark, SF_ORACLE, "pages"))
    rows = P.page_links(ix).collect()
    assert rows
    bad = [(r.src_url, r.href, r.dst_url) for r in rows if r.dst_url != urljoin(r.src_url, r.href)]
    assert bad == []
