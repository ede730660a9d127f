"""Values of the page queries on a test table, against a reading of each page's tags and texts as they stream by."""

import re
from collections import Counter, defaultdict
from html.parser import HTMLParser
from urllib.parse import urljoin, urlsplit

import pytest

from pagewright.plans import page_queries
from pagewright.sources.tables import table


class Stream(HTMLParser):
    """Start tags, runs of text and comments in the order they come, without a tree."""

    def __init__(self, html):
        super().__init__(convert_charrefs=True)
        self.tags, self.texts, self.comments, self.fresh = [], [], [], True
        self.feed(html or "")
        self.close()

    def handle_starttag(self, tag, attrs):
        self.tags.append((tag, {k: v or "" for k, v in attrs}))
        self.texts.append("")

    def handle_endtag(self, tag):
        self.texts.append("")

    def handle_comment(self, data):
        self.comments.append(data)
        self.texts.append("")

    def handle_data(self, data):
        self.texts = self.texts or [""]
        self.texts[-1] += data


@pytest.fixture(scope="module")
def pages(spark, sf):
    return {r.page_id: (r.url, Stream(r.html)) for r in table(spark, sf, "pages").collect()}


def by_page(df, *order):
    out = defaultdict(list)
    for r in df.collect():
        out[r.page_id].append(r)
    return {k: sorted(v, key=lambda r: [r[c] for c in order]) for k, v in out.items()}


def test_nodes(spark, sf, pages):
    import json

    for page, rows in by_page(page_queries.html_nodes(spark, sf), "node_id").items():
        s = pages[page][1]
        assert [(r.tag, json.loads(r.attrs)) for r in rows if r.kind == "element"] == s.tags
        assert "".join(r.text for r in rows if r.kind == "text") == "".join(s.texts)
        assert [r.text for r in rows if r.kind == "comment"] == s.comments
        assert [r.node_id for r in rows] == list(range(len(rows)))


def test_links(spark, sf, pages):
    found, same = by_page(page_queries.absolute_links(spark, sf), "node_id"), by_page(page_queries.same_site_link(spark, sf), "node_id")
    host = lambda u: re.sub(r"\.[^.]*$", "", re.sub(r"^www\.", "", urlsplit(u).hostname or ""))
    for page, (url, s) in pages.items():
        refs = [(t, a["href"] if t == "a" else a["src"]) for t, a in s.tags if (t == "a" and "href" in a) or (t == "img" and "src" in a)]
        assert [(r.tag, r.link) for r in found.get(page, [])] == [(t, urljoin(url, x)) for t, x in refs]
        want = [urljoin(url, x) for t, x in refs if t == "a"]
        assert [(r.link, r.same_site) for r in same.get(page, [])] == [(x, bool(x) and not url.endswith(x) and host(x) == host(url)) for x in want]


def test_visible_nodes(spark, sf, pages):
    import json

    for page, rows in by_page(page_queries.visible_nodes(spark, sf), "node_id").items():
        want = [(t, {k: v for k, v in a.items() if k in ("href", "class")}) for t, a in pages[page][1].tags if t not in ("script", "style") and a.get("class") != "ad"]
        assert [(r.tag, json.loads(r.attrs)) for r in rows if r.tag] == want


def test_subtree_counts_of_a_page(spark, sf, pages):
    """A page's outermost element holds all of its links."""
    for page, rows in by_page(page_queries.subtree_counts(spark, sf), "node_id").items():
        most = max((r.n for r in rows if r.label == "link"), default=0)
        assert most == sum(t == "a" for t, _ in pages[page][1].tags)


def test_vocabulary(spark, sf, pages):
    plain = str.maketrans("áàâäãåéèêëíìîïóòôöõúùûüçñ", "aaaaaaeeeeiiiiooooouuuucn")
    words = Counter()
    for _, s in pages.values():
        text = re.sub(r"\s+", " ", "".join(t.strip(" ") for t in s.texts))
        words.update(re.findall(r"\b(\w\w+)\b", text.lower().translate(plain)))
    want = sorted(words.items(), key=lambda x: (-x[1], x[0]))[:100]
    got = [(r.word, r.n) for r in page_queries.page_vocabulary(spark, sf).collect()]
    assert sorted(got, key=lambda x: (-x[1], x[0])) == want


def test_clean_pages(spark, sf, pages):
    kept = {"href", "class", "src", "style"}
    for r in page_queries.clean_page(spark, sf).collect():
        s, before = Stream(r.html), pages[r.page_id][1]
        assert not s.comments and not {t for t, _ in s.tags} & {"script", "style", "head", "title"}
        assert all(set(a) <= kept and a.get("class") != "ad" for _, a in s.tags)
        assert not re.search(r"\s\s|\s[,.]|\|", "".join(s.texts))
        assert [a["href"] for t, a in s.tags if t == "a"] == [a["href"] for t, a in before.tags if t == "a"]
        assert all(a.get("style") == "margin:0" for t, a in s.tags if t == "p")


def test_records_and_hits(spark, sf, pages):
    """Aliases are targets of the page's links; every link with such a target is a hit, in order."""
    target = re.compile(r"^/[^/?#]+$")
    hits = by_page(page_queries.tag_hits(spark, sf), "seq")
    records = by_page(page_queries.records_from_pages(spark, sf), "block")
    for page, (_, s) in pages.items():
        links = [a["href"] for t, a in s.tags if t == "a" and target.search(a.get("href", ""))]
        assert [h.value for h in hits.get(page, []) if h.label == "alias"] == links
        own = [r.alias for r in records.get(page, [])]
        assert len(own) == len(set(own)) and set(own) <= set(links)
        assert own == [x for x in dict.fromkeys(links) if x in set(own)]
    assert sum(map(len, records.values())) > len(pages)


def test_details_take_the_whole_page(spark, sf, pages):
    """The number of a page, a fallback with a default, is one that stands in it, or the default where none does."""
    rows = {r.page_id: r for r in page_queries.detail_records(spark, sf).collect()}
    for page, r in rows.items():
        digits = re.findall(r"\d+", "".join(pages[page][1].texts))
        assert r.number is None or r.number == 0 or any(int(x) == r.number for x in digits)


def test_pager(spark, sf, pages):
    got = {r.page_id: r.text for r in page_queries.pager_candidates(spark, sf).collect()}
    assert got == {p: "2" if p % 2 == 0 else "two" for p in pages}
