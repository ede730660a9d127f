"""Trees, cleaning, tagging, blocks and pagers, in Python and as tables."""

import pytest
from pyspark.sql import functions as F

from pagewright.functions import tagging as column_tagging
from pagewright.operators import dom, pages, pagination
from pagewright.operators.blocks import Finder
from pagewright.operators.clean import Settings, clean
from pagewright.operators.tagging import tag
from pagewright.rules import Rule


def cleaned(html, **settings):
    return clean(dom.parse(f"<body>{html}</body>"), Settings(**settings)).html().removeprefix("<body>").removesuffix("</body>")


def test_parser_closes_what_is_open():
    assert dom.parse("<ul><li>a<li>b</ul><br><p>x<p>y</b></p>z").html() == "<ul><li>a</li><li>b</li></ul><br><p>x</p><p>y</p>z"


@pytest.mark.parametrize(
    ("html", "settings", "want"),
    [
        ("a<!-- <p>gone</p> -->b", {}, "ab"),
        ("<script>x</script>a<svg><g>y</g></svg>", {"excluded_tags": ("script", "svg")}, "\na\n".replace("\n", " ")),
        ('<p style="display: none">x</p><p hidden>y</p><p>z</p>', {"invisible_tag_regex": ("display:\\s*none",)}, "<p>z</p>"),
        ('<p class="a" id="b">x</p>', {"whitelisted_attributes": ("class",)}, '<p class="a">x</p>'),
        ("one <b>two</b> <i>three <b>four</b></i> five", {"flattened_tags": ("b", "i")}, "one two three four five"),
        ("<b>a<u>keep</u></b> c", {"flattened_tags": ("b",)}, "<b>a<u>keep</u></b> c"),
        ("<p><span>A</span><span>of</span><span>B</span></p>", {"flattened_special_strings": ("of",)}, "<p>A of B</p>"),
        ("<div><p> </p><p><img></p><span></span></div>", {"empty_tags": ("img",)}, "<div><p><img></p></div>"),
        ("a \n\t b", {}, "a b"),
        ("HERE ? ! .", {"punctuation_marks": ("!", "?")}, "HERE?! ."),
        ("a | b", {"redundant_punctuation_marks": ("|",)}, "a b"),
        ("<p style=\"background: url('u1')\">x</p><p style='background-image: url(\"u2\")'>y</p><p style=\"background: url(u3)\">z</p>", {"whitelisted_attributes": ("src",), "empty_tags": ("img",)}, '<p>x<img src="u1"></p><p>y<img src="u2"></p><p>z</p>'),
        ("a<!-- x -->b", {"ignored_cleaning_steps": ("remove_comments",)}, "a<!-- x -->b"),
        ("<p><b> </b></p>x", {}, "x"),
    ],
)
def test_cleaning(html, settings, want):
    assert cleaned(html, **settings) == want


def test_style_sheets():
    root = dom.parse("<head><style>/* c */ .k { color: red } p.k {margin:0} * { top: 1px } div > p { left: 0 } #i, em { right: 0 }</style></head><body><div><p class='k' style='a: b'>x</p></div><em id=i>y</em></body>")
    body = clean(root, Settings())
    p, em = (next(n for n in body.elements() if n.tag == t) for t in ("p", "em"))
    assert all(x in p.attrs["style"] for x in ("color: red", "margin:0", "top: 1px", "left: 0")) and p.attrs["style"].endswith("a: b")
    assert em.attrs["style"].count("right: 0") == 1 and "left" not in em.attrs["style"]


@pytest.mark.parametrize(
    ("sheet", "inline", "want"),
    [
        (".x{display:none} .x{display:block}", "", "display:block"),
        ("p.x{display:block} .x{display:none}", "", "display:block"),
        ("#i{color:red} p.x{color:blue}", "", "color:red"),
        ("@media print{.x{display:none}} @import url(a.css); .x{top:0}", "", "top:0"),
        (".x{color:red !important; top:0}", "color:blue", "top:0; color:red !important"),
        (".x{background:url('a;b{c}')}", "color:blue", "background:url('a;b{c}'); color:blue"),
        ("@font-face{font-family:y} @supports (a:b){.x{left:0}} .x{right:0}", "", "right:0"),
    ],
)
def test_cascade(sheet, inline, want):
    if "{c}" in sheet:
        sheet, want = sheet.replace("{c}", ""), want.replace("{c}", "")
    root = clean(dom.parse(f"<head><style>{sheet}</style></head><body><p class='x' id='i'{f' style={chr(34)}{inline}{chr(34)}' if inline else ''}>t</p></body>"), Settings())
    assert next(n for n in root.elements() if n.tag == "p").attrs["style"] == want


def test_deep_pages(spark):
    """A page nested thousands deep is a page like any other."""
    html = "<div>" * 5000 + "x" + "</div>" * 5000
    assert dom.parse(html).html() == html
    df = spark.createDataFrame([(1, "http://h.com", html)], "page_id long, url string, html string")
    rows = pages.nodes(df).collect()
    assert len(rows) == 5001 and max(r.depth for r in rows) == 5000 and {r.subtree_end for r in rows} == {5000}
    assert pages.cleaned(df, Settings()).first().html == html


PAGE = '<div><a href="/replace-me"><span>REPLACE ME</span></a><a href="/REPLACE-ME"><span>replace me</span></a><a href="/stay"><span>Not this</span></a></div>'


def texts(tagged):
    return [t.text for t in tagged.root.texts()]


def test_examples_and_patterns():
    t = tag(dom.parse(PAGE), [Rule("test", tags={"example_driven", "text"}, examples=("REPLACE ME",))])
    assert texts(t) == ["$TEST$", "replace me", "Not this"] and [h.value for h in t.hits] == ["REPLACE ME"]
    t = tag(dom.parse(PAGE), [Rule("test", tags={"example_driven", "text", "ignore_case"}, examples=("REPLACE ME",))])
    assert texts(t)[:2] == ["$TEST$", "$TEST$"]
    t = tag(dom.parse(PAGE), [Rule("test", tags={"regex_driven", "attribute"}, regex="replace-me", attribute_regex="href")])
    assert [n.attrs.get("href") for n in t.root.elements() if n.tag == "a"] == ["/$TEST$", "/REPLACE-ME", "/stay"]
    t = tag(dom.parse("<p>Remove everything after THIS word</p>"), [Rule("test", tags={"regex_driven", "text", "filtered"}, regex="Remove.*", filter_regex="THIS")])
    assert [h.value for h in t.hits] == ["Remove everything after"]


def test_two_hits_in_one_element_and_aggregate():
    rules = [Rule("test", tags={"example_driven", "text"}, examples=("REPLACE", "ME")), Rule("both", tags={"regex_driven", "text", "aggregate"}, regex=r"\$TEST\$ \$TEST\$", prefix="v: ")]
    t = tag(dom.parse(PAGE), rules)
    assert [(h.label, h.value) for h in t.hits] == [("test", "REPLACE"), ("test", "ME"), ("both", "v: REPLACE REPLACE")]


def test_chained_exclusive_similar_fallback():
    rules = [Rule("make", tags={"example_driven", "text"}, examples=("Audi",)), Rule("model", tags={"regex_driven", "text", "fallback"}, regex=r"(?<=\$MAKE\$ )\w+")]
    t = tag(dom.parse("<p>Audi quattro</p>"), rules)
    assert texts(t) == ["$MAKE$ $MODEL$"] and [(h.value, h.fallback) for h in t.hits] == [("Audi", False), ("quattro", True)]
    t = tag(dom.parse("<p>test x</p><p>x</p>"), [Rule("test", tags={"example_driven", "text", "exclusive"}, examples=("x",))])
    assert texts(t) == ["test x", "$TEST$"]
    t = tag(dom.parse("<p>id: K77</p><p>K77 again</p>"), [Rule("key", tags={"regex_driven", "text", "replace_similar"}, regex=r"(?<=id: )\w+")])
    assert texts(t) == ["id: $KEY$", "$KEY$ again"]


def test_flags_hold_for_every_pattern_of_a_rule():
    rule = Rule("make", tags={"example_driven", "text", "exclusive", "ignore_case"}, examples=("vw",))
    assert texts(tag(dom.parse("<p>$MAKE$ vw</p><p>VW</p>"), [rule])) == ["$MAKE$ vw", "$MAKE$"]
    rule = Rule("make", tags={"example_driven", "text", "exclusive"}, examples=("vw",))
    assert texts(tag(dom.parse("<p>$MAKE$ vw</p>"), [rule])) == ["$MAKE$ $MAKE$"]
    rule = Rule("part", tags={"regex_driven", "text", "filtered", "ignore_case"}, regex="keep.*", filter_regex="stop")
    assert [h.value for h in tag(dom.parse("<p>Keep this STOP that</p>"), [rule]).hits] == ["Keep this"]


def test_labels_of_attributes():
    rule = Rule("km", tags={"regex_driven", "attribute", "labeled"}, regex=r"\d+", attribute_regex="^data", labels=("Mileage",))
    html = "<section><p>Mileage</p><b data-x='12'>x</b></section><section><b data-x='34'>y</b><p>Mileage</p></section>"
    assert [h.value for h in tag(dom.parse(html), [rule], 1).hits] == ["12"]
    assert tag(dom.parse("<b data-x='12'>Mileage</b>"), [rule], 0).hits == []


def test_what_stands_beside_a_block():
    """Siblings count like the block itself: before fallbacks and defaults, and for what rules a block out."""
    rules = [
        Rule("alias", tags={"regex_driven", "attribute"}, regex=r"/\w+", attribute_regex="^href$", required=True),
        Rule("number", tags={"regex_driven", "text", "fallback"}, regex=r"\d+", default="0"),
        Rule("sold", tags={"example_driven", "text", "anti_attribute"}, examples=("SOLD",)),
    ]
    html = "<body><a href='/x'>x</a><p>42</p></body>"
    block = Finder(tag(dom.parse(html), rules), rules).blocks(absorb=True)[0]
    assert block.values["number"] == ["42"] and block.alias == "/x"
    assert Finder(tag(dom.parse(html.replace("42", "-")), rules), rules).blocks(absorb=True)[0].values["number"] == ["0"]
    two = "<body><div><a href='/x'>x</a></div><div><a href='/y'>y</a></div><p>SOLD</p></body>"
    found = Finder(tag(dom.parse(two), rules), rules)
    assert [b.alias for b in found.blocks()] == ["/x", "/y"] and [b.alias for b in found.blocks(absorb=True)] == ["/y"]


def test_labels():
    rule = Rule("km", tags={"regex_driven", "text", "labeled"}, regex=r"\d+", labels=("Mileage",))
    t = tag(dom.parse("<div><p>12</p><ul><li>Mileage</li><li>34</li></ul></div><section><div><p>56</p></div></section>"), [rule], max_label_distance=2)
    assert [h.value for h in t.hits] == ["34"]
    assert [h.value for h in tag(dom.parse("<p>Mileage 7</p><p>8 Mileage</p>"), [rule], 0).hits] == ["7"]


def test_distance():
    root = dom.parse("<body><div>a</div><div>b</div><section><div><p>c</p></div><div>d</div></section></body>")
    a, b, c = (dom.path(next(n for n in root.elements() if n.content() == x and n.tag in ("div", "p"))) for x in "abc")
    inner = dom.path(next(n for n in root.elements() if n.tag == "p"))
    assert dom.distance(a, a) == 0 and dom.distance(a, b) == 1 == dom.distance(b, a)
    assert dom.distance(a, inner) == dom.distance(inner, a) == 3 and dom.distance(a, c) == 2
    assert dom.distance(["x"], ["x", "y"]) == 2


RULES = [Rule("alias", tags={"regex_driven", "attribute"}, regex=r"/\w+", attribute_regex="^href$", required=True), Rule("title", tags={"regex_driven", "text"}, regex=r"[a-z]+", required=True), Rule("price", type="float", tags={"regex_driven", "text"}, regex=r"\d[\d.]*", default="1")]
LIST = "<body><nav><a href='/top'>top</a></nav><ul>" + "".join(f"<li><div><a href='/r{k}'>rec</a><b>{k}.500</b></div></li>" for k in range(4)) + "<li><div><a href='/r1'>again</a></div></li></ul></body>"


def test_blocks():
    found = Finder(tag(dom.parse(LIST), RULES), RULES, max_tag_distance=1).records(known=["/r2"])
    assert [b.alias for b in found] == ["/r0", "/r1", "/r3"]
    assert found[0].values["price"] == ["0.500"] and found[0].node.tag == "li" and found[0].parent.tag == "ul"


def test_groups_may_overlap():
    finder = Finder(tag(dom.parse("<p>x</p>"), []), [], 1)

    class At:
        def __init__(self, at):
            self.node, self.group, self.parent = at, -1, None

    for spots, want in (([0, 1, 2, 3, 9], [1, 2, 3]), ([0, 5, 6, 1], [0, 1])):
        with pytest.MonkeyPatch.context() as m:
            m.setattr(dom, "path", lambda n: n)
            m.setattr(dom, "distance", lambda a, b: abs(a - b))
            m.setattr(dom, "common_parent", lambda n: dom.Node("element"))
            assert [b.node for b in finder.largest_group([At(k) for k in spots])] == want


def test_pager():
    root = dom.parse("<body><p>2</p><ul><li>x</li></ul><div class='pg'><a>1</a><a><span>2</span></a><a>three</a></div></body>")
    button = pagination.pager(root, 1, 9, ("a",), after=3, classes=("pg",))
    assert button.tag == "a" and button.content() == "2"
    assert pagination.pager(root, 2, 9, ("a",), after=3).content() == "three"
    far = dom.parse("<body><p>1</p>" + "<div>" * 9 + "<a>2</a>" + "</div>" * 9 + "</body>")
    assert pagination.pager(far, 1, 9, ("a",)) is None
    mixed = dom.parse("<body><p>1</p><script>2</script><a>2</a><i class='Main PAGER-x'><a>2</a></i></body>")
    assert pagination.pager(mixed, 1, 9, ("a",)).index == 3
    assert pagination.pager(mixed, 1, 9, ("a",), classes=("pager",)).parent.tag == "i"
    assert pagination.number_words(1234) == "one thousand, two hundred and thirty-four" and pagination.number_words(21_005) == "twenty-one thousand and five"
    assert pagination.page_numbers(1, 2) == [1, 2] and pagination.page_numbers(5, 6) == [3, 4, 5, 6]
    assert pagination.number_words(42) == "forty-two" and pagination.names("Forty two", 42)
    assert [n.tag for n in pagination.view_more(dom.parse("<a><i>View More</i></a>"), ["view more"], ("a",))] == ["a"]


def frame(spark, *html):
    return spark.createDataFrame([(k, f"http://h.com/{k}", h) for k, h in enumerate(html)], "page_id long, url string, html string")


def test_node_table_against_the_tree(spark):
    html = [LIST, PAGE, "", None, "<p>a<p>b<!-- c -->"]
    df = frame(spark, *html)
    nodes = pages.nodes(df)
    got = {(r.page_id, r.node_id): r for r in nodes.collect()}
    hits = nodes.where("tag = 'a'").select("page_id", "node_id", F.lit("link").alias("label"))
    counts = {(r.page_id, r.node_id): r.n for r in pages.subtree_counts(nodes, hits).collect()}
    paths = {(r.page_id, r.node_id): r.path for r in pages.paths(nodes).collect()}
    for k, h in enumerate(html):
        walked = list(dom.parse(h).walk())[1:]
        for i, n in enumerate(walked):
            below = list(n.walk())
            row = got[k, i]
            assert (row.kind, row.tag, row.text, row.subtree_end - row.node_id) == (n.kind, n.tag, n.text, len(below) - 1)
            assert counts.get((k, i), 0) == sum(x.tag == "a" for x in below)
            if n.kind == "element":
                assert paths[k, i] == dom.path(n)
    assert len(got) == sum(len(list(dom.parse(h).walk())) - 1 for h in html)


def test_next_buttons_after_the_blocks(spark):
    pager = "<div><a>1</a><a>2</a></div>"
    html = f"<body>{pager}{LIST.removeprefix('<body>').removesuffix('</body>').replace('again', '2')}{pager}</body>"
    df = frame(spark, html, html).withColumn("n", F.col("page_id") + 1)
    first = pages.next_buttons(df, 1, 9).collect()
    after = pages.next_buttons(df, 1, 9, rules=RULES, max_tag_distance=1).collect()
    assert {r.path for r in first} == {"body/div[1]/a[2]"} and {r.path for r in after} == {"body/div[2]/a[2]"}
    assert [r.page_id for r in pages.next_buttons(df, "n", 9).collect()] == [0]  # page 2 has no button for a third
    assert pages.next_buttons(df, 1, 1).count() == 0


def test_distance_column(spark):
    rows = [(["a", "b"], ["a", "b"]), (["a", "b[1]"], ["a", "b[2]"]), (["a"], ["a", "c"]), (["a", "b", "c"], ["a", "d"]), (["x"], ["y", "z"])]
    df = spark.createDataFrame(rows, "a array<string>, b array<string>")
    assert [r[0] for r in df.select(pages.tree_distance(F.col("a"), F.col("b"))).collect()] == [dom.distance(a, b) for a, b in rows]


def test_records_table(spark):
    found = pages.typed_records(pages.records(frame(spark, LIST, "<p>none</p>", None), RULES, max_tag_distance=1), RULES)
    assert [(r.alias, r.title, r.price) for r in found.where("page_id = 0").orderBy("block").collect()] == [("/r0", "rec", 500.0), ("/r1", "rec", 1500.0), ("/r2", "rec", 2500.0), ("/r3", "rec", 3500.0)]


def test_text_rules_as_columns_agree_with_the_tree(spark):
    rules = [
        Rule("make", tags={"example_driven", "text", "reorder_examples"}, examples=("Audi", "Audi Sport", None)),
        Rule("model", tags={"regex_driven", "text", "filtered"}, regex=r"\$MAKE\$ .*", filter_regex=" km"),
        Rule("of", tags={"example_driven", "text", "exclusive", "ignore_case"}, examples=("THE",)),
    ]
    rows = ["x Audi Sport 7 km", "Audi Audi", "the end", "of the end", "", "nothing $", None]
    df = spark.createDataFrame(list(enumerate(rows)), "k int, t string")
    got = [r[1] for r in df.select("k", column_tagging.tag_text(F.col("t"), rules)).orderBy("k").collect()]
    for t, g in zip(rows, got, strict=True):
        if t:
            assert g == texts(tag(dom.parse(f"<p>{t}</p>"), rules))[0]
    df = spark.createDataFrame([({"href": "a x b x", "id": "x"},)], "m map<string,string>")
    rule = Rule("k", tags={"regex_driven", "attribute"}, regex="x", attribute_regex="^href$")
    assert df.select(column_tagging.tag_attributes(F.col("m"), rule)).first()[0] == {"href": "a $K$ b $K$", "id": "x"}


def test_texts_of_nodes(spark):
    nodes = pages.nodes(frame(spark, "<p> a <b>B</b> c</p><p>d \n\n e É</p>"))
    assert sorted(r.text for r in pages.own_texts(nodes).collect()) == ["B", "a  c", "d \n\n e É"]
    assert pages.corpus_text(nodes).first().text == "aBcd e É"
    df = spark.createDataFrame([("Été été ab x",)], "text string")
    assert [tuple(r) for r in pages.vocabulary(df, 5).collect()] == [("ete", 2), ("ab", 1)]


def test_unknown_rule_tag():
    with pytest.raises(ValueError, match="unknown rule tags"):
        Rule("x", tags={"nonsense"})
