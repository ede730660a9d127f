"""Parsing, cleaning and tagging queries over pages and documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import links, scalars, tagging, text
from ..operators import pages as P
from ..operators.clean import Settings
from ..rules import Rule
from ..sources.tables import table
from .registry import query

BLANKS = r"[\s\x00\x0b\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"

# ------------------------------------------------------------------ scalar values

NUMBER_SQL = """CASE l_linenumber % 5 WHEN 0 THEN concat('€ ', CAST(CAST(l_quantity AS INT) AS VARCHAR), '.', lpad(CAST(l_orderkey % 1000 AS VARCHAR), 3, '0'), ',50')
    WHEN 1 THEN concat(CAST(CAST(l_quantity AS INT) AS VARCHAR), ',', CAST(l_orderkey % 10 AS VARCHAR), ' km') WHEN 2 THEN concat(CAST(l_orderkey AS VARCHAR), ' thd')
    WHEN 3 THEN 'n/a' ELSE concat(CAST(l_orderkey AS VARCHAR), '.', CAST(l_partkey % 100 AS VARCHAR), '.1') END"""
FLOAT_SQL = r"TRY_CAST(regexp_replace(regexp_replace(regexp_replace({0}, ',(\d{{1,2}})\b', '.\1', 'g'), '[,.](\d{{3}})', '\1', 'g'), '[^0-9.]', '', 'g') AS DOUBLE)"


def _numbers(spark, sf_dir):
    q, o = F.col("l_quantity").cast("int").cast("string"), F.col("l_orderkey")
    s = (
        F.when(F.col("l_linenumber") % 5 == 0, F.concat(F.lit("€ "), q, F.lit("."), F.lpad((o % 1000).cast("string"), 3, "0"), F.lit(",50")))
        .when(F.col("l_linenumber") % 5 == 1, F.concat(q, F.lit(","), (o % 10).cast("string"), F.lit(" km")))
        .when(F.col("l_linenumber") % 5 == 2, F.concat(o.cast("string"), F.lit(" thd")))
        .when(F.col("l_linenumber") % 5 == 3, F.lit("n/a"))
        .otherwise(F.concat(o.cast("string"), F.lit("."), (F.col("l_partkey") % 100).cast("string"), F.lit(".1")))
    )
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", s.alias("s"))


@query(f"SELECT l_orderkey, s, {FLOAT_SQL.format('s')} AS value, CAST(trunc({FLOAT_SQL.format('s')}) AS BIGINT) AS whole FROM (SELECT l_orderkey, {NUMBER_SQL} AS s FROM lineitem)")
def parse_float(spark, sf_dir):
    s = F.col("s")
    return _numbers(spark, sf_dir).select("l_orderkey", "s", scalars.parse_float(s).alias("value"), scalars.parse_int(s).alias("whole"))


@query(f"SELECT l_orderkey, s, {FLOAT_SQL.format('s')} * CASE WHEN s LIKE '%thd%' THEN 1000.0 WHEN regexp_matches(s, 'k[mM]') THEN 0.5 ELSE 1.0 END AS value FROM (SELECT l_orderkey, {NUMBER_SQL} AS s FROM lineitem)")
def convert_units(spark, sf_dir):
    return _numbers(spark, sf_dir).select("l_orderkey", "s", scalars.convert_units(F.col("s"), [("thd", 1000), ("k[mM]", 0.5)]).alias("value"))


@query(
    """SELECT l_partkey, round(coalesce(kept[2], kept[1]), 2) AS value, round(most, 2) AS most FROM (SELECT l_partkey, list_filter(v, lambda x: x >= 0.3 * v[1]) AS kept, v[1] AS most
    FROM (SELECT l_partkey, list(l_extendedprice ORDER BY l_extendedprice DESC) AS v FROM lineitem GROUP BY l_partkey))"""
)
def constrained_value(spark, sf_dir):
    values = table(spark, sf_dir, "lineitem").groupBy("l_partkey").agg(F.collect_list("l_extendedprice").alias("v"))
    v = F.col("v")
    return values.select("l_partkey", F.round(scalars.constrained(v, "30%", 2), 2).alias("value"), F.round(scalars.constrained(v, "0"), 2).alias("most"))


DATE_SQL = """CASE o_orderkey % 6 WHEN 0 THEN strftime(o_orderdate, '%d.%m.%Y') WHEN 1 THEN strftime(o_orderdate, '%d/%m/%Y') WHEN 2 THEN strftime(o_orderdate, '%Y.%m.%d')
    WHEN 3 THEN strftime(o_orderdate, '%m %Y') WHEN 4 THEN strftime(o_orderdate, '%Y-%m-%d') ELSE strftime(o_orderdate, '%Y') END"""


@query(
    f"""SELECT o_orderkey, s, CASE o_orderkey % 6 WHEN 0 THEN strftime(o_orderdate, '%Y-%m-%d') WHEN 1 THEN strftime(o_orderdate, '%Y-%m-%d') WHEN 2 THEN strftime(o_orderdate, '%Y-%m-01') WHEN 3 THEN strftime(o_orderdate, '%Y-%m-01')
    ELSE strftime(o_orderdate, '%Y-01-01') END AS date, CASE WHEN o_orderkey % 6 IN (0, 1, 2, 4) THEN strftime(o_orderdate, '%Y-%m-%d') WHEN o_orderkey % 6 = 3 THEN strftime(o_orderdate, '%Y-%m-01') ELSE strftime(o_orderdate, '%Y-01-01') END AS iso
    FROM (SELECT *, {DATE_SQL} AS s FROM orders)"""
)
def parse_date(spark, sf_dir):
    formats = ["dd.MM.yyyy", "dd/MM/yyyy", "yyyy.MM.dd", "MM yyyy", "yyyy-MM-dd", "yyyy"]
    s = F.lit(None).cast("string")
    for k, f in enumerate(formats):
        s = F.when(F.col("o_orderkey") % 6 == k, F.date_format("o_orderdate", f)).otherwise(s)
    rows = table(spark, sf_dir, "orders").withColumn("s", s)
    return rows.select("o_orderkey", "s", scalars.parse_date(F.col("s")).alias("date"), scalars.parse_date_iso(F.col("s")).cast("string").alias("iso"))


@query("SELECT o_orderkey, coalesce(CASE lower(o_orderpriority) WHEN '1-urgent' THEN 'now' WHEN '5-low' THEN 'later' END, lower(o_orderpriority)) AS value FROM orders")
def translate_value(spark, sf_dir):
    value = scalars.translate(F.col("o_orderpriority"), {"1-URGENT": "now", "5-Low": "later"}, ignore_case=True)
    return table(spark, sf_dir, "orders").select("o_orderkey", value.alias("value"))


@query("SELECT doc_id, CASE WHEN text <> '' THEN sha256(text) END AS content_hash FROM documents")
def content_hash(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", scalars.content_hash(F.col("text")).alias("content_hash"))


@query("SELECT doc_id, image_hash FROM (SELECT doc_id, sha256(text) AS image_hash FROM documents WHERE text <> '') d WHERE image_hash NOT IN (SELECT sha256(text) FROM documents WHERE doc_id % 10 = 0 AND text <> '')")
def drop_default_images(spark, sf_dir):
    from ..operators.catalog import drop_default_images as drop

    images = table(spark, sf_dir, "documents").select("doc_id", scalars.content_hash(F.col("text")).alias("image_hash"))
    return drop(images, images.where("doc_id % 10 = 0").select(F.col("image_hash").alias("hash"))).select("doc_id", "image_hash")


@query("SELECT p_partkey, make, nullif(regexp_extract(rest, '[A-Za-z]+', 0), '') AS model FROM (SELECT p_partkey, CASE WHEN contains(p_name, 'ring') THEN 'Ring' WHEN contains(p_name, 'widget') THEN 'WIDGET' END AS make, replace(replace(p_name, CASE WHEN contains(p_name, 'ring') THEN 'ring' ELSE '#' END, ''), CASE WHEN NOT contains(p_name, 'ring') THEN 'widget' ELSE '#' END, '') AS rest FROM part)")
def split_title(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", scalars.split_title(F.col("p_name"), ["Ring", "WIDGET"], "[A-Za-z]+").alias("t")).select("p_partkey", "t.make", "t.model")


@query("SELECT o_orderkey, CASE WHEN CAST(o_orderdate AS DATE) <= DATE '1998-05-31' THEN strftime(o_orderdate, '%Y-%m-%d') END AS date FROM orders")
def api_date(spark, sf_dir):
    raw = F.concat(F.lit(" '"), F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit("';"))
    return table(spark, sf_dir, "orders").select("o_orderkey", scalars.api_date(raw, F.lit("1998-06-01").cast("date")).cast("string").alias("date"))


# -------------------------------------------------------------------------- links

LINK_SQL = "CASE page_id % 5 WHEN 0 THEN '/a/b' WHEN 1 THEN 'c' WHEN 2 THEN 'www.x.com/d' WHEN 3 THEN 'https://y.com' ELSE NULL END"


@query(f"SELECT page_id, CASE WHEN l IS NULL OR l LIKE 'http%' OR l LIKE 'www%' THEN l WHEN l LIKE '/%' AND NOT url LIKE '%/' THEN concat(url, '/', l) WHEN l LIKE '/%' THEN concat(url, substr(l, 2)) WHEN url LIKE '%/' THEN concat(url, l) ELSE concat(url, '/', l) END AS link FROM (SELECT page_id, CASE WHEN page_id % 2 = 0 THEN concat(url, '/') ELSE url END AS url, {LINK_SQL} AS l FROM pages)")
def format_link(spark, sf_dir):
    raw = F.expr(LINK_SQL)
    url = F.when(F.col("page_id") % 2 == 0, F.concat("url", F.lit("/"))).otherwise(F.col("url"))
    return table(spark, sf_dir, "pages").select("page_id", links.format_link(raw, url).alias("link"))


@query("SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN NULL ELSE concat(lang, '_', source) END AS alias FROM documents")
def namespaced_alias(spark, sf_dir):
    alias = F.when(F.col("doc_id") % 3 == 0, F.lit("")).otherwise(F.col("source"))
    return table(spark, sf_dir, "documents").select("doc_id", links.namespaced(alias, F.col("lang")).alias("alias"))


@query()
def same_site_link(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    found = P.link_rows(P.nodes(pages), pages).where("tag = 'a'").join(pages.select("page_id", "url"), "page_id")
    return found.select("page_id", "node_id", "link", links.same_site(F.col("link"), F.col("url")).alias("same_site"))


@query()
def absolute_links(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    return P.link_rows(P.nodes(pages), pages)


# --------------------------------------------------------------------------- text


@query("SELECT page_id, regexp_replace(html, '(?s)<!--.*?-->', '', 'g') AS html FROM pages")
def strip_comments(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", text.strip_comments(F.col("html")).alias("html"))


@query(f"SELECT doc_id, regexp_replace(text, '{BLANKS}+', ' ', 'g') AS text FROM documents")
def collapse_whitespace(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", text.collapse_blanks(F.col("text")).alias("text"))


@query(f"SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(concat(text, ' ! ?'), '{BLANKS}*\\|{BLANKS}*', ' ', 'g'), '{BLANKS}+!', '!', 'g'), '{BLANKS}+\\?', '?', 'g') AS text FROM documents".replace(r"[\s\x00", r"[\s"))
def punctuation(spark, sf_dir):
    value = text.redundant_punctuation(F.concat("text", F.lit(" ! ?")), ["|"])
    return table(spark, sf_dir, "documents").select("doc_id", text.punctuation_blanks(value, ["!", "?"]).alias("text"))


@query("SELECT doc_id, regexp_replace(text, '(?i)thing|the|of', '', 'g') AS text FROM documents")
def stopwords(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", text.remove_stopwords(F.col("text"), ["the", "of", "thing"]).alias("text"))


@query("SELECT word, n FROM (SELECT word, count(*) AS n FROM (SELECT unnest(regexp_extract_all(lower(text), '[a-z]{2,}')) AS word FROM documents) GROUP BY word) ORDER BY n DESC, word LIMIT 100")
def vocabulary(spark, sf_dir):
    words = table(spark, sf_dir, "documents").select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("([a-z]{2,})"))).alias("word"))
    return words.groupBy("word").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "word").limit(100)


@query("SELECT page_id, regexp_matches(html, 'ththed|class=\"nope\"') AS failed FROM pages")
def failed_load(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", text.failed_load(F.col("html"), ["ththed", 'class="nope"']).alias("failed"))


@query("SELECT page_id, n FROM (SELECT page_id, len(regexp_extract_all(regexp_replace(html, '(?s)<!--.*?-->', '', 'g'), '<[A-Za-z][^<>]*>')) AS n FROM pages) WHERE n > 30")
def tag_count_filter(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", text.tag_count(F.col("html")).alias("n")).where("n > 30")


# ------------------------------------------------------------------------ tagging

EDGE = r"(^|[^\p{L}\p{N}_])"
AFTER = r"($|[^\p{L}\p{N}_])"


def _first_word(column: str, word: str, label: str) -> str:
    """The first whole word becomes the label, with letters of all languages."""
    return rf"regexp_replace({column}, '{EDGE}{word}{AFTER}', '\1{label}\2')"


MAKE = Rule("make", tags={"example_driven", "text"}, examples=("the", "and"))


@query(f"SELECT doc_id, {_first_word(_first_word('text', 'the', '$MAKE$'), 'and', '$MAKE$')} AS text FROM documents")
def tag_example(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", tagging.tag_text(F.col("text"), [MAKE]).alias("text"))


@query("SELECT doc_id, regexp_replace(text, '[a-z]{14,}', '$LONG$') AS text, nullif(regexp_extract(text, '[a-z]{14,}'), '') AS value FROM documents")
def tag_regex(spark, sf_dir):
    rule = Rule("long", tags={"regex_driven", "text"}, regex="[a-z]{14,}")
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", tagging.tag_text(F.col("text"), [rule]).alias("text"), tagging.found_first(F.col("text"), rule.regex).alias("value"))


@query("SELECT doc_id, CASE WHEN found = '' THEN text ELSE concat(substr(text, 1, strpos(text, hit) - 1), '$PART$', substr(text, strpos(text, hit) + len(found))) END AS text FROM (SELECT doc_id, text, hit, CASE WHEN contains(hit, 'er') THEN trim(split_part(hit, 'er', 1)) ELSE hit END AS found FROM (SELECT doc_id, text, regexp_extract(text, '[a-z]{12,}') AS hit FROM documents))")
def tag_filtered(spark, sf_dir):
    rule = Rule("part", tags={"regex_driven", "text", "filtered"}, regex="[a-z]{12,}", filter_regex="er")
    return table(spark, sf_dir, "documents").select("doc_id", tagging.tag_text(F.col("text"), [rule]).alias("text"))


@query(rf"SELECT doc_id, regexp_replace({_first_word(_first_word('text', 'the', '$MAKE$'), 'and', '$MAKE$')}, '\$MAKE\$ [a-z]+', '$MODEL$') AS text FROM documents")
def tag_chained(spark, sf_dir):
    model = Rule("model", tags={"regex_driven", "text"}, regex=r"\$MAKE\$ [a-z]+")
    return table(spark, sf_dir, "documents").select("doc_id", tagging.tag_text(F.col("text"), [MAKE, model]).alias("text"))


@query(f"SELECT doc_id, CASE WHEN regexp_matches(text, '{EDGE}of{AFTER}') THEN text ELSE {_first_word('text', 'the', '$OF$')} END AS text FROM documents")
def tag_exclusive(spark, sf_dir):
    rule = Rule("of", tags={"example_driven", "text", "exclusive"}, examples=("the",))
    return table(spark, sf_dir, "documents").select("doc_id", tagging.tag_text(F.col("text"), [rule]).alias("text"))


# ------------------------------------------------------------------ trees of pages

CLEANING = Settings(
    excluded_tags=("script", "style", "div.ad"),
    invisible_tag_regex=("display:\\s*none",),
    whitelisted_attributes=("href", "class", "src", "style"),
    flattened_tags=("b", "i"),
    punctuation_marks=(",", "."),
    redundant_punctuation_marks=("|",),
    empty_tags=("img", "br"),
)
#: Navigation items as records: a link's target is its alias, its text the title.
ITEMS = [
    Rule("alias", tags={"regex_driven", "attribute"}, regex=r"^/[^/?#]+$", attribute_regex="^href$", required=True),
    Rule("title", tags={"regex_driven", "text"}, regex=r"\w{2,}", required=True),
    Rule("number", type="int", tags={"regex_driven", "text", "fallback"}, regex=r"\d+", default="0"),
]


@query()
def html_nodes(spark, sf_dir):
    nodes = P.nodes(table(spark, sf_dir, "pages"))
    return nodes.withColumn("attrs", F.to_json("attrs"))


@query()
def visible_nodes(spark, sf_dir):
    """Elements left without scripts, styles and advertisements, with few attributes."""
    nodes = P.nodes(table(spark, sf_dir, "pages"))
    marked = F.coalesce(F.col("tag").isin("script", "style") | (F.col("attrs")["class"] == "ad"), F.lit(False))
    return P.without(nodes, marked).where("kind <> 'comment'").select("page_id", "node_id", "tag", F.to_json(P.whitelisted(F.col("attrs"), ["href", "class"])).alias("attrs"))


@query()
def subtree_counts(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    return P.subtree_counts(P.nodes(pages), _element_hits(pages))


def _element_hits(pages):
    """Hits on the node table: links, and texts of ten words or more."""
    nodes = P.nodes(pages)
    label = F.when(F.col("tag") == "a", F.lit("link")).when((F.col("kind") == "text") & (F.size(F.split("text", " ")) >= 10), F.lit("prose"))
    return nodes.withColumn("label", label).where("label is not null").select("page_id", "node_id", "label")


@query()
def element_paths(spark, sf_dir):
    return P.paths(P.nodes(table(spark, sf_dir, "pages"))).select("page_id", "node_id", F.concat_ws("/", "path").alias("path"))


@query()
def element_distances(spark, sf_dir):
    """Distances between the links of a page, within the page."""
    nodes = P.nodes(table(spark, sf_dir, "pages"))
    links_ = P.paths(nodes).join(nodes.where("tag = 'a'").select("page_id", "node_id"), ["page_id", "node_id"])
    a, b = links_.select("page_id", F.col("node_id").alias("a"), F.col("path").alias("pa")), links_.select("page_id", F.col("node_id").alias("b"), F.col("path").alias("pb"))
    return a.join(b, "page_id").where("a < b").select("page_id", "a", "b", P.tree_distance(F.col("pa"), F.col("pb")).alias("distance"))


@query()
def clean_page(spark, sf_dir):
    return P.cleaned(table(spark, sf_dir, "pages"), CLEANING)


@query()
def tag_hits(spark, sf_dir):
    return P.hits(table(spark, sf_dir, "pages"), ITEMS, CLEANING)


@query()
def tag_labeled(spark, sf_dir):
    """A number after a headline's words, only below a label."""
    rule = Rule("size", tags={"regex_driven", "text", "labeled"}, regex=r"\b[a-z]{8,}\b", labels=("the", "de", "der"))
    return P.hits(table(spark, sf_dir, "pages"), [rule], CLEANING, max_label_distance=2)


@query()
def tag_similar(spark, sf_dir):
    rule = Rule("name", tags={"regex_driven", "text", "replace_similar"}, regex=r"\b[A-Z][a-z]{6,}\b")
    return P.hits(table(spark, sf_dir, "pages"), [rule], CLEANING)


@query()
def tag_aggregate(spark, sf_dir):
    rules = [Rule("word", tags={"regex_driven", "text"}, regex=r"\b[a-z]{9,}\b"), Rule("pair", tags={"regex_driven", "text", "aggregate"}, regex=r"\$WORD\$ \w+", prefix="= ")]
    return P.hits(table(spark, sf_dir, "pages"), rules, CLEANING)


@query()
def records_from_pages(spark, sf_dir):
    """The items of each page's largest group, typed."""
    return P.typed_records(P.records(table(spark, sf_dir, "pages"), ITEMS, CLEANING), ITEMS)


@query()
def detail_records(spark, sf_dir):
    """Detail pages: the first block filled from the whole page."""
    from ..operators.catalog import fuzzy_fill as fill

    found = P.typed_records(P.records(table(spark, sf_dir, "pages"), ITEMS, CLEANING, detail=True), ITEMS)
    names = ["page_id", *(r.name for r in ITEMS)]
    return fill(found.where("block = 0").select(*names), found.where("block = 1").select(*names), "page_id")


@query()
def pager_candidates(spark, sf_dir):
    """Next-page buttons of pages that a pager has been added to, in digits or words."""
    steps = F.when(F.col("page_id") % 2 == 0, F.lit("1 2 3")).otherwise(F.lit("one two three"))
    pager = F.concat(F.lit('<div class="pager"><a>'), F.replace(steps, F.lit(" "), F.lit("</a><a>")), F.lit("</a></div>"))
    pages = table(spark, sf_dir, "pages").withColumn("html", F.concat("html", pager))
    return P.next_buttons(pages, current=1, most=10, classes=("pager",))


@query()
def own_texts(spark, sf_dir):
    return P.own_texts(P.nodes(table(spark, sf_dir, "pages")))


@query()
def page_vocabulary(spark, sf_dir):
    """The hundred most frequent words of all pages' texts: a report."""
    return P.vocabulary(P.corpus_text(P.nodes(table(spark, sf_dir, "pages"))), 100)
