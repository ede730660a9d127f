"""Pages as DataFrames: node tables, cleaned pages, hits, blocks and pager buttons.

Each page is parsed once in an Arrow batch and whatever has to follow document
order is done there; everything after is relational.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..rules import Rule
from . import dom
from .blocks import Finder
from .clean import Settings, clean
from .pagination import blank, pager
from .tagging import tag

NODES = "page_id long, node_id int, parent_id int, subtree_end int, depth int, pos int, kind string, tag string, attrs map<string,string>, text string"
HITS = "page_id long, node_id int, label string, seq int, value string, is_fallback boolean"
RECORDS = "page_id long, block int, node_id int, path string, grp int, values map<string,array<string>>"


def per_page(pages: DataFrame, work: Callable[[dict], Iterator[tuple]], schema: str, also: Sequence[str] = ()) -> DataFrame:
    """``work`` on each row (page_id, url, html); its tuples become rows, with these columns of the page as well."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    out_schema = StructType([*StructType.fromDDL(schema), *(pages.schema[c] for c in also)])
    arrow = to_arrow_schema(out_schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 64):
                rows = [(*out, *(row[c] for c in also)) for row in batch.slice(lo, 64).to_pylist() for out in work(row)]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), arrow, strict=True)], schema=arrow)

    return pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html", *also).mapInArrow(run, out_schema)


def nodes(pages: DataFrame) -> DataFrame:
    """One row for each element, text and comment, in document order; a node's subtree is node_id to subtree_end."""

    def work(row: dict) -> Iterator[tuple]:
        out: list[list] = []
        below = lambda node, parent, depth: [(c, parent, depth, k) for k, c in enumerate(node.children)][::-1]
        todo = below(dom.parse(row["html"]), None, 0)
        while todo:
            node, parent, depth, pos = todo.pop()
            me = len(out)
            out.append([row["page_id"], me, parent, me, depth, pos, node.kind, node.tag, list(node.attrs.items()), node.text])
            todo += below(node, me, depth + 1)
        for me in range(len(out) - 1, -1, -1):  # a subtree ends where its last child's does
            parent = out[me][2]
            if parent is not None:
                out[parent][3] = max(out[parent][3], out[me][3])
        yield from map(tuple, out)

    return per_page(pages, work, NODES)


def whitelisted(attrs: Column, names: Sequence[str]) -> Column:
    return F.map_filter(attrs, lambda k, v: k.isin(*names))


def without(nodes_: DataFrame, marked: Column) -> DataFrame:
    """Nodes outside the subtrees of marked ones: an anti-join on intervals within a page."""
    gone = nodes_.where(marked).select(F.col("page_id").alias("_p"), F.col("node_id").alias("_a"), F.col("subtree_end").alias("_b"))
    return nodes_.join(gone, (F.col("page_id") == F.col("_p")) & F.col("node_id").between(F.col("_a"), F.col("_b")), "left_anti")


def subtree_counts(nodes_: DataFrame, hits: DataFrame) -> DataFrame:
    """Each node's labels with their numbers in its subtree: differences of running sums over node ids."""
    own = hits.groupBy("page_id", "node_id", "label").agg(F.count("*").alias("n"))
    labels = own.select("page_id", "label").distinct()
    grid = nodes_.select("page_id", "node_id", "subtree_end").join(labels, "page_id").join(own, ["page_id", "node_id", "label"], "left")
    w = Window.partitionBy("page_id", "label").orderBy("node_id")
    upto = F.sum(F.coalesce("n", F.lit(0))).over(w.rowsBetween(Window.unboundedPreceding, 0))
    # a subtree's rows follow its root without a gap, so its last running sum stands that many rows below
    sums = grid.withColumn("upto", upto).withColumn("before", F.coalesce(F.lag("upto").over(w), F.lit(0)))
    last = sums.select("page_id", "label", F.col("node_id").alias("subtree_end"), F.col("upto").alias("total"))
    return sums.join(last, ["page_id", "label", "subtree_end"]).withColumn("n", F.col("total") - F.col("before")).where("n > 0").select("page_id", "node_id", "label", F.col("n").cast("long").alias("n"))


def paths(nodes_: DataFrame) -> DataFrame:
    """Each element's path of names from the top, numbered where siblings share a name."""
    own = nodes_.where("kind = 'element'")
    same = Window.partitionBy("page_id", "parent_id", "tag")
    step = F.when(F.count("*").over(same) > 1, F.concat("tag", F.lit("["), F.row_number().over(same.orderBy("node_id")), F.lit("]"))).otherwise(F.col("tag"))
    steps = own.withColumn("step", step).select("page_id", "node_id", "subtree_end", "depth", "step")
    up = steps.select(F.col("page_id").alias("_p"), F.col("node_id").alias("_a"), F.col("subtree_end").alias("_b"), F.col("depth").alias("_d"), F.col("step").alias("_s"))
    both = steps.join(up, (F.col("page_id") == F.col("_p")) & F.col("node_id").between(F.col("_a"), F.col("_b")))
    ordered = F.transform(F.sort_array(F.collect_list(F.struct("_d", "_s"))), lambda x: x["_s"])
    return both.groupBy("page_id", "node_id").agg(ordered.alias("path"))


def own_texts(nodes_: DataFrame) -> DataFrame:
    """Each element's own text, without that of the elements in it."""
    texts = nodes_.where("kind = 'text' AND parent_id IS NOT NULL").groupBy("page_id", F.col("parent_id").alias("node_id"))
    return texts.agg(F.trim(F.concat_ws("", F.transform(F.sort_array(F.collect_list(F.struct("node_id", "text"))), lambda x: x["text"]))).alias("text"))


def corpus_text(nodes_: DataFrame) -> DataFrame:
    """A page's texts, each stripped, one after another; runs of blanks become one."""
    texts = nodes_.where("kind = 'text'").groupBy("page_id")
    joined = F.concat_ws("", F.transform(F.sort_array(F.collect_list(F.struct("node_id", "text"))), lambda x: F.trim(x["text"])))
    return texts.agg(F.regexp_replace(joined, r"(?U)\s+", " ").alias("text"))


def vocabulary(texts: DataFrame, most: int) -> DataFrame:
    """The most frequent words of two letters or more, accents taken off, with their counts."""
    plain = F.translate(F.lower("text"), "áàâäãåéèêëíìîïóòôöõúùûüçñ", "aaaaaaeeeeiiiiooooouuuucn")
    words = texts.select(F.explode(F.regexp_extract_all(plain, F.lit(r"(?U)\b(\w\w+)\b"))).alias("word"))
    return words.groupBy("word").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "word").limit(most)


def tree_distance(a: Column, b: Column) -> Column:
    """Steps between two path arrays: 0 the same, 1 siblings."""
    shorter = F.least(F.size(a), F.size(b))
    differs = F.filter(F.sequence(F.lit(1), shorter), lambda k: F.element_at(a, k) != F.element_at(b, k))
    same = F.coalesce(F.try_element_at(differs, F.lit(1)), shorter) - 1
    return F.when(a == b, 0).otherwise(F.size(a) + F.size(b) - 2 * same - 1)


def cleaned(pages: DataFrame, settings: Settings) -> DataFrame:
    """(page_id, html) after all cleaning steps."""
    return per_page(pages, lambda row: iter([(row["page_id"], clean(dom.parse(row["html"]), settings).html())]), "page_id long, html string")


def hits(pages: DataFrame, rules: Sequence[Rule], settings: Settings | None = None, max_label_distance: int = 3) -> DataFrame:
    """Every value that the rules find; ``seq`` numbers a page's hits in the order they are found."""

    def work(row: dict) -> Iterator[tuple]:
        root = dom.parse(row["html"])
        tagged = tag(clean(root, settings) if settings else root, rules, max_label_distance)
        for k, h in enumerate(tagged.hits):
            yield row["page_id"], h.node.index, h.label, k, h.value, h.fallback

    return per_page(pages, work, HITS)


def records(pages: DataFrame, rules: Sequence[Rule], settings: Settings | None = None, max_tag_distance: int = 2, max_label_distance: int = 3, detail: bool = False, also: Sequence[str] = ()) -> DataFrame:
    """Blocks of each page with the texts found for each rule: the records of a list page, or, with ``detail``, the
    first block with what stands beside it (block 0) and the record of the whole page (block 1).  ``also``: columns of
    the pages that go with their records."""

    def work(row: dict) -> Iterator[tuple]:
        root = dom.parse(row["html"])
        finder = Finder(tag(clean(root, settings) if settings else root, rules, max_label_distance), rules, max_tag_distance)
        found = [*finder.blocks(absorb=True)[:1], finder.whole()] if detail else finder.records()
        for k, b in enumerate(found):
            yield row["page_id"], k, b.node.index, "/".join(dom.path(b.node)) if b.node.kind == "element" else "", b.group, list(b.values.items())

    return per_page(pages, work, RECORDS, also)


def typed_records(found: DataFrame, rules: Sequence[Rule], also: Sequence[str] = ()) -> DataFrame:
    """Each rule's texts as one typed column."""
    from ..functions.scalars import typed

    columns = [typed(r.type, F.col("values")[r.name], r.conversions, r.constraints, r.translations if r.has("translated") else None, r.has("ignore_case")).alias(r.name) for r in rules]
    return found.select("page_id", "block", "node_id", "path", *columns, *also)


def next_buttons(pages: DataFrame, current: int | str, most: int, tags: Sequence[str] = ("a", "button"), rules: Sequence[Rule] = (), settings: Settings | None = None, max_tag_distance: int = 2, **how: object) -> DataFrame:
    """The element to click for the next page, where there is one; none once ``most`` pages are reached.

    ``current`` is the page's number or the name of the column that has it.  With
    ``rules`` a page's blocks are found first: their texts are blanked, only what
    stands after the last one counts, and the button nearest to their parent is taken.
    """

    def work(row: dict) -> Iterator[tuple]:
        number = row[current] if isinstance(current, str) else current
        if number is None or number >= most:
            return
        root, own = dom.parse(row["html"]), dict(how)
        if rules:
            again = dom.parse(row["html"])
            blocks = Finder(tag(clean(again, settings) if settings else again, rules), rules, max_tag_distance).records()
            if blocks:
                of = {n.index: n for n in root.elements()}
                own = {"after": blocks[-1].node.index, "block_parent": of.get(blocks[0].parent.index) if blocks[0].parent else None} | own
                blank(root, [b.node.index for b in blocks])
        button = pager(root, number, most, tags, **own)
        if button is not None:
            yield row["page_id"], button.index, "/".join(dom.path(button)), button.content().strip()

    return per_page(pages, work, "page_id long, node_id int, path string, text string", [current] if isinstance(current, str) else [])


def link_rows(nodes_: DataFrame, pages: DataFrame) -> DataFrame:
    """Links and images of each page, made absolute."""
    from ..functions.links import absolute

    refs = nodes_.where("kind = 'element'").select("page_id", "node_id", "tag", F.when(F.col("tag") == "a", F.col("attrs")["href"]).when(F.col("tag") == "img", F.col("attrs")["src"]).alias("ref")).where("ref is not null")
    return refs.join(pages.select("page_id", "url"), "page_id").select("page_id", "node_id", "tag", absolute(F.col("ref"), F.col("url")).alias("link"))


def as_mapping(settings: Mapping[str, object]) -> Settings:
    return Settings(**settings)
