"""Whole documents: logical tables over pages, links of parsers, and all tables of a document from its blocks."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping
from functools import cache, reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewell.functions import text as T
from tracewell.operators import canonical, graph, objects, references, structure
from tracewell.plans.lineage import written

MARGINS = ("page_header", "page_footer")
CAPTION = r"(?U)^Table\s+((?:\d+-)*\d+)[.]\s+\S"
RULE = r"^[A-Z]{2,}(-[A-Z0-9]+)+$"
ROW = r"(?U)^\d{1,4}$"


def _folded(text: Column) -> Column:
    return T.folded(F.translate(text, "—–", "--"))


def _ruled(blocks: DataFrame) -> DataFrame:
    """The blocks of pages without margins: ``at`` (place on the page), the next two texts, and what they say as a row (``sound``) of a ruled table."""
    content = blocks.where(~F.col("block_type").isin(*MARGINS))
    order = Window.partitionBy("doc_id", "page").orderBy("pos")
    rows = content.select("doc_id", "page", "text", "box", (F.row_number().over(order) - 1).alias("at"), F.lead("text").over(order).alias("next_"), F.lead("text", 2).over(order).alias("second_"), F.lead("box").over(order).alias("beside_"))
    rows = rows.withColumn("lines", T.lines(F.col("text"))).withColumn("following_", T.strip(F.col("next_")))
    level = F.least(F.col("box.y1"), F.col("beside_.y1")) >= F.greatest(F.col("box.y0"), F.col("beside_.y0"))
    own = F.when(F.element_at("lines", -1).rlike(RULE), F.element_at("lines", -1))
    rows = rows.withColumn("own_code", F.when(F.size("lines") > 0, own)).withColumn("next_code", F.when(F.col("following_").rlike(RULE) & level, F.col("following_")))
    facts = F.when(F.col("own_code").isNotNull(), F.slice("lines", 1, F.greatest(F.size("lines") - 1, F.lit(1)))).otherwise(F.col("lines"))
    rows = rows.withColumn("facts", facts).withColumn("code", F.coalesce("own_code", "next_code"))
    sound = (F.size("lines") > 0) & F.coalesce(F.get("facts", F.lit(0)).rlike(ROW), F.lit(False)) & F.col("code").isNotNull() & (F.size("facts") >= 4)
    cells = F.array(F.get("facts", F.lit(0)), F.get("facts", F.lit(1)), F.get("facts", F.lit(2)), F.array_join(F.slice("facts", 4, F.size("facts")), " "), F.col("code"))
    rows = rows.withColumn("sound", F.coalesce(sound, F.lit(False))).withColumn("code_beside", F.col("own_code").isNull())
    return rows.withColumn("row_no", F.when(F.col("sound"), F.get("facts", F.lit(0)).cast("int"))).withColumn("cells", F.when(F.col("sound"), cells))


def table_rows(blocks: DataFrame) -> DataFrame:
    """Blocks that are rows of a ruled table: doc_id, page, at (place among the page's content), row_no, cells.

    A row has its number on the first line, three more lines at least, and a rule code
    on the last line or in the next block if that stands at its height.
    """
    return _ruled(blocks).where("sound").select("doc_id", "page", "at", "row_no", "cells", "code_beside")


def logical_tables(blocks: DataFrame) -> DataFrame:
    """Tables that go on over pages: doc_id, number, page, part, row_no, column_name, cell_text.

    A table begins after its caption with a group line and a line of two or more
    columns, and goes on on the next page if that begins with the same two and its
    first row number is the next.  Tables of one page are no logical tables.

    The blocks are read once.  ``gap`` counts the places of a page before a block that no
    row takes (a code of its own beside a row is part of it), so the rows that follow a
    beginning without a break are those of its gap, and at most four beginnings share one.
    """
    order = Window.partitionBy("doc_id", "page").orderBy("at")
    rows = _ruled(blocks).withColumn("bare_", T.strip(F.col("text"))).withColumn("taken_", F.when(F.col("sound"), 1 + F.col("code_beside").cast("int")).otherwise(0))
    rows = rows.withColumn("started_", F.when(F.col("bare_").rlike(CAPTION), T.lines(F.col("second_")))).withColumn("going_", F.when(F.col("at") == 0, T.lines(F.col("next_"))))
    ahead = [F.lead("taken_", k, 0).over(order) for k in (1, 2)]
    rows = rows.withColumn("gap_", F.col("at") - F.coalesce(F.sum("taken_").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).withColumn("one_", ahead[0]).withColumn("two_", ahead[1])

    def event(at: Column, gap: Column, row_no: Column, cells: Column, begin: Column, number: Column, group: Column, columns: Column) -> Column:
        return F.struct(at.cast("int").alias("at"), gap.cast("bigint").alias("gap"), row_no.cast("int").alias("row_no"), cells.cast("array<string>").alias("cells"), F.struct(begin.cast("int").alias("begin"), number.cast("string").alias("number"), group.alias("group"), columns.alias("columns")).alias("head"))

    none, at, gap = F.lit(None), F.col("at"), F.col("gap_")
    text = none.cast("string")
    row = F.when(F.col("sound"), event(at, gap, F.col("row_no"), F.col("cells"), none, none, text, none.cast("array<string>")))
    start = F.when(F.size("started_") >= 2, event(at, gap + 3 - F.col("taken_") - F.col("one_") - F.col("two_"), none, none, at + 3, F.regexp_extract("bare_", CAPTION, 1), _folded(F.col("next_")), F.col("started_")))
    going = F.when(F.size("going_") >= 2, event(at, gap + 2 - F.col("taken_") - F.col("one_"), none, none, F.lit(2), none, _folded(F.col("text")), F.col("going_")))
    events = rows.select("doc_id", "page", F.inline(F.array_compact(F.array(row, start, going))))
    found = events.withColumn("heads", F.collect_list(F.when(F.col("head.begin").isNotNull(), F.col("head"))).over(Window.partitionBy("doc_id", "page", "gap")))
    found = found.where("cells is not null").select("doc_id", "page", "gap", "at", "row_no", "cells", F.explode(F.filter("heads", lambda h: h["begin"] <= F.col("at"))).alias("h")).select("doc_id", "page", "gap", "at", "row_no", "cells", "h.*")
    # The rows of a part are on one page and go with it, so nothing is joined to them again.
    parts = found.groupBy("doc_id", "page", "gap", "begin", "number", "group", "columns").agg(F.min("row_no").alias("low"), F.max("row_no").alias("high"), F.size(F.collect_set("row_no")).alias("n"), F.collect_list(F.struct("row_no", "cells")).alias("rows")).where("high - low + 1 = n")
    pages = Window.partitionBy("doc_id", "group", "columns").orderBy("page", "begin")
    goes_on = F.col("number").isNull() & (F.lag("page").over(pages) + 1 == F.col("page")) & (F.lag("high").over(pages) + 1 == F.col("low"))
    parts = parts.withColumn("goes_on", F.coalesce(goes_on, F.lit(False)))
    parts = parts.withColumn("table", F.sum((~F.col("goes_on")).cast("int")).over(pages)).withColumn("part", F.row_number().over(Window.partitionBy("doc_id", "group", "columns", "table").orderBy("page", "begin")))
    whole = Window.partitionBy("doc_id", "group", "columns", "table")
    parts = parts.withColumn("name", F.min_by("number", "part").over(whole)).withColumn("parts", F.count("*").over(whole)).where("parts > 1 and name is not null")
    cells = parts.select("doc_id", F.col("name").alias("number"), "page", "part", "columns", F.inline("rows"))
    sound = F.when(F.size("columns") == F.size("cells"), F.arrays_zip("columns", "cells"))
    return cells.select("doc_id", "number", "page", "part", "row_no", F.posexplode_outer(sound).alias("col_no", "c")).select("doc_id", "number", "page", "part", "row_no", "col_no", F.col("c.columns").alias("column_name"), F.col("c.cells").alias("cell_text"))


def parser_links(links: DataFrame, blocks: DataFrame, sections: DataFrame) -> DataFrame:
    """Links of parsers as relations: doc_id, link_id, pos, target_id, status.

    A web address is its own target; a page target is the section that begins on the
    page, if the block names its title.  What neither gives stays unresolved.
    ``links``: doc_id, page, link_id, box, target_text, target_page; ``sections``: doc_id, section_id, page, title.
    """
    at = references.link_blocks(links, blocks).select(F.col("doc_id").alias("d_"), F.col("link_id").alias("k_"), "pos")
    text = blocks.select(F.col("doc_id").alias("e_"), F.col("pos").alias("q_"), "text")
    first = sections.groupBy(F.col("doc_id").alias("f_"), F.col("page").alias("g_")).agg(F.min_by("section_id", "section_id").alias("section_id"), F.min_by("title", "section_id").alias("title"))
    rows = links.join(at, (F.col("doc_id") == F.col("d_")) & (F.col("link_id") == F.col("k_")), "left").join(text, (F.col("doc_id") == F.col("e_")) & (F.col("pos") == F.col("q_")), "left")
    rows = rows.join(first, (F.col("doc_id") == F.col("f_")) & (F.col("target_page") == F.col("g_")), "left")
    web = F.coalesce(F.col("target_text").rlike("^https?://"), F.lit(False))
    named = F.coalesce(F.lower("text").contains(F.lower("title")), F.lit(False))
    target = F.when(F.col("pos").isNotNull() & web, F.col("target_text")).when(F.col("pos").isNotNull() & ~web & named, F.col("section_id"))
    return rows.select("doc_id", "link_id", "pos", target.alias("target_id"), F.when(target.isNotNull(), "observed").otherwise("unresolved").alias("status"))


#: What blocks may lack, and the type of it.
_OPTIONAL = {"observed_type": "string", "box": "struct<x0:double,y0:double,x1:double,y1:double>", "height": "double", "split_last": "boolean"}
_RELATION = ("doc_id", "source_pos", "literal", "target_id", "relation_type", "status", "method")


def canonical_blocks(blocks: DataFrame, pages: DataFrame | None = None, images: DataFrame | None = None) -> DataFrame:
    """The blocks of documents in one reading order: doc_id, pos, page, text, block_type, method, box, height.

    ``blocks``: doc_id, pos, page, text, and where known observed_type, box, height (of the
    page) and split_last.  A page of ``pages`` (doc_id, page, text) without a block gives one
    of its text; blocks are cut at bullets, tables and page ends that come early; images
    (doc_id, page, pos, box) take part as figures; then all are numbered anew.  An empty
    block keeps a number.
    """
    placed = {"box", "height"} <= set(blocks.columns)
    for name, kind in _OPTIONAL.items():
        if name not in blocks.columns:
            blocks = blocks.withColumn(name, F.lit(None).cast(kind))
    columns = ["doc_id", "page", "pos", "text", *_OPTIONAL]
    rows = blocks.select(*columns)
    # A last block of a page that ends early has its last sentence cut off; without boxes no page is known to.
    if placed:
        high = rows.where("box is not null and height is not null").withColumn("y1", F.col("box.y1"))
        early = structure.early_page_ends(high).select(F.col("doc_id").alias("e_"), F.col("pos").alias("at_"))
        rows = rows.join(early, (F.col("doc_id") == F.col("e_")) & (F.col("pos") == F.col("at_")), "left")
        rows = rows.withColumn("split_last", F.coalesce("split_last", F.lit(False)) | F.col("at_").isNotNull()).drop("e_", "at_")
    rows = rows.withColumn("split_last", F.coalesce("split_last", F.lit(False)))
    if pages is not None:
        # A page of its own has nothing to stand before or behind, so any number will do.
        lone = objects.page_fallback(pages, rows).withColumn("pos", F.lit(0))
        rows = rows.unionByName(lone.withColumn("split_last", F.lit(False)), allowMissingColumns=True)
    pieces = structure.fragments(rows).withColumn("ord", F.struct(F.col("pos").cast("bigint").alias("pos"), F.col("fragment").cast("bigint").alias("fragment")))
    shown = ["doc_id", "page", "ord", "text", "block_type", "method", "box", "height"]
    # Text stands in the order its parser gave it, as most parsers have no boxes for it.
    layers = [pieces.select(*shown).withColumn("y0", F.lit(None).cast("double"))]
    if images is not None:
        figure = F.struct(F.col("pos").cast("bigint").alias("pos"), F.lit(0).cast("bigint").alias("fragment"))
        layers[0] = layers[0].withColumn("y0", F.col("box.y0"))
        layers.append(images.select("doc_id", "page", figure.alias("ord"), F.lit("").alias("text"), F.lit("figure").alias("block_type"), F.lit("image").alias("method"), "box", F.lit(None).cast("double").alias("height"), F.col("box.y0").alias("y0")))
    return objects.canonical_order(*layers).drop("ord", "y0")


def _related(rows: DataFrame, kind: str, status: str | Column, method: str) -> DataFrame:
    """Relations from rows of doc_id, pos, literal, target_id."""
    known = status if isinstance(status, Column) else F.lit(status)
    return rows.select("doc_id", F.col("pos").alias("source_pos"), F.col("literal"), F.col("target_id"), F.lit(kind).alias("relation_type"), known.alias("status"), F.lit(method).alias("method"))


def _own_links(blocks: DataFrame, sections: DataFrame, links: DataFrame) -> DataFrame:
    own = parser_links(links, blocks, sections.select("doc_id", "section_id", "page", "title"))
    return own.withColumn("literal", F.coalesce("target_id", F.col("link_id").cast("string")))


def tasks_left(blocks: DataFrame, sections: DataFrame | None = None, links: DataFrame | None = None) -> DataFrame:
    """What :func:`relations` cannot settle; sections matter only to links."""
    tasks = references.unresolved_mentions(blocks).select("doc_id", "pos", "literal", "task_id", F.lit("cross_document_reference").alias("kind"))
    if links is None:
        return tasks
    left = _own_links(blocks, sections, links).where("status = 'unresolved'")
    return tasks.unionByName(left.select("doc_id", "pos", "literal", T.stable_id(F.col("doc_id"), F.col("link_id"), F.lit("parser_link")).alias("task_id"), F.lit("parser_link").alias("kind")))


def relations(blocks: DataFrame, sections: DataFrame, labels: DataFrame | None = None, links: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """All references of blocks, each once by block, literal, type, target and method, and the tasks that are left.

    ``labels``: doc_id, label, page_id; ``links``: as for :func:`parser_links`.  A link of a
    parser whose block names the same address in its text is handled by that and gives no
    relation of its own; one that finds no target is a task, as is a document named with a
    version.
    """
    urls = references.url_references(blocks).select("doc_id", "pos", F.col("url").alias("literal"), F.col("url").alias("target_id"))
    found = [_related(references.section_references(blocks, sections), "references", "resolved", "deterministic_exact"), _related(urls, "links_to", "observed", "deterministic_url")]
    if labels is not None:
        pages = references.page_references(blocks, labels).withColumnRenamed("page_id", "target_id")
        found.append(_related(pages, "references", "resolved", "printed_page_label"))
    if links is not None:
        own = _own_links(blocks, sections, links)
        handled = urls.select(F.col("doc_id").alias("h_"), F.col("pos").alias("p_"), F.col("target_id").alias("t_"))
        same = (F.col("doc_id") == F.col("h_")) & (F.col("pos") == F.col("p_")) & (F.col("target_id") == F.col("t_"))
        found.append(_related(own.where("status = 'observed'").join(handled, same, "left_anti"), "links_to", "observed", "parser_link"))
    rows = reduce(DataFrame.unionByName, found)
    key = T.stable_id(*[F.col(c) for c in ("doc_id", "source_pos", "literal", "relation_type", "target_id", "method")])
    return rows.withColumn("relation_id", key).dropDuplicates(["relation_id"]), tasks_left(blocks, sections, links)


class Tables(Mapping):
    """Tables by name, each made when it is first asked for."""

    def __init__(self, made: dict[str, Callable[[], DataFrame]]):
        self._made = {name: cache(make) for name, make in made.items()}

    def __getitem__(self, name: str) -> DataFrame:
        return self._made[name]()

    def __iter__(self) -> Iterator[str]:
        return iter(self._made)

    def __len__(self) -> int:
        return len(self._made)


def build(blocks: DataFrame, pages: DataFrame | None = None, images: DataFrame | None = None, links: DataFrame | None = None, labels: DataFrame | None = None, parsed: DataFrame | None = None) -> Mapping[str, DataFrame]:
    """All tables of documents from blocks (see :func:`canonical_blocks`), partitioned by document.

    The blocks in their order are written once and everything is made from that table,
    each when it is asked for; sections are written where a table needs them.
    A document without numbered headings has the one division of the document itself;
    its ``section_pages`` are the parser's (``parsed``: doc_id, section_id, first_page,
    last_page) if there are any, else all its pages.
    """
    typed = written(canonical_blocks(blocks, pages, images).withColumn("observed_type", F.col("block_type")), "blocks")
    lengths = typed.groupBy("doc_id").agg(F.max("pos").alias("last_pos"))
    number = T.heading_number(F.col("text"))

    def section(pos: Column) -> Column:
        return F.concat(F.col("doc_id").cast("string"), F.lit(":s"), pos.cast("string"))

    @cache
    def sections() -> DataFrame:
        heads = typed.where("block_type = 'heading'").withColumn("number", number).withColumn("title", T.heading_title(F.col("text"))).where("number is not null")
        heads = heads.select("doc_id", "pos", "page", "number", "title", T.heading_level(F.col("number")).alias("level"))
        nested = structure.nested_sections(heads).join(lengths, "doc_id").withColumn("end_pos", F.coalesce(F.col("next_pos") - 1, F.col("last_pos"))).drop("next_pos", "last_pos")
        return written(nested.withColumn("section_id", section(F.col("pos"))).withColumn("parent_id", section(F.col("parent_pos"))), "sections")

    paging = typed.withColumn("level", T.heading_level(T.heading_number(F.col("text")))).select("doc_id", "pos", "page", "level")
    root = F.concat(F.col("doc_id").cast("string"), F.lit(":document"))

    def divisions() -> DataFrame:
        whole = lengths.select("doc_id", root.alias("division_id"), F.lit(None).cast("string").alias("parent_division_id"))
        return whole.unionByName(sections().select("doc_id", F.col("section_id").alias("division_id"), F.coalesce("parent_id", root).alias("parent_division_id")))

    # The section a block stands in is the last heading at or before it: sections nest, so that is the deepest.
    # Whether a block is a heading it says itself, so blocks are not joined to headings, nor nodes to blocks, and one exchange serves all.
    head = F.when((F.col("block_type") == "heading") & number.isNotNull(), F.col("pos"))
    owner = F.last(head, ignorenulls=True).over(structure.document_order().rowsBetween(Window.unboundedPreceding, 0))
    placed = typed.withColumn("division_id", F.coalesce(section(owner), root))
    nodes = canonical.content_nodes(placed.where("doc_id is not null").withColumn("node_kind", F.col("block_type")), "node_kind", "division_id").withColumn("n_chars", F.length("text"))

    page_at = typed.select(F.col("doc_id").alias("a_"), F.col("pos").alias("b_"), F.col("page").alias("last_page"))
    counts = typed.groupBy("doc_id").agg((F.max("page") + 1).alias("pages"))

    def section_pages() -> DataFrame:
        own = sections().join(page_at, (F.col("doc_id") == F.col("a_")) & (F.col("end_pos") == F.col("b_")), "left").select("doc_id", "section_id", F.col("page").alias("first_page"), "last_page")
        return objects.section_fallback(own, own.where("false") if parsed is None else parsed, counts)

    notes = objects.footnotes(typed)
    tables = logical_tables(typed)
    drawn = typed.where("block_type = 'figure' and method = 'image'").select("doc_id", "page", "pos", "box")
    shown = objects.figures(typed.where("box is not null"), drawn)
    things = notes.select("doc_id", "pos").unionByName(drawn.select("doc_id", "pos"))
    owned = things.join(placed.select(F.col("doc_id").alias("o_"), F.col("pos").alias("p_"), "division_id"), (F.col("doc_id") == F.col("o_")) & (F.col("pos") == F.col("p_")))
    owned = _related(owned.select("doc_id", "pos", F.lit(None).cast("string").alias("literal"), F.col("division_id").alias("target_id")), "owned_by", "resolved", "deterministic_exact")
    marks = _related(notes.where("marker_pos is not null").select("doc_id", "pos", F.col("marker").alias("literal"), F.concat(F.col("doc_id").cast("string"), F.lit(":b"), F.col("marker_pos").cast("string")).alias("target_id")), "annotates", "resolved", "deterministic_nearest")
    more = owned.unionByName(marks)
    more = more.withColumn("relation_id", T.stable_id(*[F.col(c) for c in ("doc_id", "source_pos", "literal", "relation_type", "target_id", "method")]))

    @cache
    def every() -> DataFrame:
        found = relations(typed, sections(), labels, links)[0].unionByName(more).withColumn("epistemic_state", canonical.epistemic_state(F.col("status"), F.col("method")))
        return found.withColumn("gold_eligible", graph.is_gold(F.col("target_id"), F.col("status"), F.col("epistemic_state")))

    shape = F.to_json(F.sort_array(F.collect_list(F.struct("row_no", "col_no", "column_name", "cell_text"))))
    subject = F.concat(F.col("doc_id").cast("string"), F.lit(":table:"), F.col("number"))
    representations = tables.groupBy("doc_id", "number").agg(shape.alias("payload")).select("doc_id", T.stable_id(F.col("doc_id"), F.col("number"), F.lit("cells")).alias("representation_id"), subject.alias("subject_id"), F.lit("application/json").alias("media_type"), "payload", F.sha2("payload", 256).alias("payload_sha256"))
    sizes = typed.groupBy("doc_id").agg(F.count("*").alias("blocks"), F.size(F.collect_set("page")).cast("bigint").alias("pages"), F.sum(F.length("text")).alias("characters"), F.sha2(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", F.sha2("text", 256).alias("h")))), lambda x: x["h"]), ""), 256).alias("content_sha256"))
    graph_nodes = nodes.select("node_id", "doc_id", "division_id", "node_kind", "sequence_number", "text_sha256", "char_start", "char_end")
    return Tables({
        "blocks": lambda: typed,
        "sections": sections,
        "section_pages": section_pages,
        "continuation": lambda: structure.section_continuation(sections().select("doc_id", "pos", "level", "end_pos"), paging),
        "divisions": divisions,
        "nodes": lambda: nodes,
        "tables": lambda: tables,
        "figures": lambda: shown,
        "footnotes": lambda: notes,
        "relations": every,
        "unresolved": lambda: tasks_left(typed, None if links is None else sections(), links),
        "representations": lambda: representations,
        "descriptors": lambda: sizes,
        "graph_nodes": lambda: graph_nodes,
        "graph_edges": lambda: every().select("relation_id", "doc_id", "source_pos", "target_id", "relation_type", "status", "epistemic_state", "gold_eligible"),
        "evidence": lambda: structure.evidence_chain(typed.select("doc_id", F.col("page").alias("pos")).distinct()),
    })
