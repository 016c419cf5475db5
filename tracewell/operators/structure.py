"""Blocks, headings, sections, margins and tables of documents.

Tables are long: one row per block, keyed by ``doc_id`` with its place ``pos``.  All
windows run inside a document, so one exchange by ``doc_id`` serves them all.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from tracewell.functions import text as T


def document_order(*keys: str) -> Window:
    return Window.partitionBy(*(keys or ("doc_id",))).orderBy("pos")


def headings(blocks: DataFrame) -> DataFrame:
    """The blocks that are numbered headings, with ``number``, ``title`` and ``level``."""
    found = blocks.withColumn("number", T.heading_number(F.col("text"))).where("number is not null")
    return found.withColumn("title", T.heading_title(F.col("text"))).withColumn("level", T.heading_level(F.col("number")))


def typed(blocks: DataFrame) -> DataFrame:
    """The blocks with ``block_type`` from ``text`` and ``observed_type``."""
    return blocks.withColumn("block_type", T.block_type(F.col("text"), F.col("observed_type")))


def fragments(blocks: DataFrame) -> DataFrame:
    """Blocks split at their bullets, inline tables and, where ``split_last`` says so, before the last sentence.

    Adds ``fragment`` (its number), ``text`` and ``block_type`` of each and ``method``.
    """
    text, kind = F.col("text"), T.block_type(F.col("text"), F.col("observed_type"))
    cut = T.inline_table(text)
    rows = T.lines(text)
    items = F.filter(F.transform(F.split(text, r"(?m)^•\s*\n"), T.strip), lambda x: x != "")
    pieces = F.split(F.regexp_replace(text, r"(?U)(?<=[?!.])\s+(?=\S)", "\x01"), "\x01")
    head = T.strip(F.regexp_extract(text, r"(?Us)^(.*(?<=[.!?]))\s+(?=\S)", 1))

    def part(value: Column, method: str) -> Column:
        return F.struct(value.alias("text"), F.lit(method).alias("method"))

    split = (
        F.when(F.col("observed_type").isin("page_header", "page_footer"), F.array(part(text, "whole")))
        .when(cut.isNotNull(), F.array(part(F.array_join(F.slice(rows, 1, F.greatest(cut, F.lit(1))), "\n"), "inline_table"), part(F.array_join(F.slice(rows, cut + 1, F.size(rows)), " "), "inline_prose")))
        .when(F.contains(text, F.lit("•")) & (F.size(items) > 1) & (kind == "list"), F.transform(items, lambda x: part(x, "list_item")))
        .when(F.col("split_last") & (F.size(pieces) > 1), F.array(part(head, "sentence_split"), part(T.strip(F.element_at(pieces, -1)), "sentence_split")))
        .otherwise(F.array(part(text, "whole")))
    )
    out = blocks.select(*[c for c in blocks.columns if c not in ("text",)], F.posexplode(split).alias("fragment", "f_"))
    out = out.withColumn("text", F.col("f_.text")).withColumn("method", F.col("f_.method")).drop("f_")
    return out.withColumn("block_type", F.when(F.col("method") == "list_item", "list_item").when(F.col("method") == "inline_table", "table").otherwise(T.block_type(F.col("text"), F.col("observed_type"))))


def sentence_spans(blocks: DataFrame) -> DataFrame:
    """doc_id, pos, sentence, char_start, char_end: half-open spans that end before the white space.

    Offsets are summed within the row, so no text is shuffled.
    """
    pieces = F.split(F.regexp_replace("text", T.SENTENCE_GAP, "\x01$1"), "\x01")
    rows = blocks.select("doc_id", "pos", pieces.alias("p_")).withColumn("w_", F.transform("p_", lambda x: F.length(F.regexp_replace(x, r"(?U)^\s+", ""))))
    rows = rows.withColumn("e_", F.arrow_udf(_ends, "array<int>")(F.transform("p_", F.length)))
    spans = F.filter(F.zip_with("w_", "e_", lambda w, e: F.struct((e - w).alias("s"), e.alias("e"))), lambda x: x["s"] < x["e"])
    return rows.select("doc_id", "pos", F.posexplode(spans).alias("sentence", "x_")).select("doc_id", "pos", "sentence", F.col("x_.s").alias("char_start"), F.col("x_.e").alias("char_end"))


def _ends(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """Running sums within each list."""
    for batch in batches:
        yield pa.array([None if x is None else list(accumulate(x)) for x in batch.to_pylist()], pa.list_(pa.int32()))


def _nest(keys: list, positions: list, levels: list) -> tuple[list, list]:
    """For headings in order of document and place: the last earlier one of a lower level, and the next one of the same or a lower."""
    parents, following = [None] * len(keys), [None] * len(keys)
    stack: list[int] = []
    for i, (key, level) in enumerate(zip(keys, levels)):
        if i and key != keys[i - 1]:
            stack.clear()
        while stack and levels[stack[-1]] >= level:
            following[stack.pop()] = positions[i]
        if stack:
            parents[i] = positions[stack[-1]]
        stack.append(i)
    return parents, following


def _nested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches sorted by document and place, with both columns of :func:`_nest`; a document that goes on is held back."""
    held: list[pa.RecordBatch] = []

    def out() -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(held)
        at = table.column("pos").type
        both = _nest(*(table.column(c).to_pylist() for c in ("doc_id", "pos", "level")))
        yield from table.append_column("parent_pos", pa.array(both[0], at)).append_column("next_pos", pa.array(both[1], at)).combine_chunks().to_batches()

    for batch in batches:
        ids = batch.column("doc_id")
        last, cut = ids[-1], batch.num_rows - 1
        while cut and ids[cut - 1] == last:
            cut -= 1
        if held and (cut or held[-1].column("doc_id")[-1] != last):
            held.append(batch.slice(0, cut))
            yield from out()
            held = [batch.slice(cut)]
        elif cut:
            held = [batch.slice(0, cut)]
            yield from out()
            held = [batch.slice(cut)]
        else:
            held.append(batch)
    if held:
        yield from out()


def nested_sections(heads: DataFrame) -> DataFrame:
    """The headings with ``parent_pos``, the last earlier heading of a lower level, and ``next_pos``, the next one of their level or a lower.

    One pass with a stack over the sorted headings of a document, at any depth and
    number of headings; a heading without a level is none and goes.
    """
    rows = heads.where("level is not null").repartition("doc_id").sortWithinPartitions("doc_id", "pos")
    kind = rows.schema["pos"].dataType
    return rows.mapInArrow(_nested, StructType([*rows.schema.fields, StructField("parent_pos", kind), StructField("next_pos", kind)]))


def section_parents(heads: DataFrame) -> DataFrame:
    """The headings with ``parent_pos``: the last earlier heading of a lower level, null at the top."""
    return nested_sections(heads).drop("next_pos")


def section_spans(heads: DataFrame, lengths: DataFrame) -> DataFrame:
    """The headings with ``end_pos``, the block before the next heading of their level or a lower one, else the last."""
    found = nested_sections(heads).drop("parent_pos")
    return found.join(lengths, "doc_id").withColumn("end_pos", F.coalesce(F.col("next_pos") - 1, F.col("last_pos"))).drop("next_pos", "last_pos")


def section_continuation(spans: DataFrame, blocks: DataFrame) -> DataFrame:
    """Whether a section goes on over a page's end.

    ``spans`` holds doc_id, pos, level, end_pos; ``blocks`` holds doc_id, pos, page
    and level (null for text).  A section of several pages is ``deterministic_true``
    and names the blocks on both sides of its first page end; one that ends with its
    page before a heading of its level or a lower one is ``deterministic_false``.
    """
    order = document_order()
    edges = blocks.withColumn("next_page", F.lead("page").over(order)).withColumn("next_pos", F.lead("pos").over(order)).withColumn("next_level", F.lead("level").over(order))
    edges = edges.where("next_page <> page").select(F.col("doc_id").alias("d_"), F.col("pos").alias("edge"), "next_pos", "next_level")
    joined = spans.join(edges, (F.col("doc_id") == F.col("d_")) & F.col("edge").between(F.col("pos"), F.col("end_pos")), "left")
    inside = F.when(F.col("edge") < F.col("end_pos"), F.col("edge"))
    ending = F.max(F.when((F.col("edge") == F.col("end_pos")) & (F.col("next_level") <= F.col("level")), F.lit(True)))
    out = joined.groupBy("doc_id", "pos", "level", "end_pos").agg(F.min(inside).alias("continues_from"), F.min_by("next_pos", inside).alias("continues_to"), ending.alias("stops"))
    status = F.when(F.col("continues_from").isNotNull(), "deterministic_true").when(F.col("stops"), "deterministic_false")
    return out.select("doc_id", "pos", "level", "end_pos", status.alias("status"), "continues_from", "continues_to")


def repeated_regions(blocks: DataFrame) -> DataFrame:
    """Texts that recur in the top 12 % or bottom 12 % of pages: doc_id, region, margin, occurrences.

    ``blocks`` holds doc_id, page, y0, y1, height and text.  A text recurs with
    occurrences on a quarter of the pages and at least two.
    """
    region = F.when(F.col("y0") <= F.col("height") * 0.12, "page_header").when(F.col("y1") >= F.col("height") * 0.88, "page_footer")
    pages = blocks.groupBy("doc_id").agg(F.count_distinct("page").alias("pages"))
    found = blocks.withColumn("region", region).where("region is not null").groupBy("doc_id", "region", T.margin_text(F.col("text")).alias("margin")).agg(F.count("*").alias("occurrences"))
    return found.join(pages, "doc_id").where(F.col("occurrences") >= F.greatest(F.lit(2), F.ceil(F.col("pages") * 0.25))).drop("pages")


def evidence_chain(pages: DataFrame) -> DataFrame:
    """Pages (doc_id, pos) with ids of their evidence and of the evidence before and after."""
    own = T.stable_id(F.col("doc_id"), F.col("pos"))
    rows = pages.withColumn("evidence_id", own)
    return rows.withColumn("previous_id", F.lag("evidence_id").over(document_order())).withColumn("next_id", F.lead("evidence_id").over(document_order()))


def outline_sections(entries: DataFrame, page_counts: DataFrame) -> DataFrame:
    """Outline entries (doc_id, pos, page) with ``end_page``: the page before the next entry's, else the last."""
    found = entries.withColumn("next_", F.lead("page").over(Window.partitionBy("doc_id").orderBy("pos", "page"))).join(page_counts, "doc_id")
    return found.withColumn("end_page", F.coalesce(F.col("next_") - 1, F.col("pages") - 1)).drop("next_", "pages")


def footnote_markers(blocks: DataFrame) -> DataFrame:
    """Footnote blocks with ``marker_pos``: the nearest earlier block that is running text."""
    running = ~F.col("block_type").isin("heading", "caption", "figure", "table", "page_header", "page_footer")
    before = document_order("doc_id", "page").rowsBetween(Window.unboundedPreceding, -1)
    return blocks.withColumn("marker_pos", F.last(F.when(running, F.col("pos")), ignorenulls=True).over(before)).where("block_type = 'footnote'")


def early_page_ends(blocks: DataFrame) -> DataFrame:
    """Last blocks of pages that end in the upper 30 % before a page that begins with a heading, and hold a sentence end."""
    pages = blocks.groupBy("doc_id", "page").agg(F.min_by("text", "pos").alias("first_text"), F.max_by("text", "pos").alias("last_text"), F.max("pos").alias("last_pos"), F.max_by("y1", "pos").alias("bottom"), F.max("height").alias("height"))
    order = Window.partitionBy("doc_id").orderBy("page")
    following = F.lead("first_text").over(order)
    found = pages.withColumn("next_heading", T.heading_number(following))
    return found.where(F.col("next_heading").isNotNull() & (F.col("bottom") <= F.col("height") * 0.3) & F.col("last_text").rlike(r"(?U)(?<=[?!.])\s+(?=\S)")).select("doc_id", "page", F.col("last_pos").alias("pos"))


def list_neighbours(blocks: DataFrame) -> DataFrame:
    """List blocks with ``splits``: not beside a heading."""
    order = document_order()
    beside = (F.coalesce(F.lag("block_type").over(order), F.lit("")) == "heading") | (F.coalesce(F.lead("block_type").over(order), F.lit("")) == "heading")
    return blocks.withColumn("splits", ~beside).where("block_type = 'list'")


def table_continuity(parts: DataFrame) -> DataFrame:
    """Tables of several parts whose rows go on without a gap: table_id, parts, rows, first_row, last_row.

    ``parts`` holds one row per table row: table_id, part, row_no.
    """
    ends = parts.groupBy("table_id", "part").agg(F.min("row_no").alias("low"), F.max("row_no").alias("high"), F.count_distinct("row_no").alias("n"))
    order = Window.partitionBy("table_id").orderBy("part")
    ends = ends.withColumn("follows", F.coalesce(F.col("low") == F.lag("high").over(order) + 1, F.lit(True)) & (F.col("high") - F.col("low") + 1 == F.col("n")))
    tables = ends.groupBy("table_id").agg(F.count("*").alias("parts"), F.sum("n").alias("rows"), F.min("low").alias("first_row"), F.max("high").alias("last_row"), F.bool_and("follows").alias("sound"))
    return tables.where("sound and parts > 1").drop("sound")


def table_cells(rows: DataFrame) -> DataFrame:
    """One row per cell from ``columns`` and ``cells`` arrays; rows whose numbers differ are marked, not zipped short."""
    sound = F.size("columns") == F.size("cells")
    zipped = F.posexplode_outer(F.when(sound, F.arrays_zip("columns", "cells"))).alias("col_no", "c_")
    return rows.select("table_id", "row_no", sound.alias("sound"), zipped).select("table_id", "row_no", "sound", "col_no", F.col("c_.columns").alias("column_name"), F.col("c_.cells").alias("cell_text"))
