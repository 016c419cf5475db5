"""Figures, footnotes and repeated regions as objects with owners, and the canonical order of blocks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracewell.functions import text as T
from tracewell.operators import references, structure

FIGURE = r"(?U)^Figure\s+((?:\d+-)*\d+)[.]\s+(\S.*)$"
FOOTNOTE = r"(?Us)^Footnote\s+(\d+)\s*[-—]\s*(\S.*)$"


def figures(blocks: DataFrame, images: DataFrame) -> DataFrame:
    """Images with the caption nearest below: doc_id, page, pos, number, title, caption_pos; null where there is none."""
    captions = blocks.where(T.strip(F.col("text")).rlike(FIGURE))
    found = references.figure_captions(images, captions).select(F.col("doc_id").alias("d_"), F.col("page").alias("p_"), F.col("pos").alias("i_"), "caption_pos")
    text = captions.select(F.col("doc_id").alias("e_"), F.col("pos").alias("c_"), F.regexp_extract(T.strip(F.col("text")), FIGURE, 1).alias("number"), F.regexp_extract(T.strip(F.col("text")), FIGURE, 2).alias("title"))
    rows = images.join(found, (F.col("doc_id") == F.col("d_")) & (F.col("page") == F.col("p_")) & (F.col("pos") == F.col("i_")), "left")
    rows = rows.join(text, (F.col("doc_id") == F.col("e_")) & (F.col("caption_pos") == F.col("c_")), "left")
    return rows.select("doc_id", "page", "pos", "number", "title", "caption_pos")


def footnotes(blocks: DataFrame) -> DataFrame:
    """Footnotes with marker, first sentence and the block they belong to: doc_id, page, pos, marker, note, marker_pos."""
    found = structure.footnote_markers(blocks).withColumn("bare", T.strip(F.col("text")))
    note = F.regexp_extract("bare", FOOTNOTE, 2)
    return found.select("doc_id", "page", "pos", F.regexp_extract("bare", FOOTNOTE, 1).alias("marker"), T.first_sentence(note).alias("note"), "marker_pos")


def ownership(objects: DataFrame, members: DataFrame) -> DataFrame:
    """Objects (doc_id, object_id, pos) with the deepest section that has their block, as relations ``owned_by``."""
    owner = references.deepest_owner(members).where("not tied").select(F.col("doc_id").alias("d_"), "block", "section")
    rows = objects.join(owner, (F.col("doc_id") == F.col("d_")) & (F.col("pos") == F.col("block")), "left")
    return rows.select("doc_id", "object_id", F.col("section").alias("target_id"), F.lit("owned_by").alias("relation_type"), F.when(F.col("section").isNotNull(), "resolved").otherwise("unresolved").alias("status"))


def region_rollup(blocks: DataFrame) -> DataFrame:
    """Repeated margins with their occurrences in page order and a number by first sight: doc_id, region, margin, region_no, pages."""
    found = structure.repeated_regions(blocks).select(F.col("doc_id").alias("d_"), F.col("region").alias("r_"), F.col("margin").alias("m_"))
    region = F.when(F.col("y0") <= F.col("height") * 0.12, "page_header").when(F.col("y1") >= F.col("height") * 0.88, "page_footer")
    rows = blocks.withColumn("region", region).withColumn("margin", T.margin_text(F.col("text")))
    rows = rows.join(found, (F.col("doc_id") == F.col("d_")) & (F.col("region") == F.col("r_")) & (F.col("margin") == F.col("m_")))
    out = rows.groupBy("doc_id", "region", "margin").agg(F.min("page").alias("first_"), F.array_join(F.transform(F.sort_array(F.collect_list("page")), lambda p: p.cast("string")), ",").alias("pages"))
    return out.withColumn("region_no", F.row_number().over(Window.partitionBy("doc_id").orderBy("first_", "region", "margin"))).drop("first_")


def continuation_edges(blocks: DataFrame, members: DataFrame) -> DataFrame:
    """For each page end the last and first block of running text: resolved if one section has both and the second stands in the top fifth, else rejected.

    ``blocks``: doc_id, pos, page, y0, height; ``members``: doc_id, block, section.
    """
    order = Window.partitionBy("doc_id").orderBy("pos")
    edges = blocks.withColumn("next_pos", F.lead("pos").over(order)).withColumn("next_page", F.lead("page").over(order)).withColumn("top", F.lead("y0").over(order) <= F.lead("height").over(order) * 0.2)
    edges = edges.where("next_page = page + 1").select("doc_id", "page", "pos", "next_pos", "top")
    one, two = (members.select(F.col("doc_id").alias(f"{x}d"), F.col("block").alias(f"{x}b"), F.col("section").alias(f"{x}s")) for x in "ab")
    shared = edges.join(one, (F.col("doc_id") == F.col("ad")) & (F.col("pos") == F.col("ab")), "left").join(two, (F.col("doc_id") == F.col("bd")) & (F.col("next_pos") == F.col("bb")) & (F.col("as") == F.col("bs")), "left")
    out = shared.groupBy("doc_id", "page", "pos", "next_pos", "top").agg(F.max("bs").alias("section"))
    return out.select("doc_id", "page", "pos", "next_pos", F.when(F.col("section").isNotNull() & F.col("top"), "resolved").otherwise("rejected").alias("status"))


def canonical_order(*layers: DataFrame) -> DataFrame:
    """Blocks of text, figures and table parts (doc_id, page, y0, source, ord, text, block_type) in one new reading order.

    On a page blocks stand by their height, those without one last, then by layer and
    their own order; a page without any block has none here (see :func:`page_fallback`).
    """
    rows = reduce(DataFrame.unionByName, [t.withColumn("layer", F.lit(k)) for k, t in enumerate(layers)])
    order = Window.partitionBy("doc_id").orderBy("page", F.col("y0").asc_nulls_last(), "layer", "ord")
    return rows.withColumn("pos", F.row_number().over(order) - 1).drop("layer")


def page_fallback(pages: DataFrame, blocks: DataFrame) -> DataFrame:
    """One ``text`` block for each page (doc_id, page, text) that has text and no block."""
    have = blocks.select(F.col("doc_id").alias("d_"), F.col("page").alias("p_")).distinct()
    rows = pages.where(T.strip(F.col("text")) != "").join(have, (F.col("doc_id") == F.col("d_")) & (F.col("page") == F.col("p_")), "left_anti")
    return rows.select("doc_id", "page", "text", F.lit("text").alias("observed_type"))


def section_fallback(own: DataFrame, parsed: DataFrame, documents: DataFrame) -> DataFrame:
    """Sections (doc_id, section_id, first_page, last_page): found ones, else the parser's, else one for all pages of the document."""
    def lacking(rows: DataFrame, have: DataFrame) -> DataFrame:
        return rows.join(have.select(F.col("doc_id").alias("h_")).distinct(), F.col("doc_id") == F.col("h_"), "left_anti")

    columns = ["doc_id", "section_id", "first_page", "last_page"]
    second = lacking(parsed, own).select(*columns)
    whole = lacking(lacking(documents, own), parsed).select("doc_id", F.concat(F.col("doc_id").cast("string"), F.lit(":all")).alias("section_id"), F.lit(0).alias("first_page"), (F.col("pages") - 1).cast("int").alias("last_page"))
    return own.select(*columns).withColumn("method", F.lit("numbered")).unionByName(second.withColumn("method", F.lit("parser"))).unionByName(whole.withColumn("method", F.lit("document")))


def fact_sources(facts: DataFrame, observations: DataFrame) -> DataFrame:
    """Projected facts (region_id, fact, value_sha256) with the parsers that observed that very value, sorted; ``bound`` if any did."""
    o = observations.select(F.col("region_id").alias("r_"), F.col("fact").alias("f_"), F.col("value_sha256").alias("h_"), "parser_id")
    rows = facts.join(o, (F.col("region_id") == F.col("r_")) & (F.col("fact") == F.col("f_")) & (F.col("value_sha256") == F.col("h_")), "left")
    return rows.groupBy("region_id", "fact", "value_sha256").agg(F.array_join(F.sort_array(F.collect_set("parser_id")), "|").alias("parsers"), (F.count("parser_id") > 0).alias("bound"))


def fact_source_maps(facts: DataFrame, observations: DataFrame) -> DataFrame:
    """region_id, sources: for each region a map from its facts to the sorted parsers that observed just that value."""
    rows = fact_sources(facts, observations)
    entries = F.sort_array(F.collect_list(F.struct("fact", F.when(F.col("bound"), F.split("parsers", "[|]")).otherwise(F.array().cast("array<string>")).alias("parsers"))))
    return rows.groupBy("region_id").agg(F.map_from_entries(entries).alias("sources"))


def region_violations(observations: DataFrame) -> DataFrame:
    """Regions for which one parser gives several values of a fact: region_id, parser_id, fact, values."""
    return observations.groupBy("region_id", "parser_id", "fact").agg(F.count_distinct("value_sha256").alias("values")).where("values > 1")
