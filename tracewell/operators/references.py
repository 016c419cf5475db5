"""References in text, links on pages, and the objects they point to."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewell.functions import geometry as G
from tracewell.functions import text as T

SCANNED = tuple("paragraph list table hyperlink url".split())
NUMBER = r"(?:\d+\.)*\d+"
ONE_SECTION = rf"(?U)\bSection\s+({NUMBER})"
MANY_SECTIONS = rf"(?U)\bSections\s+{NUMBER}(?:\s*(?:and|,)\s*{NUMBER})+"
APPENDIX = r"\bAppendix\s+([A-Z])\b"
PRINTED_PAGE = r"(?Ui)\bprinted page\s+([A-Z]-\d+|\d+|[ivxlcdm]+)\b"
URL = r"https?://[^()<>\[\]\s]+"
VERSIONED = r"([A-Z][-A-Za-z0-9’' &]+(?:Policy|Manual|Handbook),\s*Version\s+(?:\d+\.)*\d+)"


def scanned(blocks: DataFrame, word: str = "") -> DataFrame:
    """Blocks whose kind is looked at for references, their text collapsed; only those with ``word``, which a wanted reference cannot do without, in small or large letters if it begins with (?Ui)."""
    named = F.col("text").rlike(word) if word.startswith("(?") else F.contains("text", F.lit(word))
    return blocks.where(F.col("block_type").isin(*SCANNED) & named).withColumn("text", T.collapse(F.col("text")))


def _phrases(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(text, F.lit(f"({pattern})" if not pattern.startswith("(?U") else pattern[: pattern.index(")") + 1] + "(" + pattern[pattern.index(")") + 1 :] + ")"), F.lit(1))


def _mentions(blocks: DataFrame, pattern: str, number: str) -> DataFrame:
    found = blocks.select("doc_id", "pos", F.explode(_phrases(F.col("text"), pattern)).alias("literal"))
    return found.withColumn("number", F.explode(F.regexp_extract_all("literal", F.lit(f"({number})"), F.lit(1))))


def section_mentions(blocks: DataFrame) -> DataFrame:
    """doc_id, pos, literal, number of every section or appendix a block names; a list of sections gives one row each."""
    one = _mentions(scanned(blocks, "Section"), ONE_SECTION, NUMBER)
    many = _mentions(scanned(blocks, "Sections"), MANY_SECTIONS, NUMBER)
    appendix = scanned(blocks, "Appendix").select("doc_id", "pos", F.explode(_phrases(F.col("text"), APPENDIX)).alias("literal")).withColumn("number", F.regexp_extract("literal", r"([A-Z])$", 1))
    return one.unionByName(many).unionByName(appendix)


def section_references(blocks: DataFrame, sections: DataFrame) -> DataFrame:
    """The mentions whose number a section of the document has; of sections of one number the last counts."""
    target = sections.groupBy(F.col("doc_id").alias("d_"), F.lower("number").alias("n_")).agg(F.max_by("section_id", "pos").alias("target_id"))
    found = section_mentions(blocks).join(target, (F.col("doc_id") == F.col("d_")) & (F.lower("number") == F.col("n_")))
    return found.select("doc_id", "pos", "literal", "target_id").distinct()


def page_references(blocks: DataFrame, pages: DataFrame) -> DataFrame:
    """Mentions of a printed page label that a page of the document has: doc_id, pos, literal, page_id."""
    found = scanned(blocks, "(?Ui)printed").select("doc_id", "pos", F.explode(_phrases(F.col("text"), PRINTED_PAGE)).alias("literal"))
    found = found.withColumn("l_", F.lower(F.regexp_extract("literal", r"(\S+)$", 1)))
    target = pages.groupBy(F.col("doc_id").alias("d_"), F.lower("label").alias("t_")).agg(F.max_by("page_id", "page_id").alias("page_id"))
    return found.join(target, (F.col("doc_id") == F.col("d_")) & (F.col("l_") == F.col("t_"))).select("doc_id", "pos", "literal", "page_id").distinct()


def url_references(blocks: DataFrame) -> DataFrame:
    """doc_id, pos, url: the distinct web addresses of a block, without closing punctuation."""
    found = scanned(blocks, "http").select("doc_id", "pos", F.explode(_phrases(F.col("text"), URL)).alias("url"))
    return found.withColumn("url", F.rtrim("url", F.lit(".,;:"))).distinct()


def unresolved_mentions(blocks: DataFrame) -> DataFrame:
    """doc_id, pos, literal, task_id of documents named with a version, which no corpus table can resolve."""
    found = scanned(blocks, "Version").select("doc_id", "pos", F.explode(_phrases(F.col("text"), VERSIONED)).alias("literal")).distinct()
    return found.withColumn("task_id", T.stable_id(F.col("doc_id"), F.col("pos"), F.col("literal"), F.lit("cross_document_reference")))


def link_blocks(links: DataFrame, blocks: DataFrame) -> DataFrame:
    """Each link (doc_id, page, link_id, box) with ``pos`` of the smallest block its box overlaps, the first of equals."""
    b = blocks.select(F.col("doc_id").alias("d_"), F.col("page").alias("p_"), F.col("pos").alias("b_pos"), F.col("box").alias("b_box"))
    found = links.join(b, (F.col("doc_id") == F.col("d_")) & (F.col("page") == F.col("p_")) & G.overlaps(F.col("box"), F.col("b_box")))
    return found.groupBy("doc_id", "page", "link_id").agg(F.min_by("b_pos", F.struct(G.area(F.col("b_box")), F.col("b_pos"))).alias("pos"))


def covered(inner: DataFrame, outer: DataFrame, least: float = 1.0) -> DataFrame:
    """The rows of ``inner`` whose box shares more than ``least`` on both axes with a box of ``outer`` on the page."""
    o = outer.select(F.col("doc_id").alias("d_"), F.col("page").alias("p_"), F.col("box").alias("o_box"))
    return inner.join(o, (F.col("doc_id") == F.col("d_")) & (F.col("page") == F.col("p_")) & G.overlaps(F.col("box"), F.col("o_box"), least), "left_semi")


def figure_captions(figures: DataFrame, captions: DataFrame) -> DataFrame:
    """Each figure with the caption below its top whose top is nearest to its bottom, the first of equals."""
    c = captions.select(F.col("doc_id").alias("d_"), F.col("page").alias("p_"), F.col("pos").alias("c_pos"), F.col("box.y0").alias("top"))
    found = figures.join(c, (F.col("doc_id") == F.col("d_")) & (F.col("page") == F.col("p_")) & (F.col("top") >= F.col("box.y0")))
    return found.groupBy("doc_id", "page", "pos").agg(F.min_by("c_pos", F.struct(F.abs(F.col("top") - F.col("box.y1")), F.col("c_pos"))).alias("caption_pos"))


def deepest_owner(members: DataFrame) -> DataFrame:
    """For each (doc_id, block) the section of the greatest level, and whether several have it (``tied``)."""
    deepest = members.withColumn("d_", F.max("level").over(Window.partitionBy("doc_id", "block"))).where("level = d_")
    return deepest.groupBy("doc_id", "block").agg(F.min("section").alias("section"), (F.count_distinct("section") > 1).alias("tied"))
