"""Segmentation views: segments hold node ids and half-open character spans, never text.

Spans are long: strategy, segment_id, role (span, seed, context, retrieval, return),
ord, node_id, char_start, char_end.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewell.operators.hierarchy import closure


def _id(strategy: str, order: Column) -> Column:
    return F.concat(F.lit(f"{strategy}:"), F.col("doc_id").cast("string"), F.format_string(":%06d", order.cast("int")))


def _number(*order: str) -> Column:
    return F.row_number().over(Window.partitionBy("doc_id").orderBy(*order))


def _span(strategy: str, role: str) -> list[Column]:
    return [F.lit(strategy).alias("strategy"), "segment_id", F.lit(role).alias("role"), "ord", "node_id", "char_start", "char_end"]


def paragraphs(nodes: DataFrame) -> DataFrame:
    """One whole-node segment per paragraph node (doc_id, sequence_number, node_id, node_kind, n_chars)."""
    rows = nodes.where("node_kind = 'paragraph'").withColumn("segment_id", _id("paragraph", _number("sequence_number")))
    return rows.select(*_span_whole("paragraph", "span"))


def _span_whole(strategy: str, role: str, order: Column | None = None) -> list[Column]:
    return [F.lit(strategy).alias("strategy"), F.col("segment_id"), F.lit(role).alias("role"), (order if order is not None else F.lit(0)).cast("int").alias("ord"), F.col("node_id"), F.lit(0).alias("char_start"), F.col("n_chars").alias("char_end")]


def direct_divisions(nodes: DataFrame) -> DataFrame:
    """One segment per division that has nodes of its own (division_id), headings included, subdivisions not."""
    first = F.min("sequence_number").over(Window.partitionBy("doc_id", "division_id"))
    rows = nodes.where("division_id is not null").withColumn("first_", first)
    rows = rows.withColumn("segment_id", _id("direct-division", F.dense_rank().over(Window.partitionBy("doc_id").orderBy("first_"))))
    return rows.select(*_span_whole("direct-division", "span", F.row_number().over(Window.partitionBy("doc_id", "division_id").orderBy("sequence_number")) - 1))


def native_structure(native: DataFrame, nodes: DataFrame) -> DataFrame:
    """Segments that a parser gave: (doc_id, pointer, ord, node_id) in pointer order, with whole nodes."""
    rows = native.join(nodes.select("node_id", "n_chars"), "node_id")
    rows = rows.withColumn("segment_id", _id("parser-native", F.dense_rank().over(Window.partitionBy("doc_id").orderBy("pointer"))))
    return rows.select(*_span_whole("parser-native", "span", F.col("ord")))


def _pack(limit: int):
    """The segment number of each sentence of a document, from the sentences' tokens in order."""

    def pack(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            out = []
            for tokens in batch.to_pylist():
                segment, filled, own = 0, 0, []
                for t in tokens:
                    if filled and filled + t > limit:
                        segment, filled = segment + 1, 0
                    own.append(segment)
                    if t > limit:
                        segment += 1
                    else:
                        filled += t
                out.append(own)
            yield pa.array(out, pa.list_(pa.int32()))

    return pack


def packed(sentences: DataFrame, limit: int, tokens: str = "tokens") -> DataFrame:
    """Sentences (doc_id, pos, node_id, char_start, char_end, tokens) with the number of their fixed-size segment.

    A segment closes before a sentence that would take it over ``limit``; a sentence
    of more than ``limit`` tokens is a segment of its own.  Segments run on over nodes.
    The fold is linear in a document's sentences; a fold of array expressions would
    copy the numbers so far at each of them.
    """
    row = F.struct("pos", *[c for c in sentences.columns if c not in ("doc_id", "pos")])
    docs = sentences.groupBy("doc_id").agg(F.sort_array(F.collect_list(row)).alias("s_"))
    numbers = F.arrow_udf(_pack(limit), "array<int>")(F.transform("s_", lambda s: s[tokens].cast("bigint")))
    both = docs.withColumn("g_", numbers).select("doc_id", F.explode(F.arrays_zip("s_", "g_")).alias("z_"))
    return both.select("doc_id", "z_.s_.*", F.col("z_.g_").alias("segment"))


def fixed_size(sentences: DataFrame, limit: int) -> DataFrame:
    """Sentence-safe segments of at most ``limit`` tokens as spans."""
    rows = packed(sentences, limit).withColumn("segment_id", _id("fixed-size", F.col("segment") + 1))
    rows = rows.withColumn("ord", F.row_number().over(Window.partitionBy("segment_id").orderBy("pos")) - 1)
    return rows.select(*_span("fixed-size", "span"))


def sentence_windows(nodes: DataFrame, before: int = 1, after: int = 1) -> DataFrame:
    """For each paragraph a seed and the paragraphs around it as context, fewer at the ends of the document."""
    rows = nodes.where("node_kind = 'paragraph'").withColumn("i_", _number("sequence_number"))
    seeds = rows.select("doc_id", F.col("i_").alias("seed"), F.explode(F.sequence(F.lit(-before), F.lit(after))).alias("d_"))
    near = seeds.join(rows, [seeds["doc_id"] == rows["doc_id"], F.col("i_") == F.col("seed") + F.col("d_")]).drop(seeds["doc_id"])
    near = near.withColumn("segment_id", _id("sentence-window", F.col("seed")))
    role = F.when(F.col("d_") == 0, "seed").otherwise("context")
    return near.select(F.lit("sentence-window").alias("strategy"), "segment_id", role.alias("role"), (F.row_number().over(Window.partitionBy("segment_id").orderBy("i_")) - 1).alias("ord"), "node_id", F.lit(0).alias("char_start"), F.col("n_chars").alias("char_end"))


def parent_child(nodes: DataFrame, divisions: DataFrame) -> DataFrame:
    """Retrieve a paragraph, return the text of its division and all below it. ``divisions``: division_id, parent_division_id."""
    below = closure(divisions, "division_id", "parent_division_id").select(F.col("root").alias("r_"), F.col("node").alias("b_"))
    seeds = nodes.where("node_kind = 'paragraph' and division_id is not null").withColumn("segment_id", _id("parent-child", _number("sequence_number")))
    retrieval = seeds.select(*_span_whole("parent-child", "retrieval"))
    members = nodes.select(F.col("division_id").alias("m_"), "sequence_number", "node_id", "n_chars")
    returned = seeds.select("segment_id", "division_id").join(below, F.col("division_id") == F.col("r_")).join(members, F.col("b_") == F.col("m_"))
    order = F.row_number().over(Window.partitionBy("segment_id").orderBy("sequence_number", "node_id")) - 1
    return retrieval.unionByName(returned.select(*_span_whole("parent-child", "return", order)))


def reconstruct(spans: DataFrame, nodes: DataFrame, separator: str = "\n") -> DataFrame:
    """segment_id, text: the spans' text in order, of retrieval and span roles alike."""
    cut = F.substring(F.col("text"), F.col("char_start") + 1, F.col("char_end") - F.col("char_start"))
    rows = spans.join(nodes.select("node_id", "text"), "node_id").select("segment_id", F.struct("ord", cut.alias("t")).alias("s_"))
    return rows.groupBy("segment_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list("s_")), lambda s: s["t"]), separator).alias("text"))


#: The roles that spans of a strategy have.
ROLES = {"paragraph": ("span",), "direct-division": ("span",), "parser-native": ("span",), "fixed-size": ("span",), "sentence-window": ("seed", "context"), "parent-child": ("retrieval", "return")}


def violations(spans: DataFrame, nodes: DataFrame) -> DataFrame:
    """segment_id, ord, rule of spans without a node, out of its text, empty, overlapping the one before in their
    node, of a role their strategy has not, or out of the count from 0 within their segment (and role, of parent-child)."""
    rows = spans.join(nodes.select(F.col("node_id").alias("n_"), "n_chars"), F.col("node_id") == F.col("n_"), "left")
    before = F.lag("char_end").over(Window.partitionBy("segment_id", "role", "node_id").orderBy("ord"))
    counted = F.when(F.col("strategy") == "parent-child", F.col("role")).otherwise("")
    rows = rows.withColumn("before_", before).withColumn("nth_", F.row_number().over(Window.partitionBy("segment_id", counted).orderBy("ord", "node_id")) - 1)
    known = F.concat("strategy", F.lit(" "), "role").isin(*[f"{s} {r}" for s, roles in ROLES.items() for r in roles])
    rules = [("missing_node", F.col("n_").isNull()), ("outside_text", F.col("char_end") > F.col("n_chars")), ("empty_span", F.col("char_start") >= F.col("char_end")), ("overlap", F.col("before_") > F.col("char_start")), ("role", ~known), ("order", F.col("ord") != F.col("nth_"))]
    found = F.array(*[F.when(broken, rule) for rule, broken in rules])
    return rows.select("segment_id", "ord", F.explode(F.filter(found, lambda r: r.isNotNull())).alias("rule"))


def window_violations(spans: DataFrame, nodes: DataFrame, before: int = 1, after: int = 1) -> DataFrame:
    """segment_id, node_id, rule of window spans that are not a seed's exact neighbours (``extra``) and of neighbours that have none (``missing``)."""
    columns = ["segment_id", "role", "ord", "node_id", "char_start", "char_end"]
    given, wanted = spans.select(*columns), sentence_windows(nodes, before, after).select(*columns)
    extra, missing = given.exceptAll(wanted), wanted.exceptAll(given)
    return extra.select("segment_id", "node_id", F.lit("extra").alias("rule")).unionByName(missing.select("segment_id", "node_id", F.lit("missing").alias("rule")))


def digest_violations(spans: DataFrame, recorded: DataFrame) -> DataFrame:
    """strategy, cache_id, recorded of views whose spans are not those their record (strategy, cache_id) was made of, or that have no record."""
    was = recorded.select(F.col("strategy").alias("s_"), F.col("cache_id").alias("recorded"))
    return cache_identity(spans).join(was, F.col("strategy") == F.col("s_"), "left").where("recorded is null or recorded <> cache_id").select("strategy", "cache_id", "recorded")


def cache_identity(spans: DataFrame) -> DataFrame:
    """strategy, cache_id: the SHA-256 of a view's spans, whatever order its rows come in.

    Segments are hashed first, then put together by the first two bytes of the hash, so
    no task holds more than the hashes of a 65,536th of a view's segments.
    """
    row = F.concat_ws("\x1f", "segment_id", "role", F.format_string("%06d", F.col("ord")), "node_id", "char_start", "char_end")
    per_segment = spans.groupBy("strategy", "segment_id").agg(F.sha2(F.array_join(F.sort_array(F.collect_list(row)), "\x1e"), 256).alias("h"))
    parts = per_segment.groupBy("strategy", F.substring("h", 1, 4).alias("b")).agg(F.sha2(F.array_join(F.sort_array(F.collect_list("h")), ""), 256).alias("p"))
    return parts.groupBy("strategy").agg(F.sha2(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("b", "p"))), lambda x: x["p"]), ""), 256).alias("cache_id"))


def all_views(*views: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, views)
