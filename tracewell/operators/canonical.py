"""Text stored once: content nodes with exact hashes, selectors, owners, and checks of the tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewell.functions import text as T

UNSETTLED = tuple("ambiguous contradicted unresolved rejected".split())


def content_nodes(blocks: DataFrame, *kept: str) -> DataFrame:
    """Nodes of the non-empty blocks: node_id, doc_id, sequence_number, text, text_sha256, char_start, char_end, and columns ``kept``.

    An empty block makes no node but keeps its sequence number.  The selector is the
    half-open span in the document that joins all blocks with line feeds, in characters.
    """
    before = Window.partitionBy("doc_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.length("text") + 1).over(before), F.lit(0)).cast("bigint")
    rows = blocks.withColumn("char_start", start).withColumn("sequence_number", F.row_number().over(Window.partitionBy("doc_id").orderBy("pos")) - 1)
    rows = rows.where(F.length(T.strip(F.col("text"))) > 0).withColumn("char_end", F.col("char_start") + F.length("text"))
    return rows.select(T.stable_id(F.col("doc_id"), F.col("sequence_number")).alias("node_id"), "doc_id", "pos", "sequence_number", "text", F.sha2("text", 256).alias("text_sha256"), "char_start", "char_end", *kept)


def node_violations(nodes: DataFrame, sources: DataFrame) -> DataFrame:
    """node_id, rule of nodes whose hash is not their text's or whose span is not their text in ``sources`` (doc_id, source_text)."""
    rows = nodes.join(sources, "doc_id", "left")
    cut = F.substring(F.col("source_text"), (F.col("char_start") + 1).cast("int"), (F.col("char_end") - F.col("char_start")).cast("int"))
    rules = F.array(F.when(F.sha2("text", 256) != F.col("text_sha256"), "text_sha256"), F.when(~cut.eqNullSafe(F.col("text")), "selector"))
    return rows.select("node_id", F.explode(F.filter(rules, lambda r: r.isNotNull())).alias("rule"))


def epistemic_state(status: Column, method: Column) -> Column:
    """How far a relation is to be trusted, from its audit status and method."""
    status, method = F.lower(status), F.lower(method)
    return (
        F.when(status.isin(*UNSETTLED), status)
        .when(method.contains("human"), "human-validated")
        .when(method.contains("model") | method.contains("inference"), "model-inferred")
        .when(method.contains("parser") | (status == "observed"), "parser-inferred")
        .otherwise("deterministically-derived")
    )


def dangling(table: DataFrame, name: str, key: str, references: list[tuple[str, DataFrame, str]]) -> DataFrame:
    """table, key, column, value of every non-null reference without a target."""
    found = []
    for column, target, target_key in references:
        ids = target.select(F.col(target_key).alias("t_")).distinct()
        bad = table.where(F.col(column).isNotNull()).join(ids, F.col(column) == F.col("t_"), "left_anti")
        found.append(bad.select(F.lit(name).alias("table_name"), F.col(key).cast("string").alias("row_key"), F.lit(column).alias("column_name"), F.col(column).cast("string").alias("value")))
    return reduce(DataFrame.unionByName, found)


def duplicate_ids(table: DataFrame, key: str) -> DataFrame:
    """Ids that several rows have, and how many."""
    return table.groupBy(key).agg(F.count("*").alias("n")).where("n > 1")


def order_violations(table: DataFrame, group: str, pos: str, key: str) -> DataFrame:
    """Rows whose key is not above the one before in their group."""
    before = F.lag(key).over(Window.partitionBy(group).orderBy(pos, key))
    return table.withColumn("previous_key", before).where(F.col("previous_key") >= F.col(key)).select(group, pos, key, "previous_key")


def owner_violations(owners: DataFrame) -> DataFrame:
    """Nodes that not exactly one division owns. In: node_id, division_id (null for none)."""
    return owners.groupBy("node_id").agg(F.count("division_id").alias("owners")).where("owners <> 1")


def unreciprocated(parents: DataFrame, children: DataFrame) -> DataFrame:
    """Pairs that only one side names: child_id, parent_id, side that lacks it."""
    p, c = parents.where("parent_id is not null").select("child_id", "parent_id"), children.select("child_id", "parent_id")
    return p.exceptAll(c).withColumn("missing_in", F.lit("children")).union(c.exceptAll(p).withColumn("missing_in", F.lit("parents")))
