"""Mixing sources to target weights by systematic sampling.

Each source has a target weight, given or by default the power ``ALPHA`` = 0.5 of
its characters, which lifts small sources and lowers large ones.  The mixture has
as many characters as the input, shared out by the weights, so every document of a
source has the same expected number of copies.  Documents of a source stand in the
order of doc_id (then of the text's hash); their expected copies are summed up to
each of them, one offset drawn for the source is added, and a document is emitted
once for each whole number that the sum crosses.  As the documents of a source have
equal expected copies, the sum up to one is its place times that; places are counted
in range partitions, so a source that holds most of the corpus is not one task, and
sums are decimals in units of 1 / UNIT copies, the same on any cluster and at any size.

Defined results: a null source is a source of its own; a null or empty text counts
as one character; a null doc_id stands first; rows that repeat in all of doc_id,
source and text stand beside each other and share what falls to them, in any order
among themselves; a source with weight 0 or without a given weight gives no row; an
empty table gives an empty result; other columns pass through under any name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tracewell.plans.lineage import fresh, written
from tracewell.plans.sequence import running_sum

ALPHA = 0.5
SEED = 20
UNIT = 100_000_000


def _weight(source: Column, size: Column, weights: dict[str, float] | None, alpha: float) -> Column:
    """The target weight as an integer, so that the total does not depend on the order of adding."""
    if weights is None:
        return F.floor(F.pow(size.cast("double"), F.lit(alpha)) * 1000).cast("bigint") if alpha != 0.5 else F.floor(F.sqrt(size.cast("double")) * 1000).cast("bigint")
    given = F.create_map(*[x for k, v in weights.items() for x in (F.lit(k), F.lit(round(v * 1e6)))]) if weights else None
    return F.coalesce(given[source] if given is not None else F.lit(None), F.lit(0)).cast("bigint")


def rates(narrow: DataFrame, weights: dict[str, float] | None = None, alpha: float = ALPHA, seed: int = SEED) -> DataFrame:
    """source, rate (expected copies of each document) and start (the offset), both in units of 1 / UNIT."""
    sizes = narrow.groupBy("source").agg(F.sum("chars").alias("size"))
    sizes = sizes.withColumn("w", _weight(F.col("source"), F.col("size"), weights, alpha))
    total = sizes.agg(F.sum("size").cast("double").alias("all_size"), F.sum("w").cast("double").alias("all_w"))
    share = (F.col("w").cast("double") * F.col("all_size")) / (F.nullif(F.col("all_w"), F.lit(0.0)) * F.col("size").cast("double"))
    draw = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.concat(F.lit("s"), "source"), F.lit("null"))).cast("binary")), 1, 8), 16, 10).cast("bigint") % UNIT
    return sizes.crossJoin(F.broadcast(total)).select("source", F.coalesce(F.floor(share * UNIT), F.lit(0)).cast("bigint").alias("rate"), draw.alias("start"))


def plan(documents: DataFrame, weights: dict[str, float] | None = None, alpha: float = ALPHA, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """source, doc_id, text_hash, n (equal rows), rate, start, place (rows of the source before the first of them)."""
    narrow = documents.select(F.col(source_col).alias("source"), F.col(id_col).alias("doc_id"), F.coalesce(F.xxhash64(F.col(text_col)), F.lit(0)).alias("text_hash"), F.greatest(F.coalesce(F.length(F.col(text_col)), F.lit(0)), F.lit(1)).cast("bigint").alias("chars"))
    narrow = written(narrow, "mix")
    rate = rates(narrow, weights, alpha, seed)
    rows = narrow.groupBy("source", "doc_id", "text_hash").agg(F.count("*").alias("n"))
    summed = running_sum(rows, "source", ["doc_id", "text_hash"], "n", "upto", "mix")
    placed = summed.select("source", "doc_id", "text_hash", "n", (F.col("upto") - F.col("n")).alias("place"))
    return placed.join(rate.withColumnRenamed("source", "source_"), F.col("source").eqNullSafe(F.col("source_"))).drop("source_")


def _crossed(start: Column, rate: Column, place: Column) -> Column:
    """Whole numbers crossed by the sum over the first ``place`` rows of a source."""
    return (start.cast("decimal(20,0)") + place.cast("decimal(19,0)") * rate.cast("decimal(18,0)")).cast("decimal(38,0)")


def _copies(start: Column, rate: Column, place: Column, n: Column) -> Column:
    """Copies of the ``n`` rows from ``place`` on."""
    one, two = (F.floor(_crossed(start, rate, p) / F.lit(UNIT)) for p in (place, place + n))
    return (two - one).cast("int")


def copies(documents: DataFrame, **options) -> DataFrame:
    """doc_id, source, copy (from 1): one row for each document of the mixture."""
    rows = plan(documents, **options)
    rows = rows.withColumn("k", _copies(F.col("start"), F.col("rate"), F.col("place"), F.col("n"))).where("k > 0")
    return rows.select("doc_id", "source", F.explode(F.sequence(F.lit(1), F.col("k"))).alias("copy"))


def mix(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """The documents of the mixture with their own columns, one row per copy; one shuffle of the texts at most."""
    key, nth, many, *own = fresh(documents, "text_hash", "nth", "copies", "m_source", "m_id", "m_hash", "m_rate", "m_start", "m_place")
    rows = plan(documents, id_col=id_col, text_col=text_col, source_col=source_col, **options)
    rows = rows.where(_copies(F.col("start"), F.col("rate"), F.col("place"), F.col("n")) > 0)
    rows = rows.select(*[F.col(c).alias(name) for c, name in zip(("source", "doc_id", "text_hash", "rate", "start", "place"), own)])
    source, doc_id, text_hash, rate, start, place = map(F.col, own)
    docs = documents.withColumn(key, F.coalesce(F.xxhash64(F.col(text_col)), F.lit(0)))
    docs = docs.withColumn(nth, F.row_number().over(Window.partitionBy(source_col, id_col, key).orderBy(F.lit(1))).cast("bigint"))
    same = F.col(source_col).eqNullSafe(source) & F.col(id_col).eqNullSafe(doc_id) & (F.col(key) == text_hash)
    joined = docs.join(rows, same).withColumn(many, _copies(start, rate, place + F.col(nth) - 1, F.lit(1))).where(F.col(many) > 0)
    return joined.withColumn(many, F.explode(F.sequence(F.lit(1), F.col(many)))).select(*[F.col(f"`{c}`") for c in documents.columns])


SQL = f"""
WITH d AS (SELECT source, doc_id, greatest(coalesce(length(text), 0), 1) AS chars FROM documents),
s AS (SELECT source, sum(chars) AS size, CAST(floor(sqrt(CAST(sum(chars) AS DOUBLE)) * 1000) AS BIGINT) AS w FROM d GROUP BY source),
t AS (SELECT CAST(sum(size) AS DOUBLE) AS all_size, CAST(sum(w) AS DOUBLE) AS all_w FROM s),
r AS (SELECT source, CAST(floor((CAST(w AS DOUBLE) * all_size) / (all_w * CAST(size AS DOUBLE)) * {UNIT}) AS BIGINT) AS rate,
  CAST('0x' || substr(md5('{SEED}:' || coalesce('s' || source, 'null')), 1, 8) AS BIGINT) % {UNIT} AS start FROM s, t),
p AS (SELECT doc_id, d.source, rate, start + sum(rate) OVER (PARTITION BY d.source ORDER BY doc_id ROWS UNBOUNDED PRECEDING) AS upto
  FROM d JOIN r ON d.source IS NOT DISTINCT FROM r.source)
SELECT doc_id, source, CAST(unnest(range(1, CAST(upto // {UNIT} - (upto - rate) // {UNIT} AS BIGINT) + 1)) AS INTEGER) AS copy FROM p
"""
