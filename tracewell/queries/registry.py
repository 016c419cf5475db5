"""Names of queries, and the tables that they are made over."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a query under its function's name, with its SQL."""

    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Bytes of a table, as it stands in its files, for each task of :func:`spread`.
SPREAD_BYTES = 4_000_000


def spread(rows: DataFrame, key: str) -> DataFrame:
    """The rows of a table hashed by ``key`` into tasks that stay as small whatever the size of the table.

    What is made of the rows of a key then stands in one task, so windows and groups
    within keys are not shuffled any more.
    """
    size = int(rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return rows.repartition(max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), size // SPREAD_BYTES), key)


def lines(spark: SparkSession, sf_dir: str, by_document: bool = False) -> DataFrame:
    """doc_id, pos, line of the non-blank lines of documents; ``pos`` counts blank ones. ``by_document`` spreads them."""
    documents = table(spark, sf_dir, "documents")
    documents = spread(documents, "doc_id") if by_document else documents
    return documents.select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line")).where("trim(line) <> ''")


#: The same rows in DuckDB, as common table expression ``l``.
LINES = """a AS (SELECT doc_id, string_split(text, chr(10)) AS x FROM documents),
b AS (SELECT doc_id, CAST(unnest(range(len(x))) AS INTEGER) AS pos, unnest(x) AS line FROM a),
l AS (SELECT * FROM b WHERE trim(line) <> '')"""


def sid(*parts: str) -> str:
    """DuckDB for ``stable_id`` of expressions that are never null."""
    return "substr(sha256(" + " || chr(31) || ".join(f"CAST({p} AS VARCHAR)" for p in parts) + "), 1, 16)"
