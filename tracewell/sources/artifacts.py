"""Sinks and stores that never change what they hold: tables by name, documents as JSON lines, native payloads."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.functions import text as T
from tracewell.operators import graph

NAMES = ("document", "evidence", "observations", "fusion", "native", "canonical", "graph", "addresses", "provenance")


class Conflict(ValueError):
    """Something else is already stored under a name or id."""


def content_hash(table: DataFrame) -> str:
    """A hash of a table's rows that does not depend on their order."""
    row = F.sha2(F.to_json(F.struct(*[F.col(f"`{c}`") for c in sorted(table.columns)]), {"ignoreNullFields": "false"}), 256)
    bits = [F.sum(F.conv(F.substring(row, 1 + 15 * k, 15), 16, 10).cast("decimal(38,0)")).alias(f"s{k}") for k in range(4)]
    found = table.agg(F.count("*").alias("n"), *bits).first()
    return "-".join(str(v or 0) for v in found)


def _exists(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)


def _moved(spark: SparkSession, source: str, target: str) -> bool:
    """Rename a folder to a place where nothing is, in one step; False if something has come there first."""
    one, two = (spark._jvm.org.apache.hadoop.fs.Path(p) for p in (source, target))
    files = one.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    files.mkdirs(two.getParent())
    return not files.exists(two) and files.rename(one, two) and not _exists(spark, f"{target}/{one.getName()}")


def _removed(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def put(table: DataFrame, root: str, name: str, run: str) -> bool:
    """Store a table of a run; storing the same rows again changes nothing, others raise :class:`Conflict`.

    Rows are written beside the place and moved there whole, so nobody reads half a table
    and of two writers one finds the other's.
    """
    if name not in NAMES:
        raise ValueError(f"no artifact is called {name}")
    path = f"{root}/{run}/{name}"
    if _exists(table.sparkSession, f"{path}/_SUCCESS"):
        if content_hash(read(table.sparkSession, root, name, run)) != content_hash(table):
            raise Conflict(path)
        return False
    spark, draft = table.sparkSession, f"{root}/{run}/_{name}-{uuid.uuid4().hex}"
    table.write.parquet(draft)
    if _moved(spark, draft, path):
        return True
    try:
        if content_hash(read(spark, root, name, run)) != content_hash(spark.read.schema(table.schema).parquet(draft)):
            raise Conflict(path)
    finally:
        _removed(spark, draft)
        _removed(spark, f"{path}/{draft.rsplit('/', 1)[1]}")
    return False


def read(spark: SparkSession, root: str, name: str, run: str) -> DataFrame:
    """A stored table."""
    if name not in NAMES:
        raise ValueError(f"no artifact is called {name}")
    return spark.read.parquet(f"{root}/{run}/{name}")


def write_json(table: DataFrame, path: str, key: str = "doc_id", buckets: int = 64) -> None:
    """One JSON line per row in ``buckets`` folders by the key's hash, never a folder per document."""
    line = F.to_json(F.struct(*[F.col(f"`{c}`") for c in table.columns]))
    table.select(F.pmod(F.hash(key), F.lit(buckets)).alias("bucket"), line.alias("value")).write.mode("errorifexists").partitionBy("bucket").text(path)


def nested(documents: DataFrame, *children: tuple[str, DataFrame]) -> DataFrame:
    """Documents with each child table's rows as an array, in the order of ``pos``."""
    out = documents
    for name, child in children:
        rest = [c for c in child.columns if c != "doc_id"]
        rows = child.groupBy(F.col("doc_id").alias("c_")).agg(F.sort_array(F.collect_list(F.struct("pos", *[c for c in rest if c != "pos"]))).alias(name))
        out = out.join(rows, F.col("doc_id") == F.col("c_"), "left").drop("c_")
    return out


def store_native(incoming: DataFrame, store: DataFrame) -> DataFrame:
    """Each incoming payload (artifact_id, payload, media_type) with status stored, unchanged or conflict, and its sha256."""
    known = store.select(F.col("artifact_id").alias("k_"), F.col("sha256").alias("h_"), F.col("media_type").alias("m_"))
    rows = incoming.withColumn("sha256", F.sha2("payload", 256)).join(known, F.col("artifact_id") == F.col("k_"), "left")
    same = (F.col("sha256") == F.col("h_")) & (F.col("media_type") == F.col("m_"))
    return rows.withColumn("status", F.when(F.col("k_").isNull(), "stored").when(same, "unchanged").otherwise("conflict")).drop("k_", "h_", "m_")


def put_native(incoming: DataFrame, folder: str) -> DataFrame:
    """Store payloads (artifact_id, payload, media_type) below ``folder`` and give their descriptors with ``status``.

    All or nothing: with a conflict among them nothing is stored and :class:`Conflict` says
    so.  A batch is written aside and moved in whole under a name made of its contents, so
    storing it again finds it there.
    """
    spark = incoming.sparkSession
    empty = spark.createDataFrame([], "artifact_id string, payload binary, media_type string, sha256 string, size int")
    there = _exists(spark, folder)
    store = spark.read.option("recursiveFileLookup", "true").schema(empty.schema).parquet(folder) if there else empty
    found = store_native(incoming, store)
    inside = incoming.groupBy("artifact_id").agg(F.count_distinct(F.struct("payload", "media_type")).alias("n")).where("n > 1")
    if (bad := found.where("status = 'conflict'").select("artifact_id").union(inside.select("artifact_id")).first()) is not None:
        raise Conflict(bad.artifact_id)
    new = found.where("status = 'stored'").dropDuplicates(["artifact_id"]).withColumn("size", F.octet_length("payload")).select(*empty.columns)
    if (count := new.count()) > 0:
        name = content_hash(new.select("artifact_id", "sha256", "media_type"))
        draft = f"{folder}-{uuid.uuid4().hex}"
        new.write.parquet(draft)
        if not _moved(spark, draft, f"{folder}/batch-{count}-{T.hex_of(name)}"):
            _removed(spark, draft)
    return found.select("artifact_id", "sha256", "media_type", F.octet_length("payload").alias("size"), "status")


def damaged(store: DataFrame) -> DataFrame:
    """Stored payloads whose bytes are not of their recorded size and hash."""
    return store.where((F.sha2("payload", 256) != F.col("sha256")) | (F.octet_length("payload") != F.col("size")))


def listing(documents: DataFrame) -> DataFrame:
    """run_id, doc_id: the distinct documents of each run."""
    return documents.select("run_id", "doc_id").distinct()


def runs(spark: SparkSession, root: str) -> DataFrame:
    """run_id, name of the tables stored below ``root``, from the names of folders alone."""
    where = spark._jvm.org.apache.hadoop.fs.Path(root)
    files = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    rows = [(run.getPath().getName(), t.getPath().getName()) for run in files.listStatus(where) if run.isDirectory() for t in files.listStatus(run.getPath()) if t.getPath().getName() in NAMES]
    return spark.createDataFrame(sorted(rows), "run_id string, name string")


def graph_of(spark: SparkSession, root: str, run: str, revision: str) -> DataFrame:
    """The stored graph of a run if it is exactly of this revision, else :class:`Conflict`."""
    table = read(spark, root, "graph", run)
    (now,) = graph.revision(("graph", table)).first()
    if now != revision:
        raise Conflict(f"the graph of {run} is {now}")
    return table
