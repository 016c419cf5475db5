"""Command line over the stores: ingest files, list runs and documents, read tables, follow events, show retention.

Results go out as JSON lines, or for people with ``--human``.
"""

from __future__ import annotations

import argparse
import sys
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.functions import text as T
from tracewell.human import render
from tracewell.operators import documents
from tracewell.sources import artifacts, files, parsers
from tracewell.streaming import events

#: Which table of a built document is stored under which name.
STORED = {"document": "blocks", "canonical": "nodes", "provenance": "relations", "evidence": "evidence", "graph": "graph_edges", "addresses": "graph_nodes"}


def ingest(spark: SparkSession, folder: str, root: str, run: str, mode: str, candidates: tuple[str, ...], suffix: str) -> DataFrame:
    """Scan, parse and build the files of a folder and store their tables; one row per file with its status."""
    found = files.scan(spark, folder, suffix)
    taken = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).join(found.where("status = 'accepted'").select("path"), "path", "left_semi")
    pages = parsers.route(taken, mode, candidates)
    ids = pages.withColumn("doc_id", T.stable_id(F.col("path")))
    lines = ids.where("error is null").select("doc_id", "page", F.posexplode(F.split("text", r"\R")).alias("line", "text")).where(T.strip(F.col("text")) != "")
    blocks = lines.select("doc_id", "page", (F.shiftleft(F.col("page").cast("bigint"), 32) + F.col("line")).alias("pos"), "text", F.lit("text").alias("observed_type"))
    made = documents.build(blocks)
    for name, table in STORED.items():
        artifacts.put(made[table], root, name, run)
    failed = ids.groupBy("path").agg(F.bool_or(F.col("error").isNotNull()).alias("bad"), F.first("doc_id").alias("doc_id"))
    out = found.join(failed, "path", "left")
    return out.select("path", "doc_id", "sha256", F.when(F.col("status") != "accepted", F.concat(F.lit("skipped_"), "status")).when(F.col("bad"), "failed").otherwise("ingested").alias("status"))


def _parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="tracewell", description=__doc__)
    top.add_argument("--human", action="store_true")
    commands = top.add_subparsers(dest="command", required=True)
    one = commands.add_parser("ingest")
    one.add_argument("folder")
    one.add_argument("root")
    one.add_argument("--run", required=True)
    one.add_argument("--mode", choices=("fixed", "fallback", "compare"), default="fixed")
    one.add_argument("--parser", action="append", dest="candidates")
    one.add_argument("--suffix", default=".pdf")
    for name in ("documents", "artifact"):
        one = commands.add_parser(name)
        one.add_argument("root")
        one.add_argument("--run", required=True)
        if name == "artifact":
            one.add_argument("name", choices=artifacts.NAMES)
    one = commands.add_parser("events")
    one.add_argument("log")
    one.add_argument("--after", type=int, default=0)
    one = commands.add_parser("retention")
    one.add_argument("log")
    return top


def main(argv: Sequence[str] | None = None, spark: SparkSession | None = None) -> int:
    """Run a command; rows stream through the driver one partition at a time."""
    given = _parser().parse_args(argv)
    spark = spark or SparkSession.builder.getOrCreate()
    if given.command == "ingest":
        rows = ingest(spark, given.folder, given.root, given.run, given.mode, tuple(given.candidates or ("pdf",)), given.suffix)
    elif given.command == "documents":
        rows = artifacts.read(spark, given.root, "document", given.run).groupBy("doc_id").agg(F.count("*").alias("blocks"))
    elif given.command == "artifact":
        rows = artifacts.read(spark, given.root, given.name, given.run)
    elif given.command == "events":
        rows = events.follow(spark, given.log, given.after)
    else:
        rows = events.state_of(spark, given.log)
    if given.human:
        print(render([r.asDict(True) for r in rows.toLocalIterator()]))
    else:
        names = F.struct(*[F.col(f"`{c}`") for c in rows.columns])
        for row in rows.select(F.to_json(names).alias("line")).toLocalIterator():
            print(row.line)
    return 0


if __name__ == "__main__":
    sys.exit(main())
