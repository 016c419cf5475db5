"""The seam for parsers of binary files: plug-ins run in Arrow batches, chosen by one of four modes.

A plug-in takes the bytes of a file and gives pages as (label, text).  What goes wrong
in one makes a failed result, never a failed job.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.plans.lineage import written
from tracewell.sources import pdf

Parser = Callable[[bytes], list[tuple[str | None, str]]]
PAGES = "path string, parser_id string, page int, label string, text string, error string"


def plain_text(payload: bytes) -> list[tuple[str | None, str]]:
    """Pages of UTF-8 text, parted by form feeds."""
    return [(str(k + 1), page.strip()) for k, page in enumerate(payload.decode("utf-8").split("\f"))]


def pdf_text(payload: bytes) -> list[tuple[str | None, str]]:
    """Label and text of the pages of a PDF file."""
    return pdf.pages_of(payload)


PARSERS: dict[str, Parser] = {"text": plain_text, "pdf": pdf_text}


def parse(files: DataFrame, parser_id: str, parsers: dict[str, Parser] = PARSERS) -> DataFrame:
    """One row per page of each file (path, content), or one row with the error."""
    if parser_id not in parsers:
        raise ValueError(f"no parser is called {parser_id}")
    run = parsers[parser_id]

    def pages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist()):
                try:
                    rows += [(path, parser_id, k, label, text, None) for k, (label, text) in enumerate(run(content))]
                except Exception as error:  # a bad file is a result of its own
                    rows.append((path, parser_id, None, None, None, f"{type(error).__name__}: {error}"))
            columns = list(zip(*rows)) if rows else [()] * 6
            kinds = [pa.string(), pa.string(), pa.int32(), pa.string(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=["path", "parser_id", "page", "label", "text", "error"])

    return files.select("path", "content").mapInArrow(pages, PAGES)


def route(files: DataFrame, mode: str, candidates: tuple[str, ...], parsers: dict[str, Parser] = PARSERS) -> DataFrame:
    """Pages by the parsers that a mode chooses.

    ``fixed`` runs the first; ``fallback`` takes for each file the first that does
    not fail, running each only on what those before it left; ``compare`` gives the
    pages of all.
    """
    if mode == "fixed":
        return parse(files, candidates[0], parsers)
    if mode == "compare":
        return reduce(DataFrame.unionByName, [parse(files, c, parsers).where("error is null") for c in candidates])
    if mode != "fallback":
        raise ValueError(f"no mode is called {mode}")
    done, rest = [], files
    for c in candidates:
        # Written, since both what it read and what it left are used; a parser runs once on a file.
        now = written(parse(rest, c, parsers), "pages")
        done.append(now.where("error is null"))
        rest = rest.join(now.where("error is not null").select(F.col("path").alias("f_")).distinct(), F.col("path") == F.col("f_"), "left_semi")
    failed = now.where("error is not null")
    return reduce(DataFrame.unionByName, [*done, failed])


__all__ = ["PARSERS", "Parser", "parse", "pdf_text", "plain_text", "route"]
