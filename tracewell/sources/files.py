"""Sources: files under a folder, lines of text, blocks of HTML, and payloads of a layout parser."""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracewell.functions import geometry as G
from tracewell.functions import text as X

#: A parser payload: a list of items, each with a label, text, and places on pages.
PAYLOAD = "texts array<struct<label:string,text:string,prov:array<struct<page_no:int,bbox:string>>>>, pages int"
HEADINGS = ("title", "section_header", "heading")


ENTRY = "path string, relative_path string, length bigint, reason string"


def walk(spark: SparkSession, folder: str, recursive: bool = True, catalog: str | None = None, stores: tuple[str, ...] = ()) -> DataFrame:
    """Every entry below a folder of this machine: path, relative_path, length, reason.

    The reason is why it is left out: ``symlink`` (never followed), ``catalog`` (the
    catalog's own file or what stands beside it), ``storage_root`` (a folder of ``stores``),
    ``special_entry`` (neither file nor folder), or the name of the error that reading a
    folder gave; null for a file that may be taken.  Empty files are files.
    """
    roots, own = {os.path.realpath(s) for s in stores}, catalog and os.path.realpath(catalog)
    rows, todo = [], [(folder, "")]
    while todo:
        here, prefix = todo.pop()
        try:
            entries = list(os.scandir(here))
        except OSError as error:
            rows.append((here, prefix.rstrip("/") or os.path.basename(here), None, type(error).__name__))
            continue
        for entry in entries:
            name, real = prefix + entry.name, os.path.realpath(entry.path)
            if entry.is_symlink():
                rows.append((entry.path, name, None, "symlink"))
            elif entry.is_file(follow_symlinks=False):
                mine = own and (real == own or real.removeprefix(own) in ("-wal", "-shm", "-journal"))
                rows.append((entry.path, name, entry.stat().st_size, "catalog" if mine else None))
            elif not entry.is_dir(follow_symlinks=False):
                rows.append((entry.path, name, None, "special_entry"))
            elif real in roots:
                rows.append((entry.path, name, None, "storage_root"))
            elif recursive:
                todo.append((entry.path, name + "/"))
    return spark.createDataFrame(sorted(rows, key=lambda r: r[1]), ENTRY)


def scan(spark: SparkSession, folder: str, suffix: str = ".pdf") -> DataFrame:
    """Every file below a folder: path, length, modified, sha256, status (``accepted`` or the reason it is skipped).

    Spark's reader passes over empty files, so they are taken from the folder's listing,
    which is all that the driver sees of it, and get the status ``empty``.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    name = F.substring_index("path", "/", -1)
    status = F.when(name.startswith("."), "hidden").when(~F.lower("path").endswith(suffix), "unsupported_suffix").otherwise("accepted")
    found = files.select("path", "length", F.col("modificationTime").alias("modified"), F.sha2("content", 256).alias("sha256"), status.alias("status"))
    where = spark._jvm.org.apache.hadoop.fs.Path(folder)
    listed, bare = where.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).listFiles(where, True), []
    while listed.hasNext():
        one = listed.next()
        if one.getLen() == 0:
            bare.append((one.getPath().toString(), one.getModificationTime() / 1000))
    empty = spark.createDataFrame(bare, "path string, at double")
    empty = empty.select("path", F.lit(0).cast("bigint").alias("length"), F.timestamp_seconds("at").alias("modified"), F.sha2(F.lit("").cast("binary"), 256).alias("sha256"), F.lit("empty").alias("status"))
    return found.unionByName(empty.join(found.select(F.col("path").alias("p_")), F.col("path") == F.col("p_"), "left_anti"))


def text_lines(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Blocks of plain text: doc_id, pos, text of every line that is not blank."""
    rows = documents.select(F.col(id_col).alias("doc_id"), F.posexplode(F.split(text_col, r"\R")).alias("pos", "text"))
    return rows.where(X.strip(F.col("text")) != "")


def html_blocks(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """Blocks of HTML: doc_id, pos, observed_type (heading, list_item, table, text), text."""
    # What a page leaves open ends with it, so that no pattern looks in vain for an end.
    whole = F.concat(F.col(html_col), F.lit("<!-- --></script></style>"))
    bare = F.regexp_replace(whole, r"(?is)<script\b.*?</script\s*>|<style\b.*?</style\s*>|<!--.*?-->", " ")
    pieces = F.split(F.regexp_replace(bare, r"(?i)(<(?:h[1-6]|li|p|td|th|div|title)\b)", "\x01$1"), "\x01")
    rows = pages.select(F.col(id_col).alias("doc_id"), F.posexplode(pieces).alias("pos", "piece"))
    tag = F.lower(F.regexp_extract("piece", r"^<([A-Za-z0-9]+)", 1))
    kind = F.when(tag.rlike("^h[1-6]$") | (tag == "title"), "heading").when(tag == "li", "list_item").when(tag.isin("td", "th"), "table").otherwise("text")
    text = X.collapse(F.regexp_replace("piece", "<[^>]*>", " "))
    return rows.select("doc_id", "pos", kind.alias("observed_type"), text.alias("text")).where("text <> ''")


def _box(raw: Column) -> Column:
    """A box given as an object l, t, r, b or as a list of four; null if malformed."""
    named = F.from_json(raw, "l double, t double, r double, b double")
    listed = F.from_json(raw, "array<double>")
    sides = [F.coalesce(named[k], F.get(listed, F.lit(i))) for i, k in enumerate("ltrb")]
    return G.box(*sides)


def parser_payload(payloads: DataFrame) -> DataFrame:
    """Items of payloads (doc_id, payload): doc_id, pos, label, text, page_index (first place, clamped to the document), box."""
    rows = payloads.select("doc_id", F.from_json("payload", PAYLOAD).alias("p")).where("p is not null")
    items = rows.select("doc_id", F.col("p.pages").alias("pages"), F.posexplode("p.texts").alias("pos", "item"))
    place = F.get(F.col("item.prov"), F.lit(0))
    page = F.greatest(F.lit(0), F.least(F.coalesce(place["page_no"], F.lit(1)) - 1, F.col("pages") - 1))
    return items.select("doc_id", "pos", F.col("item.label").alias("label"), F.col("item.text").alias("text"), page.alias("page_index"), _box(place["bbox"]).alias("box"), "pages")


def payload_sections(items: DataFrame) -> DataFrame:
    """Headings of payload items with the page on which their section ends: the one before the next heading's, else the last."""
    order = Window.partitionBy("doc_id").orderBy("pos")
    rows = items.where(F.col("label").isin(*HEADINGS))
    return rows.select("doc_id", "pos", F.col("text").alias("title"), F.col("page_index").alias("start_page"), F.coalesce(F.lead("page_index").over(order) - 1, F.col("pages") - 1).alias("end_page"))


def envelope(rects: DataFrame) -> DataFrame:
    """The box around all boxes of an image: doc_id, image_id, box."""
    sides = [F.min("box.x0"), F.min("box.y0"), F.max("box.x1"), F.max("box.y1")]
    return rects.where("box is not null").groupBy("doc_id", "image_id").agg(G.box(*sides).alias("box"))
