"""Lines that many documents of one host share.

Two operators stand on the same plan.  :func:`clean_documents` (quality rules)
removes lines that more than ``max_docs`` distinct documents of a host contain and
rejects documents that this depletes.  :func:`clean_pages` (line dedup) removes lines
that more than ``max_ratio`` of a host's pages contain, two at least, however few
pages the host has.

Lines are normalised (white space collapsed, lower case) and hashed.  The table is
read once into rows of keys and line hashes, the only thing that is exploded and
shuffled; counting combines inside tasks before the shuffle.  The lines to remove
go back as positions per document.  Documents that cannot hold any of them, by a filter
of fixed size over the lines to remove, are passed on where they lie; only the others
meet their positions in a join and have their text shuffled.  The filter has no false
negatives; the fuller it is, the more documents take the join, which is exact.

Documents are told apart by id in :func:`clean_documents`, so copies of one text under
ids of their own all count; documents without an id are told apart by text.

Defined results: a null host is a host of its own; a null, empty or blank text has
no lines and such a document is rejected by :func:`clean_documents` (it is depleted)
and kept with empty text by :func:`clean_pages`; empty lines are never counted; a line
that repeats inside a document counts once and is removed everywhere in it; a null
id is a value like others; repeated rows each give a row; an empty table gives an
empty result; other columns are not looked at in the queries' narrow results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewell.llm.bloom import may_hold
from tracewell.llm.html import BLANKS, host, html_lines, sql_host, sql_lines, trimmed_lines
from tracewell.plans.lineage import written

MAX_DOCS = 20
MIN_KEPT = 0.5
MAX_RATIO = 0.3


def _hashes(lines: Column) -> Column:
    return F.transform(lines, lambda x: F.xxhash64(F.lower(x)))


def _exploded(rows: DataFrame) -> DataFrame:
    return rows.select("host", "id", "text_hash", F.posexplode("hashes").alias("pos", "h"))


def _without(rows: DataFrame, exploded: DataFrame, over: DataFrame) -> DataFrame:
    """``rows`` (host, id, text_hash, lines) with what is left of the lines in ``left``."""
    marks = F.transform(_hashes(F.col("lines")), lambda h: F.xxhash64(h, F.col("host")))
    marked = rows.withColumn("touched", may_hold(over.select(F.xxhash64("h_", "host_").alias("mark")), marks))
    found = exploded.join(over, F.col("host").eqNullSafe(F.col("host_")) & (F.col("h") == F.col("h_")), "left_semi")
    gone = found.groupBy(F.col("host").alias("host_"), F.col("id").alias("id_"), F.col("text_hash").alias("text_hash_")).agg(F.collect_set("pos").alias("gone"))
    same = F.col("host").eqNullSafe(F.col("host_")) & F.col("id").eqNullSafe(F.col("id_")) & (F.col("text_hash") == F.col("text_hash_"))
    # The join is the same at every size: a sort-merge join of the documents concerned.
    joined = marked.where("touched").join(gone.hint("merge"), same, "left")
    # array_except hashes, so a long document costs its length; places are distinct, so it drops no repeats.
    places = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.col("gone"))
    left = F.when(F.col("gone").isNull(), F.col("lines")).otherwise(F.transform(places, lambda i: F.get(F.col("lines"), i)))
    columns = ["id", "host", "lines", "left"]
    return joined.withColumn("left", left).select(*columns).unionByName(marked.where("not touched").withColumn("left", F.col("lines")).select(*columns))


def clean_documents(documents: DataFrame, max_docs: int = MAX_DOCS, min_kept: float = MIN_KEPT, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """doc_id, source, text (what is left), n_lines, n_removed of the documents that are not depleted.

    A document is depleted if less than ``min_kept`` of the characters of its lines
    are left, or nothing.
    """
    lines = F.coalesce(trimmed_lines(F.col(text_col)), F.array().cast("array<string>"))
    rows = documents.select(F.col(id_col).alias("id"), F.col(host_col).alias("host"), F.coalesce(F.xxhash64(F.col(text_col)), F.lit(0)).alias("text_hash"), lines.alias("lines"))
    narrow = written(rows.select("id", "host", "text_hash", _hashes(F.col("lines")).alias("hashes")), "lines")
    exploded = _exploded(narrow)
    who = F.when(F.col("id").isNull(), F.col("text_hash")).otherwise(F.xxhash64("id"))
    counted = exploded.groupBy(F.col("host").alias("host_"), F.col("h").alias("h_")).agg(F.count_distinct(who).alias("n"))
    over = written(counted.where(F.col("n") > max_docs).select("host_", "h_"), "over")
    out = _without(rows, exploded, over)

    def chars(column: str) -> Column:
        return F.aggregate(column, F.lit(0).cast("bigint"), lambda a, x: a + F.length(x))

    out = out.where((F.size("left") > 0) & (chars("left") >= chars("lines") * F.lit(min_kept)))
    return out.select(F.col("id").alias("doc_id"), F.col("host").alias("source"), F.array_join("left", "\n").alias("text"), F.size("lines").alias("n_lines"), (F.size("lines") - F.size("left")).alias("n_removed"))


def clean_pages(pages: DataFrame, max_ratio: float = MAX_RATIO, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, host, text (what is left), n_lines, n_removed of every page. Pages are told apart by id; a null id is one page."""
    lines = F.coalesce(html_lines(F.col(html_col)), F.array().cast("array<string>"))
    rows = pages.select(F.col(id_col).alias("id"), host(F.col(url_col)).alias("host"), F.coalesce(F.xxhash64(F.col(html_col)), F.lit(0)).alias("text_hash"), lines.alias("lines"))
    # Extracting lines from HTML costs more than writing them, so that is done once.
    rows = written(rows, "page-lines")
    narrow = rows.select("id", "host", "text_hash", _hashes(F.col("lines")).alias("hashes"))
    who = F.coalesce(F.col("id").cast("string"), F.lit("null"))
    totals = narrow.groupBy(F.col("host").alias("host_")).agg(F.count_distinct(who).alias("total"))
    exploded = _exploded(narrow)
    counted = exploded.groupBy("host", F.col("h").alias("h_")).agg(F.count_distinct(who).alias("n"))
    over = counted.where("n > 1").join(totals, F.col("host").eqNullSafe(F.col("host_"))).where(F.col("n") > F.col("total") * F.lit(max_ratio))
    over = written(over.select("host_", "h_"), "over")
    out = _without(rows, exploded, over)
    return out.select(F.col("id").alias("page_id"), "host", F.array_join("left", "\n").alias("text"), F.size("lines").alias("n_lines"), (F.size("lines") - F.size("left")).alias("n_removed"))


_REST = """
j AS (SELECT l.id, l.host, l.k, l.pos, l.line, o.h IS NOT NULL AS gone FROM l LEFT JOIN o ON l.host IS NOT DISTINCT FROM o.host AND l.h = o.h),
a AS (SELECT id, host, k, count(*) AS n_lines, count(*) FILTER (gone) AS n_removed, sum(length(line)) AS before,
  coalesce(sum(length(line)) FILTER (NOT gone), 0) AS after, string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone) AS text FROM j GROUP BY ALL)
"""

_DOC_LINES = f"list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(regexp_replace(x, '{BLANKS}', ' ', 'g'))), lambda x: x <> '')"

DOCUMENTS_SQL = f"""
WITH d AS (SELECT doc_id AS id, source AS host, text, row_number() OVER () AS k, {_DOC_LINES} AS lines FROM documents),
l AS (SELECT id, host, k, id AS doc_id, text, unnest(lines) AS line, unnest(range(len(lines))) AS pos, lower(unnest(lines)) AS h FROM d),
o AS (SELECT host, h FROM l GROUP BY host, h HAVING count(DISTINCT coalesce('d' || doc_id, 't' || text)) > {MAX_DOCS}),
{_REST}
SELECT id AS doc_id, host AS source, text, CAST(n_lines AS INTEGER) AS n_lines, CAST(n_removed AS INTEGER) AS n_removed
FROM a WHERE n_removed < n_lines AND after >= before * {MIN_KEPT}
"""

PAGES_SQL = f"""
WITH d AS (SELECT page_id AS id, {sql_host('url')} AS host, row_number() OVER () AS k, {sql_lines('html')} AS lines FROM pages),
l AS (SELECT id, host, k, unnest(lines) AS line, unnest(range(len(lines))) AS pos, lower(unnest(lines)) AS h FROM d),
t AS (SELECT host, count(DISTINCT id) AS total FROM d GROUP BY host),
o AS (SELECT l.host, l.h FROM l JOIN t ON l.host IS NOT DISTINCT FROM t.host GROUP BY l.host, l.h, total HAVING count(DISTINCT l.id) > 1 AND count(DISTINCT l.id) > total * CAST({MAX_RATIO} AS DOUBLE)),
{_REST}
SELECT d.id AS page_id, d.host, coalesce(a.text, '') AS text, CAST(coalesce(n_lines, 0) AS INTEGER) AS n_lines, CAST(coalesce(n_removed, 0) AS INTEGER) AS n_removed
FROM d LEFT JOIN a ON d.k = a.k
"""
