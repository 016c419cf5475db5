"""Queries on blocks, headings, sections, margins, tables and references.

The corpus has no numbered headings or boxes, so blocks get marks by their position,
in the same way in both engines.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.functions import geometry as G
from tracewell.functions import text as T
from tracewell.operators import objects as O
from tracewell.operators import references as R
from tracewell.operators import structure as S
from tracewell.queries.registry import LINES, lines, query, sid, table

#: Numbers of the headings, at every ninth line: one to twelve levels in a fixed turn.
_NUMBERS = {9 * k: ".".join(str(n + 1) for n in range(k + 1)) + ". " for k in range(12)}
_MARKS = {1: "Figure 3-1. ", 2: "Footnote 4 — ", 3: "https://example.com/a ", 4: "• ", 5: "NOTE-A1 ", 6: "Appendix B. "}
_OBSERVED = ("text", "table", "list", "page_header")
#: mark and observed type by position, in both languages
_MARK = "CASE pos % 9 WHEN 0 THEN CASE (pos * 5) % 108 " + " ".join(f"WHEN {k} THEN '{v}'" for k, v in _NUMBERS.items()) + " END " + " ".join(f"WHEN {k} THEN '{v}'" for k, v in _MARKS.items()) + " ELSE '' END"
_SEEN = "CASE (pos + doc_id) % 4 " + " ".join(f"WHEN {k} THEN '{v}'" for k, v in enumerate(_OBSERVED)) + " END"
_BOX = {"x0": "10.0", "y0": "20.0 * pos", "x1": "10.0 + least(500.0, 5.0 * length(line))", "y1": "20.0 * pos + 14.0"}


def marked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines(spark, sf_dir).select("doc_id", "pos", F.expr(f"concat({_MARK}, line)").alias("text"), F.expr(_SEEN).alias("observed_type"))


_MARKED = f"m AS (SELECT doc_id, pos, {_MARK} || line AS text, {_SEEN} AS observed_type FROM l)"


def heads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The headings found in the marked lines."""
    return S.headings(marked(spark, sf_dir)).select("doc_id", "pos", "level")


_NUM = r"'^(?:Appendix\s+)?([A-Z](?:[.]\d+)*|(?:\d+[.])*\d+)[.]\s+(\S.*)$'"


_HEADS = f"""{_MARKED}, h AS (SELECT doc_id, pos, CAST(length(number) - length(replace(number, '.', '')) + 1 AS INTEGER) AS level
FROM (SELECT doc_id, pos, nullif(regexp_extract(trim(text), {_NUM}, 1), '') AS number FROM m) WHERE number IS NOT NULL)"""


@query(f"""WITH {LINES}, {_MARKED}, n AS (SELECT *, nullif(regexp_extract(trim(text), {_NUM}, 1), '') AS number, regexp_extract(trim(text), {_NUM}, 2) AS title FROM m)
SELECT doc_id, pos, number, title, CAST(length(number) - length(replace(number, '.', '')) + 1 AS INTEGER) AS level FROM n WHERE number IS NOT NULL""")
def heading_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.headings(marked(spark, sf_dir)).select("doc_id", "pos", "number", "title", "level")


_TYPE = rf"""CASE WHEN observed_type IN ('page_header', 'page_footer') THEN observed_type
WHEN regexp_matches(trim(text), {_NUM}) THEN 'heading' WHEN regexp_matches(trim(text), '^Figure\s+\d+(-\d+)*\.\s+\S') THEN 'caption'
WHEN regexp_matches(trim(text), '^Footnote\s+\d+\s*[-—]\s*\S') THEN 'footnote' WHEN regexp_matches(text, 'https?://\S+') THEN 'url'
WHEN observed_type IN ('table', 'figure', 'caption', 'footnote') THEN observed_type
WHEN observed_type IN ('list', 'list_item') OR starts_with(trim(text), '•') THEN 'list'
WHEN regexp_matches(trim(text), '^[A-Z][A-Z]+(-[A-Z0-9./]+)+(\s|$)') THEN 'callout' ELSE 'paragraph' END"""


@query(f"WITH {LINES}, {_MARKED} SELECT doc_id, pos, {_TYPE} AS block_type FROM m")
def block_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.typed(marked(spark, sf_dir)).select("doc_id", "pos", "block_type")


@query(f"""WITH {LINES}, p AS (SELECT doc_id, pos // 4 AS pos, string_agg('•' || chr(10) || line, chr(10) ORDER BY pos) AS text, count(*) AS n FROM l GROUP BY ALL),
s AS (SELECT doc_id, pos, n, list_filter(list_transform(regexp_split_to_array(text, '(?m)^•\\s*\\n'), lambda x: trim(x, ' ' || chr(10))), lambda x: x <> '') AS f, text FROM p),
u AS (SELECT doc_id, pos, unnest(CASE WHEN len(f) > 1 THEN f ELSE [text] END) AS text, unnest(range(CASE WHEN len(f) > 1 THEN len(f) ELSE 1 END)) AS fragment, len(f) > 1 AS items FROM s)
SELECT doc_id, CAST(pos AS INTEGER) AS pos, CAST(fragment AS INTEGER) AS fragment, text, CASE WHEN items THEN 'list_item' ELSE 'list' END AS block_type, CASE WHEN items THEN 'list_item' ELSE 'whole' END AS method FROM u""")
def block_fragments(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = lines(spark, sf_dir).groupBy("doc_id", F.expr("pos div 4").cast("int").alias("g")).agg(F.sort_array(F.collect_list(F.struct("pos", "line"))).alias("x"))
    blocks = groups.select("doc_id", F.col("g").alias("pos"), F.array_join(F.transform("x", lambda s: F.concat(F.lit("•\n"), s["line"])), "\n").alias("text"), F.lit("list").alias("observed_type"), F.lit(False).alias("split_last"))
    return S.fragments(blocks).select("doc_id", "pos", "fragment", "text", "block_type", "method")


@query(f"""WITH {LINES}, p AS (SELECT doc_id, pos, string_split(regexp_replace(line, '([.!?])(\\s+)', '\\1' || chr(1) || '\\2', 'g'), chr(1)) AS s FROM l),
u AS (SELECT doc_id, pos, unnest(s) AS piece, unnest(range(len(s))) AS n FROM p),
w AS (SELECT *, coalesce(sum(length(piece)) OVER (PARTITION BY doc_id, pos ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS st FROM u),
v AS (SELECT doc_id, pos, n, regexp_replace(piece, '^\\s+', '') AS bare, st + length(piece) AS e FROM w)
SELECT doc_id, pos, CAST(row_number() OVER (PARTITION BY doc_id, pos ORDER BY n) - 1 AS INTEGER) AS sentence, CAST(e - length(bare) AS INTEGER) AS char_start, CAST(e AS INTEGER) AS char_end FROM v WHERE bare <> ''""")
def sentence_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.sentence_spans(lines(spark, sf_dir).withColumnRenamed("line", "text"))


@query(f"WITH {LINES}, {_HEADS} SELECT a.doc_id, a.pos, a.level, max(b.pos) AS parent_pos FROM h a LEFT JOIN h b ON a.doc_id = b.doc_id AND b.pos < a.pos AND b.level < a.level GROUP BY ALL")
def section_parents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.section_parents(heads(spark, sf_dir))


_SPANS = """e AS (SELECT doc_id, max(pos) AS last_pos FROM l GROUP BY ALL),
s AS (SELECT a.doc_id, a.pos, a.level, coalesce(min(b.pos) - 1, any_value(last_pos)) AS end_pos FROM h a JOIN e USING (doc_id)
  LEFT JOIN h b ON a.doc_id = b.doc_id AND b.pos > a.pos AND b.level <= a.level GROUP BY ALL)"""


def _spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.section_spans(heads(spark, sf_dir), lines(spark, sf_dir).groupBy("doc_id").agg(F.max("pos").alias("last_pos")))


@query(f"WITH {LINES}, {_HEADS}, {_SPANS} SELECT * FROM s")
def section_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _spans(spark, sf_dir)


@query(f"""WITH {LINES}, {_HEADS}, {_SPANS},
g AS (SELECT l.doc_id, l.pos, l.pos // 5 AS page, h.level FROM l LEFT JOIN h ON l.doc_id = h.doc_id AND l.pos = h.pos),
w AS (SELECT *, lead(page) OVER d AS np, lead(pos) OVER d AS nx, lead(level) OVER d AS nl FROM g WINDOW d AS (PARTITION BY doc_id ORDER BY pos)),
t AS (SELECT * FROM w WHERE np <> page)
SELECT s.doc_id, s.pos, s.level, s.end_pos, CASE WHEN min(t.pos) FILTER (t.pos < end_pos) IS NOT NULL THEN 'deterministic_true'
  WHEN bool_or(t.pos = end_pos AND t.nl <= s.level) THEN 'deterministic_false' END AS status,
  min(t.pos) FILTER (t.pos < end_pos) AS continues_from, min(t.nx) FILTER (t.pos < end_pos) AS continues_to
FROM s LEFT JOIN t ON s.doc_id = t.doc_id AND t.pos BETWEEN s.pos AND s.end_pos GROUP BY s.doc_id, s.pos, s.level, s.end_pos""")
def section_continuation(spark: SparkSession, sf_dir: str) -> DataFrame:
    blocks = marked(spark, sf_dir).select("doc_id", "pos", F.expr("pos div 5").alias("page"), T.heading_level(T.heading_number(F.col("text"))).alias("level"))
    return S.section_continuation(_spans(spark, sf_dir), blocks)


@query("""WITH b AS (SELECT source AS doc_id, doc_id AS page, unnest([0, 1, 2]) AS k, source, lang FROM documents),
t AS (SELECT doc_id, page, CASE k WHEN 0 THEN source || ' report  page ' || page WHEN 1 THEN lang || ' text' ELSE 'Front  matter ' || (page % 9) END AS text,
  CASE k WHEN 0 THEN 'page_header' WHEN 2 THEN 'page_footer' END AS region FROM b),
m AS (SELECT doc_id, page, region, regexp_replace(trim(regexp_replace(text, '\\s+', ' ', 'g')), '(?i)((?:printed\\s+)?page|front\\s+matter)\\s+(\\d+|[a-z]+-\\d+|[ivxlcdm]+)\\s*$', '<page-label>') AS margin FROM t WHERE region IS NOT NULL),
n AS (SELECT source AS doc_id, count(DISTINCT doc_id) AS pages FROM documents GROUP BY ALL)
SELECT doc_id, region, margin, count(*) AS occurrences FROM m JOIN n USING (doc_id) GROUP BY doc_id, region, margin, pages HAVING count(*) >= greatest(2, ceil(pages * 0.25))""")
def repeated_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("source").alias("doc_id"), F.col("doc_id").alias("page"), "lang", F.explode(F.array(*map(F.lit, (0, 1, 2)))).alias("k"))
    text = F.when(F.col("k") == 0, F.concat("doc_id", F.lit(" report  page "), F.col("page").cast("string"))).when(F.col("k") == 1, F.concat("lang", F.lit(" text"))).otherwise(F.concat(F.lit("Front  matter "), (F.col("page") % 9).cast("string")))
    blocks = docs.select("doc_id", "page", text.alias("text"), (F.col("k") * 400.0 + 20).alias("y0"), (F.col("k") * 400.0 + 40).alias("y1"), F.lit(860.0).alias("height"))
    return S.repeated_regions(blocks)


@query(f"""WITH e AS (SELECT conv_id AS doc_id, turn AS pos, {sid('conv_id', 'turn')} AS evidence_id FROM conversations)
SELECT *, lag(evidence_id) OVER w AS previous_id, lead(evidence_id) OVER w AS next_id FROM e WINDOW w AS (PARTITION BY doc_id ORDER BY pos)""")
def evidence_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.evidence_chain(table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("pos")))


@query("""WITH e AS (SELECT l_orderkey AS doc_id, l_linenumber AS pos, l_linenumber * 2 - l_partkey % 2 AS page FROM lineitem),
n AS (SELECT l_orderkey AS doc_id, 2 * max(l_linenumber) + 3 AS pages FROM lineitem GROUP BY ALL)
SELECT e.*, coalesce(lead(page) OVER (PARTITION BY doc_id ORDER BY pos, page) - 1, pages - 1) AS end_page FROM e JOIN n USING (doc_id)""")
def outline_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "lineitem")
    entries = items.select(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("pos"), F.expr("l_linenumber * 2 - l_partkey % 2").alias("page"))
    return S.outline_sections(entries, items.groupBy(F.col("l_orderkey").alias("doc_id")).agg((2 * F.max("l_linenumber") + 3).alias("pages")))


_PAGED = f"t AS (SELECT doc_id, pos, pos // 6 AS page, {_TYPE} AS block_type FROM m)"


@query(f"""WITH {LINES}, {_MARKED}, {_PAGED}
SELECT a.doc_id, CAST(a.page AS INTEGER) AS page, a.pos, max(b.pos) AS marker_pos FROM t a LEFT JOIN t b ON a.doc_id = b.doc_id AND a.page = b.page AND b.pos < a.pos
  AND b.block_type NOT IN ('heading', 'caption', 'figure', 'table', 'page_header', 'page_footer') WHERE a.block_type = 'footnote' GROUP BY ALL""")
def footnote_markers(spark: SparkSession, sf_dir: str) -> DataFrame:
    blocks = S.typed(marked(spark, sf_dir)).withColumn("page", F.expr("pos div 6").cast("int"))
    return S.footnote_markers(blocks).select("doc_id", "page", "pos", "marker_pos")


@query(f"""WITH {LINES}, t AS (SELECT doc_id, pos, pos // 4 AS page, CASE WHEN pos % 4 = 0 AND doc_id % 2 = 0 THEN '2. ' ELSE '' END || line AS text, 20.0 * (pos % 4) + 14 + CASE WHEN pos % 8 > 3 THEN 30 ELSE 0 END AS y1 FROM l),
p AS (SELECT doc_id, page, arg_min(text, pos) AS f, arg_max(text, pos) AS z, max(pos) AS pos, arg_max(y1, pos) AS bottom FROM t GROUP BY ALL),
q AS (SELECT *, lead(f) OVER (PARTITION BY doc_id ORDER BY page) AS nf FROM p)
SELECT doc_id, CAST(page AS INTEGER) AS page, pos FROM q WHERE regexp_matches(trim(nf), {_NUM}) AND bottom <= 300 * 0.3 AND regexp_matches(z, '[.!?]\\s+\\S')""")
def early_page_ends(spark: SparkSession, sf_dir: str) -> DataFrame:
    blocks = lines(spark, sf_dir).select("doc_id", "pos", F.expr("pos div 4").cast("int").alias("page"), F.expr("concat(if(pos % 4 = 0 and doc_id % 2 = 0, '2. ', ''), line)").alias("text"), F.expr("20.0 * (pos % 4) + 14 + CASE WHEN pos % 8 > 3 THEN 30 ELSE 0 END").alias("y1"), F.lit(300.0).alias("height"))
    return S.early_page_ends(blocks)


@query(f"""WITH {LINES}, {_MARKED}, t AS (SELECT doc_id, pos, {_TYPE} AS block_type FROM m),
w AS (SELECT *, coalesce(lag(block_type) OVER d, '') AS p, coalesce(lead(block_type) OVER d, '') AS n FROM t WINDOW d AS (PARTITION BY doc_id ORDER BY pos))
SELECT doc_id, pos, NOT (p = 'heading' OR n = 'heading') AS splits FROM w WHERE block_type = 'list'""")
def list_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.list_neighbours(S.typed(marked(spark, sf_dir))).select("doc_id", "pos", "splits")


@query("""WITH r AS (SELECT l_orderkey AS table_id, (l_linenumber - 1) // 3 AS part, l_linenumber + CASE WHEN l_orderkey % 5 = 0 AND l_linenumber > 4 THEN 1 ELSE 0 END AS row_no FROM lineitem),
e AS (SELECT table_id, part, min(row_no) AS low, max(row_no) AS high, count(DISTINCT row_no) AS n FROM r GROUP BY ALL),
f AS (SELECT *, coalesce(low = lag(high) OVER (PARTITION BY table_id ORDER BY part) + 1, true) AND high - low + 1 = n AS ok FROM e)
SELECT table_id, count(*) AS parts, CAST(sum(n) AS BIGINT) AS rows, CAST(min(low) AS INTEGER) AS first_row, CAST(max(high) AS INTEGER) AS last_row FROM f GROUP BY table_id HAVING bool_and(ok) AND count(*) > 1""")
def table_continuity(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("table_id"), F.expr("cast((l_linenumber - 1) div 3 as int)").alias("part"), F.expr("cast(l_linenumber + if(l_orderkey % 5 = 0 and l_linenumber > 4, 1, 0) as int)").alias("row_no"))
    return S.table_continuity(rows)


_COLUMNS = ("part", "supplier", "flag")


@query("""WITH r AS (SELECT l_orderkey AS table_id, l_linenumber AS row_no, l_partkey % 11 <> 0 AS sound, ['part', 'supplier', 'flag'] AS c, [CAST(l_partkey AS VARCHAR), CAST(l_suppkey AS VARCHAR), l_returnflag] AS v FROM lineitem)
SELECT table_id, row_no, sound, CAST(unnest(CASE WHEN sound THEN [0, 1, 2] ELSE [NULL] END) AS INTEGER) AS col_no, unnest(CASE WHEN sound THEN c ELSE [NULL] END) AS column_name, unnest(CASE WHEN sound THEN v ELSE [NULL] END) AS cell_text FROM r""")
def table_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = F.array(F.col("l_partkey").cast("string"), F.col("l_suppkey").cast("string"), F.col("l_returnflag"))
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("table_id"), F.col("l_linenumber").alias("row_no"), F.array(*map(F.lit, _COLUMNS)).alias("columns"), F.when(F.expr("l_partkey % 11 <> 0"), cells).otherwise(F.slice(cells, 1, 2)).alias("cells"))
    return S.table_cells(rows)


@query(f"""WITH {LINES}, t AS (SELECT doc_id, pos, trim(regexp_replace(line || CASE pos % 3 WHEN 0 THEN '  Page ' || pos WHEN 1 THEN ' printed page A-' || pos ELSE '' END, '\\s+', ' ', 'g')) AS c FROM l)
SELECT doc_id, pos, sha256(regexp_replace(c, '(?i)((?:printed\\s+)?page|front\\s+matter)\\s+(\\d+|[a-z]+-\\d+|[ivxlcdm]+)\\s*$', '<page-label>')) AS margin_hash,
nullif(regexp_extract(c, '(?i)((?:printed\\s+)?page|front\\s+matter)\\s+(\\d+|[a-z]+-\\d+|[ivxlcdm]+)\\s*$', 2), '') AS label FROM t""")
def label_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.expr("concat(line, case pos % 3 when 0 then concat('  Page ', pos) when 1 then concat(' printed page A-', pos) else '' end)")
    return lines(spark, sf_dir).select("doc_id", "pos", F.sha2(T.margin_text(text), 256).alias("margin_hash"), T.page_label(text).alias("label"))


_CITES = "CASE pos % 5 WHEN 0 THEN 'See Section ' || (pos % 7) || '.1 and ' WHEN 1 THEN 'Sections 1, ' || (pos % 4) || ' and 3.1 say ' WHEN 2 THEN 'As Appendix B on printed page ' || (pos % 6) || ' has it, ' WHEN 3 THEN 'In Travel Policy, Version 2.' || (doc_id % 3) || ' at http://example.org/' || doc_id || '. ' ELSE '' END || line"


def citing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines(spark, sf_dir).select("doc_id", "pos", F.expr(_CITES).alias("text"), F.lit("paragraph").alias("block_type"))


_CITING = f"c AS (SELECT doc_id, pos, trim(regexp_replace({_CITES}, '\\s+', ' ', 'g')) AS text FROM l)"
_N = r"(?:\d+\.)*\d+"


@query(f"""WITH {LINES}, {_CITING},
x AS (SELECT doc_id, pos, unnest(regexp_extract_all(text, '\\bSection\\s+{_N}')) AS literal FROM c UNION ALL
  SELECT doc_id, pos, unnest(regexp_extract_all(text, '\\bSections\\s+{_N}(?:\\s*(?:and|,)\\s*{_N})+')) FROM c),
n AS (SELECT *, unnest(regexp_extract_all(literal, '{_N}')) AS number FROM x UNION ALL
  SELECT doc_id, pos, z, right(z, 1) FROM (SELECT doc_id, pos, unnest(regexp_extract_all(text, '\\bAppendix\\s+[A-Z]\\b')) AS z FROM c)),
s AS (SELECT doc_id, lower(CASE WHEN pos % 9 = 8 THEN 'B' ELSE (pos % 8) || CASE WHEN pos % 2 = 0 THEN '.1' ELSE '' END END) AS number, arg_max('s' || pos, pos) AS target_id FROM l WHERE pos % 2 = 0 OR pos < 9 GROUP BY ALL)
SELECT DISTINCT n.doc_id, n.pos, n.literal, s.target_id FROM n JOIN s ON n.doc_id = s.doc_id AND lower(n.number) = s.number""")
def section_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    sections = lines(spark, sf_dir).where("pos % 2 = 0 or pos < 9").select("doc_id", "pos", F.expr("if(pos % 9 = 8, 'B', concat(pos % 8, if(pos % 2 = 0, '.1', '')))").alias("number"), F.expr("concat('s', pos)").alias("section_id"))
    return R.section_references(citing(spark, sf_dir), sections)


@query(f"""WITH {LINES}, {_CITING}, x AS (SELECT doc_id, pos, unnest(regexp_extract_all(text, '(?i)\\bprinted page\\s+(?:[A-Z]-\\d+|\\d+|[ivxlcdm]+)\\b')) AS literal FROM c),
p AS (SELECT doc_id, CAST(pos % 4 AS VARCHAR) AS label, max('p' || pos) AS page_id FROM l GROUP BY ALL)
SELECT DISTINCT x.doc_id, x.pos, literal, page_id FROM x JOIN p ON x.doc_id = p.doc_id AND lower(regexp_extract(literal, '(\\S+)$', 1)) = label""")
def printed_page_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = lines(spark, sf_dir).select("doc_id", F.expr("cast(pos % 4 as string)").alias("label"), F.expr("concat('p', pos)").alias("page_id"))
    return R.page_references(citing(spark, sf_dir), pages)


@query("""WITH x AS (SELECT page_id AS doc_id, unnest(regexp_extract_all(trim(regexp_replace(html || ' ' || url || ', ' || url || '.', '\\s+', ' ', 'g')), 'https?://[^()<>\\[\\]\\s]+')) AS url FROM pages)
SELECT DISTINCT doc_id, 0 AS pos, rtrim(url, '.,;:') AS url FROM x""")
def url_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select(F.col("page_id").alias("doc_id"), F.lit(0).alias("pos"), F.expr("concat(html, ' ', url, ', ', url, '.')").alias("text"), F.lit("paragraph").alias("block_type"))
    return R.url_references(pages)


@query(f"""WITH {LINES}, {_CITING}, x AS (SELECT DISTINCT doc_id, pos, unnest(regexp_extract_all(text, '[A-Z][-A-Za-z0-9’'' &]+(?:Policy|Manual|Handbook),\\s*Version\\s+(?:\\d+\\.)*\\d+')) AS literal FROM c)
SELECT *, {sid('doc_id', 'pos', 'literal', "'cross_document_reference'")} AS task_id FROM x""")
def unresolved_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.unresolved_mentions(citing(spark, sf_dir))


def boxed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines(spark, sf_dir).select("doc_id", F.lit(0).alias("page"), "pos", G.box(*[F.expr(_BOX[k]) for k in ("x0", "y0", "x1", "y1")]).alias("box"))


_BOXED = "x AS (SELECT doc_id, pos, " + ", ".join(f"CAST({v} AS DOUBLE) AS {k}" for k, v in _BOX.items()) + " FROM l)"


@query(f"""WITH {LINES}, {_BOXED}, k AS (SELECT doc_id, pos AS link_id, x0 + 2 AS x0, y0 + 3 AS y0, x0 + 20 AS x1, y0 + 30 AS y1 FROM x WHERE pos % 2 = 0),
j AS (SELECT k.doc_id, link_id, x.pos, (x.x1 - x.x0) * (x.y1 - x.y0) AS area FROM k JOIN x ON k.doc_id = x.doc_id AND least(k.x1, x.x1) > greatest(k.x0, x.x0) AND least(k.y1, x.y1) > greatest(k.y0, x.y0))
SELECT doc_id, 0 AS page, link_id, arg_min(pos, area * 1e6 + pos) AS pos FROM j GROUP BY doc_id, link_id""")
def link_to_block(spark: SparkSession, sf_dir: str) -> DataFrame:
    blocks = boxed(spark, sf_dir)
    link = G.box(F.col("box.x0") + 2, F.col("box.y0") + 3, F.col("box.x0") + 20, F.col("box.y0") + 30)
    return R.link_blocks(blocks.where("pos % 2 = 0").select("doc_id", "page", F.col("pos").alias("link_id"), link.alias("box")), blocks)


@query(f"""WITH {LINES}, {_BOXED} SELECT a.doc_id, a.pos FROM x a WHERE pos % 3 = 1 AND EXISTS (SELECT 1 FROM x b WHERE b.doc_id = a.doc_id AND b.pos % 3 = 0
  AND least(a.x1, b.x1 + 5) - greatest(a.x0, b.x0) > 1 AND least(a.y1, b.y1 + 8) - greatest(a.y0, b.y0) > 1)""")
def covered_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    blocks = boxed(spark, sf_dir)
    outer = blocks.where("pos % 3 = 0").withColumn("box", G.box(F.col("box.x0"), F.col("box.y0"), F.col("box.x1") + 5, F.col("box.y1") + 8))
    return R.covered(blocks.where("pos % 3 = 1"), outer).select("doc_id", "pos")


@query(f"""WITH {LINES}, {_BOXED}, j AS (SELECT f.doc_id, f.pos, c.pos AS cp, abs(c.y0 - f.y1) AS d FROM x f JOIN x c ON f.doc_id = c.doc_id AND c.y0 >= f.y0 WHERE f.pos % 4 = 0 AND c.pos % 4 = 2)
SELECT doc_id, 0 AS page, pos, arg_min(cp, d * 1e6 + cp) AS caption_pos FROM j GROUP BY doc_id, pos""")
def figure_caption_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    blocks = boxed(spark, sf_dir)
    return R.figure_captions(blocks.where("pos % 4 = 0"), blocks.where("pos % 4 = 2"))


@query(f"""WITH {LINES}, {_HEADS}, {_SPANS}, mm AS (SELECT s.doc_id, l.pos AS block, s.pos AS section, s.level FROM s JOIN l ON s.doc_id = l.doc_id AND l.pos BETWEEN s.pos AND s.end_pos),
d AS (SELECT *, max(level) OVER (PARTITION BY doc_id, block) AS d FROM mm)
SELECT doc_id, block, min(section) AS section, count(DISTINCT section) > 1 AS tied FROM d WHERE level = d GROUP BY doc_id, block""")
def deepest_owner(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = _spans(spark, sf_dir).select(F.col("doc_id").alias("d_"), F.col("pos").alias("section"), "level", "end_pos")
    members = lines(spark, sf_dir).select("doc_id", F.col("pos").alias("block")).join(spans, (F.col("doc_id") == F.col("d_")) & F.col("block").between(F.col("section"), F.col("end_pos")))
    return R.deepest_owner(members.select("doc_id", "block", "section", "level"))


@query(f"""WITH {LINES}, {_MARKED}, {_PAGED}, j AS (SELECT a.doc_id, CAST(a.page AS INTEGER) AS page, a.pos, max(b.pos) AS marker_pos FROM t a LEFT JOIN t b ON a.doc_id = b.doc_id AND a.page = b.page AND b.pos < a.pos
  AND b.block_type NOT IN ('heading', 'caption', 'figure', 'table', 'page_header', 'page_footer') WHERE a.block_type = 'footnote' GROUP BY ALL),
n AS (SELECT j.*, regexp_extract(trim(text), '(?s)^Footnote\\s+(\\d+)\\s*[-—]\\s*(\\S.*)$', 1) AS marker, regexp_extract(trim(text), '(?s)^Footnote\\s+(\\d+)\\s*[-—]\\s*(\\S.*)$', 2) AS body FROM j JOIN m ON j.doc_id = m.doc_id AND j.pos = m.pos)
SELECT doc_id, page, pos, marker, coalesce(nullif(rtrim(regexp_extract(body || ' ', '(?s)^(.*?[.!?])\\s', 1)), ''), body) AS note, marker_pos FROM n""")
def footnote_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.footnotes(S.typed(marked(spark, sf_dir)).withColumn("page", F.expr("pos div 6").cast("int")))


@query(f"""WITH {LINES}, {_HEADS}, {_SPANS}, g AS (SELECT doc_id, pos, pos // 5 AS page, lead(pos) OVER w AS np, lead(pos // 5) OVER w AS npage FROM l WINDOW w AS (PARTITION BY doc_id ORDER BY pos)),
k AS (SELECT * FROM g WHERE npage = page + 1), x AS (SELECT k.doc_id, CAST(k.page AS INTEGER) AS page, k.pos, k.np AS next_pos, EXISTS (SELECT 1 FROM s WHERE s.doc_id = k.doc_id AND k.pos BETWEEN s.pos AND s.end_pos AND k.np BETWEEN s.pos AND s.end_pos) AS shared FROM k)
SELECT doc_id, page, pos, next_pos, CASE WHEN shared AND 20.0 * (next_pos % 5) <= 20 THEN 'resolved' ELSE 'rejected' END AS status FROM x""")
def continuation_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    blocks = lines(spark, sf_dir).select("doc_id", "pos", F.expr("cast(pos div 5 as int)").alias("page"), (20.0 * (F.col("pos") % 5)).alias("y0"), F.lit(100.0).alias("height"))
    spans = _spans(spark, sf_dir).select(F.col("doc_id").alias("d_"), F.col("pos").alias("section"), "end_pos")
    members = lines(spark, sf_dir).select("doc_id", F.col("pos").alias("block")).join(spans, (F.col("doc_id") == F.col("d_")) & F.col("block").between(F.col("section"), F.col("end_pos"))).select("doc_id", "block", "section")
    return O.continuation_edges(blocks, members)


@query(f"""WITH {LINES}, o AS (SELECT DISTINCT doc_id FROM l WHERE doc_id % 3 = 0), p AS (SELECT DISTINCT doc_id FROM l WHERE doc_id % 2 = 0), d AS (SELECT doc_id, max(pos) + 1 AS n FROM l GROUP BY ALL)
SELECT doc_id, doc_id || ':n' AS section_id, 0 AS first_page, 1 AS last_page, 'numbered' AS method FROM o UNION ALL SELECT doc_id, doc_id || ':p', 0, 2, 'parser' FROM p WHERE doc_id NOT IN (SELECT doc_id FROM o)
UNION ALL SELECT doc_id, doc_id || ':all', 0, n - 1, 'document' FROM d WHERE doc_id % 3 <> 0 AND doc_id % 2 <> 0""")
def section_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = lines(spark, sf_dir).groupBy("doc_id").agg((F.max("pos") + 1).alias("pages"))
    own, parsed = (docs.where(f"doc_id % {k} = 0").select("doc_id", F.expr(f"concat(doc_id, ':{x}')").alias("section_id"), F.lit(0).alias("first_page"), F.lit(last).alias("last_page")) for k, x, last in ((3, "n", 1), (2, "p", 2)))
    return O.section_fallback(own, parsed, docs)


@query(f"""WITH {LINES}, {_BOXED}, y AS (SELECT doc_id, 0 AS page, y0, pos AS ord, 0 AS layer, 'text' AS block_type FROM x UNION ALL SELECT doc_id, 0, CASE WHEN pos % 4 = 0 THEN NULL ELSE y0 - 5 END, pos, 1, 'figure' FROM x WHERE pos % 2 = 0)
SELECT doc_id, page, y0, ord, block_type, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY page, y0 NULLS LAST, layer, ord) - 1 AS INTEGER) AS pos FROM y""")
def canonical_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = boxed(spark, sf_dir).select("doc_id", "page", F.col("box.y0").alias("y0"), F.col("pos").alias("ord"))
    drawn = rows.where("ord % 2 = 0").withColumn("y0", F.when(F.expr("ord % 4 <> 0"), F.col("y0") - 5))
    return O.canonical_order(rows.withColumn("block_type", F.lit("text")), drawn.withColumn("block_type", F.lit("figure")))
