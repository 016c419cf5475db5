"""Queries on content nodes, hierarchies and the six segmentation views."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.functions import text as T
from tracewell.operators import canonical as C
from tracewell.operators import hierarchy as H
from tracewell.operators import segments as G
from tracewell.operators import structure as S
from tracewell.queries.registry import LINES, lines, query, sid, table

_LIMIT = 60
_NODES = f"""n AS (SELECT doc_id, pos AS sequence_number, {sid('doc_id', 'pos')} AS node_id, CASE WHEN pos % 5 = 0 THEN 'heading' ELSE 'paragraph' END AS node_kind,
  doc_id || ':' || (pos // 5) AS division_id, CAST(length(line) AS INTEGER) AS n_chars, line AS text FROM l)"""
#: Divisions of a document form a binary heap: division k stands under (k - 1) / 2.
_DIVISIONS = "d AS (SELECT DISTINCT doc_id || ':' || (pos // 5) AS division_id, CASE WHEN pos // 5 > 0 THEN doc_id || ':' || ((pos // 5 - 1) // 2) END AS parent_division_id FROM b)"


def _id(strategy: str, number: str) -> str:
    return f"'{strategy}:' || doc_id || ':' || lpad(CAST({number} AS VARCHAR), 6, '0')"


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines(spark, sf_dir).select(
        "doc_id", F.col("pos").alias("sequence_number"), T.stable_id(F.col("doc_id"), F.col("pos")).alias("node_id"), F.expr("if(pos % 5 = 0, 'heading', 'paragraph')").alias("node_kind"), F.expr("concat(doc_id, ':', pos div 5)").alias("division_id"), F.length("line").alias("n_chars"), F.col("line").alias("text")
    )


def divisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    return rows.select(F.expr("concat(doc_id, ':', pos div 5)").alias("division_id"), F.expr("if(pos div 5 > 0, concat(doc_id, ':', (pos div 5 - 1) div 2), null)").alias("parent_division_id")).distinct()


def sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = S.sentence_spans(lines(spark, sf_dir).withColumnRenamed("line", "text"))
    rows = spans.select("doc_id", (F.col("pos") * 1000000 + F.col("sentence")).cast("bigint").alias("pos"), T.stable_id(F.col("doc_id"), F.col("pos")).alias("node_id"), "char_start", "char_end")
    return rows.withColumn("tokens", F.col("char_end") - F.col("char_start"))


@query(f"""WITH a AS (SELECT doc_id, string_split(text, chr(10)) AS x FROM documents), b AS (SELECT doc_id, CAST(unnest(range(len(x))) AS INTEGER) AS pos, unnest(x) AS text FROM a),
w AS (SELECT *, coalesce(sum(length(text) + 1) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s FROM b)
SELECT {sid('doc_id', 'pos')} AS node_id, doc_id, pos, pos AS sequence_number, text, sha256(text) AS text_sha256, CAST(s AS BIGINT) AS char_start, CAST(s + length(text) AS BIGINT) AS char_end FROM w WHERE trim(text) <> ''""")
def content_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    blocks = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "text"))
    return C.content_nodes(blocks)


@query("""WITH a AS (SELECT doc_id, text AS whole, string_split(text, chr(10)) AS x FROM documents), b AS (SELECT doc_id, whole, CAST(unnest(range(len(x))) AS INTEGER) AS pos, unnest(x) AS text FROM a),
w AS (SELECT *, coalesce(sum(length(text) + 1) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + (pos % 7 = 3)::INT AS s FROM b)
SELECT """ + sid("doc_id", "pos") + """ AS node_id, 'selector' AS rule FROM w WHERE trim(text) <> '' AND substring(whole, CAST(s AS BIGINT) + 1, length(text)) <> text
UNION ALL SELECT """ + sid("doc_id", "pos") + """, 'text_sha256' FROM w WHERE trim(text) <> '' AND pos % 11 = 4""")
def node_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes with some spans moved and some hashes changed."""
    docs = table(spark, sf_dir, "documents")
    found = C.content_nodes(docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "text")))
    moved = found.withColumn("char_start", F.col("char_start") + F.expr("if(pos % 7 = 3, 1, 0)")).withColumn("char_end", F.col("char_end") + F.expr("if(pos % 7 = 3, 1, 0)"))
    moved = moved.withColumn("text_sha256", F.when(F.expr("pos % 11 = 4"), F.lit("")).otherwise(F.col("text_sha256")))
    return C.node_violations(moved, docs.select("doc_id", F.col("text").alias("source_text")))


@query(f"""WITH {LINES}, {_NODES} SELECT 'paragraph' AS strategy, {_id('paragraph', 'row_number() OVER (PARTITION BY doc_id ORDER BY sequence_number)')} AS segment_id, 'span' AS role, 0 AS ord, node_id, 0 AS char_start, n_chars AS char_end
FROM n WHERE node_kind = 'paragraph'""")
def seg_paragraph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.paragraphs(nodes(spark, sf_dir))


@query(f"""WITH {LINES}, {_NODES}, f AS (SELECT *, min(sequence_number) OVER (PARTITION BY division_id) AS first FROM n)
SELECT 'direct-division' AS strategy, {_id('direct-division', 'dense_rank() OVER (PARTITION BY doc_id ORDER BY first)')} AS segment_id, 'span' AS role,
CAST(row_number() OVER (PARTITION BY division_id ORDER BY sequence_number) - 1 AS INTEGER) AS ord, node_id, 0 AS char_start, n_chars AS char_end FROM f""")
def seg_direct_division(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.direct_divisions(nodes(spark, sf_dir))


@query(f"""WITH {LINES}, {_NODES} SELECT 'parser-native' AS strategy, {_id('parser-native', "dense_rank() OVER (PARTITION BY doc_id ORDER BY '#/texts/' || lpad(CAST(sequence_number // 3 AS VARCHAR), 5, '0'))")} AS segment_id,
'span' AS role, sequence_number % 3 AS ord, node_id, 0 AS char_start, n_chars AS char_end FROM n""")
def seg_native_structure(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = nodes(spark, sf_dir)
    native = own.select("doc_id", F.expr("concat('#/texts/', lpad(cast(sequence_number div 3 as string), 5, '0'))").alias("pointer"), F.expr("sequence_number % 3").alias("ord"), "node_id")
    return G.native_structure(native, own)


@query(f"""WITH RECURSIVE {LINES}, p AS (SELECT doc_id, pos, string_split(regexp_replace(line, '([.!?])(\\s+)', '\\1' || chr(1) || '\\2', 'g'), chr(1)) AS s FROM l),
u AS (SELECT doc_id, pos, unnest(s) AS piece, unnest(range(len(s))) AS k FROM p),
w AS (SELECT *, coalesce(sum(length(piece)) OVER (PARTITION BY doc_id, pos ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS st FROM u),
v AS (SELECT doc_id, pos, k, CAST(st + length(piece) - length(regexp_replace(piece, '^\\s+', '')) AS INTEGER) AS s, CAST(st + length(piece) AS INTEGER) AS e FROM w WHERE regexp_replace(piece, '^\\s+', '') <> ''),
q AS (SELECT *, e - s AS t, row_number() OVER (PARTITION BY doc_id ORDER BY pos, k) AS i FROM v),
r AS (SELECT doc_id, i, CASE WHEN t > {_LIMIT} THEN 1 ELSE 0 END AS g, CASE WHEN t > {_LIMIT} THEN 0 ELSE t END AS acc, 0 AS seg FROM q WHERE i = 1
 UNION ALL SELECT q.doc_id, q.i, r.g + CASE WHEN r.acc > 0 AND r.acc + q.t > {_LIMIT} THEN 1 ELSE 0 END + CASE WHEN q.t > {_LIMIT} THEN 1 ELSE 0 END,
  CASE WHEN q.t > {_LIMIT} THEN 0 WHEN r.acc > 0 AND r.acc + q.t > {_LIMIT} THEN q.t ELSE r.acc + q.t END, r.g + CASE WHEN r.acc > 0 AND r.acc + q.t > {_LIMIT} THEN 1 ELSE 0 END
 FROM r JOIN q ON q.doc_id = r.doc_id AND q.i = r.i + 1)
SELECT 'fixed-size' AS strategy, {_id('fixed-size', 'seg + 1')} AS segment_id, 'span' AS role, CAST(row_number() OVER (PARTITION BY doc_id, seg ORDER BY i) - 1 AS INTEGER) AS ord, {sid('doc_id', 'pos')} AS node_id, s AS char_start, e AS char_end
FROM r JOIN q USING (doc_id, i)""")
def seg_fixed_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.fixed_size(sentences(spark, sf_dir), _LIMIT)


@query(f"""WITH {LINES}, {_NODES}, p AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY sequence_number) AS i FROM n WHERE node_kind = 'paragraph'),
j AS (SELECT a.doc_id, a.i AS seed, b.i, b.node_id, b.n_chars FROM p a JOIN p b ON a.doc_id = b.doc_id AND b.i BETWEEN a.i - 1 AND a.i + 2)
SELECT 'sentence-window' AS strategy, {_id('sentence-window', 'seed')} AS segment_id, CASE WHEN i = seed THEN 'seed' ELSE 'context' END AS role,
CAST(row_number() OVER (PARTITION BY doc_id, seed ORDER BY i) - 1 AS INTEGER) AS ord, node_id, 0 AS char_start, n_chars AS char_end FROM j""")
def seg_sentence_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.sentence_windows(nodes(spark, sf_dir), 1, 2)


@query(f"""WITH RECURSIVE {LINES}, {_NODES}, {_DIVISIONS}, c AS (SELECT division_id AS root, division_id AS node FROM d UNION ALL SELECT c.root, d.division_id FROM c JOIN d ON d.parent_division_id = c.node),
p AS (SELECT *, {_id('parent-child', 'row_number() OVER (PARTITION BY doc_id ORDER BY sequence_number)')} AS segment_id FROM n WHERE node_kind = 'paragraph')
SELECT 'parent-child' AS strategy, segment_id, 'retrieval' AS role, 0 AS ord, node_id, 0 AS char_start, n_chars AS char_end FROM p UNION ALL
SELECT 'parent-child', segment_id, 'return', CAST(row_number() OVER (PARTITION BY segment_id ORDER BY n.sequence_number, n.node_id) - 1 AS INTEGER), n.node_id, 0, n.n_chars
FROM p JOIN c ON p.division_id = c.root JOIN n ON n.division_id = c.node""")
def seg_parent_child(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.parent_child(nodes(spark, sf_dir), divisions(spark, sf_dir))


@query(f"""WITH {LINES}, {_NODES}, f AS (SELECT *, min(sequence_number) OVER (PARTITION BY division_id) AS first FROM n),
s AS (SELECT {_id('direct-division', 'dense_rank() OVER (PARTITION BY doc_id ORDER BY first)')} AS segment_id, sequence_number, text FROM f)
SELECT segment_id, string_agg(text, chr(10) ORDER BY sequence_number) AS text FROM s GROUP BY segment_id""")
def seg_reconstruct(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = nodes(spark, sf_dir)
    return G.reconstruct(G.direct_divisions(own), own)


@query(f"""WITH {LINES}, {_NODES}, s AS (SELECT {_id('paragraph', 'row_number() OVER (PARTITION BY doc_id ORDER BY sequence_number)')} AS segment_id, node_id, n_chars, sequence_number AS q FROM n WHERE node_kind = 'paragraph'),
t AS (SELECT segment_id, 0 AS ord, CASE WHEN q % 10 = 1 THEN 'x' || node_id ELSE node_id END AS node_id, CASE WHEN q % 10 = 2 THEN n_chars ELSE 0 END AS a, n_chars + CASE WHEN q % 10 = 3 THEN 1 ELSE 0 END AS e FROM s)
SELECT segment_id, ord, 'missing_node' AS rule FROM t WHERE starts_with(node_id, 'x') UNION ALL SELECT segment_id, ord, 'outside_text' FROM t JOIN n USING (node_id) WHERE e > n_chars
UNION ALL SELECT segment_id, ord, 'empty_span' FROM t WHERE a >= e""")
def seg_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paragraph segments, some of them broken."""
    own = nodes(spark, sf_dir)
    number = own.select(F.col("node_id").alias("k_"), (F.col("sequence_number") % 10).alias("q_"))
    spans = G.paragraphs(own).join(number, F.col("node_id") == F.col("k_"))
    spans = spans.withColumn("char_start", F.when(F.col("q_") == 2, F.col("char_end")).otherwise(F.col("char_start"))).withColumn("char_end", F.col("char_end") + F.when(F.col("q_") == 3, 1).otherwise(0))
    spans = spans.withColumn("node_id", F.when(F.col("q_") == 1, F.concat(F.lit("x"), "node_id")).otherwise(F.col("node_id")))
    return G.violations(spans.drop("k_", "q_"), own)


def _row(order: str) -> str:
    return f"segment_id || chr(31) || 'span' || chr(31) || lpad(CAST({order} AS VARCHAR), 6, '0') || chr(31) || node_id || chr(31) || '0' || chr(31) || n_chars"


@query(f"""WITH {LINES}, {_NODES}, s AS (SELECT {_id('paragraph', 'row_number() OVER (PARTITION BY doc_id ORDER BY sequence_number)')} AS segment_id, node_id, n_chars FROM n WHERE node_kind = 'paragraph'),
h AS (SELECT segment_id, sha256({_row('0')}) AS h FROM s), bk AS (SELECT substr(h, 1, 4) AS b, sha256(string_agg(h, '' ORDER BY h)) AS p FROM h GROUP BY ALL) SELECT 'paragraph' AS strategy, sha256(string_agg(p, '' ORDER BY b)) AS cache_id FROM bk""")
def seg_cache_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.cache_identity(G.paragraphs(nodes(spark, sf_dir)))


def bundles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions, nations under them, customers under those: bundle_id, parent_id, name."""
    region = table(spark, sf_dir, "region").select(F.expr("concat('r', r_regionkey)").alias("bundle_id"), F.lit(None).cast("string").alias("parent_id"), F.col("r_name").alias("name"))
    nation = table(spark, sf_dir, "nation").select(F.expr("concat('n', n_nationkey)"), F.expr("concat('r', n_regionkey)"), "n_name")
    customer = table(spark, sf_dir, "customer").select(F.expr("concat('c', c_custkey)"), F.expr("concat('n', c_nationkey)"), "c_name")
    return region.union(nation).union(customer)


BUNDLES = """t AS (SELECT 'r' || r_regionkey AS bundle_id, NULL AS parent_id, r_name AS name FROM region UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey, n_name FROM nation
 UNION ALL SELECT 'c' || c_custkey, 'n' || c_nationkey, c_name FROM customer)"""
CLOSURE = "c AS (SELECT bundle_id AS root, bundle_id AS node, 0 AS depth FROM t UNION ALL SELECT c.root, t.bundle_id, c.depth + 1 FROM c JOIN t ON t.parent_id = c.node)"


@query(f"WITH RECURSIVE {BUNDLES}, {CLOSURE} SELECT * FROM c")
def bundle_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    return H.closure(bundles(spark, sf_dir), "bundle_id", "parent_id")


@query(f"""WITH RECURSIVE {LINES}, {_NODES}, {_DIVISIONS}, c AS (SELECT division_id AS root, division_id AS node, 0 AS depth FROM d UNION ALL SELECT c.root, d.division_id, c.depth + 1 FROM c JOIN d ON d.parent_division_id = c.node)
SELECT root, depth, node_id, sequence_number FROM c JOIN n ON n.division_id = c.node""")
def subtree_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = H.ordered_subtree(divisions(spark, sf_dir), "division_id", "parent_division_id", nodes(spark, sf_dir), "division_id")
    return found.select("root", "depth", "node_id", "sequence_number")


@query(f"WITH RECURSIVE {BUNDLES}, p AS (SELECT bundle_id AS node, name AS path FROM t WHERE parent_id IS NULL UNION ALL SELECT t.bundle_id, p.path || '/' || t.name FROM p JOIN t ON t.parent_id = p.node) SELECT * FROM p")
def bundle_tree_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return H.paths(bundles(spark, sf_dir), "bundle_id", "parent_id", "name")


@query("""WITH RECURSIVE e AS (SELECT c_custkey AS k, CASE WHEN c_custkey % 10 < 3 THEN c_custkey - c_custkey % 10 + (c_custkey % 10 + 1) % 3 ELSE c_custkey - 1 END AS p FROM customer),
w AS (SELECT k, p AS st, 1 AS d FROM e UNION ALL SELECT w.k, e.p, d + 1 FROM w JOIN e ON w.st = e.k WHERE d < 12) SELECT DISTINCT k AS node FROM w WHERE st = k""")
def division_cycles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers linked so that three of every ten form a ring and the others hang on it."""
    parent = F.expr("if(c_custkey % 10 < 3, c_custkey - c_custkey % 10 + (c_custkey % 10 + 1) % 3, c_custkey - 1)")
    return H.cyclic(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), parent.alias("p")), "k", "p")
