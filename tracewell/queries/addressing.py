"""Queries on relations, the source graph and provenance addresses."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.functions import text as T
from tracewell.operators import canonical as C
from tracewell.operators import graph as G
from tracewell.operators import segments
from tracewell.queries.registry import LINES, lines, query, sid, table
from tracewell.queries.segmenting import nodes

_STATUS = "['Observed', 'resolved', 'ambiguous', 'rejected', 'validated', 'candidate']"
_METHOD = "['deterministic_exact', 'parser_link', 'model_v2', 'human_review', 'local_inference']"
#: Relations from events: users point to users, some to none.
_RELATIONS = f"""r AS (SELECT event_id AS relation_id, 'u' || user_id AS source_id, CASE WHEN event_id % 8 <> 0 THEN 'u' || (user_id * 7 % 1013) END AS target_id, event_type AS relation_type,
  {_STATUS}[event_id % 6 + 1] AS status, {_METHOD}[event_id % 5 + 1] AS method FROM events),
s AS (SELECT *, CASE WHEN lower(status) IN ('ambiguous', 'contradicted', 'unresolved', 'rejected') THEN lower(status) WHEN method LIKE '%human%' THEN 'human-validated' WHEN method LIKE '%model%' OR method LIKE '%inference%' THEN 'model-inferred'
  WHEN method LIKE '%parser%' OR lower(status) = 'observed' THEN 'parser-inferred' ELSE 'deterministically-derived' END AS epistemic_state FROM r),
g AS (SELECT *, target_id IS NOT NULL AND lower(status) IN ('validated', 'resolved', 'observed') AS gold_eligible FROM s)"""


def relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    status, method = (F.expr(x.replace("[", "array(", 1).replace("]", ")", 1)) for x in (_STATUS, _METHOD))
    rows = table(spark, sf_dir, "events").select(
        F.col("event_id").alias("relation_id"), F.expr("concat('u', user_id)").alias("source_id"), F.expr("if(event_id % 8 <> 0, concat('u', user_id * 7 % 1013), null)").alias("target_id"), F.col("event_type").alias("relation_type"), F.get(status, F.expr("cast(event_id % 6 as int)")).alias("status"), F.get(method, F.expr("cast(event_id % 5 as int)")).alias("method")
    )
    return rows.withColumn("epistemic_state", C.epistemic_state(F.col("status"), F.col("method")))


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relations(spark, sf_dir).withColumn("gold_eligible", G.is_gold(F.col("target_id"), F.lower("status"), F.col("epistemic_state")))


@query(f"WITH {_RELATIONS} SELECT relation_id, status, method, epistemic_state FROM s")
def epistemic_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relations(spark, sf_dir).select("relation_id", "status", "method", "epistemic_state")


@query(f"WITH {_RELATIONS} SELECT relation_id, source_id, target_id, relation_type FROM g WHERE gold_eligible")
def gold_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edges(spark, sf_dir).where("gold_eligible").select("relation_id", "source_id", "target_id", "relation_type")


@query(f"""WITH {_RELATIONS} SELECT relation_id, CASE WHEN gold_eligible THEN 'gold' WHEN lower(status) = 'ambiguous' THEN 'ambiguous' ELSE 'unresolved' END AS bucket FROM g""")
def gold_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.gold_split(relations(spark, sf_dir).withColumn("status", F.lower("status"))).select("relation_id", "bucket")


_IDS = "i AS (SELECT DISTINCT 'u' || c_custkey AS id FROM customer)"


def _ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(F.expr("concat('u', c_custkey)").alias("id"))


@query(f"WITH {_RELATIONS}, {_IDS} SELECT relation_id, source_id, target_id FROM g WHERE gold_eligible AND source_id IN (SELECT id FROM i)")
def graph_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.edges_from(edges(spark, sf_dir), _ids(spark, sf_dir)).select("relation_id", "source_id", "target_id")


@query(f"WITH {_RELATIONS}, {_IDS} SELECT relation_id, source_id, target_id, gold_eligible FROM g WHERE target_id IN (SELECT id FROM i)")
def graph_in(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.edges_to(edges(spark, sf_dir), _ids(spark, sf_dir), gold_only=False).select("relation_id", "source_id", "target_id", "gold_eligible")


@query(f"""WITH {_RELATIONS}, x AS (SELECT source_id AS id, 1 AS o, 0 AS i FROM g UNION ALL SELECT target_id, 0, 1 FROM g WHERE target_id IS NOT NULL)
SELECT id, CAST(sum(o) AS BIGINT) AS outgoing, CAST(sum(i) AS BIGINT) AS incoming FROM x GROUP BY id""")
def graph_degrees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.neighbours_of(edges(spark, sf_dir))


@query(f"""WITH {_RELATIONS}, k AS (SELECT 'u' || c_custkey AS id FROM customer WHERE c_mktsegment <> 'BUILDING')
SELECT 'relations' AS table_name, CAST(relation_id AS VARCHAR) AS row_key, 'source_id' AS column_name, source_id AS value FROM r WHERE source_id NOT IN (SELECT id FROM k)
UNION ALL SELECT 'relations', CAST(relation_id AS VARCHAR), 'target_id', target_id FROM r WHERE target_id NOT IN (SELECT id FROM k)""")
def dangling_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Relations of users, against a table of users that lacks those of one segment."""
    known = table(spark, sf_dir, "customer").where("c_mktsegment <> 'BUILDING'").select(F.expr("concat('u', c_custkey)").alias("id"))
    return C.dangling(relations(spark, sf_dir), "relations", "relation_id", [("source_id", known, "id"), ("target_id", known, "id")])


@query("SELECT o_custkey AS id, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) > 1")
def duplicate_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.duplicate_ids(table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("id")), "id")


@query("""WITH w AS (SELECT l_orderkey AS grp, l_linenumber AS pos, l_partkey AS k, lag(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) AS previous_key FROM lineitem) SELECT * FROM w WHERE previous_key >= k""")
def order_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("grp"), F.col("l_linenumber").alias("pos"), F.col("l_partkey").alias("k"))
    return C.order_violations(rows, "grp", "pos", "k")


@query(f"""WITH {LINES}, n AS (SELECT {sid('doc_id', 'pos')} AS node_id, unnest(CASE pos % 4 WHEN 0 THEN [NULL] WHEN 1 THEN ['a', 'b'] ELSE ['a'] END) AS division_id FROM l)
SELECT node_id, count(division_id) AS owners FROM n GROUP BY node_id HAVING count(division_id) <> 1""")
def owner_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = lines(spark, sf_dir).select(T.stable_id(F.col("doc_id"), F.col("pos")).alias("node_id"), F.explode(F.expr("case pos % 4 when 0 then array(cast(null as string)) when 1 then array('a', 'b') else array('a') end")).alias("division_id"))
    return C.owner_violations(rows)


@query("""WITH p AS (SELECT n_nationkey AS child_id, n_regionkey AS parent_id FROM nation WHERE n_nationkey % 6 <> 0), c AS (SELECT n_nationkey AS child_id, n_regionkey AS parent_id FROM nation WHERE n_nationkey % 7 <> 0)
SELECT *, 'children' AS missing_in FROM (SELECT * FROM p EXCEPT SELECT * FROM c) UNION ALL SELECT *, 'parents' FROM (SELECT * FROM c EXCEPT SELECT * FROM p)""")
def unreciprocated(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("child_id"), F.col("n_regionkey").alias("parent_id"))
    return C.unreciprocated(nation.where("child_id % 6 <> 0"), nation.where("child_id % 7 <> 0"))


@query("""WITH a AS (SELECT DISTINCT o_custkey AS id FROM orders), b AS (SELECT DISTINCT user_id AS id FROM events)
SELECT id, 'both' AS side FROM (SELECT * FROM a INTERSECT SELECT * FROM b) UNION ALL SELECT id, 'orders' FROM (SELECT * FROM a EXCEPT SELECT * FROM b) UNION ALL SELECT id, 'events' FROM (SELECT * FROM b EXCEPT SELECT * FROM a)""")
def id_set_ops(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("id")), table(spark, sf_dir, "events").select(F.col("user_id").alias("id"))
    sides = [(a.intersect(b), "both"), (a.exceptAll(a.join(b, "id", "left_semi")).distinct(), "orders"), (b.join(a, "id", "left_anti").distinct(), "events")]
    return segments.all_views(*[x.withColumn("side", F.lit(name)) for x, name in sides])


#: Resources are documents; every seventh has changed since; addresses point to their lines, some nowhere.
_SOURCE = "c AS (SELECT doc_id, sha256(text) AS sha FROM documents)"
_ADDRESSED = f"""n AS (SELECT 'addr-' || {sid('sha', sid('l.doc_id', 'pos'), '0', 'length(line)')} AS address_id, sha AS source_sha256, CAST(l.doc_id AS VARCHAR) AS resource_id, {sid('l.doc_id', 'pos')} AS node_id, length(line) AS n_chars, pos, l.doc_id FROM l JOIN c ON l.doc_id = c.doc_id)"""


def addressed(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("d_"), F.sha2("text", 256).alias("source_sha256"))
    rows = nodes(spark, sf_dir).join(docs, F.col("doc_id") == F.col("d_"))
    return rows.select("doc_id", F.col("sequence_number").alias("pos"), F.col("doc_id").cast("string").alias("resource_id"), "source_sha256", "node_id", F.lit(0).alias("char_start"), F.col("n_chars").alias("char_end"))


@query(f"WITH {LINES}, {_SOURCE}, {_ADDRESSED} SELECT address_id, source_sha256, resource_id, node_id, 0 AS char_start, CAST(n_chars AS INTEGER) AS char_end FROM n")
def strong_addresses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.strong_addresses(addressed(spark, sf_dir))


_STRONG = f"""{_SOURCE}, {_ADDRESSED}, z AS (SELECT address_id, doc_id, pos, CASE WHEN pos % 17 = 5 THEN 'obsolete' WHEN doc_id % 11 = 3 THEN 'forbidden' WHEN doc_id % 13 = 4 THEN 'unresolved' WHEN doc_id % 7 = 2 THEN 'obsolete'
  WHEN pos % 5 = 1 THEN 'unresolved' WHEN pos % 5 = 2 THEN 'unresolved' ELSE 'exact' END AS status,
  CASE WHEN pos % 17 = 5 THEN 'address_obsolete' WHEN doc_id % 11 = 3 THEN 'access_denied' WHEN doc_id % 13 = 4 THEN 'resource_missing' WHEN doc_id % 7 = 2 THEN 'source_changed'
  WHEN pos % 5 = 1 THEN 'target_missing' WHEN pos % 5 = 2 THEN 'selector_mismatch' ELSE 'exact_match' END AS reason, node_id FROM n)"""


def _resolved(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = addressed(spark, sf_dir)
    addresses = G.strong_addresses(rows)
    numbered = addresses.join(rows.select(F.col("node_id").alias("n_"), "pos"), F.col("node_id") == F.col("n_"))
    resources = rows.where("doc_id % 13 <> 4").select("resource_id", F.when(F.expr("doc_id % 7 = 2"), F.lit("changed")).otherwise(F.col("source_sha256")).alias("source_sha256")).distinct()
    targets = rows.where("pos % 5 <> 1").select("node_id", "resource_id", "char_start", (F.col("char_end") - F.expr("if(pos % 5 = 2, 1, 0)")).alias("char_end"))
    forbidden = rows.where("doc_id % 11 = 3").select("resource_id")
    return G.resolve_strong(addresses, resources, targets, numbered.where("pos % 17 = 5").select("address_id"), forbidden)


@query(f"WITH {LINES}, {_STRONG} SELECT address_id, status, CASE WHEN status = 'exact' THEN node_id END AS target_id, reason FROM z")
def resolve_strong(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _resolved(spark, sf_dir)


@query("""WITH r AS (SELECT p_brand AS fam, p_partkey AS rid, p_partkey % 4 <> 0 AS versioned FROM part), d AS (SELECT DISTINCT l_partkey AS rid, CAST(l_linenumber AS VARCHAR) AS number FROM lineitem),
a AS (SELECT DISTINCT p_brand || '#' || k AS address_id, p_brand AS fam, CAST(k AS VARCHAR) AS ref FROM part, (SELECT unnest(range(1, 9)) AS k)),
j AS (SELECT a.address_id, r.rid, r.rid % 3 <> 0 AS allowed FROM a LEFT JOIN (SELECT r.fam, r.rid, d.number FROM r JOIN d USING (rid) WHERE versioned) r ON r.fam = a.fam AND r.number = a.ref),
g AS (SELECT address_id, count(rid) AS candidates, count(rid) FILTER (allowed) AS al, min(rid) AS one FROM j GROUP BY address_id)
SELECT address_id, CASE WHEN candidates = 0 THEN 'unresolved' WHEN al = 0 THEN 'forbidden' WHEN candidates = 1 THEN 'redirected' ELSE 'ambiguous' END AS status, CASE WHEN candidates = 1 AND al = 1 THEN one END AS resource_id, candidates FROM g""")
def resolve_logical(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    resources = part.select(F.col("p_partkey").alias("resource_id"), F.col("p_brand").alias("family_id"), F.when(F.expr("p_partkey % 4 <> 0"), "1").alias("version"))
    divisions = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("resource_id"), F.col("l_linenumber").cast("string").alias("number"))
    addresses = part.select("p_brand").distinct().select("p_brand", F.explode(F.sequence(F.lit(1), F.lit(8))).alias("k")).select(F.expr("concat(p_brand, '#', k)").alias("address_id"), F.col("p_brand").alias("resource_family_id"), F.col("k").cast("string").alias("division_reference"))
    forbidden = part.where("p_partkey % 3 = 0").select(F.col("p_partkey").alias("resource_id"))
    return G.resolve_logical(addresses, resources, divisions, forbidden)


@query(f"""WITH {LINES}, {_STRONG}, m AS (SELECT 'set-' || doc_id || '-' || (pos // 3) AS address_id, CASE WHEN pos % 19 = 7 THEN 'unresolved' ELSE status END AS s FROM z)
SELECT address_id, CASE WHEN bool_or(s = 'forbidden') THEN 'forbidden' WHEN bool_and(s = 'exact') THEN 'exact' WHEN bool_or(s = 'obsolete') THEN 'obsolete' ELSE 'unresolved' END AS status, count(*) AS members FROM m GROUP BY address_id""")
def resolve_evidence_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = addressed(spark, sf_dir)
    addresses = G.strong_addresses(rows).join(rows.select(F.col("node_id").alias("n_"), "doc_id", "pos"), F.col("node_id") == F.col("n_"))
    members = addresses.select(F.expr("concat('set-', doc_id, '-', pos div 3)").alias("address_id"), F.expr("pos % 3").alias("ord"), F.expr("if(pos % 19 = 7, 'nowhere', address_id)").alias("member_id"))
    return G.resolve_evidence_set(members, _resolved(spark, sf_dir))


@query(f"""WITH {LINES}, k AS (SELECT sha256('nodes' || chr(31) || length(line) || chr(31) || {sid('doc_id', 'pos')}) AS h FROM l UNION ALL SELECT sha256('divisions' || chr(31) || doc_id || chr(31) || source) FROM documents),
p AS (SELECT substr(h, 1, 4) AS b, sha256(string_agg(h, '' ORDER BY h)) AS p FROM k GROUP BY ALL) SELECT 'sg-' || sha256(string_agg(p, '' ORDER BY b)) AS revision FROM p""")
def graph_revision(spark: SparkSession, sf_dir: str) -> DataFrame:
    divisions = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("division_id"), F.col("source").alias("resource_id"))
    return G.revision(("nodes", nodes(spark, sf_dir).select("node_id", F.col("n_chars").alias("char_end"))), ("divisions", divisions))


@query(f"""WITH {LINES} SELECT CAST(doc_id AS VARCHAR) AS target_id, 'resource' AS kind, doc_id AS resource_id FROM documents UNION ALL SELECT {sid('doc_id', 'pos')}, 'node', doc_id FROM l
UNION ALL SELECT DISTINCT doc_id || ':' || (pos // 5), 'division', doc_id FROM l UNION ALL SELECT 'rep-' || doc_id, 'representation', doc_id FROM documents WHERE doc_id % 3 = 0""")
def target_owners(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id"))
    own = nodes(spark, sf_dir)
    resources = docs.select(F.col("doc_id").alias("resource_id"))
    found = G.owners(resources, own.select("division_id", F.col("doc_id").alias("resource_id")).distinct(), own.select("node_id", F.col("doc_id").alias("resource_id")), docs.where("doc_id % 3 = 0").select(F.expr("concat('rep-', doc_id)").alias("representation_id"), F.col("doc_id").cast("string").alias("subject_id")))
    return found
