"""Queries on the catalog, retention, routing and JSON."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.functions import json as J
from tracewell.functions import text as T
from tracewell.operators import catalog as C
from tracewell.operators import retention as R
from tracewell.operators import routing as P
from tracewell.queries.registry import query, sid, table
from tracewell.queries.segmenting import BUNDLES, CLOSURE, bundles


@query(f"""WITH d AS (SELECT source AS bundle, sha256(text) AS sha256, CAST(doc_id AS VARCHAR) AS source_key, doc_id FROM documents), k AS (SELECT bundle, sha256, bool_or(doc_id % 10 <> 0) AS live FROM d WHERE doc_id % 5 = 0 GROUP BY ALL),
n AS (SELECT d.*, live, row_number() OVER (PARTITION BY d.bundle, d.sha256 ORDER BY doc_id, source_key) AS i FROM d LEFT JOIN k ON d.bundle = k.bundle AND d.sha256 = k.sha256)
SELECT bundle, sha256, source_key, CASE WHEN live OR i > 1 THEN 'already_registered' WHEN NOT live THEN 'restored' ELSE 'created' END AS outcome, 'asset-' || {sid('bundle', 'sha256')} AS asset_id FROM n""")
def content_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select(F.col("source").alias("bundle"), F.sha2("text", 256).alias("sha256"), F.col("doc_id").cast("string").alias("source_key"), F.col("doc_id").alias("ord"))
    known = rows.where("ord % 5 = 0").select("bundle", "sha256", (F.col("ord") % 10 == 0).alias("deleted"))
    return C.register(rows, known)


_RESULT = "CASE o_orderstatus WHEN 'F' THEN 'ingested' WHEN 'O' THEN 'skipped' ELSE 'failed' END"


@query(f"""WITH r AS (SELECT {_RESULT} AS status, length(o_orderpriority) AS size FROM orders) SELECT t.status, count(r.status) AS n, CAST(coalesce(sum(size), 0) AS BIGINT) AS size
FROM (SELECT unnest(['ingested', 'skipped', 'failed', 'cancelled']) AS status) t LEFT JOIN r ON r.status = t.status GROUP BY t.status""")
def batch_status_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select(F.expr(_RESULT).alias("status"), F.length("o_orderpriority").alias("size"))
    return C.status_counts(rows, ("ingested", "skipped", "failed", "cancelled"))


@query("""SELECT c_custkey AS run_id, count(o_orderkey) AS documents, count(*) FILTER (o_orderkey % 3 = 0) AS failures,
CASE WHEN count(o_orderkey) = 0 THEN 'empty' WHEN count(*) FILTER (o_orderkey % 3 = 0) = 0 THEN 'completed' WHEN count(*) FILTER (o_orderkey % 3 = 0) < count(o_orderkey) THEN 'partial' ELSE 'failed' END AS state
FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey""")
def run_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select("o_custkey", F.col("o_orderkey").alias("doc_id"))
    runs = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("run_id")).join(orders, F.col("run_id") == F.col("o_custkey"), "left")
    return C.run_state(runs.withColumn("failed", F.coalesce(F.col("doc_id") % 3 == 0, F.lit(False))))


@query("""WITH d AS (SELECT sha256(text) AS h, doc_id % 9 = 0 AS f, strlen(text) AS s FROM documents), b AS (SELECT substr(h, 1, 4) AS b, sha256(string_agg(h, '' ORDER BY h)) AS x, count(*) AS n, count(*) FILTER (f) AS f, sum(s) AS s FROM d GROUP BY ALL)
SELECT CAST(sum(n) AS BIGINT) AS documents, CAST(sum(f) AS BIGINT) AS failures, CAST(sum(s) AS BIGINT) AS bytes, sha256(string_agg(x, '' ORDER BY x)) AS manifest_sha256 FROM b""")
def run_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.run_manifest(table(spark, sf_dir, "documents").select(F.sha2("text", 256).alias("sha256"), (F.col("doc_id") % 9 == 0).alias("failed"), F.octet_length("text").alias("size")))


def _assets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("asset_id"), F.expr("concat('c', o_custkey)").alias("bundle_id"), F.col("o_orderpriority").alias("name"), (F.col("o_orderstatus") == "P").alias("deleted"))


_ASSETS = "a AS (SELECT o_orderkey AS asset_id, 'c' || o_custkey AS bundle_id, o_orderpriority AS name, o_orderstatus = 'P' AS deleted FROM orders)"


@query(f"WITH RECURSIVE {BUNDLES}, {CLOSURE}, {_ASSETS} SELECT root, asset_id, bundle_id FROM c JOIN a ON c.node = a.bundle_id")
def bundle_assets(spark: SparkSession, sf_dir: str) -> DataFrame:
    tree = bundles(spark, sf_dir)
    return C.bundle_assets(tree, _assets(spark, sf_dir), tree.select(F.col("bundle_id").alias("root_id"))).select("root", "asset_id", "bundle_id")


@query(f"WITH RECURSIVE {BUNDLES}, {CLOSURE}, {_ASSETS} SELECT asset_id, bundle_id, deleted OR bundle_id IN (SELECT node FROM c WHERE root IN ('r2', 'n3')) AS deleted FROM a")
def soft_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    doomed = spark.createDataFrame([("r2",), ("n3",)], "root_id string")
    return C.soft_delete(bundles(spark, sf_dir), _assets(spark, sf_dir), doomed).select("asset_id", "bundle_id", "deleted")


@query(f"WITH {_ASSETS} SELECT asset_id, bundle_id, name, row_number() OVER (PARTITION BY bundle_id ORDER BY name, asset_id) AS place FROM a WHERE NOT deleted")
def asset_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.listing(_assets(spark, sf_dir)).select("asset_id", "bundle_id", "name", "place")


@query("""SELECT profile, key FROM (SELECT DISTINCT lang AS profile, sha256(text) AS key, min(doc_id) AS m FROM documents GROUP BY ALL) b WHERE NOT EXISTS
(SELECT 1 FROM documents d WHERE d.doc_id % 4 <> 0 AND d.lang = b.profile AND sha256(d.text) = b.key)""")
def unreferenced_blobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("lang").alias("profile"), F.sha2("text", 256).alias("key"), (F.col("doc_id") % 4 == 0).alias("deleted"))
    return C.unreferenced(docs.select("profile", "key").distinct(), docs)


@query("""WITH b AS (SELECT o_orderkey AS key, substr(sha256(CAST(o_orderkey AS VARCHAR)), 1, 4) AS bucket FROM orders)
SELECT key, bucket, CAST(ceil(row_number() OVER (PARTITION BY bucket ORDER BY key) / 20) AS INTEGER) AS batch FROM b""")
def deletion_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.delete_batches(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("key")), 20)


_RAW = "CASE doc_id % 6 WHEN 0 THEN ' ' || source || ' // ' || lang || '/' WHEN 1 THEN '/var/' || source WHEN 2 THEN source || '/../x' WHEN 3 THEN source || '/./' || lang WHEN 4 THEN 'C:\\\\' || source ELSE '  /' || lang END"


@query(f"""WITH r AS (SELECT doc_id, {_RAW.replace(chr(92) * 2, chr(92))} AS raw FROM documents), s AS (SELECT doc_id, raw, list_filter(list_transform(regexp_split_to_array(raw, '[/\\\\]+'), lambda x: trim(x)), lambda x: x <> '' AND x <> '.') AS s FROM r)
SELECT doc_id, CASE WHEN NOT regexp_matches(raw, '^(/|~|\\.{{1,2}}(/|$)|[A-Za-z]:[\\\\/]|\\\\\\\\|file:)') AND NOT list_contains(s, '..') AND len(s) > 0 THEN array_to_string(s, '/') END AS bundle_path FROM s""")
def bundle_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", C.bundle_path(F.expr(_RAW)).alias("bundle_path"))


@query("""WITH d AS (SELECT doc_id, strlen(text) AS size, len(string_split(text, chr(10))) AS pages FROM documents), f AS (SELECT doc_id, unnest(['max_bytes', 'max_pages']) AS rule, unnest([size, pages]) AS actual, unnest([5000, 12]) AS allowed FROM d)
SELECT doc_id, rule, CAST(actual AS BIGINT) AS actual, CAST(allowed AS BIGINT) AS allowed FROM f WHERE actual > allowed""")
def limit_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.octet_length("text").alias("size"), F.size(F.split("text", "\n")).alias("pages"))
    return C.limit_violations(docs, spark.createDataFrame([("max_bytes", 5000), ("max_pages", 12)], "rule string, allowed bigint"))


@query("""SELECT o_orderkey AS unit_id, sha256(o_orderstatus || chr(31) || CASE WHEN 'b' || o_custkey < 'a' || o_orderkey THEN 'b' || o_custkey || chr(30) || 'a' || o_orderkey ELSE 'a' || o_orderkey || chr(30) || 'b' || o_custkey END
|| chr(31) || 'summary' || chr(31) || o_orderpriority || chr(31) || CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE 'm1' END || chr(31) || 'cfg') AS enrichment_id FROM orders""")
def enrichment_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = F.when(F.expr("o_orderkey % 3 <> 0"), "m1")
    anchors = F.array(F.expr("concat('a', o_orderkey)"), F.expr("concat('b', o_custkey)"))
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("unit_id"), C.enrichment_id(F.col("o_orderstatus"), anchors, F.lit("summary"), F.col("o_orderpriority"), model, F.lit("cfg")).alias("enrichment_id"))


@query("SELECT count(DISTINCT sha256(text)) AS created FROM documents WHERE sha256(text) NOT IN (SELECT sha256(text) FROM documents WHERE doc_id % 7 = 0)")
def enrichment_register(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("enrichment_id"))
    return C.not_registered(rows, rows.where("doc_id % 7 = 0"), "enrichment_id").agg(F.count("*").alias("created"))


@query("SELECT o_orderkey AS source_id FROM orders WHERE o_orderstatus <> 'F' AND o_orderkey % 4 <> 1")
def blob_migration(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("source_id"), F.when(F.col("o_orderstatus") == "F", "blob").alias("blob_ref"))
    return C.blob_migration(rows, rows.where("source_id % 4 = 1")).select("source_id")


_KEYS = "['apiKey', 'layout_mode', 'session-token', 'cacheDir', 'maxPages', 'dbPassword']"


@query("""SELECT o_orderkey AS owner, ['apiKey', 'layout_mode', 'session-token', 'cacheDir', 'maxPages', 'dbPassword'][o_orderkey % 6 + 1] AS key FROM orders WHERE o_orderkey % 6 IN (1, 3, 4) AND NOT (o_orderkey % 6 = 3 AND o_orderkey % 5 = 0)""")
def safe_configuration(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = F.expr(_KEYS.replace("[", "array(").replace("]", ")"))
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("owner"), F.get(keys, F.expr("cast(o_orderkey % 6 as int)")).alias("key"), F.expr("if(o_orderkey % 6 = 3 and o_orderkey % 5 = 0, '/tmp/x', 'on')").alias("value"))
    return C.safe_configuration(rows).select("owner", "key")


@query("""SELECT l_orderkey, l_linenumber, CASE WHEN l_linestatus <> 'F' OR l_linenumber < 6 THEN sha256(l_orderkey || chr(31) || l_partkey || chr(31) || l_suppkey || chr(31) || l_returnflag || chr(31) ||
CASE WHEN l_linestatus = 'F' THEN 'm' || l_linenumber ELSE 'none' END || chr(31) || 'document') END AS identity FROM lineitem""")
def extraction_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = F.when(F.col("l_linestatus") == "F", F.when(F.col("l_linenumber") < 6, F.concat(F.lit("m"), F.col("l_linenumber").cast("string")))).otherwise("none")
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", R.extraction_identity(F.col("l_orderkey"), F.col("l_partkey"), F.col("l_suppkey"), F.col("l_returnflag"), model, F.lit("document")).alias("identity"))


@query(f"SELECT o_orderkey, {sid('o_orderkey', 'o_custkey', 'o_orderstatus')} AS stable_id FROM orders")
def stable_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select("o_orderkey", T.stable_id(F.col("o_orderkey"), F.col("o_custkey"), F.col("o_orderstatus")).alias("stable_id"))


_KIND = "CASE event_type WHEN 'signup' THEN 'registered' WHEN 'view' THEN 'reference_added' WHEN 'click' THEN 'reference_removed' WHEN 'purchase' THEN 'expired' ELSE CASE event_id % 40 WHEN 0 THEN 'purged' ELSE CASE WHEN event_id % 2 = 0 THEN 'hold_set' ELSE 'hold_released' END END END"
_EVENTS = f"e AS (SELECT event_id AS event_sequence, user_id AS artifact_id, {_KIND} AS event_type, 'ref' || (event_id % 4) AS reference_id FROM events)"
_STATE = f"""{_EVENTS}, f AS (SELECT artifact_id, reference_id, arg_max(event_type, event_sequence) AS t FROM e WHERE event_type IN ('registered', 'reference_added', 'reference_removed') GROUP BY ALL),
n AS (SELECT artifact_id, count(*) FILTER (t <> 'reference_removed') AS refs FROM f GROUP BY ALL),
s AS (SELECT e.artifact_id, bool_or(event_type = 'purged') AS purged, bool_or(event_type = 'expired') AS expired, coalesce(arg_max(event_type = 'hold_set', event_sequence) FILTER (event_type IN ('hold_set', 'hold_released', 'purged')), false) AS legal_hold, max(event_sequence) AS last_sequence FROM e GROUP BY ALL),
t AS (SELECT s.artifact_id, CASE WHEN purged THEN 0 ELSE coalesce(refs, 0) END AS refs, legal_hold, expired, purged, last_sequence FROM s LEFT JOIN n USING (artifact_id)),
p AS (SELECT *, CASE WHEN purged THEN 'already_purged' WHEN legal_hold THEN 'legal_hold' WHEN refs > 0 THEN 'active_references' WHEN NOT expired THEN 'not_expired' END AS purge_reason FROM t)"""


def retention_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("event_sequence"), F.col("user_id").alias("artifact_id"), F.expr(_KIND).alias("event_type"), F.expr("concat('ref', event_id % 4)").alias("reference_id"), "ts")


def _state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.retention_state(retention_events(spark, sf_dir))


@query(f'WITH {_STATE} SELECT artifact_id, CAST(refs AS BIGINT) AS "references", legal_hold, expired, purged, last_sequence FROM t')
def retention_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _state(spark, sf_dir)


@query(f"WITH {_STATE} SELECT artifact_id, purge_reason FROM p")
def purge_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.purge_reason(_state(spark, sf_dir)).select("artifact_id", "purge_reason")


@query(f"""WITH {_STATE}, q AS (SELECT artifact_id, purge_reason IS NULL AS eligible, purge_reason, substr(sha256(CAST(artifact_id AS VARCHAR)), 1, 4) AS plan_bucket FROM p WHERE NOT purged),
b AS (SELECT plan_bucket, sha256(string_agg(artifact_id || ':' || eligible, ',' ORDER BY artifact_id || ':' || eligible)) AS plan_bucket_id FROM q GROUP BY ALL) SELECT * FROM q JOIN b USING (plan_bucket)""")
def purge_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.purge_plan(_state(spark, sf_dir))


@query(f"WITH {_STATE} SELECT artifact_id, 'purged' AS event_type FROM p WHERE purge_reason IS NULL AND artifact_id % 3 <> 0")
def purge_finalised(spark: SparkSession, sf_dir: str) -> DataFrame:
    state = _state(spark, sf_dir)
    return R.finalised(R.purge_plan(state), state, state.where("artifact_id % 3 = 0"))


@query(f"WITH {_EVENTS} SELECT event_sequence, artifact_id, event_type FROM e WHERE event_sequence > 5000")
def events_after(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.events_after(retention_events(spark, sf_dir), 5000).select("event_sequence", "artifact_id", "event_type")


@query("""WITH r AS (SELECT sha256(CAST(o_custkey % 700 AS VARCHAR)) AS i, o_orderkey AS a, o_orderstatus <> 'P' AND o_orderkey % 5 <> 0 AS ok FROM orders), m AS (SELECT i, min(a) AS artifact_id FROM r WHERE ok GROUP BY i)
SELECT c_custkey AS request_id, sha256(CAST(c_custkey AS VARCHAR)) AS extraction_identity, artifact_id FROM customer LEFT JOIN m ON i = sha256(CAST(c_custkey AS VARCHAR))""")
def reuse_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("request_id"), F.sha2(F.col("c_custkey").cast("string"), 256).alias("extraction_identity"))
    records = table(spark, sf_dir, "orders").select(F.sha2((F.col("o_custkey") % 700).cast("string"), 256).alias("extraction_identity"), F.col("o_orderkey").alias("artifact_id"), F.when(F.col("o_orderstatus") == "P", "expired").otherwise("validated").alias("state"), (F.col("o_orderkey") % 5 == 0).alias("purged"))
    return R.reusable(wanted, records)


@query("""SELECT DISTINCT artifact_id, reference_id FROM (SELECT l_partkey AS artifact_id, CAST(l_orderkey AS VARCHAR) AS reference_id FROM lineitem UNION ALL SELECT o_custkey, CAST(o_orderkey AS VARCHAR) FROM orders)""")
def reference_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.reference_ids((table(spark, sf_dir, "lineitem"), "l_partkey", "l_orderkey"), (table(spark, sf_dir, "orders"), "o_custkey", "o_orderkey"))


@query("""WITH r AS (SELECT 's' || s_suppkey AS id, s_suppkey % 3 <> 0 AS available FROM supplier WHERE s_suppkey % 4 <> 0), c AS (SELECT 's' || s_suppkey AS id, s_suppkey % 2 = 0 AS advertised FROM supplier WHERE s_suppkey % 5 <> 0)
SELECT coalesce(r.id, c.id) AS parser_id, CASE WHEN r.id IS NULL THEN 'catalog' WHEN c.id IS NULL THEN 'runtime' ELSE 'both' END AS source, coalesce(available, false) AS available, coalesce(available, false) <> coalesce(advertised, false) AS conflict FROM r FULL JOIN c ON r.id = c.id""")
def capability_overlay(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("k"), F.expr("concat('s', s_suppkey)").alias("parser_id"))
    return P.overlay(rows.where("k % 4 <> 0").select("parser_id", (F.col("k") % 3 != 0).alias("available")), rows.where("k % 5 <> 0").select("parser_id", (F.col("k") % 2 == 0).alias("advertised")))


_NEEDS = ("hierarchy", "tables", "native_links", "pictures", "native_pdf_text", "paragraph_text", "geometry")
_ABLE = (("structure", "hierarchy", "available"), ("structure", "tables", "declared"), ("structure", "pictures", "unknown"), ("geometry", "native_links", "available"), ("geometry", "geometry", "available"), ("geometry", "native_pdf_text", "declared-when-available"), ("paragraph", "paragraph_text", "available"))


def _requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    needs = [F.when(F.expr(f"doc_id % {k + 2} = 0"), n) for k, n in enumerate(_NEEDS)]
    return table(spark, sf_dir, "documents").select("doc_id", F.filter(F.array(*needs), lambda x: x.isNotNull()).alias("requires"), F.when(F.expr("doc_id % 9 <> 1"), F.expr("(n_chars % 100) / 100.0").cast("double")).alias("native_ratio"))


def _able(spark: SparkSession) -> DataFrame:
    return P.eligible(spark.createDataFrame([("structure", True), ("geometry", True), ("paragraph", None)], "parser_id string, available boolean"), spark.createDataFrame(_ABLE, "parser_id string, capability string, status string"))


_NEEDED = "q AS (SELECT doc_id, CASE WHEN doc_id % 9 <> 1 THEN (n_chars % 100) / 100.0 END AS ratio, unnest([" + ", ".join(f"CASE WHEN doc_id % {k + 2} = 0 THEN '{n}' END" for k, n in enumerate(_NEEDS)) + "]) AS need FROM documents)"


@query(f"""WITH {_NEEDED}, x AS (SELECT doc_id, CASE WHEN need IN ('hierarchy', 'tables') AND ratio >= 0.5 THEN 'structure' WHEN need IN ('native_links', 'geometry', 'native_pdf_text') THEN 'geometry' END AS parser_id,
CASE need WHEN 'hierarchy' THEN 1 WHEN 'tables' THEN 1 WHEN 'native_pdf_text' THEN 4 ELSE 2 END AS rule, need FROM q WHERE need IS NOT NULL)
SELECT doc_id, parser_id, CAST(min(rule) AS INTEGER) AS rule_no, string_agg(need, ',' ORDER BY need) AS purposes FROM x WHERE parser_id IS NOT NULL GROUP BY doc_id, parser_id""")
def routing_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.plan(_requests(spark, sf_dir), P.rules(spark), _able(spark))


@query(f"""WITH {_NEEDED}, n AS (SELECT * FROM q WHERE need IS NOT NULL), c AS (SELECT doc_id, CASE WHEN need IN ('hierarchy', 'tables', 'pictures') THEN 'structure' WHEN need = 'paragraph_text' THEN 'paragraph' ELSE 'geometry' END AS p, need, need NOT IN ('pictures', 'paragraph_text') AS able FROM n WHERE doc_id % 6 <> 0 OR need <> 'tables'),
g AS (SELECT d.doc_id, (SELECT count(*) FROM n WHERE n.doc_id = d.doc_id AND NOT EXISTS (SELECT 1 FROM c WHERE c.doc_id = n.doc_id AND c.need = n.need AND able)) AS lacking,
 (SELECT count(DISTINCT p) FROM c WHERE c.doc_id = d.doc_id) AS runs, (SELECT count(*) FROM c WHERE c.doc_id = d.doc_id AND NOT able) AS unable FROM documents d)
SELECT doc_id, lacking = 0 AND unable = 0 AND runs <= 1 AND runs > 0 AS accepted, concat_ws(',', CASE WHEN lacking > 0 THEN 'purpose_not_covered' END, CASE WHEN unable > 0 THEN 'parser_not_able' END, CASE WHEN runs > 1 THEN 'run_budget_exceeded' END, CASE WHEN runs = 0 THEN 'no_parser' END) AS reasons FROM g""")
def routing_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    requests = _requests(spark, sf_dir)
    chosen = requests.select("doc_id", F.explode("requires").alias("purpose")).where("doc_id % 6 <> 0 or purpose <> 'tables'")
    chosen = chosen.withColumn("parser_id", F.expr("case when purpose in ('hierarchy', 'tables', 'pictures') then 'structure' when purpose = 'paragraph_text' then 'paragraph' else 'geometry' end"))
    return P.validate(requests, chosen, _able(spark), 1)


@query("""SELECT conv_id AS doc_id, arg_min(role, turn) AS parser_id, min(turn) AS turn FROM conversations WHERE turn % 3 <> 0 GROUP BY conv_id""")
def parser_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("role").alias("parser_id"), F.col("turn").alias("text"), F.col("turn").alias("priority"), (F.col("turn") % 3 == 0).alias("failed"))
    return P.first_success(rows).withColumnRenamed("text", "turn")


@query("""SELECT c_nationkey AS run_id, c_custkey AS task_id, CASE WHEN row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) <= 10 THEN 'send' ELSE 'inference_call_limit_reached' END AS decision FROM customer""")
def call_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.within_budget(table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("run_id"), F.col("c_custkey").alias("task_id")), 10)


@query("""SELECT event_id AS proposal_id, CASE WHEN event_type NOT IN ('view', 'click') THEN 'relation_not_allowed' WHEN user_id % 2 = 0 THEN 'unknown_target' ELSE 'inferred' END AS status, greatest(0.0, least(1.0, value / 50)) AS confidence FROM events""")
def bounded_inference(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select(F.col("event_id").alias("proposal_id"), F.col("event_type").alias("relation_type"), F.col("user_id").alias("target_id"), (F.col("value") / 50).alias("confidence"))
    return P.bounded(rows, ("view", "click"), rows.where("target_id % 2 = 1").select(F.col("target_id").alias("anchor_id"))).select("proposal_id", "status", "confidence")


@query("""WITH e AS (SELECT event_id, CASE event_id % 4 WHEN 0 THEN '#/k' WHEN 1 THEN '#/none' WHEN 2 THEN '#' ELSE '#/k~' END AS p, props FROM events) SELECT event_id, p AS pointer,
CASE p WHEN '#/k' THEN CAST(json_extract(props, '$.k') AS VARCHAR) WHEN '#' THEN replace(CAST(json(props) AS VARCHAR), ' ', '') END AS found FROM e""")
def json_pointer(spark: SparkSession, sf_dir: str) -> DataFrame:
    pointer = F.expr("case event_id % 4 when 0 then '#/k' when 1 then '#/none' when 2 then '#' else '#/k~' end")
    return table(spark, sf_dir, "events").select("event_id", pointer.alias("pointer"), J.resolve(F.col("props"), pointer).alias("found"))


@query("""WITH r AS (SELECT o_orderkey AS request_id, o_orderstatus = 'O' AS guarded, o_orderkey % 4 = 0 AS permit FROM orders)
SELECT request_id, CASE WHEN guarded AND NOT permit THEN 'local-2' ELSE 'remote-1' END AS target_id FROM r""")
def inference_target(spark: SparkSession, sf_dir: str) -> DataFrame:
    requests = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("request_id"), F.expr("if(o_orderstatus = 'O', 'restricted', 'public')").alias("classification"), F.expr("o_orderkey % 4 = 0").alias("permit_remote"))
    targets = spark.createDataFrame([(0, "remote-0", False, False), (1, "remote-1", False, True), (2, "local-2", True, True), (3, "local-3", True, True)], "ord int, target_id string, local boolean, healthy boolean")
    return P.select_target(requests, targets)


@query("""SELECT doc_id, 'pdf-' || substr(sha256(text), 1, 12) || '-' || substr('src-' || lpad(CAST(doc_id AS VARCHAR), 12, '0'), 5, 8) || '-' || substr(sha256(lang), 1, 8) AS document_id FROM documents""")
def document_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    asset = F.concat(F.lit("src-"), F.lpad(F.col("doc_id").cast("string"), 12, "0"))
    return table(spark, sf_dir, "documents").select("doc_id", T.document_id(F.sha2("text", 256), asset, F.sha2("lang", 256)).alias("document_id"))
