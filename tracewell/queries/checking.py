"""Queries on proposals, jobs, checks of views and graphs, parser payloads and stores."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.functions import geometry as G
from tracewell.functions import json as J
from tracewell.functions import text as T
from tracewell.operators import catalog as C
from tracewell.operators import documents as D
from tracewell.operators import graph as A
from tracewell.operators import jobs as B
from tracewell.operators import objects as O
from tracewell.operators import retention as N
from tracewell.operators import routing as P
from tracewell.operators import segments as S
from tracewell.queries.addressing import relations
from tracewell.queries.registry import LINES, lines, query, sid, table
from tracewell.queries.segmenting import bundles, nodes
from tracewell.sources import artifacts, files


def _in_spark(sql: str) -> str:
    return sql.replace("[", "array(").replace("]", ")")


# Proposals: one for each order, one invocation for each part of it.

_MODE = "CASE o_orderkey % 4 WHEN 0 THEN 'hybrid' WHEN 1 THEN 'deterministic' WHEN 2 THEN 'llm-directed' ELSE CASE WHEN o_orderkey % 12 = 3 THEN 'agent' ELSE 'deterministic' END END"
_LIST = "CASE WHEN o_orderkey % 5 = 0 THEN ['p0', 'p1', 'p2', 'p3', 'p4', 'p5'] ELSE ['p0', 'p1', 'p2', 'p3', 'p4', 'p5', 'p6'] END"
_TAGS = "CASE WHEN o_custkey % 3 = 0 THEN ['internal'] ELSE ['internal', 'reviewed'] END"
_PARSER = "'p' || l_partkey % 8"
_SCOPE = "CASE WHEN l_suppkey % 13 = 0 THEN 'page' WHEN l_suppkey % 29 = 0 THEN 'block' ELSE 'document' END"
_SKILLS = {f"p{k}": ["tables"] * (k != 3) + ["links"] * (k % 2) for k in range(8)}


def _proposals(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, ...]:
    o, i = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    requests = o.select(F.col("o_orderkey").alias("request_id"), F.expr(_MODE).alias("mode"), F.expr(_in_spark(_LIST)).alias("allowlist"), F.array(F.lit("document"), F.lit("page")).alias("scopes"), F.lit(5).alias("max_runs"), F.expr("o_custkey % 2 = 0").alias("external_allowed"), F.array(F.lit("reviewed")).alias("required_tags"), F.expr("CASE WHEN o_orderkey % 3 = 0 THEN array('tables', 'links') ELSE array('tables') END").alias("requires"))
    made = o.where("o_orderkey % 50 <> 7").select(F.col("o_orderkey").alias("request_id"), F.expr("o_orderstatus = 'F'").alias("external_used"), F.expr(_in_spark(_TAGS)).alias("tags"), F.expr("'v' || o_custkey % 4").alias("provider_id"), F.expr("CASE WHEN o_orderkey % 9 = 1 THEN 'first-success' END").alias("stop_condition"))
    # Lines of one order may share a number, so that invocations stand by number, parser and scope.
    runs = i.where("l_orderkey % 50 <> 7").select(F.col("l_orderkey").alias("request_id"), F.col("l_linenumber").alias("ord"), F.expr(_PARSER).alias("parser_id"), F.expr(_SCOPE).alias("scope"), F.expr("CASE WHEN l_partkey % 16 = 1 THEN array('links') ELSE array('tables') END").alias("purposes"))
    registry = spark.createDataFrame([(f"p{k}", {5: False, 4: None}.get(k, True)) for k in range(7)], "parser_id string, available boolean")
    able = spark.createDataFrame([(p, c) for p, own in _SKILLS.items() for c in own], "parser_id string, capability string")
    profiles = spark.createDataFrame([("v0", False, ["reviewed"]), ("v1", True, ["reviewed", "x"]), ("v2", False, None)], "provider_id string, uses_external boolean, tags array<string>")
    return requests, made, runs, registry, able, profiles


_VALIDATED = f"""o AS (SELECT o_orderkey AS id, {_MODE} AS mode, {_LIST} AS allowed, o_custkey % 2 = 0 AS ext_ok, o_orderkey % 3 = 0 AS links, o_orderkey % 50 <> 7 AS made, o_orderstatus = 'F' AS ext_used, o_custkey % 3 <> 0 AS tagged, o_custkey % 4 AS v, o_orderkey % 9 = 1 AS stops FROM orders),
i AS (SELECT l_orderkey AS id, l_linenumber AS ord, {_PARSER} AS p, l_partkey % 8 AS k, {_SCOPE} AS scope, CASE WHEN l_partkey % 16 = 1 THEN 'links' ELSE 'tables' END AS need FROM lineitem WHERE l_orderkey % 50 <> 7),
n AS (SELECT id, count(*) AS c, count(DISTINCT p || ' ' || scope) AS d, bool_and(scope <> 'block') AS scoped, list(p ORDER BY ord, p, scope) AS ps, bool_and(k < 7) AS reg, bool_and(k < 7 AND k <> 5 AND k <> 4) AS run, bool_and(CASE need WHEN 'tables' THEN k <> 3 ELSE k % 2 = 1 END) AS fit,
  bool_or(k IN (0, 1, 2, 6) AND need = 'tables') AS s_tables, bool_or(k IN (1, 3) AND need = 'links') AS s_links FROM i GROUP BY id),
j AS (SELECT o.*, coalesce(c, 0) AS c, coalesce(d, 0) AS d, coalesce(scoped, true) AS scoped, ps, coalesce(reg, true) AS reg, coalesce(run, true) AS run, coalesce(fit, true) AS fit, coalesce(s_tables, false) AS s_tables, coalesce(s_links, false) AS s_links FROM o LEFT JOIN n ON o.id = n.id),
h AS (SELECT *, mode <> 'agent' AND made AND c = d AS a1, NOT (mode = 'deterministic' AND made AND stops) AS a2, scoped AS a3, mode <> 'hybrid' OR coalesce(ps = list_filter(allowed, lambda x: list_contains(ps, x)), true) AS a4, coalesce(len(list_filter(ps, lambda x: NOT list_contains(allowed, x))) = 0, true) AS b, c > 0 AND c <= 5 AS e,
  CASE WHEN NOT made THEN false WHEN mode = 'deterministic' THEN NOT (ext_used AND NOT ext_ok) AND tagged ELSE v = 0 OR (v = 1 AND ext_ok) END AS f, s_tables AND (s_links OR NOT links) AS g FROM j)"""


@query(f"""WITH {_VALIDATED} SELECT id AS request_id, a1 AND a2 AND a3 AND a4 AS schema_valid, b AS allowlist_valid, e AS budget_valid, f AS security_valid, reg AS registry_valid, run AS runtime_valid, fit AND g AS capability_valid,
a1 AND a2 AND a3 AND a4 AND b AND e AND f AND reg AND run AND fit AND g AS accepted, concat_ws(',', CASE WHEN NOT a1 THEN 'proposal-shape-invalid' END, CASE WHEN NOT a2 THEN 'deterministic-stop-condition-invalid' END, CASE WHEN NOT a3 THEN 'scope-outside-boundary' END, CASE WHEN NOT a4 THEN 'hybrid-invocation-order-invalid' END,
CASE WHEN NOT b THEN 'parser-outside-allowlist' END, CASE WHEN NOT e THEN 'parser-run-budget-exceeded' END, CASE WHEN NOT f THEN 'security-boundary-violated' END, CASE WHEN NOT reg THEN 'parser-not-in-registry' END, CASE WHEN NOT run THEN 'parser-not-runtime-available' END, CASE WHEN NOT fit THEN 'invocation-purpose-unsupported' END, CASE WHEN NOT g THEN 'required-purpose-unresolved' END) AS reasons FROM h""")
def routing_proposals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.validate_proposals(*_proposals(spark, sf_dir))


@query("""SELECT o_orderkey AS request_id, 'v' || o_custkey % 4 AS provider_id, CASE o_custkey % 4 WHEN 3 THEN 'provider-profile-missing' WHEN 1 THEN CASE WHEN o_orderstatus = 'F' THEN 'allowed' ELSE 'external-service-forbidden' END
WHEN 2 THEN 'security-tags-missing' ELSE 'allowed' END AS decision FROM orders""")
def provider_preflight(spark: SparkSession, sf_dir: str) -> DataFrame:
    bounds = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("request_id"), F.expr("'v' || o_custkey % 4").alias("provider_id"), F.expr("o_orderstatus = 'F'").alias("external_allowed"), F.array(F.lit("reviewed")).alias("required_tags"))
    return P.preflight(_proposals(spark, sf_dir)[5], bounds)


@query("""WITH i AS (SELECT l_orderkey AS id, l_linenumber AS n, l_partkey AS k, l_orderkey % 6 <> 0 AS ok, l_orderkey % 7 = 0 AS stops, l_suppkey % 19 = 0 AS page, l_quantity > 48 AS purpose, l_orderkey % 11 = 0 AS guarded FROM lineitem)
SELECT id AS request_id, CASE WHEN NOT bool_and(ok) OR bool_or(stops) OR bool_or(page) OR bool_or(purpose) OR bool_or(guarded) THEN NULL WHEN count(*) = 1 THEN 'fixed' ELSE 'compare' END AS mode,
CASE WHEN NOT (NOT bool_and(ok) OR bool_or(stops) OR bool_or(page) OR bool_or(purpose) OR bool_or(guarded)) THEN string_agg('p' || k, ',' ORDER BY n, 'p' || k) END AS parsers,
CASE WHEN NOT bool_and(ok) THEN 'not-accepted' WHEN bool_or(stops) THEN 'stop-condition' WHEN bool_or(page) THEN 'page-scope' WHEN bool_or(purpose) THEN 'purpose-or-tags' WHEN bool_or(guarded) THEN 'provider-security' END AS refused FROM i GROUP BY id""")
def routing_policies(spark: SparkSession, sf_dir: str) -> DataFrame:
    empty = F.array().cast("array<string>")
    plans = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("request_id"), F.col("l_linenumber").alias("ord"), F.expr("'p' || l_partkey").alias("parser_id"), F.expr("if(l_suppkey % 19 = 0, 'page', 'document')").alias("scope"), F.when(F.col("l_quantity") > 48, F.array(F.lit("tables"))).otherwise(empty).alias("purposes"), empty.alias("tags"),
        F.expr("l_orderkey % 6 <> 0").alias("accepted"), F.expr("if(l_orderkey % 7 = 0, 'x', null)").alias("stop_condition"), F.expr("l_orderkey % 11 = 0").alias("provider_external"), empty.alias("provider_tags"),
    )
    return P.to_policy(plans)


@query("""SELECT o_orderkey AS request_id, CASE o_orderkey % 6 WHEN 4 THEN 'hybrid' WHEN 5 THEN NULL ELSE 'deterministic' END AS mode FROM orders""")
def legacy_modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    mode = F.get(F.array(*map(F.lit, ("fixed", "rule", "fallback", "compare", "agent", "other"))), F.expr("cast(o_orderkey % 6 as int)"))
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("request_id"), P.adaptive_mode(mode).alias("mode"))


@query("""WITH m AS (SELECT 's' || l_suppkey AS parser_id, CASE WHEN l_partkey % 17 = 0 THEN ' ' ELSE l_shipmode_ END AS document_class, CAST(l_linenumber AS VARCHAR) AS metric, l_discount AS value, CAST(l_quantity AS BIGINT) - 2 AS sample_count FROM (SELECT *, l_returnflag || l_linestatus AS l_shipmode_ FROM lineitem))
SELECT *, CASE WHEN trim(document_class) = '' THEN 'empty-name' WHEN sample_count < 0 THEN 'negative-samples' WHEN count(*) OVER (PARTITION BY parser_id, document_class, metric) > 1 THEN 'repeated' END AS problem FROM m""")
def learned_measurements(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.expr("if(l_partkey % 17 = 0, ' ', concat(l_returnflag, l_linestatus))").alias("document_class")
    one = F.struct(kind, F.col("l_linenumber").cast("string").alias("metric"), F.col("l_discount").alias("value"), (F.col("l_quantity").cast("bigint") - 2).alias("sample_count"))
    profiles = table(spark, sf_dir, "lineitem").groupBy(F.expr("'s' || l_suppkey").alias("parser_id")).agg(F.collect_list(one).alias("measured"))
    return P.measurements(profiles)


@query("""SELECT o_orderkey AS request_id, CASE WHEN o_custkey % 4 IN (0, 1) AND o_orderkey % 10 <> 0 THEN 'p' || o_custkey % 4 END AS parser_id, CASE WHEN o_custkey % 4 IN (0, 1) AND o_orderkey % 10 <> 0 THEN CASE WHEN o_orderstatus = 'F' THEN 'bounded_inference_selection' ELSE o_orderpriority END END AS reason,
CASE WHEN o_orderkey % 10 = 0 THEN 'no-candidates' WHEN o_custkey % 4 IN (0, 1) THEN 'selected' ELSE 'outside-allowlist' END AS status FROM orders""")
def inference_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    allowed = F.expr("if(o_orderkey % 10 = 0, array(), array('p0', 'p1'))").cast("array<string>")
    answers = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("request_id"), allowed.alias("candidates"), F.expr("'p' || o_custkey % 4").alias("parser"), F.expr("if(o_orderstatus = 'F', '', o_orderpriority)").alias("reason"))
    return P.chosen_parser(answers)


# Jobs: each user's events.

_JOB = "CASE event_id % 23 WHEN 0 THEN 'ingest_submitted' WHEN 1 THEN 'ingest_queued' WHEN 2 THEN 'ingest_started' WHEN 3 THEN 'cancellation_requested' WHEN 4 THEN CASE event_id % 3 WHEN 0 THEN 'ingest_completed' WHEN 1 THEN 'ingest_cancelled' ELSE 'ingest_failed' END ELSE 'document_ingested' END"
_JOBS = f"e AS (SELECT user_id AS job_id, event_id AS sequence, {_JOB} AS event FROM events)"


def _jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("job_id"), F.expr("'o' || user_id % 7").alias("owner_id"), F.col("event_id").alias("sequence"), F.expr(_JOB).alias("event"))


@query(f"""WITH {_JOBS}, t AS (SELECT *, min(sequence) FILTER (event IN ('ingest_completed', 'ingest_cancelled', 'ingest_failed')) OVER (PARTITION BY job_id) AS stop FROM e), v AS (SELECT *, stop IS NULL OR sequence <= stop AS live FROM t)
SELECT job_id, 'o' || job_id % 7 AS owner_id, CASE arg_max(event, sequence) FILTER (live AND event <> 'document_ingested') WHEN 'ingest_started' THEN 'running' WHEN 'cancellation_requested' THEN 'cancellation_requested' ELSE substr(arg_max(event, sequence) FILTER (live AND event <> 'document_ingested'), 8) END AS state,
count(*) FILTER (live AND event = 'document_ingested') AS documents, count(*) FILTER (NOT live AND event = 'cancellation_requested') AS cancel_refused, max(sequence) AS last_sequence FROM v GROUP BY job_id""")
def job_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.states(_jobs(spark, sf_dir))


@query(f"""WITH {_JOBS}, c AS (SELECT job_id, min(sequence) AS asked FROM e WHERE event = 'cancellation_requested' GROUP BY ALL)
SELECT e.job_id, sequence AS ord, sequence AS started, asked IS NULL OR sequence < asked AS runs FROM e LEFT JOIN c USING (job_id) WHERE event = 'document_ingested'""")
def job_cancellation(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = _jobs(spark, sf_dir)
    return B.cancelled_documents(events.where("event = 'document_ingested'").select("job_id", F.col("sequence").alias("ord"), F.col("sequence").alias("started")), events)


@query(f"""WITH {_JOBS}, w AS (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY sequence) AS place FROM e) SELECT job_id, sequence, event, place FROM w WHERE job_id % 7 = 3 AND sequence > 100""")
def job_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.replay(_jobs(spark, sf_dir), "o3", 100).select("job_id", "sequence", "event", "place")


# Checks of views, graphs and configurations.


@query(f"""WITH {LINES}, n AS (SELECT doc_id, pos, {sid('doc_id', 'pos')} AS node_id, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS i FROM l WHERE pos % 5 <> 0),
w AS (SELECT 'sentence-window:' || a.doc_id || ':' || lpad(CAST(a.i AS VARCHAR), 6, '0') AS segment_id, b.node_id, a.i AS seed, b.i FROM n a JOIN n b ON a.doc_id = b.doc_id AND b.i BETWEEN a.i - 1 AND a.i + 1)
SELECT segment_id, node_id, 'missing' AS rule FROM w WHERE seed % 9 = 2 AND i > seed UNION ALL SELECT segment_id, 'stranger', 'extra' FROM w WHERE seed % 9 = 2 AND i > seed""")
def seg_window_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of which some have another node in place of the one after the seed."""
    own = nodes(spark, sf_dir)
    spans = S.sentence_windows(own)
    number = F.substring_index("segment_id", ":", -1).cast("int")
    seed = spans.where("role = 'seed'").select(F.col("segment_id").alias("s_"), F.col("ord").alias("at_"))
    moved = spans.join(seed, F.col("segment_id") == F.col("s_")).withColumn("node_id", F.when((number % 9 == 2) & (F.col("ord") > F.col("at_")), "stranger").otherwise(F.col("node_id")))
    return S.window_violations(moved.drop("s_", "at_"), own)


@query(f"""WITH {LINES}, s AS (SELECT 'paragraph:' || doc_id || ':' || lpad(CAST(row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS VARCHAR), 6, '0') AS segment_id, {sid('doc_id', 'pos')} AS node_id, length(line) AS n FROM l WHERE pos % 5 <> 0),
h AS (SELECT sha256(segment_id || chr(31) || 'span' || chr(31) || '000000' || chr(31) || node_id || chr(31) || '0' || chr(31) || n) AS h FROM s), k AS (SELECT substr(h, 1, 4) AS b, sha256(string_agg(h, '' ORDER BY h)) AS p FROM h GROUP BY ALL)
SELECT 'paragraph' AS strategy, sha256(string_agg(p, '' ORDER BY b)) AS cache_id, 'old' AS recorded FROM k""")
def seg_digest_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.digest_violations(S.paragraphs(nodes(spark, sf_dir)), spark.createDataFrame([("paragraph", "old")], "strategy string, cache_id string"))


@query("""WITH h AS (SELECT sha256('edges' || chr(31) || n_nationkey || chr(31) || n_regionkey) AS h FROM nation), p AS (SELECT substr(h, 1, 4) AS b, sha256(string_agg(h, '' ORDER BY h)) AS p FROM h GROUP BY ALL), r AS (SELECT 'sg-' || sha256(string_agg(p, '' ORDER BY b)) AS now FROM p),
c AS (SELECT o_orderkey AS claim_id, CASE o_orderkey % 3 WHEN 0 THEN now WHEN 1 THEN 'sg-' || sha256(o_orderstatus) ELSE 'sg-' || o_orderkey END AS revision, o_orderkey % 3 AS k FROM orders, r)
SELECT claim_id, revision, CASE k WHEN 0 THEN 'current' WHEN 1 THEN 'stale' ELSE 'forged' END AS status FROM c""")
def revision_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("a_source"), F.col("n_regionkey").alias("b_target"))
    now = A.revision(("edges", edges))
    claims = table(spark, sf_dir, "orders").join(F.broadcast(now.withColumnRenamed("revision", "now"))).select(F.col("o_orderkey").alias("claim_id"), F.expr("case o_orderkey % 3 when 0 then now when 1 then concat('sg-', sha2(o_orderstatus, 256)) else concat('sg-', o_orderkey) end").alias("revision"))
    return A.revision_status(claims, ("edges", edges)).select("claim_id", "revision", "status")


@query("""SELECT event_id AS relation_id, event_id % 8 <> 0 AND event_id % 6 IN (0, 1) AS followed FROM events""")
def targets_followed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relations(spark, sf_dir).select("relation_id", A.has_target(F.col("target_id"), F.col("status")).alias("followed"))


@query("""WITH RECURSIVE k AS (SELECT c_custkey AS id, CASE WHEN c_custkey % 6 = 0 THEN 'doc' || c_nationkey ELSE 'rep' || (c_custkey - 1) END AS up FROM customer), r AS (SELECT 'rep' || id AS target_id, up FROM k UNION ALL SELECT r.target_id, k.up FROM r JOIN k ON r.up = 'rep' || k.id)
SELECT 'doc' || n_nationkey AS target_id, 'resource' AS kind, 'doc' || n_nationkey AS resource_id FROM nation UNION ALL SELECT target_id, 'representation', up FROM r WHERE up IN (SELECT 'doc' || n_nationkey FROM nation)""")
def representation_owners(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Representations of representations, up to five deep."""
    resources = table(spark, sf_dir, "nation").select(F.expr("'doc' || n_nationkey").alias("resource_id"))
    none = resources.where("false")
    chain = table(spark, sf_dir, "customer").select(F.expr("'rep' || c_custkey").alias("representation_id"), F.expr("if(c_custkey % 6 = 0, 'doc' || c_nationkey, 'rep' || (c_custkey - 1))").alias("subject_id"))
    return A.owners(resources, none.withColumn("division_id", F.lit("")), none.withColumn("node_id", F.lit("")), chain)


_RAW = """CASE doc_id % 9 WHEN 0 THEN '{"mode":"x","deep":{"list":[1,{"apiKey":"v"}]}}' WHEN 1 THEN '{"cacheDir":"/tmp/x"}' WHEN 2 THEN '{"layout":{"tokenizer":"t","size":' || doc_id || '}}' WHEN 3 THEN '[1]' WHEN 4 THEN '{"a":' WHEN 5 THEN '{"runId":1}' WHEN 6 THEN '{"model_path":"org/model-' || doc_id || '"}' WHEN 7 THEN '{"":1}' ELSE '{"a":' || repeat('{"a":', 33) || '1' || repeat('}', 34) END"""


@query(f"""SELECT doc_id, CASE doc_id % 9 WHEN 0 THEN 'forbidden-key' WHEN 1 THEN 'local-path' WHEN 3 THEN 'not-a-mapping' WHEN 4 THEN 'not-json' WHEN 5 THEN 'forbidden-key' WHEN 7 THEN 'key-not-bounded' WHEN 8 THEN 'too-deep' END AS problem FROM documents""")
def configuration_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", C.configuration_problem(F.expr(_RAW)).alias("problem"))


@query("""SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN true WHEN 1 THEN false WHEN 2 THEN true ELSE NULL END AS copies FROM documents""")
def copied_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.expr(r"""CASE doc_id % 4 WHEN 0 THEN '{"spans":[{"node":"a","body" : "x"}]}' WHEN 1 THEN '{"node":"text","note":"\\"text\\": no"}' WHEN 2 THEN '{"text":null}' ELSE '{"text"' END""")
    return table(spark, sf_dir, "documents").select("doc_id", J.copies_text(raw).alias("copies"))


@query("""SELECT c_custkey AS request_id, coalesce(g.allowed, false) AS allowed, CASE WHEN g.allowed IS NULL THEN 'no-grant' WHEN g.allowed THEN 'granted' ELSE 'denied' END AS reason, g.version AS policy_version FROM customer
LEFT JOIN (SELECT n_nationkey AS owner, n_nationkey % 3 <> 0 AS allowed, 2 AS version FROM nation WHERE n_nationkey % 4 <> 1) g ON g.owner = c_nationkey AND c_mktsegment <> 'BUILDING'""")
def authorisations(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = table(spark, sf_dir, "nation").where("n_nationkey % 4 <> 1")
    new = nation.select(F.col("n_nationkey").alias("owner_id"), F.lit("ingest").alias("action"), F.expr("n_nationkey % 3 <> 0").alias("allowed"), F.lit(2).alias("policy_version"))
    old = new.select("owner_id", "action", (~F.col("allowed")).alias("allowed"), F.lit(1).alias("policy_version"))
    requests = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("request_id"), F.col("c_nationkey").alias("owner_id"), F.expr("if(c_mktsegment = 'BUILDING', 'purge', 'ingest')").alias("action"))
    return C.authorised(requests, new.union(old))


@query("""WITH b AS (SELECT 'r' || n_regionkey AS root_id, count(*) AS bundles FROM nation GROUP BY ALL), c AS (SELECT 'c' || o_custkey AS root_id, count(*) FILTER (o_orderstatus <> 'P') AS assets FROM orders GROUP BY ALL)
SELECT root_id, bundles, 0 AS assets FROM b UNION ALL SELECT 'n' || c_nationkey, count(*), 0 FROM customer GROUP BY ALL UNION ALL SELECT root_id, 0, assets FROM c WHERE assets > 0""")
def full_bundles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every bundle that may not be deleted alone."""
    tree = bundles(spark, sf_dir)
    assets = table(spark, sf_dir, "orders").select(F.expr("'c' || o_custkey").alias("bundle_id"), (F.col("o_orderstatus") == "P").alias("deleted"))
    return C.not_empty(tree, assets, tree.select(F.col("bundle_id").alias("root_id")))


_URL = "CASE doc_id % 8 WHEN 0 THEN 'https://example.org/a?b' WHEN 1 THEN 'http://localhost/x' WHEN 2 THEN 'ftp://example.org' WHEN 3 THEN 'https://user@example.org/' WHEN 4 THEN 'http://10.1.2.3/' WHEN 5 THEN 'http://8.8.8.8:80/' WHEN 6 THEN 'https://printer.local' ELSE 'HTTPS://Example.org' END"


@query("SELECT doc_id, doc_id % 8 IN (0, 5, 7) AND doc_id % 3 = 0 AS public_source FROM documents")
def public_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = F.expr("case doc_id % 3 when 0 then '2024-02-29' when 1 then '2023-02-29' else '2024-2-9' end")
    return table(spark, sf_dir, "documents").select("doc_id", T.public_source(F.expr(_URL), day).alias("public_source"))


# Text, payloads of parsers, HTML, stores.


@query("""SELECT doc_id, len(list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '')) AS lines, trim(string_split(trim(source || ' — ' || lang), ' — ')[1]) AS caption, CASE doc_id % 3 WHEN 0 THEN 'http://x.org/' || doc_id WHEN 1 THEN 'the rules' ELSE 'plain words' END AS link FROM documents""")
def string_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    shown = F.expr("case doc_id % 3 when 0 then concat('at http://x.org/', doc_id, ' now') when 1 then 'See also: the rules' else 'plain words' end")
    return table(spark, sf_dir, "documents").select("doc_id", F.size(T.lines(F.col("text"))).alias("lines"), T.caption_head(F.concat_ws(" — ", "source", "lang")).alias("caption"), T.visible_link(shown, F.expr("concat('http://x.org/', doc_id)")).alias("link"))


def _payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Payloads of a layout parser made of lines: every fourth a heading, boxes as lists or objects, the last pages missing."""
    rows = lines(spark, sf_dir)
    box = F.expr("case when pos % 3 = 0 then '[1.0, 2.0, 3.0, 4.0]' when pos % 3 = 1 then '{\"l\":1.0,\"t\":2.0,\"r\":5.0,\"b\":6.0}' else '[1.0]' end")
    item = F.struct(F.col("pos"), F.struct(F.expr("if(pos % 4 = 0, 'section_header', 'text')").alias("label"), F.col("line").alias("text"), F.array(F.struct(F.expr("cast(pos div 5 + 1 as int)").alias("page_no"), box.alias("bbox"))).alias("prov")).alias("item"))
    docs = rows.groupBy("doc_id").agg(F.transform(F.sort_array(F.collect_list(item)), lambda x: x["item"]).alias("texts"), F.greatest(F.max(F.expr("cast(pos div 5 as int)")), F.lit(1)).alias("pages"))
    return docs.select("doc_id", F.to_json(F.struct("texts", "pages")).alias("payload"))


_ITEMS = "w AS (SELECT doc_id, pos AS p, line, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY pos) - 1 AS INTEGER) AS pos, greatest(max(pos // 5) OVER (PARTITION BY doc_id), 1) AS pages FROM l)"


@query(f"""WITH {LINES}, {_ITEMS} SELECT doc_id, pos, CASE WHEN p % 4 = 0 THEN 'section_header' ELSE 'text' END AS label, line AS text, CAST(least(p // 5, pages - 1) AS INTEGER) AS page_index, CASE p % 3 WHEN 0 THEN 3.0 WHEN 1 THEN 5.0 END AS x1 FROM w""")
def parser_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.parser_payload(_payloads(spark, sf_dir)).select("doc_id", "pos", "label", "text", "page_index", F.col("box.x1").alias("x1"))


@query(f"""WITH {LINES}, {_ITEMS}, h AS (SELECT doc_id, pos, line AS title, least(p // 5, pages - 1) AS s, pages FROM w WHERE p % 4 = 0)
SELECT doc_id, pos, title, CAST(s AS INTEGER) AS start_page, CAST(coalesce(lead(s) OVER (PARTITION BY doc_id ORDER BY pos) - 1, pages - 1) AS INTEGER) AS end_page FROM h""")
def payload_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.payload_sections(files.parser_payload(_payloads(spark, sf_dir)))


@query("""SELECT o_custkey AS doc_id, l_linenumber AS image_id, min(l_quantity) AS x0, min(l_discount) AS y0, max(l_quantity + 1) AS x1, max(l_discount + l_tax) AS y1 FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_partkey % 7 <> 0 GROUP BY ALL""")
def image_envelopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    box = F.when(F.expr("l_partkey % 7 <> 0"), G.box(F.col("l_quantity"), F.col("l_discount"), F.col("l_quantity") + 1, F.col("l_discount") + F.col("l_tax")))
    return files.envelope(rows.select(F.col("o_custkey").alias("doc_id"), F.col("l_linenumber").alias("image_id"), box.alias("box"))).select("doc_id", "image_id", "box.x0", "box.y0", "box.x1", "box.y1")


@query("""WITH d AS (SELECT doc_id AS artifact_id, text, lang FROM documents), k AS (SELECT doc_id AS artifact_id, CASE WHEN doc_id % 4 = 2 THEN sha256(text || 'x') ELSE sha256(text) END AS h, CASE WHEN doc_id % 8 = 4 THEN 'other' ELSE lang END AS m FROM documents WHERE doc_id % 2 = 0)
SELECT artifact_id, sha256(text) AS sha256, CASE WHEN h IS NULL THEN 'stored' WHEN h = sha256(text) AND m = lang THEN 'unchanged' ELSE 'conflict' END AS status FROM d LEFT JOIN k USING (artifact_id)""")
def native_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("artifact_id"), F.col("text").cast("binary").alias("payload"), F.col("lang").alias("media_type"))
    store = table(spark, sf_dir, "documents").where("doc_id % 2 = 0").select(F.col("doc_id").alias("artifact_id"), F.expr("sha2(if(doc_id % 4 = 2, concat(text, 'x'), text), 256)").alias("sha256"), F.expr("if(doc_id % 8 = 4, 'other', lang)").alias("media_type"))
    return artifacts.store_native(rows, store).select("artifact_id", "sha256", "status")


@query("SELECT doc_id AS artifact_id FROM documents WHERE doc_id % 5 IN (1, 2)")
def native_damage(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("artifact_id"), F.col("text").cast("binary").alias("payload"), F.expr("sha2(if(doc_id % 5 = 1, concat(text, 'x'), text), 256)").alias("sha256"), (F.octet_length("text") + F.expr("if(doc_id % 5 = 2, 1, 0)")).alias("size"))
    return artifacts.damaged(store).select("artifact_id")


@query("""WITH b AS (SELECT source AS doc_id, doc_id AS page, unnest([0, 2]) AS k, source FROM documents), t AS (SELECT doc_id, page, CASE k WHEN 0 THEN source || ' report  page ' || page ELSE 'Front  matter ' || (page % 9) END AS text, CASE k WHEN 0 THEN 'page_header' ELSE 'page_footer' END AS region FROM b),
m AS (SELECT doc_id, page, region, regexp_replace(trim(regexp_replace(text, '\\s+', ' ', 'g')), '(?i)((?:printed\\s+)?page|front\\s+matter)\\s+(\\d+|[a-z]+-\\d+|[ivxlcdm]+)\\s*$', '<page-label>') AS margin FROM t),
g AS (SELECT doc_id, region, margin, min(page) AS f, string_agg(CAST(page AS VARCHAR), ',' ORDER BY page) AS pages FROM m GROUP BY ALL HAVING count(*) >= 2)
SELECT doc_id, region, margin, pages, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY f, region, margin) AS INTEGER) AS region_no FROM g""")
def region_occurrences(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("source").alias("doc_id"), F.col("doc_id").alias("page"), F.explode(F.array(F.lit(0), F.lit(2))).alias("k"))
    text = F.when(F.col("k") == 0, F.concat("doc_id", F.lit(" report  page "), F.col("page").cast("string"))).otherwise(F.concat(F.lit("Front  matter "), (F.col("page") % 9).cast("string")))
    return O.region_rollup(docs.select("doc_id", "page", text.alias("text"), (F.col("k") * 400.0 + 20).alias("y0"), (F.col("k") * 400.0 + 40).alias("y1"), F.lit(860.0).alias("height")))


# Whole documents: tables over pages, links, and what is built from blocks.


#: Rows of tables that one task makes.
_RULED_ROWS = 100_000


def _ruled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks of one table for each order, three rows a page; every fourth order's later pages begin with another group."""
    items = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc_id"))
    # Numbers of rows are small and their texts are not, so tasks are given by the rows to make and not by the size of the numbers.
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), items.count() // _RULED_ROWS)
    rows = items.repartition(tasks, "doc_id").groupBy("doc_id").agg(F.count("*").cast("int").alias("n"))
    numbered = rows.select("doc_id", F.explode(F.sequence(F.lit(1), F.col("n"))).alias("r")).select("doc_id", F.expr("cast((r - 1) div 3 as int)").alias("page"), F.expr("10 + r").alias("k"), F.expr("concat(r, '\nname ', r, '\nkind\nmore\ntext\nAB-', r)").alias("text"))
    heads = numbered.select("doc_id", "page").distinct()
    group = F.expr("if(doc_id % 4 = 0 and page > 0, 'Other group', 'Group — one')")
    tops = heads.select("doc_id", "page", F.lit(1).alias("k"), group.alias("text")).union(heads.select("doc_id", "page", F.lit(2), F.lit("No\nName\nKind\nText\nCode")))
    captions = heads.where("page = 0").select("doc_id", "page", F.lit(0), F.expr("concat('Table ', doc_id, '-1. Rules')"))
    every = numbered.union(tops).union(captions)
    y = F.col("k") * 10.0
    return every.select("doc_id", "page", (F.col("page") * 1000 + F.col("k")).alias("pos"), F.lit("table").alias("block_type"), "text", G.box(F.lit(0.0), y, F.lit(9.0), y + 8).alias("box"))


_RULED = "t AS (SELECT l_orderkey AS doc_id, count(*) AS n FROM lineitem GROUP BY ALL), r AS (SELECT doc_id, n, unnest(range(1, n + 1)) AS r FROM t)"


@query(f"WITH {_RULED} SELECT doc_id, CAST((r - 1) // 3 AS INTEGER) AS page, CAST(r AS INTEGER) AS row_no, r || '|name ' || r || '|kind|more text|AB-' || r AS cells, false AS code_beside FROM r")
def table_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.table_rows(_ruled(spark, sf_dir)).select("doc_id", "page", "row_no", F.array_join("cells", "|").alias("cells"), "code_beside")


@query(f"""WITH {_RULED} SELECT doc_id, doc_id || '-1' AS number, CAST((r - 1) // 3 AS INTEGER) AS page, CAST((r - 1) // 3 + 1 AS INTEGER) AS part, CAST(r AS INTEGER) AS row_no, CAST(unnest(range(5)) AS INTEGER) AS col_no, unnest(['No', 'Name', 'Kind', 'Text', 'Code']) AS column_name,
unnest([CAST(r AS VARCHAR), 'name ' || r, 'kind', 'more text', 'AB-' || r]) AS cell_text FROM r WHERE n > 3 AND doc_id % 4 <> 0""")
def logical_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.logical_tables(_ruled(spark, sf_dir))


_LINKED = """k AS (SELECT doc_id, pos, CASE WHEN pos % 4 = 0 THEN 'https://x.org/' || pos WHEN pos % 4 = 1 THEN 'mailto:a' END AS target, line FROM l), s AS (SELECT doc_id, pos // 5 AS page, regexp_extract(arg_min(line, pos), '^\\S+') AS title FROM l GROUP BY ALL)"""


@query(f"""WITH {LINES}, {_LINKED} SELECT k.doc_id, k.pos AS link_id, k.pos, CASE WHEN starts_with(target, 'https://') THEN target WHEN contains(lower(line), lower(title)) THEN 's' || page END AS target_id,
CASE WHEN starts_with(target, 'https://') OR contains(lower(line), lower(title)) THEN 'observed' ELSE 'unresolved' END AS status FROM k LEFT JOIN s ON s.doc_id = k.doc_id AND s.page = k.pos // 5 + 1""")
def parser_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A link in each line: to the web, or to the next page, on which a section begins."""
    rows = lines(spark, sf_dir).withColumn("page", F.lit(0))
    y = 20.0 * F.col("pos")
    blocks = rows.select("doc_id", "page", "pos", F.col("line").alias("text"), G.box(F.lit(10.0), y, F.lit(90.0), y + 14).alias("box"))
    links = rows.select("doc_id", "page", F.col("pos").alias("link_id"), G.box(F.lit(12.0), y + 3, F.lit(20.0), y + 9).alias("box"), F.expr("case when pos % 4 = 0 then concat('https://x.org/', pos) when pos % 4 = 1 then 'mailto:a' end").alias("target_text"), F.expr("cast(pos div 5 + 1 as int)").alias("target_page"))
    sections = rows.groupBy("doc_id", F.expr("cast(pos div 5 as int)").alias("page")).agg(F.regexp_extract(F.min_by("line", "pos"), r"^\S+", 0).alias("title"))
    return D.parser_links(links, blocks, sections.withColumn("section_id", F.expr("concat('s', page)")))


#: A document of lines: a heading at every ninth, references in the others.
_BUILT_TEXT = "CASE WHEN pos % 9 = 0 THEN '1.' || (pos % 7) || '. ' || line WHEN pos % 9 = 1 THEN 'See Section 1.' || (pos % 5) || ' and Section 1.' || (pos % 5) || ', ' || line WHEN pos % 9 = 2 THEN 'Look at http://x.org/' || doc_id || ', or http://x.org/' || doc_id || '. ' || line WHEN pos % 9 = 3 THEN 'In Travel Policy, Version 2.' || (doc_id % 3) || ' it says: ' || line WHEN pos % 9 = 4 THEN 'On printed page ' || (pos % 4) || ' stands ' || line WHEN pos % 9 = 5 THEN 'Footnote ' || pos || ' — ' || line ELSE 'Body ' || line END"
_BUILT = f"""q AS (SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY pos) - 1 AS INTEGER) AS place, pos // 6 AS page, pos % 9 AS k, {_BUILT_TEXT} AS text, pos FROM l),
g AS (SELECT doc_id, place, '1.' || (pos % 7) AS number FROM q WHERE k = 0)"""


def _built(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    rows = lines(spark, sf_dir)
    blocks = rows.select("doc_id", "pos", F.expr("cast(pos div 6 as int)").alias("page"), F.expr(_BUILT_TEXT).alias("text"), F.lit("text").alias("observed_type"))
    labels = rows.select("doc_id", F.expr("cast(pos % 4 as string)").alias("label"), F.expr("concat('p', pos % 4)").alias("page_id")).distinct()
    return D.build(blocks, labels=labels)


_CLEAN = "trim(regexp_replace(text, '\\s+', ' ', 'g'))"
_RELATED = f"""c AS (SELECT doc_id, place, {_CLEAN} AS text FROM q WHERE k IN (1, 2, 3, 4) OR k > 5),
e AS (SELECT DISTINCT doc_id, place, literal, target_id FROM (SELECT doc_id, place, unnest(regexp_extract_all(text, '\\bSection\\s+(?:\\d+\\.)*\\d+')) AS literal FROM c) x JOIN (SELECT doc_id AS d, number, doc_id || ':s' || max(place) AS target_id FROM g GROUP BY doc_id, number) s ON d = doc_id AND number = regexp_extract(literal, '(?:\\d+\\.)*\\d+$')),
u AS (SELECT DISTINCT doc_id, place, rtrim(url, '.,;:') AS url FROM (SELECT doc_id, place, unnest(regexp_extract_all(text, 'https?://[^()<>\\[\\]\\s]+')) AS url FROM c)),
pp AS (SELECT DISTINCT doc_id, place, literal, 'p' || right(literal, 1) AS target_id FROM (SELECT doc_id, place, unnest(regexp_extract_all(text, '(?i)\\bprinted page\\s+(?:[A-Z]-\\d+|\\d+|[ivxlcdm]+)\\b')) AS literal FROM c) WHERE (doc_id, right(literal, 1)) IN (SELECT DISTINCT doc_id, CAST(pos % 4 AS VARCHAR) FROM l)),
o AS (SELECT doc_id, place, page, pos FROM q WHERE k = 5), m AS (SELECT o.doc_id, o.place, o.pos, max(x.place) AS near FROM o JOIN q x ON x.doc_id = o.doc_id AND x.page = o.page AND x.place < o.place AND x.k <> 0 GROUP BY ALL),
w AS (SELECT o.doc_id, o.place, coalesce(o.doc_id || ':s' || max(g.place), o.doc_id || ':document') AS owner FROM o LEFT JOIN g ON g.doc_id = o.doc_id AND g.place <= o.place GROUP BY o.doc_id, o.place)"""


@query(f"""WITH {LINES}, {_BUILT}, {_RELATED}
SELECT doc_id, place AS source_pos, literal, target_id, 'references' AS relation_type, 'resolved' AS status, 'deterministic_exact' AS method FROM e UNION ALL SELECT doc_id, place, url, url, 'links_to', 'observed', 'deterministic_url' FROM u
UNION ALL SELECT doc_id, place, literal, target_id, 'references', 'resolved', 'printed_page_label' FROM pp UNION ALL SELECT doc_id, place, NULL, owner, 'owned_by', 'resolved', 'deterministic_exact' FROM w
UNION ALL SELECT doc_id, place, CAST(pos AS VARCHAR), doc_id || ':b' || near, 'annotates', 'resolved', 'deterministic_nearest' FROM m""")
def document_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All relations of documents built whole."""
    return _built(spark, sf_dir)["relations"].select(*D._RELATION)


@query(f"""WITH {LINES}, {_BUILT} SELECT q.doc_id, q.place AS pos, coalesce(q.doc_id || ':s' || max(g.place), q.doc_id || ':document') AS division_id, sha256(q.text) AS text_sha256, CASE WHEN q.k = 0 THEN 'heading' WHEN q.k = 5 THEN 'footnote' WHEN regexp_matches(q.text, 'https?://\\S+') THEN 'url' ELSE 'paragraph' END AS node_kind
FROM q LEFT JOIN g ON g.doc_id = q.doc_id AND g.place <= q.place GROUP BY q.doc_id, q.place, q.text, q.k""")
def document_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _built(spark, sf_dir)["graph_nodes"].select("doc_id", F.col("sequence_number").alias("pos"), "division_id", "text_sha256", "node_kind")


@query(f"""WITH {LINES}, {_BUILT}, n AS (SELECT g.doc_id, g.place, lead(g.place) OVER (PARTITION BY g.doc_id ORDER BY g.place) - 1 AS e FROM g), z AS (SELECT doc_id, max(place) AS last_at, CAST(max(page) AS INTEGER) AS last_page FROM q GROUP BY ALL)
SELECT n.doc_id, n.doc_id || ':s' || n.place AS section_id, CAST(a.page AS INTEGER) AS first_page, CAST(b.page AS INTEGER) AS last_page, 'numbered' AS method FROM n JOIN z ON z.doc_id = n.doc_id JOIN q a ON a.doc_id = n.doc_id AND a.place = n.place JOIN q b ON b.doc_id = n.doc_id AND b.place = coalesce(n.e, z.last_at)
UNION ALL SELECT doc_id, doc_id || ':all', 0, last_page, 'document' FROM z WHERE doc_id NOT IN (SELECT doc_id FROM g)""")
def document_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _built(spark, sf_dir)["section_pages"]


@query(f"""WITH {LINES}, {_BUILT}, x AS (SELECT DISTINCT doc_id, place AS pos, unnest(regexp_extract_all({_CLEAN}, '[A-Z][-A-Za-z0-9’'' &]+(?:Policy|Manual|Handbook),\\s*Version\\s+(?:\\d+\\.)*\\d+')) AS literal FROM q WHERE k IN (1, 2, 3, 4) OR k > 5)
SELECT *, {sid('doc_id', 'pos', 'literal', "'cross_document_reference'")} AS task_id, 'cross_document_reference' AS kind FROM x""")
def document_tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _built(spark, sf_dir)["unresolved"]


@query(f"""WITH {LINES}, {_BUILT}, h AS (SELECT doc_id, sha256(string_agg(sha256(text), '' ORDER BY place)) AS content_sha256, count(*) AS blocks, count(DISTINCT page) AS pages, CAST(sum(length(text)) AS BIGINT) AS characters FROM q GROUP BY ALL) SELECT * FROM h""")
def document_descriptors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _built(spark, sf_dir)["descriptors"]


_TREE = "CASE doc_id % 4 WHEN 0 THEN 'f' || doc_id || '.pdf' WHEN 1 THEN source || '/f' || doc_id || '.pdf' ELSE source || '/' || lang || '/f' || doc_id || '.pdf' END"


@query(f"""WITH f AS (SELECT {_TREE} AS relative_path, doc_id, sha256(text) AS h FROM documents), b AS (SELECT *, CASE WHEN contains(relative_path, '/') THEN 'in/' || regexp_extract(relative_path, '^(.*)/[^/]*$', 1) ELSE 'in' END AS bundle, row_number() OVER (ORDER BY relative_path) AS n FROM f),
s AS (SELECT *, CASE WHEN doc_id % 11 = 3 THEN 'skipped' WHEN n > 150 THEN 'cancelled' WHEN doc_id % 13 = 4 THEN 'failed' END AS st FROM b), k AS (SELECT bundle, h, bool_or(doc_id % 6 <> 0) AS live FROM b WHERE doc_id % 3 = 0 GROUP BY ALL),
r AS (SELECT s.*, live, row_number() OVER (PARTITION BY s.bundle, s.h ORDER BY relative_path) AS i FROM s LEFT JOIN k ON k.bundle = s.bundle AND k.h = s.h WHERE st IS NULL)
SELECT relative_path, bundle, CASE WHEN live OR i > 1 THEN 'already_registered' WHEN NOT live THEN 'restored' ELSE 'created' END AS status, NULL AS error FROM r
UNION ALL SELECT relative_path, bundle, st, CASE WHEN doc_id % 13 = 4 THEN 'unreadable' WHEN doc_id % 11 = 3 THEN 'symlink' END FROM s WHERE st IS NOT NULL""")
def register_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select(F.col("doc_id"), F.expr(_TREE).alias("relative_path"), F.sha2("text", 256).alias("sha256"), F.expr("if(doc_id % 13 = 4, 'unreadable', null)").alias("error"), F.expr("if(doc_id % 11 = 3, 'symlink', null)").alias("reason"))
    known = rows.where("doc_id % 3 = 0").select(C.tree_bundle("in", F.col("relative_path")).alias("bundle"), "sha256", (F.col("doc_id") % 6 == 0).alias("deleted"))
    return C.register_tree(rows.drop("doc_id"), known, "in", cancelled_after=150).drop("asset_id")


@query("""WITH w AS (SELECT DISTINCT source AS path FROM documents UNION SELECT DISTINCT source || '/' || lang FROM documents), b AS (SELECT DISTINCT source || '/' || lang AS path, lang = 'en' AS deleted FROM documents WHERE doc_id % 3 = 0)
SELECT w.path, CASE WHEN contains(w.path, '/') THEN regexp_extract(w.path, '^(.*)/', 1) END AS parent, CASE WHEN b.path IS NULL THEN 'created' WHEN b.deleted THEN 'restored' ELSE 'exists' END AS change FROM w LEFT JOIN b ON b.path = w.path""")
def bundle_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("path", F.concat_ws("/", "source", "lang"))
    return C.bundle_changes(docs.select("path"), docs.where("doc_id % 3 = 0").select("path", (F.col("lang") == "en").alias("deleted")).distinct())


@query("""SELECT source, sha256(text) AS sha256, count(*) AS n FROM documents WHERE doc_id % 3 <> 0 GROUP BY ALL HAVING count(*) > 1""")
def unique_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("source", F.sha2("text", 256).alias("sha256"), (F.col("doc_id") % 3 == 0).alias("deleted"))
    return C.unique_violations(rows, ["source", "sha256"], ~F.col("deleted"))


@query("""SELECT 'p' || user_id % 3 AS profile, event_id AS key FROM events WHERE event_id % 5 <> 0 AND ts < (SELECT max(ts) FROM events) - INTERVAL 7 DAY""")
def blobs_past_grace(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select(F.expr("'p' || user_id % 3").alias("profile"), F.col("event_id").alias("key"), F.col("ts").alias("created_at"), (F.col("event_id") % 5 != 0).alias("deleted"))
    now = rows.agg(F.max("created_at").alias("now"))
    return C.past_grace(rows.join(F.broadcast(now)), rows, F.col("now")).select("profile", "key")


@query("SELECT event_id, sha256(replace(CAST(json(props) AS VARCHAR), ' ', '')) AS canonical_sha256 FROM events")
def canonical_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", J.canonical_hash(F.col("props")).alias("canonical_sha256"))


@query("SELECT event_id, event_id % 3 = 0 AS strict FROM events")
def strict_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.expr("""case event_id % 3 when 0 then props when 1 then '{"a":1,"a":2}' else '{"a":NaN}' end""")
    return table(spark, sf_dir, "events").select("event_id", J.strict(raw).alias("strict"))


_ASK = "['register', 'add', 'remove', 'hold', 'release', 'expire', 'other']"


@query(f"""WITH e AS (SELECT user_id AS a, event_id AS s, CASE event_id % 4 WHEN 0 THEN 'registered' WHEN 1 THEN 'reference_added' WHEN 2 THEN 'reference_removed' ELSE CASE event_id % 7 WHEN 0 THEN 'purged' WHEN 1 THEN 'hold_set' WHEN 2 THEN 'hold_released' ELSE 'expired' END END AS t, 'r' || event_id % 3 AS r FROM events),
f AS (SELECT a, r, arg_max(t <> 'reference_removed', s) AS held FROM e WHERE t IN ('registered', 'reference_added', 'reference_removed') GROUP BY ALL), n AS (SELECT a, count(*) FILTER (held) AS refs FROM f GROUP BY ALL),
k AS (SELECT a, bool_or(t = 'purged') AS purged, bool_or(t = 'expired') AS expired, coalesce(arg_max(t = 'hold_set', s) FILTER (t IN ('hold_set', 'hold_released', 'purged')), false) AS hold FROM e GROUP BY ALL),
q AS (SELECT o_orderkey AS id, o_custkey AS a, {_ASK}[o_orderkey % 7 + 1] AS ask, 'r' || o_orderkey % 3 AS r FROM orders),
j AS (SELECT q.*, k.a IS NOT NULL AS known, purged, expired, hold, coalesce(refs, 0) AS refs, coalesce(held, false) AS held, row_number() OVER (PARTITION BY q.a, ask, q.r ORDER BY id) AS i FROM q LEFT JOIN k ON k.a = q.a LEFT JOIN n ON n.a = q.a LEFT JOIN f ON f.a = q.a AND f.r = q.r),
o AS (SELECT *, CASE WHEN coalesce(purged, false) OR (NOT known AND ask <> 'register') OR (ask = 'expire' AND (hold OR refs > 0)) OR ask = 'other' THEN 'refused' WHEN i > 1 OR CASE ask WHEN 'register' THEN known WHEN 'add' THEN held WHEN 'remove' THEN NOT held WHEN 'hold' THEN hold WHEN 'release' THEN NOT hold ELSE expired END THEN 'unchanged' ELSE 'changed' END AS outcome FROM j)
SELECT id AS request_id, a AS artifact_id, r AS reference_id, CASE WHEN outcome = 'changed' THEN CASE ask WHEN 'register' THEN 'registered' WHEN 'add' THEN 'reference_added' WHEN 'remove' THEN 'reference_removed' WHEN 'hold' THEN 'hold_set' WHEN 'release' THEN 'hold_released' ELSE 'expired' END END AS event_type, outcome FROM o""")
def retention_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = "case event_id % 4 when 0 then 'registered' when 1 then 'reference_added' when 2 then 'reference_removed' else case event_id % 7 when 0 then 'purged' when 1 then 'hold_set' when 2 then 'hold_released' else 'expired' end end"
    events = table(spark, sf_dir, "events").select(F.col("event_id").alias("event_sequence"), F.col("user_id").alias("artifact_id"), F.expr(kind).alias("event_type"), F.expr("'r' || event_id % 3").alias("reference_id"))
    asked = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("request_id"), F.col("o_custkey").alias("artifact_id"), F.expr(f"{_in_spark(_ASK)}[cast(o_orderkey % 7 as int)]").alias("request"), F.expr("'r' || o_orderkey % 3").alias("reference_id"))
    return N.changes(asked, events)


@query("""WITH r AS (SELECT o_custkey AS i, o_orderkey AS a, o_orderkey % 4 AS k FROM orders WHERE o_orderstatus <> 'P'), m AS (SELECT i, min(a) AS a FROM r GROUP BY i)
SELECT c_custkey AS request_id, a AS artifact_id, CASE WHEN a IS NULL THEN 'miss' WHEN a % 4 IN (0, 1) THEN 'reused' ELSE 'released_damaged' END AS outcome FROM customer LEFT JOIN m ON i = c_custkey""")
def reuse_checked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Artifacts asked for again, of which some have lost their payload and some have another one."""
    o = table(spark, sf_dir, "orders")
    records = o.select(F.col("o_custkey").alias("extraction_identity"), F.col("o_orderkey").alias("artifact_id"), F.sha2("o_orderpriority", 256).alias("artifact_sha256"), F.lit("validated").alias("state"), (F.col("o_orderstatus") == "P").alias("purged"))
    payloads = o.where("o_orderkey % 4 <> 3").select(F.col("o_orderkey").alias("artifact_id"), F.expr("sha2(if(o_orderkey % 4 = 2, 'x', o_orderpriority), 256)").alias("sha256"))
    return N.acquired(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("request_id"), F.col("c_custkey").alias("extraction_identity")), records, payloads)


@query("""WITH f AS (SELECT l_orderkey AS region_id, CAST(l_linenumber AS VARCHAR) AS fact, min(l_suppkey) AS v FROM lineitem GROUP BY ALL), o AS (SELECT l_orderkey AS region_id, CAST(l_linenumber AS VARCHAR) AS fact, l_suppkey + CASE WHEN l_partkey % 3 = 0 THEN 1 ELSE 0 END AS v, l_returnflag AS parser FROM lineitem),
j AS (SELECT f.region_id, f.fact, coalesce(string_agg(DISTINCT parser, '|' ORDER BY parser), '') AS ps FROM f LEFT JOIN o ON f.region_id = o.region_id AND f.fact = o.fact AND f.v = o.v GROUP BY ALL)
SELECT region_id, string_agg(fact || '=' || ps, ';' ORDER BY fact) AS sources FROM j GROUP BY region_id""")
def fact_source_maps(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("region_id"), F.col("l_linenumber").cast("string").alias("fact"), "l_suppkey", "l_partkey", F.col("l_returnflag").alias("parser_id"))
    facts = rows.groupBy("region_id", "fact").agg(F.sha2(F.min("l_suppkey").cast("string"), 256).alias("value_sha256"))
    seen = rows.select("region_id", "fact", "parser_id", F.sha2(F.expr("l_suppkey + if(l_partkey % 3 = 0, 1, 0)").cast("string"), 256).alias("value_sha256"))
    shown = F.transform(F.map_entries("sources"), lambda e: F.concat(e["key"], F.lit("="), F.array_join(e["value"], "|")))
    return O.fact_source_maps(facts, seen).select("region_id", F.array_join(shown, ";").alias("sources"))


@query(f"""WITH {LINES} SELECT {sid('doc_id', 'pos')} AS address_id, CASE WHEN doc_id % 2 = 0 THEN 'exact' ELSE 'obsolete' END AS status, CASE WHEN doc_id % 2 = 0 THEN 'exact_match' ELSE 'revision_mismatch' END AS reason FROM l""")
def resolve_revisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Addresses made against the present graph and against an older one."""
    rows = nodes(spark, sf_dir).select("node_id", F.col("doc_id").cast("string").alias("resource_id"), F.lit(0).alias("char_start"), F.col("n_chars").alias("char_end"), F.lit("h").alias("source_sha256"), F.expr("if(doc_id % 2 = 0, 'sg-now', 'sg-old')").alias("graph_revision"))
    resources = rows.select("resource_id", "source_sha256").distinct()
    none = rows.where("false")
    found = A.resolve_strong(rows.withColumn("address_id", F.col("node_id")), resources, rows, none.select(F.col("node_id").alias("address_id")), none.select("resource_id"), "sg-now")
    return found.select("address_id", "status", "reason")
