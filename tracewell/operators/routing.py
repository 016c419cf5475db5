"""Which parsers run on a document: capabilities, deterministic rules, validation of proposals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

ELIGIBLE = ("declared", "declared-when-available", "available")
#: rule, triggers, parser, least share of native text
RULES = (
    (1, "structure-first", ["hierarchy", "tables"], "structure", 0.5),
    (2, "links-and-labels", ["native_links", "page_labels", "geometry"], "geometry", None),
    (3, "pictures", ["pictures", "provenance"], "structure", None),
    (4, "plain-native-text", ["native_pdf_text"], "geometry", None),
    (5, "paragraphs", ["paragraph_text"], "paragraph", None),
)


def rules(spark: SparkSession, rows=RULES) -> DataFrame:
    return spark.createDataFrame(rows, "rule_no int, rule_id string, triggers array<string>, parser_id string, least_ratio double")


def overlay(runtime: DataFrame, catalog: DataFrame) -> DataFrame:
    """Full outer join of what runs (parser_id, available) and what is catalogued (parser_id, advertised).

    A parser that is advertised and does not run, or runs unadvertised, is a conflict
    that stays; what runs decides.
    """
    r = runtime.select(F.col("parser_id").alias("r_"), F.col("available"))
    c = catalog.select(F.col("parser_id").alias("c_"), F.col("advertised"))
    rows = r.join(c, F.col("r_") == F.col("c_"), "full_outer")
    return rows.select(F.coalesce("r_", "c_").alias("parser_id"), F.when(F.col("r_").isNull(), "catalog").when(F.col("c_").isNull(), "runtime").otherwise("both").alias("source"), F.coalesce("available", F.lit(False)).alias("available"), (F.coalesce("available", F.lit(False)) != F.coalesce("advertised", F.lit(False))).alias("conflict"))


def eligible(parsers: DataFrame, capabilities: DataFrame) -> DataFrame:
    """parser_id, capability of parsers that run now and have the capability in an eligible status."""
    running = parsers.where(F.col("available").eqNullSafe(F.lit(True))).select(F.col("parser_id").alias("p_"))
    return capabilities.where(F.col("status").isin(*ELIGIBLE)).join(running, F.col("parser_id") == F.col("p_"), "left_semi").select("parser_id", "capability").distinct()


def matches(requires: Column, ratio: Column, triggers: Column, least: Column) -> Column:
    """Whether a rule fits: a trigger is required, and enough native text if the rule asks for some (an unknown share is not enough)."""
    return F.arrays_overlap(requires, triggers) & (least.isNull() | F.coalesce(ratio >= least, F.lit(False)))


def plan(requests: DataFrame, rule_table: DataFrame, able: DataFrame) -> DataFrame:
    """doc_id, parser_id, rule_no (of the first rule that chose it), purposes (required capabilities it serves, sorted)."""
    r = rule_table.select("rule_no", "triggers", F.col("parser_id").alias("parser"), "least_ratio")
    rows = requests.join(r, matches(F.col("requires"), F.col("native_ratio"), F.col("triggers"), F.col("least_ratio")))
    rows = rows.withColumn("purpose", F.explode(F.array_intersect("requires", "triggers")))
    a = able.select(F.col("parser_id").alias("a_"), F.col("capability").alias("k_"))
    rows = rows.join(a, (F.col("parser") == F.col("a_")) & (F.col("purpose") == F.col("k_")), "left_semi")
    return rows.groupBy("doc_id", F.col("parser").alias("parser_id")).agg(F.min("rule_no").alias("rule_no"), F.array_join(F.sort_array(F.collect_set("purpose")), ",").alias("purposes"))


def validate(requests: DataFrame, chosen: DataFrame, able: DataFrame, budget: int) -> DataFrame:
    """doc_id, accepted and reasons of plans: uncovered purposes, parsers not able, too many runs, none at all.

    ``requests``: doc_id, requires; ``chosen``: doc_id, parser_id, purpose (long).
    """
    need = requests.select(F.col("doc_id").alias("d_"), F.explode("requires").alias("need"))
    a = able.select(F.col("parser_id").alias("a_"), F.col("capability").alias("k_"))
    marked = chosen.join(a.withColumn("able_", F.lit(True)), (F.col("parser_id") == F.col("a_")) & (F.col("purpose") == F.col("k_")), "left")
    covered = marked.where("able_").select(F.col("doc_id").alias("cd_"), F.col("purpose").alias("cp_")).distinct()
    lacking = need.join(covered, (F.col("d_") == F.col("cd_")) & (F.col("need") == F.col("cp_")), "left_anti").groupBy("d_").agg(F.count("*").alias("lacking"))
    runs = marked.groupBy(F.col("doc_id").alias("m_")).agg(F.count_distinct("parser_id").alias("runs"), F.count_if(F.col("able_").isNull()).alias("unable"))
    rows = requests.join(lacking, F.col("doc_id") == F.col("d_"), "left").join(runs, F.col("doc_id") == F.col("m_"), "left")
    reasons = [("purpose_not_covered", F.coalesce("lacking", F.lit(0)) > 0), ("parser_not_able", F.coalesce("unable", F.lit(0)) > 0), ("run_budget_exceeded", F.coalesce("runs", F.lit(0)) > budget), ("no_parser", F.coalesce("runs", F.lit(0)) == 0)]
    found = F.filter(F.array(*[F.when(broken, r) for r, broken in reasons]), lambda r: r.isNotNull())
    return rows.select("doc_id", (F.size(found) == 0).alias("accepted"), F.array_join(found, ",").alias("reasons"))


def first_success(results: DataFrame) -> DataFrame:
    """Fallback: for each document the result of the first parser in order that did not fail."""
    return results.where("not failed").groupBy("doc_id").agg(F.min_by(F.struct("parser_id", "text"), "priority").alias("r_")).select("doc_id", "r_.*")


def within_budget(tasks: DataFrame, calls: int) -> DataFrame:
    """Tasks of each run with ``decision``: the first ``calls`` by task id are sent, the rest are left unresolved."""
    order = F.row_number().over(Window.partitionBy("run_id").orderBy("task_id"))
    return tasks.withColumn("decision", F.when(order <= calls, "send").otherwise("inference_call_limit_reached"))


def bounded(proposals: DataFrame, relation_types: tuple[str, ...], anchors: DataFrame) -> DataFrame:
    """Proposals of a model with status: accepted ones name an allowed relation and a known target; confidence is clamped to 0..1."""
    known = anchors.select(F.col("anchor_id").alias("k_")).distinct()
    rows = proposals.join(known, F.col("target_id") == F.col("k_"), "left")
    status = F.when(~F.col("relation_type").isin(*relation_types), "relation_not_allowed").when(F.col("k_").isNull(), "unknown_target").otherwise("inferred")
    return rows.withColumn("status", status).withColumn("confidence", F.greatest(F.lit(0.0), F.least(F.lit(1.0), "confidence"))).drop("k_")


def keeps_order(chosen: Column, allowed: Column) -> Column:
    """Whether the chosen parsers are all allowed and stand in the order of the allow-list."""
    return F.array_intersect(allowed, chosen) == chosen


def select_target(requests: DataFrame, targets: DataFrame) -> DataFrame:
    """The first healthy inference target in order for each request; sensitive data stays local unless the request permits otherwise.

    ``requests``: request_id, classification, permit_remote; ``targets``: ord, target_id, local, healthy.
    """
    guarded = F.col("classification").isin("sensitive", "restricted", "confidential") & ~F.col("permit_remote")
    rows = requests.join(targets.where("healthy"), F.col("local") | ~guarded, "left")
    return rows.groupBy("request_id").agg(F.min_by("target_id", "ord").alias("target_id"))


MODES = ("deterministic", "hybrid", "llm-directed")


def adaptive_mode(legacy: Column) -> Column:
    """The mode that stands for an older one (RT-7): an agent's is hybrid, all that follow rules are deterministic; null for a name that is none."""
    return F.when(legacy == "agent", "hybrid").when(legacy.isin("compare", "fallback", "fixed", "rule"), "deterministic")


def _holds(required: Column, given: Column) -> Column:
    """Whether all of ``required`` are among ``given``; a null is an empty list."""
    empty = F.array().cast("array<string>")
    return F.size(F.array_except(F.coalesce(required, empty), F.coalesce(given, empty))) == 0


def preflight(profiles: DataFrame, boundaries: DataFrame) -> DataFrame:
    """request_id, provider_id, decision of trusted provider profiles, before any provider is called and whatever it may claim later.

    ``boundaries``: request_id, provider_id, external_allowed, required_tags; ``profiles``:
    provider_id, uses_external, tags.  The decision is ``allowed`` or the first reason against.
    """
    known = profiles.select(F.col("provider_id").alias("p_"), "uses_external", "tags")
    rows = boundaries.join(known, F.col("provider_id") == F.col("p_"), "left")
    decision = F.when(F.col("p_").isNull(), "provider-profile-missing").when(F.col("uses_external").isNull(), "provider-profile-invalid").when(F.col("uses_external") & ~F.col("external_allowed"), "external-service-forbidden").when(~_holds(F.col("required_tags"), F.col("tags")), "security-tags-missing").otherwise("allowed")
    return rows.select("request_id", "provider_id", decision.alias("decision"))


def validate_proposals(requests: DataFrame, proposals: DataFrame, invocations: DataFrame, registry: DataFrame, able: DataFrame, profiles: DataFrame) -> DataFrame:
    """request_id, seven flags, ``accepted`` (all of them) and the reasons against in the order of the checks.

    ``requests``: request_id, mode, allowlist, scopes, max_runs, external_allowed, required_tags,
    requires; ``proposals``: request_id, external_used, tags, provider_id, stop_condition;
    ``invocations``: request_id, ord, parser_id, scope, purposes; ``registry``: parser_id,
    available; ``able``: parser_id, capability; ``profiles``: provider_id, uses_external, tags.
    A deterministic proposal answers for its own facts; others only count by the trusted
    profile of their provider.  A request without a proposal is not accepted; one without
    invocations runs too few parsers and serves nothing, but breaks no other rule.
    """
    known = registry.select(F.col("parser_id").alias("k_"), F.coalesce("available", F.lit(False)).alias("available"))
    skills = able.groupBy(F.col("parser_id").alias("a_")).agg(F.collect_set("capability").alias("skills"))
    runs = invocations.join(known, F.col("parser_id") == F.col("k_"), "left").join(skills, F.col("parser_id") == F.col("a_"), "left")
    runs = runs.withColumn("fit_", _holds(F.col("purposes"), F.col("skills")))
    each = F.sort_array(F.collect_list(F.struct("ord", "parser_id", "scope")))
    runs = runs.groupBy(F.col("request_id").alias("i_")).agg(
        each.alias("each"), F.bool_and(F.col("k_").isNotNull()).alias("registered"), F.bool_and(F.coalesce("available", F.lit(False))).alias("running"), F.bool_and("fit_").alias("fit"), F.array_distinct(F.flatten(F.collect_list(F.when(F.col("available") & F.col("fit_"), F.col("purposes"))))).alias("served")
    )
    p = proposals.select(F.col("request_id").alias("p_"), "external_used", F.col("tags").alias("p_tags"), F.col("provider_id").alias("p_provider"), "stop_condition")
    t = profiles.select(F.col("provider_id").alias("t_"), F.col("uses_external").alias("t_external"), F.col("tags").alias("t_tags"))
    rows = requests.join(p, F.col("request_id") == F.col("p_"), "left").join(runs, F.col("request_id") == F.col("i_"), "left").join(t, F.col("p_provider") == F.col("t_"), "left")
    parsers, pairs = F.transform("each", lambda x: x["parser_id"]), F.transform("each", lambda x: F.struct(x["parser_id"], x["scope"]))
    count = F.coalesce(F.size("each"), F.lit(0))
    plain = F.col("mode") == "deterministic"
    no, yes = F.lit(False), F.lit(True)
    shape = F.col("mode").isin(*MODES) & F.col("p_").isNotNull() & F.col("external_used").isNotNull() & (F.coalesce(F.size(F.array_distinct(pairs)), F.lit(0)) == count)
    stops = plain & F.col("stop_condition").isNotNull()
    scope = ~F.exists("each", lambda x: ~F.array_contains("scopes", x["scope"]))
    order = (F.col("mode") != "hybrid") | (parsers == F.array_intersect("allowlist", parsers))
    own = ~(F.col("external_used") & ~F.col("external_allowed")) & _holds(F.col("required_tags"), F.col("p_tags"))
    trusted = F.col("t_").isNotNull() & ~(F.col("t_external") & ~F.col("external_allowed")) & _holds(F.col("required_tags"), F.col("t_tags"))
    checks = [
        ("schema_valid", "proposal-shape-invalid", F.coalesce(shape, no)),
        ("schema_valid", "deterministic-stop-condition-invalid", ~stops),
        ("schema_valid", "scope-outside-boundary", F.coalesce(scope, yes)),
        ("schema_valid", "hybrid-invocation-order-invalid", F.coalesce(order, yes)),
        ("allowlist_valid", "parser-outside-allowlist", F.coalesce(_holds(parsers, F.col("allowlist")), no)),
        ("budget_valid", "parser-run-budget-exceeded", (count > 0) & (count <= F.col("max_runs"))),
        ("security_valid", "security-boundary-violated", F.coalesce(F.when(plain, own).otherwise(trusted), no)),
        ("registry_valid", "parser-not-in-registry", F.coalesce("registered", yes)),
        ("runtime_valid", "parser-not-runtime-available", F.coalesce("running", yes)),
        ("capability_valid", "invocation-purpose-unsupported", F.coalesce("fit", yes)),
        ("capability_valid", "required-purpose-unresolved", _holds(F.col("requires"), F.col("served"))),
    ]
    flags: dict[str, Column] = {}
    for flag, _, holds in checks:
        flags[flag] = flags[flag] & holds if flag in flags else holds
    accepted = F.lit(True)
    for holds in flags.values():
        accepted = accepted & holds
    reasons = F.filter(F.array(*[F.when(~holds, reason) for _, reason, holds in checks]), lambda r: r.isNotNull())
    return rows.select("request_id", *[c.alias(name) for name, c in flags.items()], accepted.alias("accepted"), F.array_join(reasons, ",").alias("reasons"))


def to_policy(plans: DataFrame) -> DataFrame:
    """request_id, mode, parsers of accepted plans as an older policy, or ``refused`` with what that policy could not say.

    ``plans``: request_id, ord, parser_id, scope, purposes, tags, accepted, stop_condition,
    provider_external, provider_tags, one row for each invocation.
    """
    some = lambda c: F.coalesce(F.size(c), F.lit(0)) > 0
    rows = plans.groupBy("request_id").agg(
        F.bool_and("accepted").alias("ok"), F.bool_or(F.col("stop_condition").isNotNull()).alias("stops"), F.bool_or(F.col("scope") != "document").alias("scoped"), F.bool_or(some("purposes") | some("tags")).alias("purposeful"), F.bool_or(F.coalesce("provider_external", F.lit(False)) | some("provider_tags")).alias("guarded"),
        F.transform(F.sort_array(F.collect_list(F.struct("ord", "parser_id"))), lambda x: x["parser_id"]).alias("p_"),
    )
    refused = F.when(~F.col("ok"), "not-accepted").when(F.col("stops"), "stop-condition").when(F.col("scoped"), "page-scope").when(F.col("purposeful"), "purpose-or-tags").when(F.col("guarded"), "provider-security")
    mode = F.when(refused.isNull(), F.when(F.size("p_") == 1, "fixed").otherwise("compare"))
    return rows.select("request_id", mode.alias("mode"), F.when(refused.isNull(), F.array_join("p_", ",")).alias("parsers"), refused.alias("refused"))


def measurements(profiles: DataFrame) -> DataFrame:
    """parser_id, document_class, metric, value, sample_count, problem of measured outcomes, as recorded and never averaged.

    ``profiles``: parser_id, measured (an array of structs of the other four).  A problem is
    ``empty-name``, ``value-not-finite``, ``negative-samples`` or ``repeated``.
    """
    rows = profiles.select("parser_id", F.explode("measured").alias("m_")).select("parser_id", "m_.*")
    times = F.count("*").over(Window.partitionBy("parser_id", "document_class", "metric"))
    blank = lambda c: F.coalesce(F.trim(c), F.lit("")) == ""
    finite = F.col("value").isNotNull() & ~F.isnan("value") & (F.abs("value") != float("inf"))
    problem = F.when(blank(F.col("document_class")) | blank(F.col("metric")), "empty-name").when(~finite, "value-not-finite").when(F.coalesce("sample_count", F.lit(-1)) < 0, "negative-samples").when(times > 1, "repeated")
    return rows.withColumn("problem", problem)


def chosen_parser(answers: DataFrame) -> DataFrame:
    """request_id, parser_id, reason, status of a model's choice (request_id, candidates, parser, reason), which counts only if it is one of the candidates."""
    inside = F.coalesce(F.array_contains("candidates", F.col("parser")), F.lit(False))
    status = F.when(F.coalesce(F.size("candidates"), F.lit(0)) <= 0, "no-candidates").when(inside, "selected").otherwise("outside-allowlist")
    return answers.select("request_id", F.when(inside, F.col("parser")).alias("parser_id"), F.when(inside, F.coalesce(F.nullif("reason", F.lit("")), F.lit("bounded_inference_selection"))).alias("reason"), status.alias("status"))
