"""The text-free source graph: gold edges, revisions, and addresses that resolve to one of six statuses."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewell.functions import text as T
from tracewell.operators.hierarchy import closure

CONCRETE = tuple("validated human-validated resolved observed accepted".split())
UNSAFE = tuple("ambiguous unresolved contradicted rejected".split())
STATUSES = tuple("exact redirected ambiguous obsolete forbidden unresolved".split())


def is_gold(target: Column, status: Column, state: Column) -> Column:
    """A target, a concrete status, and neither status nor state unsafe."""
    return target.isNotNull() & F.coalesce(status.isin(*CONCRETE) & ~status.isin(*UNSAFE) & ~F.coalesce(state, F.lit("")).isin(*UNSAFE), F.lit(False))


def has_target(target: Column, status: Column) -> Column:
    """The older rule for a relation that can be followed: a target that was seen or resolved."""
    return target.isNotNull() & F.coalesce(F.lower(status).isin("observed", "resolved"), F.lit(False))


def edges_from(edges: DataFrame, ids: DataFrame, gold_only: bool = True) -> DataFrame:
    """Edges that go out of ``ids`` (id)."""
    chosen = edges.where("gold_eligible") if gold_only else edges
    return chosen.join(ids.select(F.col("id").alias("i_")).distinct(), F.col("source_id") == F.col("i_"), "left_semi")


def edges_to(edges: DataFrame, ids: DataFrame, gold_only: bool = True) -> DataFrame:
    """Edges that come into ``ids`` (id)."""
    chosen = edges.where("gold_eligible") if gold_only else edges
    return chosen.join(ids.select(F.col("id").alias("i_")).distinct(), F.col("target_id") == F.col("i_"), "left_semi")


def owners(resources: DataFrame, divisions: DataFrame, nodes: DataFrame, representations: DataFrame) -> DataFrame:
    """target_id, kind, resource_id of everything an address can point to; a representation belongs to its subject's resource, through as many representations as there are."""
    base = [resources.select(F.col("resource_id").cast("string").alias("target_id"), F.lit("resource").alias("kind"), "resource_id")]
    base += [t.select(F.col(k).cast("string").alias("target_id"), F.lit(kind).alias("kind"), "resource_id") for t, k, kind in ((divisions, "division_id", "division"), (nodes, "node_id", "node"))]
    known = reduce(DataFrame.unionByName, base)
    subjects = known.select(F.col("target_id").alias("s_"), F.col("resource_id").alias("o_"))
    chain = representations.select(F.col("representation_id").cast("string").alias("r_"), F.col("subject_id").cast("string").alias("b_"))
    up = closure(chain, "r_", "b_").where("depth > 0").select(F.col("node").alias("target_id"), "root")
    of = up.join(subjects, F.col("root") == F.col("s_")).select("target_id", F.lit("representation").alias("kind"), F.col("o_").alias("resource_id"))
    return known.unionByName(of)


def revision(*tables: tuple[str, DataFrame]) -> DataFrame:
    """One row: the graph's revision, ``sg-`` and the SHA-256 over all rows of all tables, whatever their order.

    Rows are hashed where they lie and put together by the hash's first two bytes in order,
    so no task holds more than the hashes of a 65,536th of the rows.
    """
    hashed = [t.select(F.sha2(F.concat_ws("\x1f", F.lit(name), *[F.coalesce(F.col(c).cast("string"), F.lit("\x00")) for c in sorted(t.columns)]), 256).alias("h")) for name, t in tables]
    rows = reduce(DataFrame.unionByName, hashed)
    parts = rows.groupBy(F.substring("h", 1, 4).alias("b")).agg(F.sha2(F.array_join(F.sort_array(F.collect_list("h")), ""), 256).alias("p"))
    whole = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("b", "p"))), lambda x: x["p"]), "")
    return parts.agg(F.concat(F.lit("sg-"), F.sha2(whole, 256)).alias("revision"))


def revision_status(claims: DataFrame, *tables: tuple[str, DataFrame]) -> DataFrame:
    """The claims (revision) with ``status``: current, stale for another graph's revision, forged for what is no revision at all."""
    now = revision(*tables).select(F.col("revision").alias("now_"))
    status = F.when(~F.coalesce(F.col("revision").rlike("^sg-[0-9a-f]{64}$"), F.lit(False)), "forged").when(F.col("revision") == F.col("now_"), "current").otherwise("stale")
    return claims.join(F.broadcast(now)).withColumn("status", status).drop("now_")


def strong_addresses(nodes: DataFrame) -> DataFrame:
    """One address per node and its exact span: address_id, source_sha256, resource_id, node_id, char_start, char_end."""
    return nodes.select(F.concat(F.lit("addr-"), T.stable_id(F.col("source_sha256"), F.col("node_id"), F.col("char_start"), F.col("char_end"))).alias("address_id"), "source_sha256", "resource_id", "node_id", "char_start", "char_end")


def resolve_strong(addresses: DataFrame, resources: DataFrame, targets: DataFrame, obsolete: DataFrame, forbidden: DataFrame, graph_revision: str | None = None) -> DataFrame:
    """address_id, status, target_id, reason.

    The first that holds: named obsolete; access forbidden; another graph revision;
    no such resource; another source hash; no such target; the span differs; exact.
    A forbidden address shows no target.
    """
    r = resources.select(F.col("resource_id").alias("r_id"), F.col("source_sha256").alias("r_sha"))
    t = targets.select(F.col("node_id").alias("t_id"), F.col("resource_id").alias("t_res"), F.col("char_start").alias("t_start"), F.col("char_end").alias("t_end"))
    o = obsolete.select(F.col("address_id").alias("o_id")).distinct()
    f = forbidden.select(F.col("resource_id").alias("f_id")).distinct()
    rows = addresses.join(r, F.col("resource_id") == F.col("r_id"), "left").join(t, (F.col("node_id") == F.col("t_id")) & (F.col("resource_id") == F.col("t_res")), "left")
    rows = rows.join(o, F.col("address_id") == F.col("o_id"), "left").join(f, F.col("resource_id") == F.col("f_id"), "left")
    other = F.lit(False) if graph_revision is None else F.col("graph_revision") != graph_revision
    inside = (F.col("char_start") >= F.col("t_start")) & (F.col("char_end") <= F.col("t_end"))
    steps = [
        (F.col("o_id").isNotNull(), "obsolete", "address_obsolete"),
        (F.col("f_id").isNotNull(), "forbidden", "access_denied"),
        (other, "obsolete", "revision_mismatch"),
        (F.col("r_id").isNull(), "unresolved", "resource_missing"),
        (F.col("source_sha256") != F.col("r_sha"), "obsolete", "source_changed"),
        (F.col("t_id").isNull(), "unresolved", "target_missing"),
        (~inside, "unresolved", "selector_mismatch"),
    ]
    status, reason = F.when(steps[0][0], steps[0][1]), F.when(steps[0][0], steps[0][2])
    for broken, s, why in steps[1:]:
        status, reason = status.when(broken, s), reason.when(broken, why)
    status = status.otherwise("exact")
    return rows.select("address_id", status.alias("status"), F.when(status == "exact", F.col("node_id")).alias("target_id"), reason.otherwise("exact_match").alias("reason"))


def resolve_logical(addresses: DataFrame, resources: DataFrame, divisions: DataFrame, forbidden: DataFrame, obsolete: DataFrame | None = None) -> DataFrame:
    """address_id, status, resource_id, candidates of addresses by family and division number.

    Candidates are the family's versioned resources that have the division.  One is
    a redirection; of several, an allowed one makes the address ambiguous, none
    forbidden; none at all leaves it unresolved.
    """
    rows = addresses.select("address_id", "resource_family_id", "division_reference")
    have = divisions.select(F.col("resource_id").alias("v_id"), F.col("number").alias("v_no")).distinct()
    r = resources.where("version is not null").select(F.col("family_id").alias("r_fam"), F.col("resource_id").alias("r_id"))
    f = forbidden.select(F.col("resource_id").alias("f_id")).distinct()
    found = r.join(have, F.col("r_id") == F.col("v_id")).join(f, F.col("r_id") == F.col("f_id"), "left")
    joined = rows.join(found, (F.col("resource_family_id") == F.col("r_fam")) & (F.col("division_reference") == F.col("v_no")), "left")
    out = joined.groupBy("address_id").agg(F.count("r_id").alias("candidates"), F.count_if(F.col("r_id").isNotNull() & F.col("f_id").isNull()).alias("allowed"), F.min("r_id").alias("only"))
    status = F.when(F.col("candidates") == 0, "unresolved").when(F.col("allowed") == 0, "forbidden").when(F.col("candidates") == 1, "redirected").otherwise("ambiguous")
    if obsolete is not None:
        out = out.join(obsolete.select(F.col("address_id").alias("o_id")).distinct(), F.col("address_id") == F.col("o_id"), "left")
        status = F.when(F.col("o_id").isNotNull(), "obsolete").otherwise(status)
    return out.select("address_id", status.alias("status"), F.when(status == "redirected", F.col("only")).alias("resource_id"), "candidates")


def resolve_evidence_set(members: DataFrame, resolved: DataFrame) -> DataFrame:
    """address_id, status, members of sets of strong addresses (address_id, ord, member_id).

    Any forbidden member forbids the set; all exact make it exact; else the first of
    ambiguous, obsolete, unresolved that a member has.  Unknown members are unresolved.
    """
    r = resolved.select(F.col("address_id").alias("r_id"), F.col("status").alias("r_status"))
    rows = members.join(r, F.col("member_id") == F.col("r_id"), "left").withColumn("s_", F.coalesce("r_status", F.lit("unresolved")))
    has = lambda s: F.bool_or(F.col("s_") == s)
    status = F.when(has("forbidden"), "forbidden").when(F.bool_and(F.col("s_") == "exact"), "exact").when(has("ambiguous"), "ambiguous").when(has("obsolete"), "obsolete").otherwise("unresolved")
    return rows.groupBy("address_id").agg(status.alias("status"), F.count("*").alias("members"))


def gold_split(relations: DataFrame) -> DataFrame:
    """relations with ``bucket``: gold, ambiguous or unresolved."""
    gold = is_gold(F.col("target_id"), F.col("status"), F.col("epistemic_state"))
    return relations.withColumn("bucket", F.when(gold, "gold").when(F.col("status") == "ambiguous", "ambiguous").otherwise("unresolved"))


def neighbours_of(edges: DataFrame) -> DataFrame:
    """Out- and in-degrees of every id."""
    both = edges.select(F.col("source_id").alias("id"), F.lit(1).alias("o"), F.lit(0).alias("i")).union(edges.where("target_id is not null").select("target_id", F.lit(0), F.lit(1)))
    return both.groupBy("id").agg(F.sum("o").alias("outgoing"), F.sum("i").alias("incoming"))


def latest(table: DataFrame, key: str, order: str) -> DataFrame:
    """The last row of each key."""
    return table.withColumn("n_", F.row_number().over(Window.partitionBy(key).orderBy(F.col(order).desc()))).where("n_ = 1").drop("n_")
