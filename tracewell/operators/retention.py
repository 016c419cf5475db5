"""Extraction identities and the life of artifacts, as a fold over an append-only event log.

Events: event_sequence, artifact_id, event_type, reference_id.  Types: ``registered``
(carries an initial reference), ``reference_added``, ``reference_removed``,
``hold_set``, ``hold_released``, ``expired``, ``purged``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

IDENTITY = tuple("source_sha256 parser_id parser_version parser_configuration_hash model_version scope".split())


def extraction_identity(*parts: Column) -> Column:
    """SHA-256 of exactly six parts; null if one is null."""
    if len(parts) != len(IDENTITY):
        raise ValueError("an identity has six parts: " + ", ".join(IDENTITY))
    sound = F.lit(True)
    for part in parts:
        sound = sound & part.isNotNull()
    return F.when(sound, F.sha2(F.concat_ws("\x1f", *[p.cast("string") for p in parts]), 256))


def retention_state(events: DataFrame) -> DataFrame:
    """artifact_id, references, legal_hold, expired, purged, last_sequence after all events.

    The last addition or removal of a reference counts, the last hold event too;
    expiry stays, purging ends references and the hold.
    """
    kind = F.col("event_type")
    refs = events.where(kind.isin("registered", "reference_added", "reference_removed") & F.col("reference_id").isNotNull())
    refs = refs.groupBy("artifact_id", "reference_id").agg(F.max_by(kind != "reference_removed", "event_sequence").alias("live"))
    refs = refs.groupBy(F.col("artifact_id").alias("r_")).agg(F.count_if("live").alias("references"))
    hold = F.max_by(kind == "hold_set", F.when(kind.isin("hold_set", "hold_released", "purged"), F.col("event_sequence")))
    state = events.groupBy("artifact_id").agg(hold.alias("legal_hold"), F.bool_or(kind == "expired").alias("expired"), F.bool_or(kind == "purged").alias("purged"), F.max("event_sequence").alias("last_sequence"))
    out = state.join(refs, F.col("artifact_id") == F.col("r_"), "left")
    return out.select("artifact_id", F.when(F.col("purged"), F.lit(0)).otherwise(F.coalesce("references", F.lit(0))).cast("bigint").alias("references"), F.coalesce("legal_hold", F.lit(False)).alias("legal_hold"), "expired", "purged", "last_sequence")


def purge_reason(state: DataFrame) -> DataFrame:
    """``state`` with what stands against purging: already purged, hold, references, not expired; null if nothing does."""
    reason = F.when(F.col("purged"), "already_purged").when(F.col("legal_hold"), "legal_hold").when(F.col("references") > 0, "active_references").when(~F.col("expired"), "not_expired")
    return state.withColumn("purge_reason", reason)


def purge_plan(state: DataFrame) -> DataFrame:
    """artifact_id, eligible, purge_reason, plan_bucket, plan_bucket_id: the plan's id is made of its buckets' ids."""
    rows = purge_reason(state).where("not purged").withColumn("eligible", F.col("purge_reason").isNull())
    rows = rows.withColumn("plan_bucket", F.substring(F.sha2(F.col("artifact_id").cast("string"), 256), 1, 4))
    ids = rows.groupBy(F.col("plan_bucket").alias("b_")).agg(F.sha2(F.array_join(F.sort_array(F.collect_list(F.concat_ws(":", F.col("artifact_id").cast("string"), F.col("eligible").cast("string")))), ","), 256).alias("plan_bucket_id"))
    return rows.join(ids, F.col("plan_bucket") == F.col("b_")).select("artifact_id", "eligible", "purge_reason", "plan_bucket", "plan_bucket_id")


def reusable(wanted: DataFrame, records: DataFrame) -> DataFrame:
    """Each wanted identity with the least artifact that can be reused: validated and never purged."""
    sound = records.where("state = 'validated' and not purged").groupBy(F.col("extraction_identity").alias("i_")).agg(F.min("artifact_id").alias("artifact_id"))
    return wanted.join(sound, F.col("extraction_identity") == F.col("i_"), "left").drop("i_")


def events_after(events: DataFrame, cursor: int) -> DataFrame:
    """The events above the cursor."""
    return events.where(F.col("event_sequence") > cursor)


def finalised(plan: DataFrame, state: DataFrame, payloads: DataFrame) -> DataFrame:
    """New ``purged`` events of planned artifacts that are still eligible and whose payload is proven absent."""
    now = purge_reason(state).where("purge_reason is null").select(F.col("artifact_id").alias("n_"))
    there = payloads.select(F.col("artifact_id").alias("p_")).distinct()
    gone = plan.where("eligible").join(now, F.col("artifact_id") == F.col("n_"), "left_semi").join(there, F.col("artifact_id") == F.col("p_"), "left_anti")
    return gone.select("artifact_id", F.lit("purged").alias("event_type"))


def reference_ids(*tables: tuple[DataFrame, str, str]) -> DataFrame:
    """artifact_id, reference_id: the distinct references of all tables (table, artifact column, reference column)."""
    out = None
    for table, artifact, reference in tables:
        rows = table.where(F.col(reference).isNotNull()).select(F.col(artifact).alias("artifact_id"), F.col(reference).cast("string").alias("reference_id"))
        out = rows if out is None else out.unionByName(rows)
    return out.distinct()


#: Requests and the event that each makes where it changes something.
REQUESTS = {"register": "registered", "add": "reference_added", "remove": "reference_removed", "hold": "hold_set", "release": "hold_released", "expire": "expired"}


def changes(requests: DataFrame, events: DataFrame) -> DataFrame:
    """request_id, artifact_id, reference_id, event_type, outcome of requests (request_id, artifact_id, request, reference_id).

    A request that changes something gives its event (``changed``); one that asks for what
    already is gives none (``unchanged``), so repeating it is harmless.  Of requests for the
    same in one batch the first counts.  ``refused`` are those on unknown or purged
    artifacts, registering one that was purged, and expiring under a hold or with references.
    """
    state = retention_state(events)
    s = state.select(F.col("artifact_id").alias("s_"), "references", "legal_hold", "expired", "purged")
    kind = F.col("event_type")
    live = events.where(kind.isin("registered", "reference_added", "reference_removed") & F.col("reference_id").isNotNull())
    live = live.groupBy(F.col("artifact_id").alias("l_"), F.col("reference_id").alias("f_")).agg(F.max_by(kind != "reference_removed", "event_sequence").alias("held"))
    rows = requests.join(s, F.col("artifact_id") == F.col("s_"), "left").join(live, (F.col("artifact_id") == F.col("l_")) & (F.col("reference_id") == F.col("f_")), "left")
    ask, known, held = F.col("request"), F.col("s_").isNotNull(), F.coalesce("held", F.lit(False))
    first = F.row_number().over(Window.partitionBy("artifact_id", "request", "reference_id").orderBy("request_id")) == 1
    refused = F.coalesce("purged", F.lit(False)) | (~known & (ask != "register")) | ((ask == "expire") & (F.col("legal_hold") | (F.col("references") > 0))) | ~ask.isin(*REQUESTS)
    already = F.when(ask == "register", known).when(ask == "add", held).when(ask == "remove", ~held).when(ask == "hold", F.col("legal_hold")).when(ask == "release", ~F.col("legal_hold")).when(ask == "expire", F.col("expired"))
    outcome = F.when(refused, "refused").when(already | ~first, "unchanged").otherwise("changed")
    event = F.create_map(*[F.lit(x) for pair in REQUESTS.items() for x in pair])[ask]
    return rows.withColumn("outcome", outcome).select("request_id", "artifact_id", "reference_id", F.when(F.col("outcome") == "changed", event).alias("event_type"), "outcome")


def acquired(wanted: DataFrame, records: DataFrame, payloads: DataFrame) -> DataFrame:
    """request_id, artifact_id, outcome of requests (request_id, extraction_identity) for what has been extracted before.

    The least validated artifact of the identity is taken (``reused``) if its payload
    (artifact_id, sha256) still is what was recorded (artifact_sha256); else the reference
    just taken is given back (``released_damaged``), and without one it is a ``miss``.
    """
    sound = records.where("state = 'validated' and not purged").groupBy(F.col("extraction_identity").alias("i_")).agg(F.min(F.struct("artifact_id", "artifact_sha256")).alias("r_"))
    kept = payloads.select(F.col("artifact_id").alias("p_"), F.col("sha256").alias("h_"))
    rows = wanted.join(sound, F.col("extraction_identity") == F.col("i_"), "left").join(kept, F.col("r_.artifact_id") == F.col("p_"), "left")
    outcome = F.when(F.col("r_").isNull(), "miss").when(F.col("h_").eqNullSafe(F.col("r_.artifact_sha256")), "reused").otherwise("released_damaged")
    return rows.select("request_id", F.col("r_.artifact_id").alias("artifact_id"), outcome.alias("outcome"))
