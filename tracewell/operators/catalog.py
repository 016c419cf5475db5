"""The catalog: registration with content de-duplication, listings, soft deletion, reports and limits."""

from __future__ import annotations

import json
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewell.functions import text as T
from tracewell.operators.hierarchy import below
from tracewell.plans.sequence import running_sum

LOCAL_PATH = r"^(/|~|\.{1,2}(/|$)|[A-Za-z]:[\\/]|\\\\|file:)"
PATH_WORDS = ("path", "dir", "directory", "folder", "file", "root", "cache")
SECRET_WORDS = ("password", "passwd", "secret", "token", "credential", "credentials", "apikey")


def register(incoming: DataFrame, catalog: DataFrame) -> DataFrame:
    """Each incoming file (bundle, sha256, source_key, ord) with ``outcome`` and ``asset_id``.

    By (bundle, sha256): ``already_registered`` if the catalog has it live,
    ``restored`` if it has it deleted, else ``created`` for the first in order and
    ``already_registered`` for its repeats.
    """
    known = catalog.groupBy(F.col("bundle").alias("b_"), F.col("sha256").alias("h_")).agg(F.bool_or(~F.col("deleted")).alias("live_"))
    first = F.row_number().over(Window.partitionBy("bundle", "sha256").orderBy("ord", "source_key"))
    rows = incoming.withColumn("nth_", first).join(known, (F.col("bundle") == F.col("b_")) & (F.col("sha256") == F.col("h_")), "left")
    outcome = F.when(F.col("live_") | (F.col("nth_") > 1), "already_registered").when(F.col("live_") == F.lit(False), "restored").otherwise("created")
    return rows.select("bundle", "sha256", "source_key", outcome.alias("outcome"), F.concat(F.lit("asset-"), T.stable_id(F.col("bundle"), F.col("sha256"))).alias("asset_id"))


def tree_bundle(root: str, relative_path: Column, structure: str = "preserve") -> Column:
    """The bundle of a file of a tree: below ``root`` as its folder is (``preserve``), or ``root`` itself (``flat``)."""
    if structure not in ("preserve", "flat"):
        raise ValueError(f"no structure is called {structure}")
    folder = F.regexp_extract(relative_path, "^(.*)/[^/]*$", 1)
    return F.when((folder != "") & F.lit(structure == "preserve"), F.concat(F.lit(root + "/"), folder)).otherwise(F.lit(root))


def register_tree(files: DataFrame, catalog: DataFrame, root: str, structure: str = "preserve", cancelled_after: int | None = None) -> DataFrame:
    """relative_path, bundle, status, asset_id, error of the files of a tree (relative_path, sha256, error, reason).

    One file's error fails that file alone; those with a reason are ``skipped``; beyond
    ``cancelled_after`` files, in the order of their paths, the rest are ``cancelled``; what
    is left is registered as :func:`register` does, the first path of equal contents first.
    """
    rows = files.withColumn("bundle", tree_bundle(root, F.col("relative_path"), structure)).withColumn("source_key", F.col("relative_path")).withColumn("ord", F.col("relative_path"))
    stop = F.lit(False)
    if cancelled_after is not None:
        ranked = running_sum(files.select(F.lit(0).alias("tree_"), F.col("relative_path").alias("w_"), F.lit(1).alias("one_")), "tree_", ["w_"], "one_", "place_", "tree").select("w_", "place_")
        rows, stop = rows.join(ranked, F.col("relative_path") == F.col("w_")).drop("w_"), F.col("place_") > cancelled_after
    state = F.when(F.col("reason").isNotNull(), "skipped").when(stop, "cancelled").when(F.col("error").isNotNull() | F.col("sha256").isNull(), "failed")
    rows = rows.withColumn("state_", state)
    done = register(rows.where("state_ is null"), catalog).select(F.col("source_key").alias("relative_path"), "bundle", F.col("outcome").alias("status"), "asset_id", F.lit(None).cast("string").alias("error"))
    rest = rows.where("state_ is not null").select("relative_path", "bundle", F.col("state_").alias("status"), F.lit(None).cast("string").alias("asset_id"), F.coalesce("error", "reason").alias("error"))
    return done.unionByName(rest)


def bundle_changes(wanted: DataFrame, bundles: DataFrame) -> DataFrame:
    """path, parent, change of every bundle that paths (path) need, steps above them too: exists, restored or created.

    ``bundles``: path, deleted.
    """
    steps = F.split("path", "/")
    above = F.transform(F.sequence(F.lit(1), F.size(steps)), lambda n: F.array_join(F.slice(steps, 1, n), "/"))
    every = wanted.where("path is not null and path <> ''").select(F.explode(above).alias("path")).distinct()
    known = bundles.groupBy(F.col("path").alias("k_")).agg(F.bool_or(~F.col("deleted")).alias("live_"))
    change = F.when(F.col("live_"), "exists").when(F.col("k_").isNotNull(), "restored").otherwise("created")
    return every.join(known, F.col("path") == F.col("k_"), "left").select("path", F.nullif(F.regexp_extract("path", "^(.*)/[^/]*$", 1), F.lit("")).alias("parent"), change.alias("change"))


def unique_violations(table: DataFrame, keys: list[str], live: Column | None = None) -> DataFrame:
    """The keys, and n, of rows that share them although only one may have them, among the ``live`` rows if those alone must be apart; null keys are apart."""
    rows = table if live is None else table.where(live)
    return rows.dropna(subset=keys).groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def accepted_file(path: Column, media_type: Column) -> Column:
    """Whether a file is taken: by its suffix or its media type."""
    return F.lower(path).endswith(".pdf") | F.coalesce(media_type == "application/pdf", F.lit(False))


def status_counts(results: DataFrame, statuses: tuple[str, ...]) -> DataFrame:
    """The number of results with each status, zeros too."""
    known = results.sparkSession.createDataFrame([(s,) for s in statuses], "status string")
    counts = results.groupBy(F.col("status").alias("s_")).agg(F.count("*").alias("n"), F.sum("size").alias("size"))
    return known.join(counts, F.col("status") == F.col("s_"), "left").select("status", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("size", F.lit(0)).alias("size"))


def run_state(results: DataFrame) -> DataFrame:
    """Per run its documents, failures and state: completed, partial, failed, or empty."""
    out = results.groupBy("run_id").agg(F.count("doc_id").alias("documents"), F.count_if("failed").alias("failures"))
    state = F.when(F.col("documents") == 0, "empty").when(F.col("failures") == 0, "completed").when(F.col("failures") < F.col("documents"), "partial").otherwise("failed")
    return out.withColumn("state", state)


def run_manifest(results: DataFrame) -> DataFrame:
    """One row over all results: documents, failures, sizes and the hash over the documents' hashes in order."""
    h = F.sha2(F.array_join(F.sort_array(F.collect_list("bucket_hash")), ""), 256)
    buckets = results.groupBy(F.substring("sha256", 1, 4).alias("b")).agg(F.sha2(F.array_join(F.sort_array(F.collect_list("sha256")), ""), 256).alias("bucket_hash"), F.count("*").alias("n"), F.count_if("failed").alias("f"), F.sum("size").alias("s"))
    return buckets.agg(F.sum("n").alias("documents"), F.sum("f").alias("failures"), F.sum("s").alias("bytes"), h.alias("manifest_sha256"))


def bundle_assets(bundles: DataFrame, assets: DataFrame, roots: DataFrame) -> DataFrame:
    """Assets of the bundles in ``roots`` (root_id) and of all bundles below them."""
    under = below(bundles, "bundle_id", "parent_id", roots.select(F.col("root_id").alias("root")))
    return under.select("root", F.col("node").alias("n_")).join(assets, F.col("n_") == F.col("bundle_id")).drop("n_")


def soft_delete(bundles: DataFrame, assets: DataFrame, doomed: DataFrame, recursive: bool = True) -> DataFrame:
    """The assets with ``deleted`` set below the bundles of ``doomed`` (root_id); deleted ones stay so.

    Without ``recursive`` only bundles without bundles below and without live assets
    may go (see :func:`not_empty`); if one of ``doomed`` has some, that is a ValueError.
    """
    if not recursive and (full := not_empty(bundles, assets, doomed).first()):
        raise ValueError(f"bundle {full.root_id} is not empty")
    gone = below(bundles, "bundle_id", "parent_id", doomed.select(F.col("root_id").alias("root"))).select(F.col("node").alias("n_")).distinct()
    marked = assets.join(gone, F.col("bundle_id") == F.col("n_"), "left")
    return marked.withColumn("deleted", F.col("deleted") | F.col("n_").isNotNull()).drop("n_")


def not_empty(bundles: DataFrame, assets: DataFrame, doomed: DataFrame) -> DataFrame:
    """root_id, bundles, assets of those of ``doomed`` that have bundles or live assets of their own."""
    inner = bundles.where("parent_id is not null").groupBy(F.col("parent_id").alias("p_")).agg(F.count("*").alias("bundles"))
    live = assets.where(~F.col("deleted")).groupBy(F.col("bundle_id").alias("b_")).agg(F.count("*").alias("assets"))
    rows = doomed.select("root_id").distinct().join(inner, F.col("root_id") == F.col("p_"), "left").join(live, F.col("root_id") == F.col("b_"), "left")
    return rows.select("root_id", F.coalesce("bundles", F.lit(0)).alias("bundles"), F.coalesce("assets", F.lit(0)).alias("assets")).where("bundles + assets > 0")


def unreferenced(blobs: DataFrame, sources: DataFrame, older_than: Column | None = None) -> DataFrame:
    """Blobs (profile, key) that no live source refers to, older than a moment if one is given."""
    live = sources.where(~F.col("deleted")).select(F.col("profile").alias("p_"), F.col("key").alias("k_"))
    rows = blobs.join(live, (F.col("profile") == F.col("p_")) & (F.col("key") == F.col("k_")), "left_anti")
    return rows if older_than is None else rows.where(F.col("created_at") < older_than)


#: Days that a blob without a source is kept.
GRACE_DAYS = 7


def past_grace(blobs: DataFrame, sources: DataFrame, now: Column | None = None, days: int = GRACE_DAYS) -> DataFrame:
    """Blobs that no live source refers to and that are older than ``days``, a week by default."""
    moment = F.current_timestamp() if now is None else now
    return unreferenced(blobs, sources, moment - F.make_dt_interval(F.lit(days)))


def delete_batches(blobs: DataFrame, size: int) -> DataFrame:
    """Blobs with the number of their deletion batch of at most ``size`` (1 to 500), in key order within hash buckets."""
    if not 1 <= size <= 500:
        raise ValueError("a batch holds 1 to 500 blobs")
    bucket = F.substring(F.sha2(F.col("key").cast("string"), 256), 1, 4)
    order = F.row_number().over(Window.partitionBy("bucket").orderBy("key"))
    return blobs.withColumn("bucket", bucket).withColumn("batch", F.ceil(order / size).cast("int"))


def listing(assets: DataFrame, deleted: bool = False) -> DataFrame:
    """Live (or deleted) assets with their place in the order of bundle, name and id."""
    rows = assets.where(F.col("deleted") == F.lit(deleted))
    return rows.withColumn("place", F.row_number().over(Window.partitionBy("bundle_id").orderBy("name", "asset_id")))


def bundle_path(raw: Column) -> Column:
    """A bundle path without empty, blank or dot steps; null if a step climbs or the path is a machine's own."""
    steps = F.filter(F.transform(F.split(raw, r"[/\\]+"), T.strip), lambda s: (s != "") & (s != "."))
    return F.when(~raw.rlike(LOCAL_PATH) & ~F.array_contains(steps, "..") & (F.size(steps) > 0), F.array_join(steps, "/"))


def key_words(key: Column) -> Column:
    """The lower-case words of a camel, snake or kebab key."""
    spaced = F.regexp_replace(F.regexp_replace(key, r"([a-z0-9])([A-Z])", "$1 $2"), r"([A-Z]+)([A-Z][a-z])", "$1 $2")
    return F.filter(F.split(F.lower(spaced), r"[^a-z0-9]+"), lambda w: w != "")


def is_secret_key(key: Column) -> Column:
    """Whether a configuration key names a secret."""
    words = key_words(key)
    return F.arrays_overlap(words, F.array(*map(F.lit, SECRET_WORDS))) | F.array_join(words, " ").contains("api key") | F.array_join(words, " ").contains("private key")


def safe_configuration(configuration: DataFrame) -> DataFrame:
    """Configuration items (owner, key, value) without secrets and local paths."""
    return configuration.where(~is_secret_key(F.col("key")) & ~F.coalesce(F.col("value").rlike(LOCAL_PATH), F.lit(False)))


#: Bounds of a parser's configuration: depth, values, entries of one map or list, signs of a text and of a key.
CONFIGURATION_BOUNDS = (32, 4096, 1024, 4096, 128)


def _problem(raw: str | None) -> str | None:
    """The first thing wrong with a configuration in JSON, or None. Depth and size are checked before anything is kept."""
    depth_bound, value_bound, entry_bound, text_bound, key_bound = CONFIGURATION_BOUNDS
    try:
        top = json.loads(raw or "", parse_constant=lambda name: float("nan"))
    except (ValueError, RecursionError):
        return "not-json"
    if not isinstance(top, dict):
        return "not-a-mapping"
    seen, todo = 0, [(top, 0, False)]
    while todo:
        item, depth, pathlike = todo.pop()
        seen += 1
        if seen > value_bound:
            return "too-many-values"
        if depth > depth_bound:
            return "too-deep"
        if isinstance(item, float) and not math.isfinite(item):
            return "number-not-finite"
        if isinstance(item, str):
            if len(item) > text_bound:
                return "text-too-long"
            if pathlike and re.match(LOCAL_PATH, item):
                return "local-path"
        elif isinstance(item, (dict, list)) and len(item) > entry_bound:
            return "collection-too-large"
        elif isinstance(item, dict):
            for key, inner in item.items():
                if not key or len(key) > key_bound:
                    return "key-not-bounded"
                spaced = re.sub(r"([a-z0-9])([A-Z])", r"\1 \2", key)
                words = [w for w in re.split(r"[^a-z0-9]+", spaced.lower()) if w]
                if set(words) & set(SECRET_WORDS) or any(f" {x} " in f" {' '.join(words)} " for x in ("api key", "private key", "run id", "job id")):
                    return "forbidden-key"
                todo.append((inner, depth + 1, bool(set(words) & set(PATH_WORDS))))
        elif isinstance(item, list):
            todo += [(inner, depth, False) for inner in item]
    return None


def _problems(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for batch in batches:
        yield pa.array([_problem(x) for x in batch.to_pylist()], pa.string())


def configuration_problem(raw: Column) -> Column:
    """What keeps a nested configuration in JSON from being part of an identity, or null: shape, depth, size, secrets, local paths."""
    return F.arrow_udf(_problems, "string")(raw)


def authorised(requests: DataFrame, grants: DataFrame) -> DataFrame:
    """Requests (request_id, owner_id, action) with ``allowed`` and ``reason``: the newest grant of the owner and action decides, none denies.

    ``grants``: owner_id, action, allowed, policy_version.
    """
    latest = grants.groupBy(F.col("owner_id").alias("o_"), F.col("action").alias("a_")).agg(F.max_by("allowed", "policy_version").alias("g_"), F.max("policy_version").alias("policy_version"))
    rows = requests.join(latest, (F.col("owner_id") == F.col("o_")) & (F.col("action") == F.col("a_")), "left")
    reason = F.when(F.col("g_").isNull(), "no-grant").when(F.col("g_"), "granted").otherwise("denied")
    return rows.select("request_id", F.coalesce("g_", F.lit(False)).alias("allowed"), reason.alias("reason"), "policy_version")


def limit_violations(documents: DataFrame, limits: DataFrame) -> DataFrame:
    """doc_id, rule, actual, allowed of documents beyond the limits (rule, allowed) on size and pages."""
    facts = documents.select("doc_id", F.expr("stack(2, 'max_bytes', cast(size as bigint), 'max_pages', cast(pages as bigint)) as (rule, actual)"))
    return facts.join(limits.withColumnRenamed("rule", "r_"), (F.col("rule") == F.col("r_")) & (F.col("actual") > F.col("allowed"))).select("doc_id", "rule", "actual", "allowed")


def enrichment_id(source_hash: Column, anchors: Column, kind: Column, method: Column, model: Column, config: Column) -> Column:
    """The id of an enrichment: the SHA-256 of its parts, anchors in order, a missing model empty."""
    return F.sha2(F.concat_ws("\x1f", source_hash, F.array_join(F.array_sort(anchors), "\x1e"), kind, method, F.coalesce(model, F.lit("")), config), 256)


def not_registered(wanted: DataFrame, catalog: DataFrame, key: str) -> DataFrame:
    """The first row of each key of ``wanted`` that the catalog lacks."""
    new = wanted.join(catalog.select(F.col(key).alias("c_")).distinct(), F.col(key) == F.col("c_"), "left_anti")
    return new.dropDuplicates([key])


def blob_migration(sources: DataFrame, moved: DataFrame) -> DataFrame:
    """Sources without a blob reference that no earlier batch has moved: what a restarted migration has left."""
    return sources.where("blob_ref is null").join(moved.select(F.col("source_id").alias("m_")).distinct(), F.col("source_id") == F.col("m_"), "left_anti")
