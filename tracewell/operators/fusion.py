"""Observations of several parsers: aligned, compared, adjudicated fact by fact.

Observations are long: parser_id, region_id, fact, value, with the SHA-256 of the
value.  Alignment pairs are found by equal keys and never by pairing all regions.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import partial, reduce
from hashlib import sha256

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewell.functions import geometry as G
from tracewell.functions import text as T
from tracewell.plans.lineage import drop_written, written

THRESHOLD = 0.8
UNSAFE = tuple("ambiguous unresolved contradicted rejected".split())
STATES = tuple("agreement complementary conflict unresolved".split())
#: fact, strategy, resolution, gold on acceptance, preferred value
POLICIES = (
    ("bbox", "preserve-conflict", "fact-specific-policy", False, None),
    ("blocks", "preserve-segmentation-variants", "align-by-source-span-then-preserve-both-segmentation-observations", False, None),
    ("native_link_target", "retain-complementary", "retain-complementary-fact", True, None),
    ("object_type", "prefer-explicit-value", "richer-validated-structure", False, "table"),
    ("owner_division", "retain-complementary", "retain-complementary-fact", True, None),
    ("reading_order", "require-review", "unresolved-reading-order", False, None),
    ("segmentation", "preserve-segmentation-variants", "align-by-source-span-then-preserve-both-segmentation-observations", False, None),
    ("text", "exact-agreement", "exact-typed-value", False, None),
)


def policies(spark, rows=POLICIES) -> DataFrame:
    return spark.createDataFrame(rows, "p_fact string, strategy string, p_resolution string, p_gold boolean, preferred string")


def unpivot(blocks: DataFrame, facts: dict[str, str], empty_skipped: tuple[str, ...] = (), kept: tuple[str, ...] = ()) -> DataFrame:
    """One row per region and fact: parser_id, region_id, columns ``kept``, fact, value, value_sha256. Nulls give no row, nor do empty values of ``empty_skipped``."""
    columns = ", ".join(f"'{fact}', cast(`{column}` as string)" for fact, column in facts.items())
    rows = blocks.select("parser_id", "region_id", *kept, F.expr(f"stack({len(facts)}, {columns}) as (fact, value)")).where("value is not null")
    if empty_skipped:
        rows = rows.where(~(F.col("fact").isin(*empty_skipped) & (F.col("value") == "")))
    return rows.withColumn("value_sha256", F.sha2("value", 256))


def _sides(regions: DataFrame, keys: list[str], carried: list[str]) -> DataFrame:
    """Pairs of regions of different parsers that agree in ``keys``, the lesser region left."""
    left = regions.select(*keys, *[F.col(c).alias(f"l_{c}") for c in carried])
    right = regions.select(*[F.col(k).alias(f"k_{k}") for k in keys], *[F.col(c).alias(f"r_{c}") for c in carried])
    same = [F.col(k) == F.col(f"k_{k}") for k in keys]
    return left.join(right, [*same, F.col("l_region_id") < F.col("r_region_id"), F.col("l_parser_id") != F.col("r_parser_id")])


def align_exact(regions: DataFrame, keys: list[str], method: str) -> DataFrame:
    """left_id, right_id, status of pairs equal in all ``keys``: exact if each is the other's only peer of that parser, else ambiguous."""
    pairs = _sides(regions.dropna(subset=keys), keys, ["region_id", "parser_id"])
    peers_left = F.count("*").over(Window.partitionBy("l_region_id", "r_parser_id"))
    peers_right = F.count("*").over(Window.partitionBy("r_region_id", "l_parser_id"))
    return pairs.select(F.col("l_region_id").alias("left_id"), F.col("r_region_id").alias("right_id"), F.lit(method).alias("method"), F.when((peers_left == 1) & (peers_right == 1), "exact").otherwise("ambiguous").alias("status"))


#: What a pair of regions may agree in, the strongest first, by the name its evidence gets.
METHODS = ("exact-resource-page-anchor", "exact-selector", "exact-character-span", "exact-relation-signature", "bbox-iou-mutual-best", "exact-text-digest-occurrence")
SHARED_ID = "exact-source-region-id"
_PLACE = ("resource_id", "page", "anchor", "char_start", "char_end", "box")


def _whole(regions: DataFrame, within: tuple[str, ...]) -> DataFrame:
    """One row per region: its parsers, joined by bars, all its selectors, and the least of every other fact."""
    rest = [c for c in regions.columns if c not in ("region_id", "parser_id", "selectors", *within)]
    first = Window.partitionBy(*within, "region_id").orderBy("parser_id")
    every = first.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    parsers = F.array_join(F.sort_array(F.collect_set("parser_id").over(every)), "|").alias("parsers")
    selectors = F.array_distinct(F.flatten(F.collect_list(F.coalesce("selectors", F.array().cast("array<string>"))).over(every))).alias("selectors")
    rows = regions.select(*within, "region_id", parsers, selectors, *[F.min(c).over(every).alias(c) for c in rest], F.row_number().over(first).alias("n_"))
    return rows.where("n_ = 1").drop("n_")


def candidates(whole: DataFrame, within: tuple[str, ...] = (), alone: Column | None = None) -> DataFrame:
    """Each pair of regions of one kind with its strongest agreement: left_id, right_id, parsers, priority, score, selectors.

    ``whole``: regions with all their ``parsers``. A region gives a row for each key by
    which it may agree with others, nulls being equal, and meets those that follow it under
    the key. Keys of boxes are the bands of their page that they reach into, twice as high
    as its tallest box; a pair counts in the band where the later of the two begins, and
    not at all if the boxes do not overlap. ``within`` as for :func:`align`. Regions with
    ``alone`` are also paired with themselves, at priority 0.
    """
    nowhere = F.coalesce(F.size("selectors"), F.lit(0)) <= 0
    for column in _PLACE:
        nowhere = nowhere & F.col(column).isNull()
    boxed = F.coalesce((F.col("kind") != "generic") & F.col("page").isNotNull() & (F.col("box.y1") > F.col("box.y0")), F.lit(False))
    place = F.coalesce("resource_id", F.lit(""))
    page = Window.partitionBy(*within, F.when(boxed, place), F.when(boxed, F.col("page")), F.when(~boxed, F.col("region_id")))
    high = F.greatest(2 * F.max(F.when(boxed, F.col("box.y1") - F.col("box.y0"))).over(page), F.lit(1e-9))
    rows = whole.withColumn("from_", F.floor(F.col("box.y0") / high)).withColumn("to_", F.floor(F.col("box.y1") / high))

    def key(priority: int, *parts: Column, begins: Column | None = None) -> Column:
        padded = [*parts, *[F.lit(None)] * (4 - len(parts))]
        return F.struct(F.lit(priority).alias("priority"), (F.lit(True) if begins is None else begins).alias("begins"), *[c.cast("string").alias(f"k{i}_") for i, c in enumerate(padded)])

    resource, on = F.col("resource_id"), F.col("page")
    ways = [
        F.when((F.col("kind") != "relation") & resource.isNotNull() & on.isNotNull() & F.col("anchor").isNotNull(), F.array(key(1, resource, on, F.col("anchor")))),
        F.transform("selectors", lambda selector: key(2, selector)),
        F.when(F.col("char_start").isNotNull(), F.array(key(3, resource, on, F.col("char_start"), F.col("char_end")))),
        F.when((F.col("kind") == "relation") & F.col("signature").isNotNull(), F.array(key(4, F.col("signature")))),
        F.when(boxed, F.transform(F.sequence("from_", "to_"), lambda band: key(5, place, on, band, begins=band == F.col("from_")))),
        F.when((F.col("kind") == "generic") & F.col("digest").isNotNull() & nowhere, F.array(key(6, F.col("digest")))),
    ]
    if alone is not None:
        ways.append(F.when(alone, F.array(key(0))))
    keys = F.explode(F.flatten(F.array_compact(F.array(*ways)))).alias("key_")
    rows = rows.select(*within, "region_id", "parsers", "kind", "box", keys).select(*within, "region_id", "parsers", "kind", "key_.*", F.when(F.col("key_.priority") == 5, F.col("box")).alias("box"))
    names = ["priority", "kind", *[f"k{i}_" for i in range(4)]]
    # The hash comes first since sorting is fast by its first column.
    rows = rows.withColumn("hash_", F.xxhash64(*names))
    following = Window.partitionBy("hash_", *within, *names).orderBy("region_id").rowsBetween(1, Window.unboundedFollowing)
    own = F.struct("region_id", "parsers", "begins", "box")
    others = F.when(F.col("priority") == 0, F.array(own)).otherwise(F.collect_list(own).over(following))
    pairs = rows.withColumn("others_", others).withColumn("o_", F.explode("others_"))
    apart = (F.col("priority") == 0) | ((F.col("region_id") < F.col("o_.region_id")) & (F.col("parsers") != F.col("o_.parsers")) & ~F.arrays_overlap(F.split("parsers", "[|]"), F.split("o_.parsers", "[|]")))
    score = F.when(F.col("priority") == 5, G.iou(F.col("box"), F.col("o_.box"))).otherwise(F.lit(1.0)).alias("score")
    pairs = pairs.where(apart & (F.col("begins") | F.col("o_.begins"))).select(*within, F.col("region_id").alias("left_id"), F.col("o_.region_id").alias("right_id"), F.col("parsers").alias("left_parser"), F.col("o_.parsers").alias("right_parser"), "priority", score, F.when(F.col("priority") == 2, F.col("k0_")).alias("selector"))
    least = Window.partitionBy(*within, "left_id", "right_id", "left_parser", "right_parser").orderBy("priority", "score")
    shared = F.array_join(F.sort_array(F.collect_set("selector").over(least.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))), "|")
    pairs = pairs.where("score > 0").withColumn("shared_", shared).withColumn("n_", F.row_number().over(least)).where("n_ = 1")
    return pairs.select(*within, "left_id", "right_id", "left_parser", "right_parser", "priority", "score", F.when(F.col("priority") == 2, F.col("shared_")).otherwise("").alias("selectors"))


#: Pairs that are settled together where ``within`` is given; those of a group always are.
PAIRS_AT_ONCE = 100_000


def _settled(pairs: pa.Table, threshold: float) -> tuple[np.ndarray, np.ndarray, list[str], np.ndarray]:
    """Codes of the left and right regions of candidates, the regions by code, and the status of each candidate, settled as by :func:`align`."""
    ids = pa.concat_arrays([c for side in ("left_id", "right_id") for c in pairs[side].chunks]).dictionary_encode()
    parsers = pa.concat_arrays([c for side in ("left_parser", "right_parser") for c in pairs[side].chunks]).dictionary_encode()
    left, right = np.split(ids.indices.to_numpy().astype(np.int64), 2)
    left_parser, right_parser = np.split(parsers.indices.to_numpy().astype(np.int64), 2)
    priority, score = pairs["priority"].to_numpy(), pairs["score"].to_numpy()
    status = np.full(len(left), "superseded", object)
    taken = np.zeros(len(ids.dictionary), bool)
    many = np.array(["|" in name for name in parsers.dictionary.to_pylist()], bool)
    alone = priority == 0
    status[alone] = "exact"
    taken[left[alone & many[left_parser]]] = True
    for step, method in enumerate(METHODS, 1):
        now = np.flatnonzero((priority == step) & ~taken[left] & ~taken[right])
        if not len(now):
            continue
        l, r, s = left[now], right[now], score[now]
        sides = [np.unique(own * len(parsers.dictionary) + other, return_inverse=True)[1] for own, other in ((l, right_parser[now]), (r, left_parser[now]))]
        if method.startswith("bbox"):
            best = []
            for side in sides:
                most = np.zeros(side.max() + 1)
                np.maximum.at(most, side, s)
                best.append(np.abs(s - most[side]) <= 1e-9 * np.maximum(np.abs(s), np.abs(most[side])))
            ok = (s >= threshold) & best[0] & best[1]
            for side, is_best in zip(sides, best):
                ok &= np.bincount(side, is_best)[side] == 1
            won = np.zeros(len(taken), bool)
            won[l[ok]] = won[r[ok]] = True
            found = np.where(ok, "accepted-candidate", np.where(won[l] | won[r], "superseded", np.where(s < threshold, "rejected", "ambiguous"))).astype(object)
        else:
            found = np.where((np.bincount(sides[0])[sides[0]] == 1) & (np.bincount(sides[1])[sides[1]] == 1), "exact", "ambiguous").astype(object)
        status[now] = found
        over = np.isin(found, ("exact", "accepted-candidate", "ambiguous"))
        taken[l[over]] = taken[r[over]] = True
    return left, right, ids.dictionary.to_pylist(), status


def _evidence(pairs: pa.Table, threshold: float) -> dict:
    status = _settled(pairs, threshold)[3]
    # A region of n parsers is exact by its id once for each pair of them.
    bars = pc.count_substring(pairs["left_parser"], "|").to_numpy()
    alone = pairs["priority"].to_numpy() == 0
    at = np.repeat(np.arange(len(status)), np.where(alone, bars * (bars + 1) // 2, 1))
    method = pa.array((SHARED_ID, *METHODS)).take(pairs["priority"].combine_chunks())
    made = {"left_id": pairs["left_id"], "right_id": pairs["right_id"], "method": method, "score": pairs["score"], "selectors": pairs["selectors"], "status": pa.array(status, pa.string())}
    return {name: column.take(pa.array(at)) for name, column in made.items()}


def _members(pairs: pa.Table, threshold: float) -> dict:
    left, right, names, status = _settled(pairs, threshold)
    up = list(range(len(names)))

    def root(x: int) -> int:
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    joined = np.isin(status, ("exact", "accepted-candidate")) & (left != right)
    for one, two in zip(left[joined].tolist(), right[joined].tolist()):
        up[root(one)] = root(two)
    groups: dict[int, list[str]] = {}
    for code, name in enumerate(names):
        groups.setdefault(root(code), []).append(name)
    rows = [(name, m[0] if len(m) == 1 else "group-" + sha256("\x1f".join(sorted(m)).encode()).hexdigest(), len(m)) for m in groups.values() for name in m]
    kinds = {"region_id": pa.string(), "group_id": pa.string(), "members": pa.int32()}
    return {name: pa.array(values, kind) for (name, kind), values in zip(kinds.items(), zip(*rows))}


def _by_group(pairs: DataFrame, within: tuple[str, ...], made: Callable[[pa.Table], dict], schema: str) -> DataFrame:
    """``made`` of all pairs, some whole groups of ``within`` at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0

        def out(table: pa.Table) -> Iterator[pa.RecordBatch]:
            if table.num_rows:
                yield from pa.table(made(table)).to_batches(10_000)

        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            if n < PAIRS_AT_ONCE:
                continue
            table = pa.Table.from_batches(held)
            last = np.ones(n, bool)
            for c in within:
                last &= pc.equal(table[c], table[c][n - 1]).fill_null(False).to_numpy() | (pc.is_null(table[c]).to_numpy() & (not table[c][n - 1].is_valid))
            cut = int(n - np.argmin(last[::-1])) if not last.all() else 0
            if cut:
                yield from out(table.slice(0, cut))
                held, n = table.slice(cut).to_batches(), n - cut
        if held:
            yield from out(pa.Table.from_batches(held))

    return pairs.repartition(*within).sortWithinPartitions(*within).mapInArrow(run, schema)


def align(regions: DataFrame, threshold: float = THRESHOLD, within: tuple[str, ...] = ()) -> DataFrame:
    """Evidence that regions of several parsers are one: left_id, right_id, method, score, selectors, status.

    ``regions``: region_id, parser_id, kind, resource_id, page, anchor, selectors, char_start,
    char_end, signature, box, digest; a region that several parsers share is ``exact`` by
    its id.  Agreements are settled from the strongest to the weakest.  A pair is exact if
    each is the other's only one of its parsers, else all its pairs are ambiguous; boxes
    take part as in :func:`mutual_best`.  What is settled, ambiguity too, supersedes
    weaker pairs.  Every step is a table, so the plan has one scan of the regions.

    ``within``: columns of which a region, and any two that can agree, have the same
    values; regions partitioned by them are not shuffled, and all steps are taken at once
    for each of their groups.
    """
    if within:
        pairs = candidates(_whole(regions.where("region_id is not null"), within), within, F.contains("parsers", F.lit("|")))
        return _by_group(pairs, within, partial(_evidence, threshold=threshold), "left_id string, right_id string, method string, score double, selectors string, status string")
    whole = written(_whole(regions, ()), "regions")
    names = whole.where(F.contains("parsers", F.lit("|"))).withColumn("p_", F.split("parsers", "[|]"))
    pairs = names.select("region_id", F.explode("p_").alias("a_"), "p_").select("region_id", "a_", F.explode("p_").alias("b_")).where("a_ < b_")
    out = [pairs.select(F.col("region_id").alias("left_id"), F.col("region_id").alias("right_id"), F.lit(SHARED_ID).alias("method"), F.lit(1.0).alias("score"), F.lit("").alias("selectors"), F.lit("exact").alias("status"))]
    found = written(candidates(whole), "candidates")
    settled = names.select(F.col("region_id").alias("u_"))
    for priority, method in enumerate(METHODS, 1):
        rows = found.where(F.col("priority") == priority)
        for side in ("left", "right"):
            rows = rows.join(settled.select(F.col("u_").alias(f"{side}_u")), F.col(f"{side}_id") == F.col(f"{side}_u"), "left")
        free = F.col("left_u").isNull() & F.col("right_u").isNull()
        columns = ["left_id", "right_id", F.lit(method).alias("method"), "score", "selectors", "status"]
        late = rows.where(~free).withColumn("status", F.lit("superseded"))
        live = rows.where(free).drop("left_u", "right_u")
        if method.startswith("bbox"):
            live = mutual_best(live, threshold).withColumn("selectors", F.lit("")).withColumn("status", F.when(F.col("status") == "accepted", "accepted-candidate").otherwise(F.col("status")))
        else:
            only = (F.count("*").over(Window.partitionBy("left_id", "right_parser")) == 1) & (F.count("*").over(Window.partitionBy("right_id", "left_parser")) == 1)
            live = live.withColumn("status", F.when(only, "exact").otherwise("ambiguous"))
        now = written(live.select(*columns).unionByName(late.select(*columns)), "evidence")
        out.append(now)
        taken = now.where(F.col("status").isin("exact", "accepted-candidate", "ambiguous")).select(F.explode(F.array("left_id", "right_id")).alias("u_"))
        settled = written(settled.union(taken).distinct(), "settled")
    return reduce(DataFrame.unionByName, out)


def alignment_groups(regions: DataFrame, evidence: DataFrame) -> DataFrame:
    """region_id, group_id, members: regions joined by exact or accepted evidence; a lone one is its own group, others go by the hash of their ids."""
    edges = evidence.where(F.col("status").isin("exact", "accepted-candidate") & (F.col("left_id") != F.col("right_id"))).select(F.col("left_id").alias("u"), F.col("right_id").alias("v"))
    roots = aligned_groups(edges).withColumnRenamed("node", "n_")
    rows = regions.select("region_id").distinct().join(roots, F.col("region_id") == F.col("n_"), "left").select("region_id", F.coalesce("root", "region_id").alias("root"))
    groups = rows.groupBy("root").agg(F.sort_array(F.collect_set("region_id")).alias("m_"))
    name = F.when(F.size("m_") == 1, F.get("m_", F.lit(0))).otherwise(F.concat(F.lit("group-"), F.sha2(F.array_join("m_", "\x1f"), 256)))
    return groups.select(F.explode("m_").alias("region_id"), name.alias("group_id"), F.size("m_").alias("members"))


def groups_within(regions: DataFrame, within: tuple[str, ...], threshold: float = THRESHOLD) -> DataFrame:
    """:func:`alignment_groups` of regions and their :func:`align`, each of the groups of ``within`` at once."""
    pairs = candidates(_whole(regions.where("region_id is not null"), within), within, F.lit(True))
    return _by_group(pairs, within, partial(_members, threshold=threshold), "region_id string, group_id string, members int")


def bbox_scores(regions: DataFrame) -> DataFrame:
    """Overlapping same-kind pairs on a page: left_id, right_id, parsers and ``score``, the intersection over union.

    Pages are cut into bands of the height of their tallest box, so boxes are only
    compared with those of the same or a neighbouring band.
    """
    tall = regions.where("box is not null").withColumn("band_h", F.greatest(F.max(F.col("box.y1") - F.col("box.y0")).over(Window.partitionBy("doc_id", "page")), F.lit(1e-9)))
    banded = tall.withColumn("band", F.floor(F.col("box.y0") / F.col("band_h")))
    left = banded.select("doc_id", "page", "kind", F.explode(F.array(F.col("band") - 1, F.col("band"), F.col("band") + 1)).alias("band"), F.col("region_id").alias("left_id"), F.col("parser_id").alias("left_parser"), F.col("box").alias("l_box"))
    right = banded.select(F.col("doc_id").alias("d_"), F.col("page").alias("p_"), F.col("kind").alias("k_"), F.col("band").alias("b_"), F.col("region_id").alias("right_id"), F.col("parser_id").alias("right_parser"), F.col("box").alias("r_box"))
    pairs = left.join(right, (F.col("doc_id") == F.col("d_")) & (F.col("page") == F.col("p_")) & (F.col("kind") == F.col("k_")) & (F.col("band") == F.col("b_")) & (F.col("left_id") < F.col("right_id")) & (F.col("left_parser") != F.col("right_parser")))
    return pairs.withColumn("score", G.iou(F.col("l_box"), F.col("r_box"))).where("score > 0").select("left_id", "right_id", "left_parser", "right_parser", "score")


def mutual_best(scored: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``scored`` with ``status``.

    A pair is accepted if its score reaches the threshold and is the only best one of
    both regions; others that touch an accepted region are superseded, those below
    the threshold rejected, the rest ambiguous.
    """
    left, right = Window.partitionBy("left_id", "right_parser"), Window.partitionBy("right_id", "left_parser")
    rows = scored.withColumn("bl_", F.max("score").over(left)).withColumn("br_", F.max("score").over(right))
    is_left, is_right = G.near(F.col("score"), F.col("bl_")), G.near(F.col("score"), F.col("br_"))
    rows = rows.withColumn("nl_", F.count_if(is_left).over(left)).withColumn("nr_", F.count_if(is_right).over(right))
    rows = rows.withColumn("ok_", (F.col("score") >= threshold) & is_left & is_right & (F.col("nl_") == 1) & (F.col("nr_") == 1))
    taken = rows.where("ok_").select(F.explode(F.array("left_id", "right_id")).alias("t_")).distinct()
    left_taken, right_taken = taken.select(F.col("t_").alias("tl_")), taken.select(F.col("t_").alias("tr_"))
    rows = rows.join(left_taken, F.col("left_id") == F.col("tl_"), "left").join(right_taken, F.col("right_id") == F.col("tr_"), "left")
    status = F.when(F.col("ok_"), "accepted").when(F.col("tl_").isNotNull() | F.col("tr_").isNotNull(), "superseded").when(F.col("score") < threshold, "rejected").otherwise("ambiguous")
    return rows.select("left_id", "right_id", "left_parser", "right_parser", "score", status.alias("status"))


def aligned_groups(edges: DataFrame) -> DataFrame:
    """(node, root) of the connected components of ``edges`` (u, v), root the least node.

    Star contraction; every round is a table in the shared folder, so the plan stays
    short, and the number of rounds grows with the logarithm of the longest chain.
    """
    now = written(edges.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).where("u <> v").distinct(), "components")
    before = None
    while True:
        both = now.union(now.select("v", "u")).toDF("x", "y")
        star = both.join(both.groupBy("x").agg(F.min("y").alias("m")), "x").select(F.least("x", "m").alias("m"), "x", "y")
        large = star.where("y > x").select(F.col("y").alias("v"), F.col("m").alias("u")).where("u <> v").distinct()
        small = large.join(large.groupBy("v").agg(F.min("u").alias("m")), "v")
        step = small.where("u <> m").select(F.col("m").alias("u"), F.col("u").alias("v")).union(small.select(F.col("m").alias("u"), "v")).where("u <> v").distinct()
        following = written(step, "components")
        shape = following.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        drop_written(now)
        now = following
        if shape == before:
            return now.select(F.col("v").alias("node"), F.col("u").alias("root"))
        before = shape


def parser_rank(parser: Column) -> Column:
    """Parsers with geometry first, then structure, then plain text; unknown ones between."""
    return F.when(parser == "geometry", 0).when(parser == "structure", 1).when(parser == "basic", 99).otherwise(50)


def fact_precedence(facts: DataFrame) -> DataFrame:
    """For each (doc_id, page, fact) the value of the best-ranked parser, and whether parsers differ."""
    order = F.struct(parser_rank(F.col("parser_id")), F.col("parser_id"), F.col("value"))
    return facts.groupBy("doc_id", "page", "fact").agg(F.min_by("value", order).alias("value"), (F.count_distinct("value") > 1).alias("conflict"), F.count_distinct("parser_id").alias("parsers"))


def block_type_rank(kind: Column) -> Column:
    return F.when(kind == "title", 0).when(kind.isin("section_header", "heading"), 1).when(kind.isin("caption", "table", "figure"), 2).when(kind.isin("list_item", "list"), 3).when(kind == "text", 99).otherwise(50)


def fuse_blocks(blocks: DataFrame) -> DataFrame:
    """Blocks of all parsers joined by folded text and its occurrence in the parser's page, in a new reading order.

    In: doc_id, page, parser_id, block_id, text, block_type, y0, x0, confidence,
    reading_order.  Text, type and place come from the best-ranked parser each.
    """
    nth = F.row_number().over(Window.partitionBy("doc_id", "page", "parser_id", T.folded(F.col("text"))).orderBy("reading_order", "block_id"))
    rows = blocks.withColumn("folded", T.folded(F.col("text"))).withColumn("nth", nth)
    rank = F.struct(parser_rank(F.col("parser_id")), F.col("parser_id"))
    kind = F.struct(block_type_rank(F.col("block_type")), F.col("block_type"), rank)
    place = F.when(F.col("y0").isNotNull(), F.struct(parser_rank(F.col("parser_id")), F.col("parser_id")))
    fused = rows.groupBy("doc_id", "page", "folded", "nth").agg(
        F.min_by("text", rank).alias("text"), F.min_by("block_type", kind).alias("block_type"), F.min_by("y0", place).alias("y0"), F.min_by("x0", place).alias("x0"), F.max("confidence").alias("confidence"), F.min("reading_order").alias("o_"), F.array_join(F.sort_array(F.collect_set("parser_id")), "|").alias("parsers")
    )
    order = Window.partitionBy("doc_id", "page").orderBy(F.col("y0").asc_nulls_last(), F.col("x0").asc_nulls_last(), "o_", "folded", "nth")
    return fused.withColumn("reading_order", F.row_number().over(order) - 1).drop("o_", "folded", "nth")


def adjudicate(observations: DataFrame, rules: DataFrame, within: tuple[str, ...] = ()) -> DataFrame:
    """One decision per (group_id, fact): state, accepted_value, resolution, action, gold.

    In: group_id, fact, parser_id, value, value_sha256, ambiguous, unsafe.  Rules
    match the exact fact, else the part before its first dot.  ``within``: columns that a
    group has one value of; observations partitioned by them are not shuffled.
    """
    rules = rules.groupBy("p_fact").agg(*[F.min(c).alias(c) for c in rules.columns if c != "p_fact"])
    family = rules.select(*[F.col(c).alias(f"f_{c}") for c in rules.columns])
    strategy, resolution, gold, preferred = (F.coalesce(F.col(c), F.col(f"f_{c}")) for c in ("strategy", "p_resolution", "p_gold", "preferred"))
    # Which values there are matters only as one or several, so least and greatest say enough and nothing is made distinct.
    # Rules go to the observations: shuffled by fact, all rows of a fact would be one task's.
    def ruled(rows: DataFrame) -> DataFrame:
        return rows.join(F.broadcast(rules), F.col("fact") == F.col("p_fact"), "left").join(F.broadcast(family), F.substring_index("fact", ".", 1) == F.col("f_p_fact"), "left")

    rows = ruled(observations).withColumn("is_preferred", F.coalesce(F.col("value") == preferred, F.lit(False))).groupBy(*within, "group_id", "fact").agg(
        (F.min("parser_id") != F.max("parser_id")).alias("several_parsers"), (F.min("value_sha256") != F.max("value_sha256")).alias("several_values"), F.bool_or("ambiguous").alias("ambiguous"), F.bool_or("unsafe").alias("unsafe"), F.min("value").alias("one"), F.bool_or("is_preferred").alias("has_preferred"), F.count("*").alias("n_observations"),
    )
    rows = ruled(rows)
    single = ~F.col("several_values") & ~F.col("ambiguous")
    agreed = single & F.col("several_parsers")
    chosen = ~F.col("ambiguous") & F.col("several_values") & (strategy == "prefer-explicit-value") & F.col("has_preferred")
    state = F.when(F.col("ambiguous"), "unresolved").when(agreed, "agreement").when(single, "complementary").when(strategy == "require-review", "unresolved").otherwise("conflict")
    return rows.select(
        *within,
        "group_id",
        "fact",
        state.alias("state"),
        F.when(single, F.col("one")).when(chosen, preferred).alias("accepted_value"),
        F.when(F.col("ambiguous"), "ambiguous-source-alignment").when(agreed, "exact-typed-value").when(single, F.coalesce(resolution, F.lit("single-observed-fact"))).otherwise(F.coalesce(resolution, F.lit("preserve-unreviewed-conflict"))).alias("resolution"),
        F.when(state == "unresolved", "selective-review-or-third-parser").alias("action"),
        (~F.col("unsafe") & (agreed | (single & F.coalesce(gold, F.lit(False))))).alias("gold"),
        "n_observations",
    )


def region_states(decisions: DataFrame, within: tuple[str, ...] = ()) -> DataFrame:
    """Per group the gravest state of its facts, and gold if all facts are; ``within`` as for :func:`adjudicate`."""
    grave = F.max(F.array_position(F.array(*map(F.lit, STATES)), F.col("state")))
    return decisions.groupBy(*within, "group_id").agg(F.element_at(F.array(*map(F.lit, STATES)), grave.cast("int")).alias("state"), F.bool_and("gold").alias("gold"), F.count("*").alias("facts"))


def state_counts(decisions: DataFrame) -> DataFrame:
    """The number of decisions in each of the four states, zeros too."""
    spark = decisions.sparkSession
    counts = decisions.groupBy(F.col("state").alias("s_")).agg(F.count("*").alias("n"))
    return spark.createDataFrame([(s,) for s in STATES], "state string").join(counts, F.col("state") == F.col("s_"), "left").select("state", F.coalesce("n", F.lit(0)).alias("n"))


def fuse(rows: DataFrame, keys: list[str], chosen: list[str]) -> DataFrame:
    """Objects, relations or sections of all parsers joined by ``keys`` and their occurrence within a parser.

    In: keys, parser_id, ord, confidence and the ``chosen`` columns, of which each
    comes from the best-ranked parser that has it; the greatest confidence stays, and
    ``conflict`` says whether parsers differ in any chosen column.
    """
    nth = F.row_number().over(Window.partitionBy("parser_id", *keys).orderBy("ord"))
    rank = F.struct(parser_rank(F.col("parser_id")), F.col("parser_id"))
    picks = [F.min_by(c, F.when(F.col(c).isNotNull(), rank)).alias(c) for c in chosen]
    differ = [F.count_distinct(c) > 1 for c in chosen]
    conflict = differ[0]
    for one in differ[1:]:
        conflict = conflict | one
    fused = rows.withColumn("nth", nth).groupBy(*keys, "nth").agg(*picks, F.max("confidence").alias("confidence"), conflict.alias("conflict"), F.array_join(F.sort_array(F.collect_set("parser_id")), "|").alias("parsers"))
    return fused.withColumnRenamed("nth", "occurrence")
