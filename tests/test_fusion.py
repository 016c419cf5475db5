import random
import re

import pytest
from pyspark.sql import functions as F

from tracewell.operators import fusion as U
from tracewell.operators import hierarchy as H
from tracewell.plans.lineage import written
from tracewell.queries import fusing, registry

SF = "/root/testdata/sf0.001"
OBS = "group_id string, fact string, parser_id string, value string, ambiguous boolean, unsafe boolean"


@pytest.mark.parametrize(
    "rows, expected",
    [
        ([("text", "a", "x"), ("text", "b", "x")], ("agreement", "x", "exact-typed-value", None, True)),
        ([("native_link_target", "a", "u")], ("complementary", "u", "retain-complementary-fact", None, True)),
        ([("blocks", "a", "2"), ("blocks", "b", "1")], ("conflict", None, "align-by-source-span-then-preserve-both-segmentation-observations", None, False)),
        ([("reading_order", "a", "1"), ("reading_order", "b", "2")], ("unresolved", None, "unresolved-reading-order", "selective-review-or-third-parser", False)),
        ([("bbox", "a", "1"), ("bbox", "b", "2")], ("conflict", None, "fact-specific-policy", None, False)),
        ([("object_type", "a", "table"), ("object_type", "b", "text")], ("conflict", "table", "richer-validated-structure", None, False)),
        ([("caption", "a", "c")], ("complementary", "c", "single-observed-fact", None, False)),
        ([("width", "a", "1"), ("width", "b", "1.0")], ("conflict", None, "preserve-unreviewed-conflict", None, False)),
        ([("text.head", "a", "x"), ("text.head", "b", "y")], ("conflict", None, "exact-typed-value", None, False)),
    ],
)
def test_adjudication(spark, rows, expected):
    frame = spark.createDataFrame([("g", f, p, v, False, False) for f, p, v in rows], OBS).withColumn("value_sha256", F.sha2("value", 256))
    (d,) = U.adjudicate(frame, U.policies(spark)).collect()
    assert (d.state, d.accepted_value, d.resolution, d.action, d.gold) == expected


def test_observations_are_not_shuffled_by_fact(spark):
    rows = [("g", "text", "a", "x", False, False)]
    decided = U.adjudicate(spark.createDataFrame(rows, OBS).withColumn("value_sha256", F.sha2("value", 256)), U.policies(spark))
    plan = decided._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(fact" not in plan and "SortMergeJoin" not in plan


@pytest.mark.parametrize("summed", [U.region_states, U.state_counts])
def test_summaries_of_decisions_are_not_shuffled_by_fact(spark, summed):
    frame = spark.createDataFrame([("g", "text", "a", "x", False, False)], OBS).withColumn("value_sha256", F.sha2("value", 256))
    made = summed(U.adjudicate(frame, U.policies(spark)))
    assert "hashpartitioning(fact" not in made._jdf.queryExecution().executedPlan().toString()


def _hashed(made):
    return set(re.findall(r"hashpartitioning\(([a-z_]+)", made._jdf.queryExecution().executedPlan().toString())) - {"p_fact"}


def test_decisions_stay_in_the_task_of_their_document(spark, monkeypatch):
    assert _hashed(fusing.region_states(spark, SF)) == {"doc_id"}
    assert _hashed(fusing.fusion_state_counts(spark, SF)) <= {"doc_id", "state", "s_"}
    monkeypatch.setattr(registry, "SPREAD_BYTES", 10_000)
    assert fusing.region_states(spark, SF).rdd.getNumPartitions() > 8, "tasks by the size of the table"


def test_fused_blocks_stay_in_the_task_of_their_document(spark):
    assert _hashed(fusing.block_fusion(spark, SF)) == {"doc_id"}


def test_ambiguity_comes_first_and_unsafe_is_never_gold(spark):
    rows = [("g", "text", "a", "x", True, False), ("g", "text", "b", "x", True, False), ("h", "text", "a", "x", False, True), ("h", "text", "b", "x", False, False)]
    frame = spark.createDataFrame(rows, OBS).withColumn("value_sha256", F.sha2("value", 256))
    got = {d.group_id: (d.state, d.gold) for d in U.adjudicate(frame, U.policies(spark)).collect()}
    assert got == {"g": ("unresolved", False), "h": ("agreement", False)}


def test_mutual_best(spark):
    pairs = [("a1", "b1", 0.9), ("a1", "b2", 0.85), ("a2", "b3", 0.9), ("a2", "b4", 0.9), ("a3", "b5", 0.7), ("a4", "b6", 0.8)]
    frame = spark.createDataFrame([(x, y, "a", "b", s) for x, y, s in pairs], "left_id string, right_id string, left_parser string, right_parser string, score double")
    got = {(r.left_id, r.right_id): r.status for r in U.mutual_best(frame).collect()}
    assert got == {("a1", "b1"): "accepted", ("a1", "b2"): "superseded", ("a2", "b3"): "ambiguous", ("a2", "b4"): "ambiguous", ("a3", "b5"): "rejected", ("a4", "b6"): "accepted"}


def test_components_equal_union_find(spark):
    rng = random.Random(4)
    edges = [(f"n{rng.randrange(300):03d}", f"n{rng.randrange(300):03d}") for _ in range(180)] + [(f"c{k:03d}", f"c{k + 1:03d}") for k in range(60)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for u, v in edges:
        a, b = sorted((find(u), find(v)))
        root[b] = a
    want = {x: find(x) for x in root if find(x) != x}
    got = {r.node: r.root for r in U.aligned_groups(spark.createDataFrame(edges, "u string, v string")).collect()}
    assert got == want


def test_closure_and_cycles(spark):
    tree = spark.createDataFrame([(1, None), (2, 1), (3, 2), (4, 2), (5, None)], "k int, p int")
    got = {tuple(r) for r in H.closure(tree, "k", "p").collect()}
    assert got == {(1, 1, 0), (2, 2, 0), (3, 3, 0), (4, 4, 0), (5, 5, 0), (1, 2, 1), (2, 3, 1), (2, 4, 1), (1, 3, 2), (1, 4, 2)}
    assert H.cyclic(tree, "k", "p").count() == 0
    ring = spark.createDataFrame([(1, 3), (2, 1), (3, 2), (4, 1), (5, 5)], "k int, p int")
    assert {r.node for r in H.cyclic(ring, "k", "p").collect()} == {1, 2, 3, 5}


def test_a_tail_on_a_cycle_ends(spark):
    ring = spark.createDataFrame([("a", "b"), ("b", "a"), ("c", "a"), ("d", "c"), ("e", None)], "k string, p string")
    got = {tuple(r) for r in H.closure(ring, "k", "p").collect()}
    assert got == {(x, x, 0) for x in "abcde"} | {("b", "a", 1), ("a", "b", 1), ("a", "c", 1), ("b", "c", 2), ("c", "d", 1), ("a", "d", 2), ("b", "d", 3)}
    assert {r.node for r in H.cyclic(ring, "k", "p").collect()} == {"a", "b"}
    roots = spark.createDataFrame([("a",), ("x",)], "root string")
    assert {tuple(r) for r in H.below(ring, "k", "p", roots).collect()} == {("a", "a", 0), ("a", "b", 1), ("a", "c", 1), ("a", "d", 2)}


def test_deep_trees_take_few_rounds(spark):
    chain = spark.range(300).select("id", F.when(F.col("id") > 0, F.col("id") - 1).alias("up"))
    assert H.closure(chain, "id", "up").agg(F.max("depth"), F.count("*")).first() == (299, 300 * 301 // 2)
    assert H.cyclic(chain, "id", "up").count() == 0


def test_cycles_end_when_no_end_is_lost_and_gather_nothing(spark, monkeypatch):
    rows = [(10 * t + k, 10 * t + ((k + 1) % 3 if k < 3 else k - 1)) for t in range(200) for k in range(10)]
    made = []
    monkeypatch.setattr(H, "written", lambda df, label: made.append(df) or written(df, label))
    got = {r.node for r in H.cyclic(spark.createDataFrame(rows, "k bigint, p bigint"), "k", "p").collect()}
    assert got == {10 * t + k for t in range(200) for k in range(3)}
    assert len(made) <= 6, "rounds by the depth of the tails and not by the number of nodes"
    assert not any("BroadcastHashJoin" in df._jdf.queryExecution().executedPlan().toString() for df in made)


REGION = "region_id string, parser_id string, kind string, resource_id string, page int, anchor string, selectors array<string>, char_start int, char_end int, signature string, box struct<x0:double,y0:double,x1:double,y1:double>, digest string"


def _region(name, parser, kind="block", **facts):
    empty = {"resource_id": None, "page": None, "anchor": None, "selectors": None, "char_start": None, "char_end": None, "signature": None, "box": None, "digest": None}
    return (name, parser, kind, *{**empty, **facts}.values())


def test_stronger_evidence_supersedes(spark):
    at = lambda y: (0.0, float(y), 10.0, float(y) + 10.0)
    rows = [
        _region("a1", "a", resource_id="r", page=0, anchor="x", box=at(0)), _region("b1", "b", resource_id="r", page=0, anchor="x", box=at(100)),
        _region("b2", "b", resource_id="r", page=0, box=at(0)), _region("a3", "a", resource_id="r", page=0, box=at(100)),
        _region("a4", "a", "relation", signature="s"), _region("b4", "b", "relation", signature="s"), _region("c4", "c", "relation", signature="s"),
        _region("a5", "a", "generic", digest="t"), _region("b5", "b", "generic", digest="t"), _region("c5", "c", "generic", digest="t", page=3),
        _region("a6", "a", selectors=["p", "q"]), _region("b6", "b", selectors=["q"]), _region("b7", "b", selectors=["p"]),
        _region("z", "a"), _region("z", "b"), _region("y", "a", resource_id="r", page=2, box=at(0)), _region("w", "b", "table", resource_id="r", page=2, box=at(0)),
    ]
    frame = spark.createDataFrame(rows, REGION)
    evidence = U.align(frame)
    got = {(r.left_id, r.right_id): (r.method, r.selectors, r.status) for r in evidence.collect()}
    digest, signature, selector, box = U.METHODS[5], U.METHODS[3], U.METHODS[1], U.METHODS[4]
    assert got == {
        ("a1", "b1"): (U.METHODS[0], "", "exact"), ("a1", "b2"): (box, "", "superseded"), ("a3", "b1"): (box, "", "superseded"), ("z", "z"): (U.SHARED_ID, "", "exact"),
        ("a4", "b4"): (signature, "", "exact"), ("a4", "c4"): (signature, "", "exact"), ("b4", "c4"): (signature, "", "exact"), ("a5", "b5"): (digest, "", "exact"),
        ("a6", "b6"): (selector, "q", "ambiguous"), ("a6", "b7"): (selector, "p", "ambiguous"),
    }
    groups = {r.region_id: (r.group_id, r.members) for r in U.alignment_groups(frame, evidence).collect()}
    assert groups["z"] == ("z", 1) and groups["a4"] == groups["b4"] == groups["c4"] and groups["a4"][1] == 3 and groups["a1"][0].startswith("group-")
    assert evidence._jdf.queryExecution().optimizedPlan().toString().count("Relation") <= 8, "one table for each step"


def _many_regions(documents, apart=False):
    """Regions of all kinds; if ``apart``, those of different documents agree in nothing."""
    rng = random.Random(7)
    rows = []
    for d in range(documents):
        some = lambda values: rng.choice([*values, None])
        for k in range(60):
            kind, y = rng.choice(["block", "block", "table", "relation", "generic"]), rng.randrange(12)
            facts = {"resource_id": some([f"r{d}"] * 3), "page": some([0, 1]), "anchor": some("xyz"), "signature": some([f"{d}:s", f"{d}:t"]), "digest": some([f"{d}:u", f"{d}:v"]), "char_start": some([1, 2]), "char_end": some([3]), "box": some([(0.0, float(y), 10.0, y + rng.choice([0.0, 4.0, 5.0, 9.0]))] * 3)}
            if kind == "generic" or rng.random() < 0.4:
                facts = {"digest": facts["digest"], "signature": facts["signature"], "box": facts["box"] if kind != "generic" else None, "page": facts["page"] if kind != "generic" else None}
            if apart and facts.get("resource_id") is None:
                facts |= {"char_start": None, "box": None}
            facts["selectors"] = some([[f"{d}:{k % 7}", f"{d}:{k % 5}"], [], None])
            for parser in rng.sample("abc", rng.choice([1, 1, 1, 1, 2, 3])):
                rows.append((d, *_region(f"{d}:{k:02d}", parser, kind, **facts)))
    return rows


def test_alignment_within_groups_is_that_of_all_regions(spark, monkeypatch):
    frame = spark.createDataFrame([*_many_regions(6, apart=True), (None, *_region(None, "a"))], "doc bigint, " + REGION)
    evidence = U.align(frame.drop("doc"))
    groups = U.alignment_groups(frame.drop("doc"), evidence)
    want, members = sorted(map(tuple, evidence.collect())), sorted(map(tuple, groups.collect()))
    assert {r[2] for r in want} == {U.SHARED_ID, *U.METHODS} and {r[5] for r in want} == {"exact", "accepted-candidate", "superseded", "rejected", "ambiguous"}
    for at_once in (5, 100_000):
        monkeypatch.setattr(U, "PAIRS_AT_ONCE", at_once)
        assert sorted(map(tuple, U.align(frame, within=("doc",)).select(evidence.columns).collect())) == want
        assert sorted(map(tuple, U.groups_within(frame, ("doc",)).select(groups.columns).collect())) == members


def test_candidates_are_those_of_comparing_all_regions(spark):
    regions = U._whole(spark.createDataFrame(_many_regions(4), "doc bigint, " + REGION).drop("doc"), ())
    found = {(r.left_id, r.right_id): (r.priority, r.selectors, round(r.score, 9)) for r in U.candidates(regions).collect()}
    rows, want = regions.collect(), {}
    for a in rows:
        for b in rows:
            if a.region_id >= b.region_id or set(a.parsers.split("|")) & set(b.parsers.split("|")) or a.kind != b.kind:
                continue
            same = lambda *names: all(a[n] == b[n] for n in names)
            shared = sorted(set(a.selectors) & set(b.selectors))
            nowhere = not any(x[c] is not None for x in (a, b) for c in U._PLACE) and not a.selectors and not b.selectors
            boxes = a.kind != "generic" and a.page is not None and same("page") and (a.resource_id or "") == (b.resource_id or "") and a.box and b.box
            high = min(a.box.y1, b.box.y1) - max(a.box.y0, b.box.y0) if boxes else 0
            if a.kind != "relation" and None not in (a.resource_id, a.page, a.anchor) and same("resource_id", "page", "anchor"):
                want[a.region_id, b.region_id] = (1, "", 1.0)
            elif shared:
                want[a.region_id, b.region_id] = (2, "|".join(shared), 1.0)
            elif a.char_start is not None and same("resource_id", "page", "char_start", "char_end"):
                want[a.region_id, b.region_id] = (3, "", 1.0)
            elif a.kind == "relation" and a.signature is not None and same("signature"):
                want[a.region_id, b.region_id] = (4, "", 1.0)
            elif high > 0:
                want[a.region_id, b.region_id] = (5, "", round(10 * high / (10 * (a.box.y1 - a.box.y0) + 10 * (b.box.y1 - b.box.y0) - 10 * high), 9))
            elif a.kind == "generic" and a.digest is not None and same("digest") and nowhere:
                want[a.region_id, b.region_id] = (6, "", 1.0)
    assert {p for p, _, _ in want.values()} == {1, 2, 3, 4, 5, 6}
    assert found == want


@pytest.mark.parametrize("aligned", ["align_priority", "align_groups"])
def test_regions_are_aligned_in_the_task_of_their_document(spark, aligned):
    plan = getattr(fusing, aligned)(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert set(re.findall(r"hashpartitioning\(([a-z_]+)", plan)) == {"doc_id"} and "Join" not in plan
