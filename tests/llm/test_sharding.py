import datetime
import random
from decimal import Decimal

import pytest

from tracewell.llm import sharding

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, shard_id string, d0 string"


def _docs(n=500, seed=4):
    rng = random.Random(seed)
    out = []
    for k in range(n):
        text = "é" * int(rng.expovariate(0.02))
        out.append((k, text, rng.choice(["en", "de", "fr", None]), f"src{rng.randrange(6)}", len(text), "x", "y"))
    return out


def _code(text):
    return -1 if text is None else int.from_bytes(text.encode()[:7].ljust(7, b"\0"), "big")


def _brute(rows, target, n, root=None):
    """Shards as lists of row numbers, in tree order. A row: values and bytes."""
    def split(nodes, root):
        span = [max(rows[i][0][d] for i in nodes) - min(rows[i][0][d] for i in nodes) for d in range(n)]
        root = root or [max(1, s) for s in span]
        total = sum(rows[i][1] for i in nodes)
        if total <= target or not any(span):
            return [nodes]
        dim = max(range(n), key=lambda d: (span[d] / root[d], -d))
        values = sorted({rows[i][0][dim] for i in nodes})
        below, median = 0, None
        for v in values:
            below += sum(rows[i][1] for i in nodes if rows[i][0][dim] == v)
            if 2 * below >= total:
                median = v
                break
        cut = median - 1 if median == values[-1] else median
        return split([i for i in nodes if rows[i][0][dim] <= cut], root) + split([i for i in nodes if rows[i][0][dim] > cut], root)

    return split(list(range(len(rows))), root)


def test_shards_equal_brute_force(spark, monkeypatch):
    docs = _docs()
    rows = [((_code(lang), _code(source), n, k), len(text.encode())) for k, text, lang, source, n, _, _ in docs]
    frame = spark.createDataFrame(docs, DOCS)
    for target, slots, finish in ((3000, 1 << 16, 1 << 20), (900, 64, 100), (2000, 1 << 16, 0), (10**9, 64, 0)):
        monkeypatch.setattr(sharding, "SLOTS", slots)
        monkeypatch.setattr(sharding, "NODE_SLOTS", min(slots, 7))
        monkeypatch.setattr(sharding, "FINISH_ROWS", finish)
        want = {docs[i][0]: s for s, part in enumerate(_brute(rows, target, 4)) for i in part}
        got = {r.doc_id: r.shard_id for r in sharding.shards(frame.repartition(3), target_bytes=target).collect()}
        assert got == want


def test_texts_that_begin_alike_are_told_apart(spark):
    rng = random.Random(9)
    sources = [None, "", "www.exa", "www.exa\0", *[f"https://www.example.org/{k}é" for k in range(9)]]
    docs = [(k, "t" * rng.randrange(40), "common_crawl_" + rng.choice("12"), rng.choice(sources), 7, "x", "y") for k in range(400)]
    rank = {d: {v: i for i, v in enumerate(sorted({r[d] for r in docs} - {None}, key=str.encode))} | {None: -1} for d in (2, 3)}
    rows = [((rank[2][r[2]], rank[3][r[3]], 7), len(r[1])) for r in docs]
    frame = spark.createDataFrame(docs, DOCS)
    for target in (3000, 100):
        want = {docs[i][0]: s for s, part in enumerate(_brute(rows, target, 3)) for i in part}
        got = {r.doc_id: r.shard_id for r in sharding.shards(frame.repartition(3), dimensions=("lang", "source", "n_chars"), target_bytes=target).collect()}
        assert got == want
    # At the last target every pair of values is a shard of its own.
    assert len(set(got.values())) == len({(r[2], r[3]) for r in docs})


@pytest.mark.parametrize("finish", [1 << 20, 5])
def test_one_dimension_of_each_type(spark, monkeypatch, finish):
    """Splits tell apart values however close: twenty sources that share twelve bytes are twenty shards."""
    monkeypatch.setattr(sharding, "FINISH_ROWS", finish)
    rng = random.Random(5)
    values = {
        "string": [f"commoncrawl-{k}" for k in range(20)],
        "double": [0.0, 1e-9, 2e-9, -1e-300, 1e300, float("inf"), float("-inf"), float("nan"), 0.1, 0.1 + 2**-55],
        "float": [0.5, 0.25, -3.0],
        "decimal(18,4)": [Decimal(k) / 10000 for k in range(10)],
        "decimal(38,2)": [Decimal(f"{10**28}.{k:02}") for k in range(8)],
        "bigint": [-(2**63), 2**63 - 1, 0, 1],
        "int": [3, 4],
        "boolean": [True, False],
        "date": [datetime.date(2024, 1, 1 + k) for k in range(9)],
    }
    for kind, some in values.items():
        rows = [(v, "x" * 500) for v in some for _ in range(rng.randrange(1, 4))] + [(None, "x" * 500)]
        rng.shuffle(rows)
        frame = spark.createDataFrame(rows, f"v {kind}, text string")
        out = sharding.with_shard(frame.repartition(3), dimensions=("v",), target_bytes=400).collect()
        shard = {}
        for r in out:
            shard.setdefault("nan" if r.v != r.v else r.v, set()).add(r.shard_id)
        assert all(len(x) == 1 for x in shard.values()) and len(set.union(*shard.values())) == len(some) + 1
        if kind != "string":
            order = [min(shard["nan" if v != v else v]) for v in sorted(some, key=lambda v: (v != v, v))]
            assert order == sorted(order) and (kind == "bigint" or shard[None] == {0})


def test_without_dimensions_all_is_one_shard(spark):
    frame = spark.createDataFrame([("a",), (None,)], "text string")
    assert {r.shard_id for r in sharding.with_shard(frame, dimensions=()).collect()} == {0}


def test_edge_rows(spark):
    rows = [(None, None, None, None, None, "x", "y"), (1, "", "en", "s", 0, "x", "y"), (2, "a" * 1_000_000, "en", "s", 5, "x", "y"), (2, "a" * 1_000_000, "en", "s", 5, "x", "y"), (3, "b", "de", "t", 1, "x", "y")]
    frame = spark.createDataFrame(rows, DOCS)
    out = sharding.with_shard(frame, target_bytes=1000)
    assert out.columns == [*frame.columns, "shard_id_"]
    by_id = {}
    for r in out.collect():
        by_id.setdefault(r.doc_id, set()).add(r.shard_id_)
    assert all(len(s) == 1 for s in by_id.values()) and len(set.union(*by_id.values())) >= 2
    assert sharding.shards(frame.limit(0)).count() == 0


def test_leaves_reach_the_target(spark):
    docs = _docs(2000, 8)
    rows = sharding.shards(spark.createDataFrame(docs, DOCS), target_bytes=20_000).collect()
    size = {}
    for r in rows:
        size[r.shard_id] = size.get(r.shard_id, 0) + r.n_bytes
    assert max(size.values()) <= 20_000 and sorted(size) == list(range(len(size)))
