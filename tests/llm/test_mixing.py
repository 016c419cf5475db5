import random
from collections import Counter, defaultdict
from math import floor, sqrt

from pyspark.sql import functions as F

from tracewell.llm import mixing

DOCS = "doc_id bigint, text string, source string, copies int, upto string"


def _docs(n=400):
    rng = random.Random(1)
    return [(k, "x" * rng.randrange(1, 60), "abcd"[min(3, int(rng.expovariate(1)))], 1, "u") for k in range(n)]


def _brute(docs, start, weights=None):
    size = defaultdict(int)
    for _, text, source, _, _ in docs:
        size[source] += max(1, len(text or ""))
    w = {s: floor(sqrt(float(v)) * 1000) if weights is None else round(weights.get(s, 0) * 1e6) for s, v in size.items()}
    rate = {s: floor((float(w[s]) * float(sum(size.values()))) / (float(sum(w.values())) * float(size[s])) * mixing.UNIT) for s in size}
    at, out = dict(start), Counter()
    for doc_id, _, source, _, _ in sorted(docs, key=lambda d: d[0]):
        before = at[source]
        at[source] += rate[source]
        out[doc_id] = at[source] // mixing.UNIT - before // mixing.UNIT
    return +out, rate


def _starts(frame, **options):
    narrow = frame.select("source", "doc_id", F.greatest(F.length("text"), F.lit(1)).cast("bigint").alias("chars"))
    return {r.source: r.start for r in mixing.rates(narrow, **options).collect()}


def test_copies_equal_brute_force(spark):
    docs = _docs()
    frame = spark.createDataFrame(docs, DOCS)
    for options in ({}, {"weights": {"a": 1.0, "c": 3.0}}, {"seed": 5}):
        want, _ = _brute(docs, _starts(frame, **options), options.get("weights"))
        assert Counter(r.doc_id for r in mixing.copies(frame.repartition(5), **options).collect()) == want
        assert Counter(r.doc_id for r in mixing.mix(frame, **options).collect()) == want


def test_sources_reach_their_weights(spark):
    docs = _docs(3000)
    got = Counter(r.source for r in mixing.mix(spark.createDataFrame(docs, DOCS), weights={"a": 1.0, "b": 1.0, "d": 2.0}).collect())
    _, rate = _brute(docs, {s: 0 for s in "abcd"}, {"a": 1.0, "b": 1.0, "d": 2.0})
    count = Counter(d[2] for d in docs)
    assert all(abs(got[s] - count[s] * rate[s] / mixing.UNIT) <= 1 for s in "abcd") and got["c"] == 0


def test_edge_rows(spark):
    rows = [(1, None, "a", 1, "u"), (2, "", None, 1, "u"), (None, "text", "a", 1, "u"), (5, "same", "a", 1, "u"), (5, "same", "a", 2, "v"), (6, "long " * 100_000, "b", 1, "u")]
    frame = spark.createDataFrame(rows, DOCS)
    out = mixing.mix(frame)
    assert out.columns == frame.columns
    assert out.count() == mixing.copies(frame).count() > 0
    assert mixing.mix(frame.limit(0)).count() == 0 and mixing.copies(frame.limit(0)).count() == 0
    assert mixing.mix(frame, weights={}).count() == 0


def test_clashing_columns(spark):
    rows = [(k, "x" * (k + 1), "ab"[k % 2], k, k, k, k) for k in range(20)]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string, source string, m_source int, m_place int, nth int, text_hash int")
    out = mixing.mix(frame)
    assert out.columns == frame.columns
    assert Counter(r.doc_id for r in out.collect()) == Counter(r.doc_id for r in mixing.copies(frame).collect())


def test_sums_beyond_a_long(spark):
    frame = spark.createDataFrame([(99, 2 * 10**8 + 1, 10**12, 3)], "start bigint, rate bigint, place bigint, n bigint")
    ((got,),) = frame.select(mixing._copies(*map(F.col, frame.columns))).collect()
    sums = [99 + p * (2 * 10**8 + 1) for p in (10**12, 10**12 + 3)]
    assert got == sums[1] // mixing.UNIT - sums[0] // mixing.UNIT
