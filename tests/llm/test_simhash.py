import random

import numpy as np
import pyarrow as pa

from tracewell.llm import simhash

DOCS = "doc_id bigint, text string, grp string, a string"


def _texts(seed=3, n=120):
    rng = random.Random(seed)
    vocabulary = [f"word{k}x" for k in range(3000)]
    out = []
    for _ in range(n):
        base = [rng.choice(vocabulary) for _ in range(rng.randrange(60, 300))]
        out.append(" ".join(base))
        for _ in range(rng.randrange(3)):
            copy = list(base)
            for _ in range(rng.randrange(1, 6)):
                copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            out.append(" ".join(copy))
    return out


def _roots(near):
    root = list(range(len(near)))
    for _ in root:
        root = [min(root[j] for j in np.flatnonzero(near[i])) for i in range(len(near))]
    return root


def _joined(n, pairs):
    near = np.eye(n, dtype=bool)
    for i, j in pairs:
        near[i, j] = near[j, i] = True
    return _roots(near)


def test_every_pair_within_the_bits_shares_a_key():
    rng = np.random.default_rng(2)
    sig = rng.integers(0, 1 << 63, (2000, 2)).astype(np.uint64)
    other = sig.copy()
    for i in range(len(sig)):
        for bit in rng.choice(simhash.BITS, simhash.MAX_BITS - i % 4, replace=False):
            other[i, bit // 64] ^= np.uint64(1 << int(bit % 64))
    # The worst case: two bits in each segment but one.
    other[0] = sig[0]
    for bit in [*range(0, 128, 16), *range(1, 113, 16)]:
        other[0, bit // 64] ^= np.uint64(1 << int(bit % 64))
    met = np.zeros(len(sig), bool)
    for one, two in zip(simhash.keys_of(sig), simhash.keys_of(other)):
        met |= one == two
    assert met.all()


def test_recall_of_pairs_against_brute_force():
    sig = simhash.signatures(pa.array(_texts()))
    bits = np.bitwise_count(sig[:, None, :] ^ sig[None, :, :]).sum(2)
    want = {(i, j) for i, j in zip(*np.nonzero(bits <= simhash.MAX_BITS)) if i < j}
    met = {(i, j) for k in simhash.keys_of(sig) for i, j in zip(*np.nonzero(k[:, None] == k[None, :])) if i < j}
    assert len(want) > 50 and want <= met


def test_groups_equal_brute_force(spark):
    texts = _texts(5)
    docs = spark.createDataFrame([(k, t, "g", "a") for k, t in enumerate(texts)], DOCS)
    sig = simhash.signatures(pa.array(texts))
    root = _roots(np.bitwise_count(sig[:, None, :] ^ sig[None, :, :]).sum(2) <= simhash.MAX_BITS)
    want = {(i, r) for i, r in enumerate(root) if i != r}
    assert {tuple(r) for r in simhash.duplicate_pairs(docs).collect()} == want and len(want) > 20


def _crowd(rng, n):
    """Unrelated signatures, tight groups and chains, all in one key."""
    sig = rng.integers(0, 1 << 63, (n, 2)).astype(np.uint64)
    for i in range(n // 3, n // 2):
        sig[i] = sig[i - 1] if i % 7 else sig[i]
        for bit in rng.integers(0, simhash.BITS, rng.integers(0, 20)):
            sig[i, bit // 64] ^= np.uint64(1 << int(bit % 64))
    sig[-n // 5 :] = sig[-1]
    sig[-n // 5 :, 0] ^= rng.integers(0, 1 << 6, n - (n - n // 5)).astype(np.uint64)
    return sig[rng.permutation(n)]


def test_keys_of_any_size_join_what_all_pairs_join(monkeypatch):
    rng = np.random.default_rng(4)
    for pairs, wide, depth in ((512, 2048, 3), (4, 8, 3), (4, 50, 1), (4, 10**9, 3)):
        monkeypatch.setattr(simhash, "PAIRS", pairs)
        monkeypatch.setattr(simhash, "WIDE", wide)
        monkeypatch.setattr(simhash, "DEPTH", depth)
        sig = _crowd(rng, 300)
        key = (np.arange(300) % 3 == 0).astype(np.int64)
        near = (np.bitwise_count(sig[:, None, :] ^ sig[None, :, :]).sum(2) <= simhash.MAX_BITS) & (key[:, None] == key[None, :])
        assert _joined(300, simhash.linked(key, sig)) == _roots(near)
    assert len(simhash.linked(np.zeros(0, np.int64), np.zeros((0, 2), np.uint64))) == 0


def test_work_on_a_key_of_unrelated_signatures_grows_with_its_size(monkeypatch):
    compared = []
    count = np.bitwise_count
    monkeypatch.setattr(simhash.np, "bitwise_count", lambda x: (compared.append(x.size), count(x))[1])
    rng = np.random.default_rng(6)
    work = []
    for n in (8_000, 32_000):
        compared.clear()
        assert len(simhash.linked(np.zeros(n, np.int64), rng.integers(0, 1 << 63, (n, 2)).astype(np.uint64))) == 0
        work.append(sum(compared) / n)
    # All pairs would be four times as many for each signature; these are those that meet by accident.
    assert work[1] < 32_000 / 8


def test_edge_rows(spark):
    long = "tail " * 200_000
    rows = [(1, None, "g", "a"), (2, None, "g", "a"), (3, "", "g", "a"), (4, "", "g", "a"), (5, "same words here again", "g", "a"), (5, "same words here again", "g", "b"), (None, "same words here again", "g", "a"), (7, long, "g", "a"), (8, long + "end", "g", "a"), (9, "quite another text altogether", "g", "a")]
    docs = spark.createDataFrame(rows, DOCS)
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == [1, 2, 3, 5, 7, 9]
    assert {tuple(r) for r in simhash.duplicate_pairs(docs).collect()} == {(4, 3), (8, 7)}
    assert simhash.keep_one(docs.limit(0)).count() == 0 and simhash.duplicate_pairs(docs.limit(0)).count() == 0


def test_thousands_of_copies_are_one_group(spark):
    docs = spark.createDataFrame([(k, "the very same page of text " * 5 + "end" * (k % 2), "g", "a") for k in range(3000)], DOCS)
    assert simhash.keep_one(docs).count() == 1


def test_pairs_do_not_depend_on_partitions(spark):
    docs = spark.createDataFrame([(k, t, "g", "a") for k, t in enumerate(_texts(9, 40))], DOCS)
    one = sorted(map(tuple, simhash.duplicate_pairs(docs.repartition(1)).collect()))
    assert one == sorted(map(tuple, simhash.duplicate_pairs(docs.repartition(7)).collect()))
