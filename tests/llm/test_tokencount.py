import base64
import random
import tracemalloc

import pytest
import tiktoken

from tracewell.llm import tokencount

DOCS = "doc_id bigint, text string, n_tokens string"
MULTI = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"


def _encoding(path):
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    return tiktoken.Encoding("own", pat_str=tokencount.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.mark.parametrize("path", [tokencount.VOCABULARY, MULTI])
def test_counts_equal_a_library(spark, path):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    encoding = _encoding(path)
    texts = {r.doc_id: r.text for r in docs.collect()}
    got = {r.doc_id: r.n_tokens for r in tokencount.token_counts(docs, path).collect()}
    assert got == {k: len(encoding.encode_ordinary(t)) for k, t in texts.items()}


def _plain(word, ranks):
    parts = [word[i : i + 1] for i in range(len(word))]
    while True:
        pairs = [(ranks[parts[i] + parts[i + 1]], i) for i in range(len(parts) - 1) if parts[i] + parts[i + 1] in ranks]
        if not pairs:
            return len(parts)
        _, i = min(pairs)
        parts[i : i + 2] = [parts[i] + parts[i + 1]]


def test_merging_equals_the_plain_way():
    ranks = tokencount.read_ranks()
    rng = random.Random(3)
    for _ in range(400):
        word = bytes(rng.choice(b"aabcdeehhilnoorsttt \xc3\xa9\xf0") for _ in range(rng.randrange(1, 60)))
        assert tokencount.count_merged(word, ranks) == _plain(word, ranks)
    assert tokencount.count_merged(b"", ranks) == 0
    tokencount_long = tokencount.LONG
    try:
        tokencount.LONG = 8
        assert all(tokencount.count_merged(w, ranks) == _plain(w, ranks) for w in (b"hello world of merges", "é".encode() * 9, b"a" * 50))
    finally:
        tokencount.LONG = tokencount_long
    few = {b"aa": 0, b"aaaa": 1}
    for n in range(1, 40):
        assert tokencount.count_merged(b"a" * n, few) == _plain(b"a" * n, few)


def test_edge_rows(spark, monkeypatch):
    monkeypatch.setattr(tokencount, "MEMORY", 3)
    long = "a" * 300_000
    rows = [(1, None, "x"), (2, "", "x"), (None, "hello world", "x"), (3, "hello world", "x"), (3, "hello world", "x"), (4, long, "x"), (5, "\U0001f600 \x00 tab\t\n  end", "x")]
    got = [(r.doc_id, r.n_tokens) for r in tokencount.token_counts(spark.createDataFrame(rows, DOCS)).collect()]
    encoding = _encoding(tokencount.VOCABULARY)
    assert got[:5] == [(1, None), (2, 0), (None, 2), (3, 2), (3, 2)]
    assert abs(got[5][1] - 100 * _plain(b"a" * 3000, tokencount.read_ranks())) <= 100
    assert got[6][1] == len(encoding.encode_ordinary(rows[6][1]))
    assert tokencount.token_counts(spark.createDataFrame([], DOCS)).count() == 0


def test_memory_of_one_long_word():
    ranks = tokencount.read_ranks()
    word = b"a" * 200_000
    tracemalloc.start()
    assert tokencount.count_merged(word, ranks) == len(word) / 4
    assert tracemalloc.get_traced_memory()[1] < 90 * len(word)
    tracemalloc.stop()
