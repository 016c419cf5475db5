"""Token counts by byte-pair merging with a heap over a linked list.

A text is cut into pre-tokens by the vocabulary's pattern.  The bytes of a
pre-token are a linked list of symbols; a heap holds the adjacent pairs that the
vocabulary ranks, by rank and then from the left.  The lowest is popped and merged
until none is left, so the count is the number of initial symbols less the
number of merges; no identifiers are made.  A pre-token of n bytes takes
O(n log n) and about 90 n bytes of memory, whatever it holds.  Counts of pre-tokens of up to ``REMEMBERED`` bytes
are kept within a task, at most ``MEMORY`` of them at a time.

The vocabulary is a file of ``base64 rank`` lines, by default the public
``byte_bpe_50k.tiktoken``; the driver reads it and broadcasts the ranks (about
50,000 entries).  Single bytes are initial symbols even if the file lacks them.

Defined results: a null text has a null count, an empty one 0; texts are counted
whole at any length; null or repeated ids and repeated rows each give their row; an
empty table gives an empty result; other columns are not looked at.
"""

from __future__ import annotations

import base64
from array import array
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: The usual pre-token pattern of byte-level vocabularies.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
REMEMBERED = 64
#: Pre-tokens of more bytes hold their list in arrays, a tenth of the memory of lists.
LONG = 4096
#: Bits of a place in a heap entry; the rank stands above them.
_PLACE = 40
_BELOW = (1 << _PLACE) - 1
MEMORY = 400_000


def read_ranks(path: str = VOCABULARY) -> dict[bytes, int]:
    """The ranks of a vocabulary file."""
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}


def count_merged(word: bytes, ranks: dict[bytes, int]) -> int:
    """Symbols of ``word`` after all merges."""
    n = len(word)
    if n < 2:
        return n
    end, before = range(1, n + 1), range(-1, n - 1)  # of the symbol that begins here; 0 once it is merged into the one before
    end, before = (list(end), list(before)) if n <= LONG else (array("q", end), array("q", before))
    get = ranks.get
    heap = [rank << _PLACE | i for i in range(n - 1) if (rank := get(word[i : i + 2])) is not None]
    heapify(heap)
    merges = 0
    while heap:
        low = heappop(heap)
        i = low & _BELOW
        mid = end[i]
        if not 0 < mid < n or get(word[i : (to := end[mid])]) != low >> _PLACE:
            continue  # one of the two has changed since
        end[i], end[mid] = to, 0
        merges += 1
        if to < n:
            before[to] = i
            if (rank := get(word[i : end[to]])) is not None:
                heappush(heap, rank << _PLACE | i)
        if (left := before[i]) >= 0 and (rank := get(word[left:to])) is not None:
            heappush(heap, rank << _PLACE | left)
    return n - merges


def _count(shared, pattern: str):
    def count(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        ranks, find = shared.value, regex.compile(pattern).finditer
        known: dict[str, int] = {}
        for batch in batches:
            out = []
            for value in batch:
                text = value.as_py()
                if text is None:
                    out.append(None)
                    continue
                total = 0
                for match in find(text):
                    word = match[0]
                    size = known.get(word)
                    if size is None:
                        size = count_merged(word.encode("utf-8", "surrogatepass"), ranks)
                        if len(word) <= REMEMBERED:
                            if len(known) >= MEMORY:
                                known.clear()
                            known[word] = size
                    total += size
                out.append(total)
            yield pa.array(out, pa.int64())

    return count


def n_tokens(spark: SparkSession, text: Column, vocabulary: str = VOCABULARY, pattern: str = PATTERN) -> Column:
    """The number of tokens of ``text``."""
    shared = spark.sparkContext.broadcast(read_ranks(vocabulary))
    return F.arrow_udf(_count(shared, pattern), "bigint")(text)


def token_counts(documents: DataFrame, vocabulary: str = VOCABULARY, pattern: str = PATTERN, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens of every document. No shuffle."""
    return documents.select(F.col(id_col).alias("doc_id"), n_tokens(documents.sparkSession, F.col(text_col), vocabulary, pattern).alias("n_tokens"))
