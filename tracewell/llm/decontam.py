"""Benchmark decontamination with one Aho-Corasick automaton.

Benchmark items (questions and answers) and documents go through the same
normalisation: compatibility decomposition, case folding, accents dropped, and
every run of other signs made one blank.  A letter of a script that is written
without blanks (Chinese, Japanese, Thai, Lao, Khmer, Burmese, Yi) is a word of its own,
so that such an item is found inside running text.  The automaton holds the items cut into
consecutive blocks of half of ``min_run`` words, rounded up; any run of ``min_run``
item words in a text holds a whole block, so one scan finds every such run, which is
then grown to its full length against the item.  A run counts if it has ``min_run``
words or is the whole item, however short that is: answers of one word count too,
unless the caller asks for ``min_words``.  Offsets point into the original text, in
characters.

Defined results: a null or empty text has no match; a null or wordless item is not
searched, nor is one of fewer than ``min_words`` words (1 by default, so none); items of equal text
each give a row, and so do repeated items and repeated documents; an empty table
gives no row; text of any length is scanned whole; ids may have any type and may be
null; columns other than the text (and, for :func:`leaks`, ``doc_id``) are never
looked at, so their names are free.
"""

from __future__ import annotations

import os
import unicodedata
from collections.abc import Iterator
from typing import Any

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from tracewell.plans.lineage import fresh

MIN_RUN = 13
MIN_WORDS = 1
#: Normalised characters that one automaton holds (about 50 bytes each in a worker); more items make further automata.
AUTOMATON_CHARS = 2_000_000

_FIELDS = ("item_id", "start_char", "end_char", "n_words")
_TABLE: list[np.ndarray] = []
#: Letters and digits lie below the first, marks and signs of format below the second; nothing beyond them has a form of its own.
_LETTERS, _LAST = 0x40000, 0xE1000

#: First and last code point of the scripts written without blanks.
_UNSPACED = ((0x0E00, 0x0EFF), (0x1000, 0x109F), (0x1780, 0x17FF), (0x1950, 0x19DF), (0x3005, 0x3007), (0x3040, 0x312F), (0x31F0, 0x31FF), (0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xA000, 0xA4CF), (0xF900, 0xFAFF), (0x1B000, 0x1B16F), (0x20000, 0x3FFFF))


def _table() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All normal forms end to end, and for each code point where its own begins and how long it is; other signs are a blank."""
    if not _TABLE:
        forms, size = [], np.ones(_LAST, np.uint8)
        for code in [*range(_LETTERS), *range(0xE0000, _LAST)]:
            char = chr(code)
            kind = unicodedata.category(char)
            out = " "
            if kind[0] == "M" or kind == "Cf":
                out = ""
            elif kind[0] in "LN":
                whole = unicodedata.normalize("NFKD", unicodedata.normalize("NFKD", char).casefold())
                out = "".join(c for c in whole if c == " " or unicodedata.category(c)[0] in "LN") or char
            forms.append(out)
            size[code] = len(out)
        start = np.concatenate(([0], np.cumsum(size[:-1].astype(np.int64))))
        flat = np.full(int(start[-1] + size[-1]), 32, np.uint32)
        low, high = "".join(forms[:_LETTERS]), "".join(forms[_LETTERS:])
        flat[: len(low)] = np.frombuffer(low.encode("utf-32-le", "surrogatepass"), np.uint32)
        flat[len(flat) - len(high) :] = np.frombuffer(high.encode("utf-32-le", "surrogatepass"), np.uint32)
        _TABLE.extend((flat, start, size))
    return _TABLE[0], _TABLE[1], _TABLE[2]


def normalise(text: str) -> tuple[str, np.ndarray]:
    """The normal form with a blank at both ends, and for each of its characters the place in ``text`` (-1 and len at the ends)."""
    flat, start, size = _table()
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    low = np.where(codes < _LAST, codes, 0)
    places, at, begin = size[low], np.arange(len(codes)), start[low]
    if (places != 1).any():
        places = places.astype(np.int64)
        at = np.repeat(at, places)
        begin = np.repeat(begin - np.cumsum(places) + places, places) + np.arange(len(at))
    out = flat[begin]
    out = np.concatenate(([32], out, [32])).astype(np.uint32)
    at = np.concatenate(([-1], at, [len(codes)]))
    # Scripts with blanks lie below most of the ranges, so most texts are passed by their greatest letter.
    if out.max() >= _UNSPACED[0][0]:
        alone = np.zeros(len(out), bool)
        for first, last in _UNSPACED:
            alone |= (out >= first) & (out <= last)
        whence = np.repeat(np.arange(len(out)), 1 + 2 * alone)
        inner = np.cumsum(1 + 2 * alone) - 1 - alone
        blank = alone[whence]
        blank[inner] = False
        out, at = np.where(blank, np.uint32(32), out[whence]), at[whence]
    keep = np.ones(len(out), bool)
    keep[1:] = (out[1:] != 32) | (out[:-1] != 32)
    return out[keep].tobytes().decode("utf-32-le", "surrogatepass"), at[keep]


class Scanner:
    """The automaton over ``items`` (identifier, text) and the scan of one text."""

    def __init__(self, items: list[tuple[Any, str]], min_run: int = MIN_RUN, min_words: int = MIN_WORDS) -> None:
        self.items: list[tuple[Any, str]] = []
        self.min_run = min_run
        size = max(1, (min_run + 1) // 2)
        blocks: dict[str, list[tuple[int, int]]] = {}
        for item_id, text in items:
            norm, _ = normalise(text or "")
            words = norm.split(" ")[1:-1]
            if len(words) < max(1, min_words):
                continue
            at = 0
            for i in range(0, max(1, len(words) - size + 1), size):
                block = " " + " ".join(words[i : i + size]) + " "
                blocks.setdefault(block, []).append((len(self.items), at))
                at += len(block) - 1
            self.items.append((item_id, norm))
        self.automaton = None
        if blocks:
            self.automaton = ahocorasick.Automaton()
            for block, owners in blocks.items():
                self.automaton.add_word(block, (len(block), owners))
            self.automaton.make_automaton()

    def scan(self, text: str | None) -> list[tuple[Any, int, int, int]]:
        """(item, first character, end, words) of each maximal run, in text order."""
        if not text or self.automaton is None:
            return []
        norm, at = normalise(text)
        found: list[tuple[Any, int, int, int]] = []
        done: dict[tuple[int, int], int] = {}
        for end, (length, owners) in self.automaton.iter(norm):
            start = end - length + 1
            for nth, q in owners:
                if done.get((nth, start - q), -1) >= end:
                    continue
                item_id, item = self.items[nth]
                left = len(os.path.commonprefix((norm[max(0, start - q) : start][::-1], item[:q][::-1])))
                right = len(os.path.commonprefix((norm[end + 1 : end + 1 + len(item)], item[q + length :])))
                a, b = start - left, end + 1 + right
                done[nth, start - q] = b - 1
                a += norm[a:b].index(" ")
                b = a + norm[a:b].rindex(" ")
                n_words = norm.count(" ", a, b)
                if n_words >= self.min_run or n_words == item.count(" ") - 1:
                    found.append((item_id, int(at[a + 1]), int(at[b - 1]) + 1, n_words))
        return sorted(found, key=lambda x: x[1:3])


def _blocks(benchmark: DataFrame, item_col: str, text_col: str) -> Iterator[list[tuple[Any, str]]]:
    """The items in lists of at most AUTOMATON_CHARS characters, streamed through the driver one list at a time."""
    block: list[tuple[Any, str]] = []
    size = 0
    for row in benchmark.select(F.col(item_col), F.col(text_col)).where(F.col(text_col).isNotNull()).toLocalIterator():
        if block and size + len(row[1]) > AUTOMATON_CHARS:
            yield block
            block, size = [], 0
        block.append((row[0], row[1]))
        size += len(row[1])
    if block:
        yield block


def _scan(shared, kind: pa.DataType, min_run: int, min_words: int):
    fields = pa.list_(pa.struct([("item_id", kind), *[(name, pa.int32()) for name in _FIELDS[1:]]]))

    def scan(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        scanner = Scanner(shared.value, min_run, min_words)
        for batch in batches:
            yield pa.array([[dict(zip(_FIELDS, hit)) for hit in scanner.scan(t)] for t in batch.to_pylist()], fields)

    return scan


def hits(spark: SparkSession, text: Column, benchmark: DataFrame, item_col: str = "item_id", text_col: str = "text", min_run: int = MIN_RUN, min_words: int = MIN_WORDS) -> Column:
    """An array column of the matches in ``text``.

    The benchmark goes to the workers as one automaton while it has at most
    AUTOMATON_CHARS characters; a larger one is cut into several of that size,
    each scanned in turn, so that no worker ever holds more than one.
    """
    kind = benchmark.schema[item_col].dataType
    hit = f"array<struct<item_id:{kind.simpleString()},start_char:int,end_char:int,n_words:int>>"
    found = None
    for block in _blocks(benchmark, item_col, text_col):
        shared = spark.sparkContext.broadcast(block)
        one = F.arrow_udf(_scan(shared, to_arrow_type(kind), min_run, min_words), hit).asNondeterministic()(text)
        found = one if found is None else F.concat(found, one)
    return found if found is not None else F.array().cast(hit)


def leaks(documents: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One row per run of benchmark words in a document: doc_id, item_id, start_char, end_char, n_words."""
    found = hits(documents.sparkSession, F.col("text_"), benchmark, **options)
    docs = documents.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text_"))
    return docs.select("doc_id", F.explode(found).alias("hit")).select("doc_id", "hit.*")


def drop_leaks(documents: DataFrame, benchmark: DataFrame, text_col: str = "text", **options) -> DataFrame:
    """The documents without a run of benchmark words, with their own columns. A null text stays."""
    (name,) = fresh(documents, "hits")
    found = hits(documents.sparkSession, F.col(text_col), benchmark, **options)
    return documents.withColumn(name, F.size(found)).where(F.col(name) == 0).select(*[F.col(f"`{c}`") for c in documents.columns])
