"""License notices found by MinHash bands over overlapping windows, verified by shingle containment.

Texts and templates become shingles of ``SHINGLE`` words.  Templates of up to 9, up
to 17 and more words are looked for in windows of 16, 32 and 64 words that overlap
by half, so each template of the first two kinds, wherever it stands, lies whole in
some window; longer ones are cut into such windows themselves.  A window and the
template it holds have a Jaccard similarity of at least 3 / 14, so with ``BANDS`` = 40
bands of one minimum each they meet in a band with a probability above 0.9999
(:func:`collision_probability`).  A meeting window is verified: the share of the
template's shingles that stand within a template's length of the window must be
at least ``MIN_CONTAINMENT``.

A window without any shingle of any template cannot meet a template in a band, so
signatures are only made for windows that have one; that drops no match.

Defined results: one row per document and license, with the best containment and
the first place that has it, from the first to the last of the template's shingles
thereabouts, in characters of the original text; a null, empty or
short text has no row, and a template of fewer than SHINGLE words has no shingle and is
never found; repeated rows each give their rows; null ids pass; texts are
scanned whole at any length, memory following the slice; an empty table gives an
empty result; other columns are not looked at.  Templates are given as a dictionary
that the driver broadcasts; they are the caller's, not the corpus's.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.llm.notices import NOTICES
from tracewell.llm.wordhash import U, mix, per_text, raw, texts_in_slices, tokens

SHINGLE = 3
BANDS = 40
MIN_CONTAINMENT = 0.8
#: Greatest number of words of a template, and the words of the windows it is looked for in.
WINDOWS = ((9, 16), (17, 32), (1 << 62, 64))

_SEEDS = mix(np.arange(1, BANDS + 1, dtype=np.uint64) * U(0x9E3779B97F4A7C15))
_FILTER_BITS = 22
_HIT = "array<struct<license_id:string,containment:double,start_char:int,end_char:int>>"
_HIT_ARROW = pa.list_(pa.struct([("license_id", pa.string()), ("containment", pa.float64()), ("start_char", pa.int32()), ("end_char", pa.int32())]))


def collision_probability(jaccard: float, bands: int = BANDS) -> float:
    """The chance that sets of this similarity share a band of one minimum."""
    return 1 - (1 - jaccard) ** bands


def shingles(words: np.ndarray) -> np.ndarray:
    """The hash of each run of SHINGLE words."""
    n = max(0, len(words) - SHINGLE + 1)
    out = np.zeros(n, np.uint64)
    for i in range(SHINGLE):
        out = mix(out * U(0x9E3779B97F4A7C15) + words[i : i + n])
    return out


def _minima(rows: np.ndarray) -> np.ndarray:
    """(windows, BANDS) minima of rows of shingles; the greatest value stands for none."""
    none = rows == U(2**64 - 1)
    out = np.empty((len(rows), BANDS), np.uint64)
    for k in range(BANDS):
        mixed = mix(rows ^ _SEEDS[k])
        mixed[none] = U(2**64 - 1)
        out[:, k] = mixed.min(1)
    return out


def _keys(minima: np.ndarray, kind: int) -> np.ndarray:
    return mix(minima + _SEEDS * U(2 * kind + 3))


class Index:
    """The templates' shingles and band keys."""

    def __init__(self, templates: dict[str, str], min_containment: float = MIN_CONTAINMENT) -> None:
        self.names = sorted(templates)
        self.min_containment = min_containment
        self.sets: list[np.ndarray] = []
        self.words: list[int] = []
        keys, owners = [], []
        for nth, name in enumerate(self.names):
            body, offsets = raw(pa.array([templates[name]]))
            words = tokens(body, offsets)[2]
            sh = shingles(words)
            self.words.append(len(words))
            self.sets.append(np.unique(sh))
            kind = next(k for k, (most, _) in enumerate(WINDOWS) if len(words) <= most)
            size = WINDOWS[kind][1] - SHINGLE + 1
            for at in range(0, max(1, len(sh) - size // 2), WINDOWS[kind][1] // 2):
                part = sh[at : at + size]
                if len(part):
                    keys.append(_keys(_minima(part[None, :]), kind)[0])
                    owners.append(np.full(BANDS, nth))
        every = np.concatenate(keys) if keys else np.zeros(0, np.uint64)
        owner = np.concatenate(owners) if owners else np.zeros(0, np.int64)
        order = np.argsort(every, kind="stable")
        self.keys, self.owner = every[order], owner[order]
        self.shingles = np.unique(np.concatenate(self.sets)) if self.sets else np.zeros(0, np.uint64)
        self.filter = np.zeros(1 << _FILTER_BITS, bool)
        self.filter[self.shingles >> U(64 - _FILTER_BITS)] = True

    def _known(self, sh: np.ndarray) -> np.ndarray:
        """Where the templates' shingles stand."""
        at = np.flatnonzero(self.filter[sh >> U(64 - _FILTER_BITS)])
        return at[np.isin(sh[at], self.shingles)] if len(at) else at

    def candidates(self, sh: np.ndarray, known: np.ndarray) -> set[tuple[int, int, int]]:
        """(kind, window, template) that share a band."""
        out: set[tuple[int, int, int]] = set()
        for kind, (_, words) in enumerate(WINDOWS):
            step, size = words // 2, words - SHINGLE + 1
            last = known // step
            first = np.maximum(0, -((size - 1 - known) // step))
            windows = np.unique(np.concatenate([np.minimum(first + i, last) for i in range(words // step + 1)]))
            for a in range(0, len(windows), 4096):
                some = windows[a : a + 4096]
                place = some[:, None] * step + np.arange(size)
                rows = np.where(place < len(sh), sh[np.minimum(place, len(sh) - 1)], U(2**64 - 1))
                keys = _keys(_minima(rows), kind)
                low, high = np.searchsorted(self.keys, keys, "left"), np.searchsorted(self.keys, keys, "right")
                for w, b in zip(*np.nonzero(high > low)):
                    out.update((kind, int(some[w]), int(t)) for t in self.owner[low[w, b] : high[w, b]])
        return out

    def verify(self, sh: np.ndarray, kind: int, window: int, template: int) -> tuple[float, int, int]:
        """Containment of the template in the window's surroundings, and the shingles between which it lies."""
        words = WINDOWS[kind][1]
        a = max(0, window * (words // 2) - self.words[template])
        region = sh[a : window * (words // 2) + words + self.words[template]]
        own = self.sets[template]
        inside = np.flatnonzero(np.isin(region, own))
        share = len(np.unique(region[inside])) / len(own) if len(own) else 0.0
        return (share, a + int(inside[0]), a + int(inside[-1])) if len(inside) else (0.0, 0, 0)

    def best(self, sh: np.ndarray, found: set[tuple[int, int, int]]) -> list[tuple[int, float, int, int]]:
        """(template, containment, first and last shingle) of the templates that pass."""
        best: dict[int, tuple[float, int, int]] = {}
        for kind, window, template in sorted(found, key=lambda x: (x[2], x[1])):
            now = self.verify(sh, kind, window, template)
            if now[0] >= self.min_containment and (template not in best or now[0] > best[template][0]):
                best[template] = now
        return [(t, *x) for t, x in sorted(best.items())]

    def scan(self, arr: pa.Array) -> list[list[dict]]:
        """The matches in each text."""
        body, offsets = raw(arr)
        starts, ends, words = tokens(body, offsets)
        first = per_text(starts, offsets)
        every = shingles(words)
        known = self._known(every)
        out: list[list[dict]] = [[] for _ in range(len(arr))]
        owner = np.searchsorted(first, known, "right") - 1
        for t in np.unique(owner):
            a, b = int(first[t]), int(first[t + 1])
            sh = every[a : max(a, b - SHINGLE + 1)]
            mine = known[owner == t] - a
            mine = mine[mine < len(sh)]
            if not len(mine):
                continue
            for template, share, low, high in self.best(sh, self.candidates(sh, mine)):
                base = int(offsets[t])
                places = [int(np.count_nonzero((body[base:x] & 0xC0) != 0x80)) for x in (starts[a + low], ends[a + high + SHINGLE - 1])]
                out[t].append({"license_id": self.names[template], "containment": share, "start_char": places[0], "end_char": places[1]})
        return out


def _scan(shared, min_containment: float):
    def scan(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        index = Index(shared.value, min_containment)
        for batch in batches:
            found = [x for a, b in texts_in_slices(batch) for x in index.scan(batch.slice(a, b - a))]
            yield pa.array(found, _HIT_ARROW)

    return scan


def notices(spark: SparkSession, text: Column, templates: dict[str, str] = NOTICES, min_containment: float = MIN_CONTAINMENT) -> Column:
    """An array column of the license notices in ``text``."""
    return F.arrow_udf(_scan(spark.sparkContext.broadcast(templates), min_containment), _HIT).asNondeterministic()(text)


def license_notices(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """doc_id, license_id, containment, start_char, end_char. No shuffle."""
    found = notices(documents.sparkSession, F.col("text_"), **options)
    docs = documents.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text_"))
    return docs.select("doc_id", F.explode(found).alias("hit")).select("doc_id", "hit.*")
