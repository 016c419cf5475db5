"""Main text of pages: what a page does not share with the page of the nearest URL.

Pages of a host stand in the order of their URLs' paths.  Each is paired with the one
beside it whose path begins alike for longer (the earlier one if both do), the two
pages' text lines are aligned by a longest common subsequence, and the shared lines
are deleted.  Templates, navigation and notices go, what is the page's own stays.

Neighbours are found in range partitions (:mod:`tracewell.plans.sequence`), so one
huge host is many tasks.  Only line hashes travel to a page's partner; lines are
shuffled once, and only those of pages that lose some.  The alignment works on bit
vectors of the length of the partner, after equal beginnings and ends and lines of one
page alone are taken off; of n lines left it holds about the root of n vectors at a time.

Defined results: a page without a host, or alone in its host, keeps all lines; a null
or empty page has no lines and no effect on its partner; rows equal in page_id, url
and html count as one page and each give a row; of pages with equal paths the order
is by URL, page_id and content; where several subsequences are longest the one found
from the end is taken, which prefers late lines of this page; pages of any length are
aligned whole; an empty table gives an empty result; other columns are not looked at.
"""

from __future__ import annotations

import math
import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewell.llm.bloom import may_hold
from tracewell.llm.html import host, html_lines, path
from tracewell.plans.lineage import written
from tracewell.plans.sequence import neighbours


def _masks(where: dict[int, list[int]], size: int):
    """Bit vectors of a line's places; those of lines that stand in many places are kept, no more than the root of ``size`` of them."""
    many, kept = math.isqrt(size) + 1, {}

    def mask(line: int) -> int:
        places = where[line]
        if len(places) == 1:
            return 1 << places[0]
        if (held := kept.get(line)) is None:
            bits = bytearray((places[-1] >> 3) + 1)
            for j in places:
                bits[j >> 3] |= 1 << (j & 7)
            held = int.from_bytes(bits, "little")
            if len(places) >= many:
                kept[line] = held
        return held

    return mask


def common(a: list[int], b: list[int]) -> list[int]:
    """Places in ``a`` of a longest common subsequence with ``b``."""
    head = 0
    while head < min(len(a), len(b)) and a[head] == b[head]:
        head += 1
    tail = 0
    while tail < min(len(a), len(b)) - head and a[-1 - tail] == b[-1 - tail]:
        tail += 1
    both = set(a[head : len(a) - tail]) & set(b[head : len(b) - tail])
    at = [i for i in range(head, len(a) - tail) if a[i] in both]
    lines = [a[i] for i in at]
    where: dict[int, list[int]] = {}
    for j, x in enumerate(x for x in b[head : len(b) - tail] if x in both):
        where.setdefault(x, []).append(j)
    size = sum(map(len, where.values()))
    full, mask = (1 << size) - 1, _masks(where, size)

    def after(now: int, line: int) -> int:
        match = now & mask(line)
        return ((now + match) | (now - match)) & full

    # One vector in front of each block of lines is kept; the way back makes a block's vectors again when it gets there.
    step = math.isqrt(len(lines)) + 1
    fronts, now = [], full
    for i, x in enumerate(lines):
        if i % step == 0:
            fronts.append(now)
        now = after(now, x)
    i, j, block, rows, found = len(lines), size, -1, [full], []
    while i and j:
        if (i - 1) // step != block:
            block = (i - 1) // step
            rows = [fronts[block]]
            for x in lines[block * step : (block + 1) * step]:
                rows.append(after(rows[-1], x))
        k = i - block * step
        if rows[k] >> (j - 1) & 1:
            j -= 1
        elif not rows[k - 1] >> (j - 1) & 1:
            i -= 1
        else:
            i, j = i - 1, j - 1
            found.append(at[i])
    return [*range(head), *found[::-1], *range(len(a) - tail, len(a))]


def _own(pairs: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    for own, other in pairs:
        out = []
        for a, b in zip(own.to_pylist(), other.to_pylist()):
            shared = set(common(a, b)) if a and b else ()
            out.append([i for i in range(len(a or ())) if i not in shared])
        yield pa.array(out, pa.list_(pa.int32()))


def _like(triples: Iterator[tuple[pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    for arrays in triples:
        out = []
        for here, before, after in zip(*[x.to_pylist() for x in arrays]):
            one, two = (len(os.path.commonprefix((here, x))) if x is not None else -1 for x in (before, after))
            out.append(two > one)
        yield pa.array(out, pa.bool_())


def pairs(pages: DataFrame) -> DataFrame:
    """For each distinct page (host, path, url, key, content) the key and content of its partner, null if it has none."""
    beside = neighbours(pages, "host", ["path", "url", "key", "content"], ["path", "key", "content"], "paths")
    later = F.arrow_udf(_like, "boolean")(F.col("path"), F.col("previous.path"), F.col("following.path"))
    chosen = F.when(later, F.col("following")).otherwise(F.col("previous"))
    return beside.withColumn("other", chosen).select("key", "content", F.col("other.key").alias("o_key"), F.col("other.content").alias("o_content"))


def own_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, host, text (the page's own lines), n_lines, n_removed of every page.

    Pages are known by two hashes, of page_id and URL and of the HTML.  Which lines
    stay is settled on line hashes; the lines themselves are extracted again where
    they are needed.
    """
    key, content = F.xxhash64(F.col(id_col), F.col(url_col)), F.coalesce(F.xxhash64(F.col(html_col)), F.lit(0))
    lines = F.coalesce(html_lines(F.col(html_col)), F.array().cast("array<string>"))
    own = pages.select(key.alias("key"), content.alias("content"), F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), lines.alias("lines"))
    narrow = own.select("key", "content", "page_id", "url", F.transform("lines", lambda x: F.xxhash64(x)).alias("hashes"))
    narrow = written(narrow, "page-lines")
    known = narrow.select(host(F.col("url")).alias("host"), path(F.col("url")).alias("path"), "url", "key", "content").where("host is not null").distinct()
    paired = pairs(known).where("o_key is not null")
    hashes = narrow.groupBy("key", "content").agg(F.first("hashes").alias("hashes"))
    others = hashes.select(F.col("key").alias("p_key"), F.col("content").alias("p_content"), F.col("hashes").alias("other"))
    both = paired.join(others, (F.col("o_key") == F.col("p_key")) & (F.col("o_content") == F.col("p_content"))).select(F.col("key").alias("k_key"), F.col("content").alias("k_content"), "other")
    both = hashes.join(both, (F.col("key") == F.col("k_key")) & (F.col("content") == F.col("k_content")))
    stay = both.withColumn("own", F.arrow_udf(_own, "array<int>")(F.col("hashes"), F.col("other")))
    stay = written(stay.where(F.size("own") < F.size("hashes")).select("k_key", "k_content", "own"), "own-lines")
    # Pages that lose nothing stay where they lie; the others' lines are shuffled to their places, at every size alike.
    marked = own.withColumn("touched", may_hold(stay.select(F.xxhash64("k_key", "k_content").alias("mark")), F.array(F.xxhash64("key", "content"))))
    joined = marked.where("touched").join(stay.hint("merge"), (F.col("key") == F.col("k_key")) & (F.col("content") == F.col("k_content")), "left")
    left = F.when(F.col("own").isNull(), F.col("lines")).otherwise(F.transform("own", lambda i: F.get(F.col("lines"), i)))
    columns = ["page_id", "url", "lines", "left"]
    left = joined.withColumn("left", left).select(*columns).unionByName(marked.where("not touched").withColumn("left", F.col("lines")).select(*columns))
    return left.select("page_id", host(F.col("url")).alias("host"), F.array_join("left", "\n").alias("text"), F.size("lines").alias("n_lines"), (F.size("lines") - F.size("left")).alias("n_removed"))
