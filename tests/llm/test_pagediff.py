import os
import random
import tracemalloc

import pytest

from tracewell.llm import pagediff

PAGES = "page_id bigint, url string, html string, lines string, key string, host string"


def _places(a, b):
    """A longest common subsequence from the whole table, found from the end."""
    t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
    i, j, out = len(a), len(b), []
    while i and j:
        if a[i - 1] == b[j - 1]:
            out.append(i - 1)
            i, j = i - 1, j - 1
        elif t[i][j] == t[i][j - 1]:
            j -= 1
        else:
            i -= 1
    return t[-1][-1], out[::-1]


def _is_common(places, a, b):
    rest = iter(b)
    return places == sorted(set(places)) and all(any(y == a[i] for y in rest) for i in places)


def test_common_is_a_longest_common_subsequence():
    rng = random.Random(2)
    for n in (14, 60):
        for _ in range(300):
            a, b = ([rng.randrange(rng.choice((3, 6, 40))) for _ in range(rng.randrange(n))] for _ in range(2))
            places = pagediff.common(a, b)
            assert _is_common(places, a, b) and len(places) == _places(a, b)[0]
    assert len(pagediff.common([1, 2] * 5000, [2, 1] * 5000)) == 9999


@pytest.mark.parametrize("case", ["apart", "shuffled", "few"])
def test_pages_of_many_lines(case):
    rng = random.Random(3)
    n = 50_000
    a, b = {"apart": (range(n), range(n, 2 * n)), "shuffled": (range(n), sorted(range(n), key=lambda k: k // 50 * 50 + rng.random() * 100)), "few": ([rng.randrange(30) for _ in range(n)], [rng.randrange(30) for _ in range(n)])}[case]
    a, b = list(a), list(b)
    tracemalloc.start()
    places = pagediff.common(a, b)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert _is_common(places, a, b) and peak < 50e6
    assert len(places) == 0 if case == "apart" else len(places) > n / 20


def _html(lines):
    return "<html><script>x</script>" + "".join(f"<div>{x}</div>" for x in lines) + "</html>"


def test_pages_equal_brute_force(spark):
    rng = random.Random(11)
    pages = []
    for k in range(160):
        host = f"h{min(2, int(rng.expovariate(1)))}.org"
        lines = [rng.choice(["menu", "foot", "ad"]) if rng.random() < 0.5 else f"own {k} {i}" for i in range(rng.randrange(9))]
        pages.append((k, host, f"/{rng.choice('abc')}/{rng.randrange(40)}", lines))
    frame = spark.createDataFrame([(k, f"http://{h}{p}?q={k}#f", _html(x), "l", "k", "h") for k, h, p, x in pages], PAGES)
    got = {r.page_id: (r.n_lines, r.n_removed, r.text) for r in pagediff.own_text(frame.repartition(6)).collect()}
    for host in {p[1] for p in pages}:
        own = sorted((p for p in pages if p[1] == host), key=lambda p: (p[2], f"http://{host}{p[2]}?q={p[0]}#f"))
        for i, (k, _, path, lines) in enumerate(own):
            like = [len(os.path.commonprefix((path, own[j][2]))) if 0 <= j < len(own) else -1 for j in (i - 1, i + 1)]
            other = own[i + 1] if like[1] > like[0] else own[i - 1] if i else None
            gone = pagediff.common(lines, other[3]) if other else []
            assert len(gone) == (_places(lines, other[3])[0] if other else 0) and (not other or _is_common(gone, lines, other[3]))
            assert got[k] == (len(lines), len(gone), "\n".join(x for i, x in enumerate(lines) if i not in gone))


def test_edge_rows(spark):
    big = _html(f"line {k}" for k in range(5000))
    rows = [(1, None, _html("a"), "l", "k", "h"), (2, "nowhere", _html("a"), "l", "k", "h"), (3, "http://x.org/1", None, "l", "k", "h"), (4, "http://y.org/a/1", big, "l", "k", "h"), (5, "http://y.org/a/2", big + "<p>more", "l", "k", "h"), (None, "http://z.org/", _html("ab"), "l", "k", "h"), (None, "http://z.org/", _html("ab"), "l", "k", "h")]
    frame = spark.createDataFrame(rows, PAGES)
    got = sorted((str(r.page_id), r.host, r.n_lines, r.n_removed, r.text[:9]) for r in pagediff.own_text(frame).collect())
    assert got == [("1", None, 1, 0, "a"), ("2", None, 1, 0, "a"), ("3", "x.org", 0, 0, ""), ("4", "y.org", 5000, 5000, ""), ("5", "y.org", 5001, 5000, "more"), ("None", "z.org", 2, 0, "a\nb"), ("None", "z.org", 2, 0, "a\nb")]
    assert pagediff.own_text(frame.limit(0)).count() == 0
