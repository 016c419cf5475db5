import random

import numpy as np
import pyarrow as pa

from tracewell.llm import licenses
from tracewell.llm.notices import NOTICES
from tracewell.llm.wordhash import raw, tokens

DOCS = "doc_id bigint, text string, license_id string, hit string"


def _filler(rng, n):
    return " ".join(rng.choice("lorem ipsum dolor sit amet license software rights under the of work".split()) for _ in range(n))


def _brute(index, text):
    """Verify every template in every window."""
    body, offsets = raw(pa.array([text]))
    sh = licenses.shingles(tokens(body, offsets)[2])
    found = set()
    for t in range(len(index.names)):
        kind = next(k for k, (most, _) in enumerate(licenses.WINDOWS) if index.words[t] <= most)
        found |= {(kind, w, t) for w in range(len(sh) // (licenses.WINDOWS[kind][1] // 2) + 1)}
    return {index.names[t] for t, *_ in index.best(sh, found)} if len(sh) else set()


def test_recall_against_brute_force():
    rng = random.Random(5)
    index = licenses.Index(NOTICES)
    texts = []
    for _ in range(150):
        words = rng.choice(list(NOTICES.values())).split()
        for _ in range(rng.randrange(3) if len(words) > 40 else 0):
            words[rng.randrange(len(words))] = "changed"
        texts.append(_filler(rng, rng.randrange(200)) + " " + " ".join(words) + " " + _filler(rng, rng.randrange(200)))
    got = [{x["license_id"] for x in found} for found in index.scan(pa.array(texts))]
    want = [_brute(index, t) for t in texts]
    assert sum(len(w) for w in want) >= 140
    assert all(g <= w for g, w in zip(got, want))
    assert sum(len(g & w) for g, w in zip(got, want)) >= 0.99 * sum(len(w) for w in want)


def test_templates_find_themselves_and_their_place():
    index = licenses.Index(NOTICES)
    for name, notice in NOTICES.items():
        text = "é intro words here: " + notice + " zzz yyy xxx"
        hit = next(x for x in index.scan(pa.array([text]))[0] if x["license_id"] == name)
        assert hit["containment"] == 1.0
        assert text[hit["start_char"] : hit["end_char"]].lower().rstrip(".)/") == notice.lower().rstrip(".)/")


def test_bands_meet_with_high_probability():
    assert licenses.collision_probability(3 / 14) > 0.9999
    rng = np.random.default_rng(1)
    met = 0
    for _ in range(300):
        own = rng.integers(0, 2**63, 3).astype(np.uint64)
        rows = np.stack([np.concatenate([own, rng.integers(0, 2**63, n).astype(np.uint64)]) for n in (11, 11)])
        minima = licenses._minima(rows)
        met += bool((minima[0] == minima[1]).any())
    assert met >= 290  # two windows that share 3 of 25 shingles


def test_edge_rows(spark):
    notice = NOTICES["mit-released"]
    rows = [(1, None, "l", "h"), (2, "", "l", "h"), (3, "two words", "l", "h"), (4, notice, "l", "h"), (4, notice, "l", "h"), (None, "pad " * 300_000 + notice, "l", "h"), (5, f"{notice} {notice}", "l", "h"), (6, "Released under another license", "l", "h")]
    frame = spark.createDataFrame(rows, DOCS)
    got = sorted((str(r.doc_id), r.license_id) for r in licenses.license_notices(frame).collect())
    assert got == [("4", "mit-released"), ("4", "mit-released"), ("5", "mit-released"), ("None", "mit-released")]
    assert licenses.license_notices(frame.limit(0)).count() == 0
    assert licenses.license_notices(frame, templates={}).count() == 0
    assert licenses.license_notices(frame, templates={"none": "", "short": "one two"}).count() == 0
