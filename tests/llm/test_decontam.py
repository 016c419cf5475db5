import random

from tracewell.llm import decontam

DOCS = "doc_id bigint, text string, hits string, item_id string"


def _words(seed, n):
    rng = random.Random(seed)
    return [rng.choice("alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu".split()) + str(rng.randrange(40)) for _ in range(n)]


def _brute(text, items, min_run=decontam.MIN_RUN):
    """Every maximal common run of words of at least ``min_run``, or a whole item."""
    found = set()
    words = decontam.normalise(text)[0].split()
    for item_id, item in items:
        own = decontam.normalise(item or "")[0].split()
        for i in range(len(words)):
            for j in range(len(own)):
                if words[i] != own[j] or (i and j and words[i - 1] == own[j - 1]):
                    continue
                n = 0
                while i + n < len(words) and j + n < len(own) and words[i + n] == own[j + n]:
                    n += 1
                if n >= min_run or n == len(own):
                    found.add((item_id, n, i))
    return found


def test_matches_equal_brute_force():
    items = [(k, " ".join(_words(k, 8 + 7 * k))) for k in range(6)] + [(9, None), (10, "too short"), (11, "")]
    rng = random.Random(1)
    for min_run in (decontam.MIN_RUN, 8, 3, 2, 1, 40):
        scanner = decontam.Scanner(items, min_run)
        for _ in range(30):
            own = rng.choice(items[:6])[1].split()
            a = rng.randrange(len(own))
            text = " ".join(_words(rng.random(), 30) + own[a : a + rng.randrange(30)] + _words(rng.random(), 10))
            got = {(i, n, len(decontam.normalise(text[:s])[0].split())) for i, s, e, n in scanner.scan(text)}
            assert got == _brute(text, items, min_run)


def test_short_items_are_found_whole():
    items = [(1, "Paris is nice"), (2, "42"), (3, "blue whale")]
    hits = decontam.Scanner(items).scan("They say: paris, is NICE! The blue whales are not; 421 no, 42 yes.")
    assert [(i, n) for i, _, _, n in hits] == [(1, 3), (2, 1)]
    assert decontam.Scanner(items, min_words=3).scan("42 blue whale") == []


def test_forms_of_any_length_and_plane():
    for one, other in (("\ufdfa", "صلى الله عليه وسلم"), ("\U0002f800", "丽"), ("a\U000e0101b", "ab"), ("ﬃ", "FFI"), ("\U0001d400", "a")):
        assert decontam.normalise(one)[0] == decontam.normalise(other)[0]
    text, at = decontam.normalise("x\ufdfay \U0010ffff z")
    assert len(text) == len(at) and text[0] == text[-1] == " " and at[0] == -1 and at[-1] == 7


def test_offsets_point_into_the_original():
    item = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen"
    text = "Ä😀 intro; ONE, two -- three\nfour FÍVE six seven eight nine ten; eleven twelve thirteen fourteen!!! end"
    ((item_id, start, end, n),) = decontam.Scanner([(3, item)]).scan(text)
    assert (item_id, n) == (3, 14)
    assert text[start:end].startswith("ONE") and text[start:end].endswith("fourteen")


def test_scripts_without_blanks_are_searched():
    items = [(1, "中华人民共和国的首都是哪座城市？"), (2, "日本で一番高い山は何ですか。名前を答えよ"), (3, "ประเทศไทยมีกี่จังหวัด"), (4, "𠀀𠀁𠀂𠀃𠀄"), (5, "山")]
    scanner = decontam.Scanner(items)
    for item_id, item in items[:4]:
        body = item.rstrip("？")
        text = f"Q1 你好{body}呢 the end"
        ((found, start, end, n),) = [hit for hit in scanner.scan(text) if hit[0] != 5]
        assert found == item_id and text[start:end].rstrip("\u0e31") == body.rstrip("\u0e31") and n >= 5
    assert [hit[0] for hit in scanner.scan("中华人民共和国 山 plain words")] == [5]


def test_edge_rows(spark):
    item = " ".join(_words(5, 20))
    docs = spark.createDataFrame([(1, None, "h", "i"), (2, "", "h", "i"), (3, item, "h", "i"), (3, item, "h", "i"), (None, "x " * 50_000 + item, "h", "i"), (4, "clean", "h", "i")], DOCS)
    bench = spark.createDataFrame([(7, item), (8, item), (9, None)], "item_id bigint, text string")
    rows = decontam.leaks(docs, bench).collect()
    assert sorted((str(r.doc_id), r.item_id) for r in rows) == [("3", 7), ("3", 7), ("3", 8), ("3", 8), ("None", 7), ("None", 8)]
    kept = decontam.drop_leaks(docs, bench)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [1, 2, 4]
    assert decontam.leaks(docs.limit(0), bench).count() == 0 and decontam.leaks(docs, bench.limit(0)).count() == 0


def test_ids_of_any_type(spark):
    item = " ".join(_words(5, 20))
    docs = spark.createDataFrame([("d1", item), (None, item)], "doc_id string, text string")
    bench = spark.createDataFrame([("q1", item), (None, item)], "item_id string, text string")
    assert sorted((str(r.doc_id), str(r.item_id)) for r in decontam.leaks(docs, bench).collect()) == [("None", "None"), ("None", "q1"), ("d1", "None"), ("d1", "q1")]
    assert decontam.drop_leaks(docs, bench).count() == 0
