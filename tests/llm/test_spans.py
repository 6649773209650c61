import random

import numpy as np
from pyspark.sql import functions as F

from scoria.llm import spans


def brute_pairs(docs, n):
    grams: dict = {}
    for i, t in docs:
        for k in range(len(t or "") - n + 1):
            grams.setdefault(t[k : k + n], set()).add(i)
    return {(min(a, b), max(a, b)) for ids in grams.values() for a in ids for b in ids if a != b}


def brute_cover(docs, n):
    grams: dict = {}
    for i, t in docs:
        for k in range(len(t or "") - n + 1):
            grams.setdefault(t[k : k + n], set()).add(i)
    out = {}
    for i, t in docs:
        hit = set()
        for k in range(len(t or "") - n + 1):
            if len(grams[t[k : k + n]]) > 1:
                hit |= set(range(k, k + n))
        if hit:
            out[i] = len(hit)
    return out


def corpus(seed):
    rng = random.Random(seed)
    shared = ["".join(rng.choice("abcdef .é😀") for _ in range(rng.randrange(25, 60))) for _ in range(6)]
    docs = []
    for i in range(120):
        parts = []
        for _ in range(rng.randrange(0, 4)):
            s = rng.choice(shared)
            a = rng.randrange(0, 20)
            parts += ["".join(rng.choice("ghijk ") for _ in range(rng.randrange(0, 40))), s[a : a + rng.randrange(10, 60)]]
        docs.append((i, "".join(parts)))
    docs += [(200, "x" * 90), (201, "y" + "x" * 35), (202, "ab" * 40), (203, "ba" * 17), (204, docs[0][1]), (205, docs[0][1]), (206, None), (207, ""), (208, "short")]
    return docs


def test_windows_hold_every_run():
    rng = np.random.default_rng(3)
    texts = ["".join(rng.choice(list("ab"), 200)), "c" * 90, "tiny", "".join(rng.choice(list("abcdefgh"), 333))]
    number, sig, c, first, last = spans.compact_windows(texts, 40, 12)
    for k, t in enumerate(texts):
        mine = [(int(f), int(x)) for n, f, x in zip(number, first, last) if n == k]
        covered = sorted(i for f, x in mine for i in range(f, x + 1))
        assert covered == list(range(max(0, len(t) - 40 + 1)))
        for n, f, x, p in zip(number, first, last, c):
            if n == k:
                assert x <= p <= f + 40 - 12


def test_pairs_and_parts_against_brute_force(spark):
    for seed in (1, 2):
        docs = corpus(seed)
        frame = spark.createDataFrame(docs, "doc_id bigint, text string").withColumns({"key": F.lit("clash"), "sig": F.lit(1)})
        got = [(r.doc_id_a, r.doc_id_b) for r in spans.shared_pairs(frame, 30, gram=10).collect()]
        assert len(got) == len(set(got)) and set(got) == brute_pairs(docs, 30)
        parts = {r.doc_id: r.shared_chars for r in spans.shared_parts(frame, 30, gram=10).collect()}
        assert parts == brute_cover(docs, 30)


def test_repeating_texts_against_brute_force(spark):
    rng = random.Random(11)
    for seed in range(3):
        docs = []
        for i in range(60):
            unit = rng.choice(["-", "ab", "abc", "=-=", "xyzw", "0123456789"])
            docs.append((i, rng.choice(["", "q", "head ", "qq"]) + (unit * 80)[rng.randrange(len(unit)) :][: rng.randrange(20, 75)] + rng.choice(["", "w", " tail", "ww"]) + (unit * 9)[: rng.randrange(40)]))
        frame = spark.createDataFrame(docs, "doc_id bigint, text string")
        got = {(r.doc_id_a, r.doc_id_b) for r in spans.shared_pairs(frame, 30, gram=8 + 4 * seed).collect()}
        assert got == brute_pairs(docs, 30)


def tailed(seed, n=150):
    """A repeating part of under n characters and a tail, with different text before and after; long and broken parts too."""
    rng = random.Random(seed)
    units = ["-", "=-", "- ", "word ", "1 | ok | -\n", "abcdefghijklmnopqrstuvwxyz0123456789" * 2]
    tails = ["".join(rng.choice("pqrstu ") for _ in range(70)) for _ in range(2)]
    docs = []
    for i in range(90):
        unit = rng.choice(units)
        part = (unit * 400)[rng.randrange(len(unit)) :][: rng.choice([rng.randrange(60, n + 20), rng.randrange(80, n), rng.randrange(n, 330)])]
        tail = rng.choice(tails)[: rng.choice([0, rng.randrange(5, 71)])]
        other = (rng.choice(units) * 300)[: rng.randrange(200)]
        docs.append((i, "".join(rng.choice("ABCDEF") for _ in range(rng.randrange(9))) + part + tail + "".join(rng.choice("GHIJKL") for _ in range(rng.choice([1, 9, 90]))) + rng.choice(["", other])))
    return docs


def local_pairs(docs, n, gram):
    """shared_pairs over a handful of texts, without Spark."""
    names, texts = zip(*docs)
    windows: dict = {}
    for k, sig, c, first, last, gap in zip(*spans.chains(*spans.compact_windows(list(texts), n, gram), gram)):
        windows.setdefault(int(sig), []).append((int(k), int(c), int(first - c), int(last - c), int(gap)))
    places: dict = {}
    for group in windows.values():
        for i, c, f, t, g in group:
            for j, d, e, u, h in group:
                if i < j and f <= u and e <= t:
                    places.setdefault((i, j), []).append({"at": c, "shift": d - c, "gap_a": g, "gap_b": h})
    return {(names[i], names[j]) for (i, j), p in places.items() if next(spans.shared_runs(texts[i], texts[j], p, n, gram), None)}


def test_tails_of_repeating_parts():
    for seed in range(12):
        docs = tailed(seed)
        assert local_pairs(docs, 150, 80) == brute_pairs(docs, 150)
        assert local_pairs(docs, 60, 32) == brute_pairs(docs, 60)


def test_tails_of_short_rows(spark):
    rng = random.Random(1)
    tail = "the section ends with this tail of seventy characters, as all of them.."
    for unit in ("12 | ok |\n", "-", "word "):
        docs = []
        for n in (5, 20, 45, 70):
            for _ in range(24):
                line = (unit * 300)[-rng.choice([rng.randrange(80, 150), rng.randrange(150 - n, 150), 300]) :]
                docs.append((len(docs), "".join(rng.choice("ABCDEF") for _ in range(rng.randrange(9))) + line + tail[:n] + "".join(rng.choice("GHIJKL") for _ in range(90))))
        frame = spark.createDataFrame(docs, "doc_id bigint, text string")
        got = [(r.doc_id_a, r.doc_id_b) for r in spans.shared_pairs(frame, 150).collect()]
        assert len(got) == len(set(got)) and set(got) == brute_pairs(docs, 150)


def test_long_and_empty(spark):
    rng = random.Random(5)
    long = "".join(rng.choice("abcdefghij ") for _ in range(60000))
    docs = [(1, long), (2, "q" * 500 + long[1000:1200]), (3, long[5000:5149]), (4, "z" * 20000), (5, "z" * 150)]
    frame = spark.createDataFrame(docs, "doc_id bigint, text string")
    assert {(r.doc_id_a, r.doc_id_b) for r in spans.shared_pairs(frame, 150).collect()} == {(1, 2), (4, 5)}
    assert spans.shared_pairs(frame.limit(0), 150).count() == 0 and spans.shared_parts(frame.limit(0), 150).count() == 0


def test_common_run():
    assert spans.common_run("xxabcyy", "abcz", -2, 3) == (2, 5)
    assert spans.common_run("a" * 300, "a" * 200, 0, 150) == (0, 200)
    assert spans.common_run("ab", "cd", 0, 0) == (0, 0)


def test_ruled_lines_and_what_follows():
    """Over 10,000 pairs of ruled lines, each followed by shared text and then by other text, at the shipped sizes."""
    rng = random.Random(21)
    pairs = 0
    for unit in ("-", "=", "-=", "_ ", "* * ", "~-~"):
        for after in (0, 1, 9, 300):
            tails = ["".join(rng.choice("abc ") for _ in range(12)) for _ in range(2)]
            docs = []
            for i in range(40):
                size = rng.randrange(140, 150) if i % 2 else rng.randrange(150, 500)
                docs.append((i, (unit * 500)[:size] + rng.choice(tails)[: rng.randrange(13)] + "".join(rng.choice("defgh") for _ in range(after))))
            want = brute_pairs(docs, 150)
            assert local_pairs(docs, 150, 80) == want
            pairs += 40 * 39 // 2
    assert pairs > 10_000
    # a run that holds the end of a ruled line, where inner windows are the ones that meet
    docs = [(1, "d--------------cc"), (2, "a--" * 12 + "-" * 46 + "cbb")]
    assert local_pairs(docs, 15, 8) == brute_pairs(docs, 15) == {(1, 2)}


def test_very_common_passages(spark, monkeypatch):
    """Signatures with very many windows are joined in pieces, with the same result; so are texts worked on one by one."""
    rng = random.Random(8)
    docs = [(i, "".join(rng.choice("ghijk ") for _ in range(rng.randrange(60))) + "the same passage in all of them, of some length" + str(i % 7) * 3) for i in range(120)]
    frame = spark.createDataFrame(docs, "doc_id bigint, text string")
    monkeypatch.setattr(spans, "HOT_WINDOWS", 5)
    monkeypatch.setattr(spans, "BLOCK", 50)
    got = [(r.doc_id_a, r.doc_id_b) for r in spans.shared_pairs(frame, 30, gram=10).collect()]
    assert len(got) == len(set(got)) and set(got) == brute_pairs(docs, 30)
    assert {r.doc_id: r.shared_chars for r in spans.shared_parts(frame, 30, gram=10).collect()} == brute_cover(docs, 30)


def test_odd_input(spark):
    schema = "doc_id bigint, text string, a string, places int, lo_a int"
    texts = ["\t" * 200, " " * 200, "😀".encode("utf-16", "surrogatepass").decode("utf-16") * 200, None, "", "x"]
    frame = spark.createDataFrame([(i, t, "k", 1, 2) for i, t in enumerate(texts * 2)], schema)
    assert {(r.doc_id_a, r.doc_id_b) for r in spans.shared_pairs(frame, 150).collect()} == {(0, 6), (1, 7), (2, 8)}
    assert {(r.doc_id, r.shared_part) for r in spans.shared_parts(frame, 150).collect()} == {(i, 1.0) for i in (0, 1, 2, 6, 7, 8)}
