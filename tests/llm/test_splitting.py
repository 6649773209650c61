import random
import re

from scoria.llm.splitting import Limits, cut, needs_split, split_oversized
from pyspark.sql import functions as F

MARKER = r"^\s*(?:High|Medium|Low|Log|Critical)\s+\d+/\w+|^\s*NVT:"


def count(text):
    return sum(bool(re.search(MARKER, x)) for x in text.split("\n"))


def check(text, limits):
    pieces = cut(text, limits)
    if len(text) <= limits.max_chars and count(text) <= limits.max_markers:
        assert pieces == [(0, len(text))]
        return pieces
    rebuilt, before = "", None
    for a, b in pieces:
        assert b - a <= limits.max_chars and count(text[a:b]) <= limits.max_markers
        if before:
            assert before[0] <= a <= before[1] < b
        rebuilt += text[len(rebuilt) : b]
        before = (a, b)
    assert rebuilt == text and pieces[0][0] == 0
    return pieces


def test_random_texts():
    rng = random.Random(8)
    parts = ["NVT:", "\n", " ", "High 1/tcp", "a", "word ", ". ", "\n\n", "é", "\r\n", "x" * 30]
    for _ in range(1500):
        limits = Limits(MARKER, rng.choice([8, 40, 120]), rng.choice([1, 3]), rng.choice([0, 3, 7]))
        check("".join(rng.choice(parts) for _ in range(rng.randrange(0, 80))), limits)


def test_natural_places_and_overlap():
    limits = Limits(MARKER, 100, 5, 10)
    text = "NVT: a\n" + "One sentence here. Another one follows. " * 2 + "\nNVT: b\n" + "More text is here. " * 4
    pieces = check(text, limits)
    assert text[pieces[0][1] :].startswith("NVT: b") and pieces[1][0] == pieces[0][1] - 10
    long = "One sentence here. " * 20
    for a, b in check(long, limits)[:-1]:
        assert long[:b].endswith(". ")
    assert [b for _, b in check("x" * 250, limits)] == [100, 190, 250]


def test_many_markers():
    limits = Limits(MARKER, 1000, 5, 120)
    pieces = check("NVT: a\n" * 23, limits)
    assert len(pieces) >= 5
    assert len(check("filler text and more of it\nNVT: a long enough name for the overlap to hold few of them, surely that many characters are enough\n" * 11, limits)) > 2


def test_operator(spark):
    limits = Limits(MARKER, 50, 2, 5)
    rows = [("d", 1, None), ("d", 2, ""), ("d", 3, "short"), ("d", 4, "y" * 51), ("d", 4, "y" * 51), ("e", 5, "NVT: a\nNVT: b\n NVT: c"), ("e", 6, "y" * 50), ("e", 7, "Highest 1/t\n(NVT: x)\nNVT: a\nNVT: b"), ("e", 8, "w " * 60000)]
    frame = spark.createDataFrame(rows, "doc_id string, block_id int, text string").withColumn("piece", F.lit("clash"))
    got = split_oversized(frame, limits, ["doc_id", "block_id"]).collect()
    assert {r.block_id for r in got} == {4, 5, 8}
    assert sum(r.block_id == 4 and r.piece_no == 0 for r in got) == 2
    assert all(r.end - r.start == len(r.piece) <= 50 for r in got)
    assert frame.filter(needs_split(F.col("text"), limits)).count() == 4
    assert split_oversized(frame.limit(0), limits, ["doc_id"]).count() == 0
