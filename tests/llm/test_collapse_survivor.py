import json
import random
import unicodedata

from pyspark.sql import functions as F

from scoria.llm import collapse, survivor
from scoria.llm.canonical import canonical_words


def words(value):
    """Brute force, character by character."""
    text = "" if value is None else str(value)
    out, current = [], ""
    for i, ch in enumerate(text):
        kind = unicodedata.category(ch)
        inner = kind[0] == "P" and 0 < i < len(text) - 1 and unicodedata.category(text[i - 1]) == "Nd" and unicodedata.category(text[i + 1]) == "Nd"
        if (kind[0] in "ZP" or ch in "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f\x85") and not inner:
            out.append(current)
            current = ""
        else:
            current += ch
    return tuple(w.upper().lower() for w in [*out, current] if w)


ALPHABET = ["a", "B", "é", "É", "ß", "1", "2", ".", "-", ",", "<", "=", " ", " ", " ", "\t", "\n", "\x1f", "\x85", "•", "“", "_", "٣", "word", "10.2.3", "̈"]


def test_words_against_brute_force(spark):
    rng = random.Random(1)
    texts = ["".join(rng.choice(ALPHABET) for _ in range(rng.randrange(0, 14))) for _ in range(3000)] + [None, "", "...", "ΑΣ ας", "x" * 50000]
    got = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", canonical_words(F.col("t")).alias("w")).collect()
    for r in got:
        assert tuple(r.w.split()) == tuple(words(texts[r.i])), texts[r.i]


def raw_rows():
    rows = [
        (5, '{"Name": "A b 1.2", "port": 443, "protocol": "tcp"}'),
        (2, '{"port":"443 ","NAME":"a  (B) 1.2","Protocol":"TCP."}'),
        (9, '{"Name": "a b 1 2", "port": 443, "protocol": "tcp"}'),
        (7, '{"Name": "A b 1.2", "port": 443, "protocol": "tcp"}'),
        (1, '{"Name": "x", "port": null}'),
        (3, '{"Name": "X", "port": " ", "protocol": ""}'),
        (4, None),
        (6, "{}"),
        (8, "broken ["),
        (10, "broken ["),
        (11, "broken  ["),
    ]
    return rows


def test_collapse(spark):
    frame = spark.createDataFrame([(*r, "k") for r in raw_rows()], "raw_id bigint, raw string, key string")
    got = {(r.group_first, r.id) for r in collapse.formatting_duplicates(frame).collect()}
    assert got == {(2, 5), (2, 7), (1, 3), (4, 6), (8, 10)}
    _, groups = collapse.collapse_formatting(frame)
    assert {(r.group_first, r.group_copies) for r in groups.collect()} == {(2, 3), (9, 1), (1, 2), (4, 2), (8, 2), (11, 1)}
    assert collapse.formatting_duplicates(frame.limit(0)).count() == 0


def test_collapse_with_hot_copies(spark):
    hot = '{"Name": "hot", "port": 1, "protocol": "t"}'
    rows = [(i, hot if i % 3 else json.dumps({"name": f"n{i // 6}", "port": str(i // 6)})) for i in range(3000)]
    got = {r.id: r.group_first for r in collapse.formatting_duplicates(spark.createDataFrame(rows, "raw_id bigint, raw string")).collect()}
    first: dict = {}
    want = {}
    for i, raw in rows:
        o = {k.lower(): v for k, v in json.loads(raw).items()}
        key = tuple(words(o.get(k)) for k in ("name", "port", "protocol"))
        if key in first:
            want[i] = first[key]
        first.setdefault(key, i)
    assert got == want


SCHEMA = "seq bigint, run_id string, Name string, port string, protocol string, description array<string>, severity string, instances array<struct<instance:string>>, extracted_at int, members string"


def brute(rows):
    groups: dict = {}
    for r in rows:
        groups.setdefault((r[1], tuple(words(x) for x in r[2:5])), []).append(r)
    out = set()
    for g in groups.values():
        if len(g) < 2:
            continue
        first = min(r[0] for r in g)

        def best(score, g=g):
            top = min(g, key=lambda r: (-score(r), r[8] is None, -(r[8] or 0), r[0]))
            return top[0] if score(top) > 0 else None

        scores = {
            "description": lambda r: sum(len("".join(x.split())) for x in (r[5] or []) if x),
            "severity": lambda r: int((r[6] or "").strip().upper() in survivor.SEVERITIES),
            "instances": lambda r: len(r[7] or []),
        }
        for f, score in scores.items():
            if (b := best(score)) is not None:
                out.add((first, f, b))
    return out


def test_survivors_against_brute_force(spark):
    rng = random.Random(2)
    rows = []
    for i in range(800):
        name = rng.choice(["hot", "HOT ", "Hot.", "b", None, "c d", "c-d"]) if rng.random() < 0.9 else f"n{i}"
        rows.append((i, rng.choice(["r1", "r1", "r2", None]), name, rng.choice(["1", None, ""]), "tcp", rng.choice([None, [], [" "], ["ab", None, "c"], ["a b\tc"], ["abcd" * rng.randrange(3)]]), rng.choice([None, "", "n/a", " high\n", "LOG", "Info"]), rng.choice([None, [], [("u",)], [("u",), ("v",)]]), rng.choice([None, 1, 2, 3]), "clash"))
    frame = spark.createDataFrame(rows, SCHEMA)
    ranked = survivor.duplicate_findings(frame)
    assert {(r.first_id, r.field, r.best_id) for r in survivor.best_fields(ranked).collect()} == brute(rows)
    assert survivor.best_fields(survivor.duplicate_findings(frame.limit(0))).count() == 0


def test_surviving_records(spark):
    rows = [(1, "r", "a", "1", "t", ["x"], None, None, 1), (2, "r", "A", "1", "t", ["xyz"], "high", None, 2), (3, "r", "a.", "1", "t", None, "bad", [("u",)], 3), (4, "r", "other", "1", "t", ["q"], "LOW", None, 1)]
    frame = spark.createDataFrame(rows, SCHEMA.replace(", members string", ""))
    got = survivor.surviving_records(frame, survivor.duplicate_findings(frame)).collect()
    assert [(r.seq, r.description, r.severity, [i.instance for i in r.instances], r.members) for r in got] == [(1, ["xyz"], "high", ["u"], 3)]
    clash = frame.withColumn("members", F.lit("own"))
    got = survivor.surviving_records(clash, survivor.duplicate_findings(clash)).collect()
    assert [(r.seq, r.members, r.group_members) for r in got] == [(1, "own", 3)]
    assert survivor.surviving_records(frame.limit(0), survivor.duplicate_findings(frame.limit(0))).count() == 0


def test_trusted_sources(spark):
    rows = [(1, "r", "a", "1", "t", ["x"], "low", None, 9, "B"), (2, "r", "a", "1", "t", ["y"], "high", None, 1, "A"), (3, "r", "a", "1", "t", ["z"], None, None, 5, None)]
    frame = spark.createDataFrame(rows, SCHEMA.replace("members", "source"))
    group = [F.col("run_id")]
    assert [(r.best_description, r.best_severity) for r in survivor.rank_fields(frame, group).collect()] == [(1, 1)]
    assert [(r.best_description, r.best_severity) for r in survivor.rank_fields(frame, group, trust={"A": 2, "B": 1}).collect()] == [(2, 2)]
