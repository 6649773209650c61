import json
import random

import pytest
from pyspark.sql import functions as F

from scoria.operators import consolidate as c
from scoria.operators import datasets, evaluate, extract, linkage, validate
from scoria.plans import records as plans
from scoria.profiles import PROFILES, load_model, load_profile, with_environment


@pytest.mark.parametrize(
    ("raw", "n"),
    [
        ('[{"Name": "a"}]', 1),
        ('{"vulnerabilities": [{"Name": "a"}, {"Name": "b"}]}', 2),
        ('{"vulnerabilities": 3}', 0),
        ('{"status": 1, "items": [{"Name": "a"}]}', 1),
        ('{"items": []}', 0),
        ('Here it is: [{"Name": "a"}] done', 1),
        ('```json\n[{"Name": "a"}]\n```', 1),
        ('[{"Name": "a"', 0),
        ("[]", 0),
        ("no", 0),
        (None, 0),
    ],
)
def test_recover_json(raw, n):
    assert len(extract.recover_json(raw)) == n


def test_validate_answer(spark):
    rows = [('[{"Name": "a"}]', "text"), ('[{"Name": ', "text"), (None, None), ("[1]", "w " * 3000)]
    got = extract.validate_answer(spark.createDataFrame(rows, "raw string, text string"), 4096).collect()
    assert [r.json_valid for r in got] == [True, False, False, True]
    assert [r.needs_redivision for r in got] == [False, True, True, True]
    assert "unbalanced brackets" in got[1].errors and "unbalanced braces" in got[1].errors


def test_records_of_coerces(spark):
    items = json.dumps([{"Name": "a", "description": "one", "port": 443, "references": ["r"]}, 7, {"Name": "b", "port": None}])
    got = extract.records_of(spark.createDataFrame([("d", 1, 0, items)], "doc_id string, block_id int, chunk_id int, items string")).orderBy("item_no").collect()
    assert [(r.item_no, r.Name, r.description, r.port) for r in got] == [(0, "a", ["one"], "443"), (2, "b", [], None)]


def test_inherit_header(spark):
    rows = [("d", 1, 0, i, p) for i, p in enumerate(["0", None, "", "general", "null"])] + [("d", 0, 0, 0, "99")]
    records = spark.createDataFrame(rows, "doc_id string, block_id int, chunk_id int, item_no int, port string").withColumns({"protocol": F.lit(None).cast("string"), "severity": F.lit("Low")})
    b = spark.createDataFrame([("d", 0, "1", "udp", "High"), ("d", 1, "443", "tcp", "High")], "doc_id string, block_id int, port string, protocol string, severity string")
    got = {(r.block_id, r.item_no): (r.port, r.protocol, r.severity) for r in extract.inherit_header(records, b).collect()}
    assert [got[(1, i)][0] for i in range(5)] == ["443", "443", "443", "general", "443"]
    assert got[(0, 0)] == ("1", "udp", "High") and got[(1, 0)] == ("443", "tcp", "Low")


def test_rule_backend_and_retry(spark):
    text = "High 443/tcp\nNVT: A thing\nSummary\nIt is bad.\nSolution\nFix."
    chunk = spark.createDataFrame([("d", 1, 0, text)], "doc_id string, block_id int, chunk_id int, text string")
    answered = extract.validate_answer(extract.call_backend(chunk, extract.rule_based))
    got = extract.records_of(answered).first()
    assert (got.Name, got.port, got.severity, got.description, got.solution) == ("A thing", "443", "HIGH", ["It is bad."], ["Fix."])
    broken = extract.validate_answer(chunk.withColumn("raw", F.lit('[{"Name"')))
    again = extract.retry_redivided(broken, extract.rule_based).collect()
    assert sum(len(json.loads(r["items"])) for r in again) == 1
    assert extract.call_backend(chunk, lambda p: 1 / 0).first().error


def test_pairs_and_ports(spark):
    rows = [("XSS", "1"), ("XSS Instances (2)", "1"), ("SQLi", "2")]
    got = extract.complete_pairs(spark.createDataFrame(rows, "Name string, plugin string")).collect()
    assert {r.Name for r in got} == {"XSS", "XSS Instances (2)"}
    urls = ["https://a/x", "http://a:81/", "ftp://a", None]
    assert [r.p for r in spark.createDataFrame([(u,) for u in urls], "u string").select(extract.url_port(F.col("u")).alias("p")).collect()] == [443, 81, None, None]


def test_validators(spark):
    rows = [("VULNERABILITY LOW PLUGIN ID 3", "INFO", None), (" ", "x", None), ("ok", "INFO", ["https://a", "b"])]
    frame = spark.createDataFrame(rows, "Name string, severity string, identification array<string>")
    got = validate.validate_records(frame, "identification").collect()
    assert [(r.Name, r.severity) for r in got] == [("ok Instances (2)", "LOG")]
    raw = [('{"definition.name": "a", "port": "8x", "definition.cvss3.base_score": "7.5", "id": 3, "definition.see_also": "u"}',), ('{"id": "x"}',), ("broken",), (None,)]
    got = validate.validate_assets(spark.createDataFrame(raw, "raw string")).collect()
    assert len(got) == 1 and got[0]["port"] is None and got[0]["definition.cvss3.base_score"] == 7.5 and got[0]["id"] == "3" and got[0]["definition.see_also"] == ["u"]
    assert validate.validator_for(PROFILES["cais"]) is validate.validate_assets


FILLED = "seq bigint, Name string, port string, protocol string, description array<string>, plugin string"


def test_most_complete(spark):
    rows = [(1, "a", None, None, None, "p"), (2, "a", "1", "t", ["d"], "p"), (3, "a", "1", "t", ["e"], "p"), (4, None, "1", None, None, None), (5, None, None, None, [], None)]
    got = c.most_complete(spark.createDataFrame(rows, FILLED)).orderBy("place").collect()
    assert [(r.seq, r.place) for r in got] == [(2, 1), (4, 4)]


def test_openvas_services(spark):
    rows = [(1, "Services", "1", "t", ["x"], None), (2, "Services", "1", "t", ["y"], None), (3, "Services", "1", "t", ["x"], None), (4, " b", "1", "t", None, None), (5, "b ", "1", "t", ["z"], None)]
    assert sorted(r.seq for r in c.dedup_openvas(spark.createDataFrame(rows, FILLED)).collect()) == [1, 2, 5]


def test_merge_tenable(spark):
    rows = [(1, "a", "p", [], ["i1"]), (2, "a", "p", ["s2"], None), (3, "a", "p", ["s3"], ["i3"]), (4, "a", None, None, None)]
    got = c.merge_tenable(spark.createDataFrame(rows, "seq bigint, Name string, plugin string, solution array<string>, instances array<string>")).orderBy("seq").collect()
    assert [(r.seq, r.solution, r.instances) for r in got] == [(1, ["s2"], ["i1", "i3"]), (4, None, [])]


def test_merge_group_and_base_join(spark):
    rows = [(1, "X Instances (2)", "LOG", ["a", "b"]), (2, "X Instances (5)", "unknown", ["b", "c"]), (3, "X Instances (1)", "INFO", None)]
    got = c.merge_group(spark.createDataFrame(rows, "seq bigint, Name string, severity string, refs array<string>"), [F.lit(1)]).first()
    assert (got.Name, got.severity, got.refs) == ("X Instances (5)", "INFO", ["b", "c", "a"])
    rows = [(1, "X", "p", None), (2, "X Instances (2)", "p", ["u1", "u2"]), (3, "Y Instances (1)", "q", ["u3"])]
    got = c.base_and_instances(spark.createDataFrame(rows, "seq bigint, Name string, plugin string, instances array<string>")).orderBy("Name").collect()
    assert [(r.seq, r.Name, r.instances) for r in got] == [(1, "X", ["u1", "u2"]), (3, "Y", ["u3"])]


def test_consolidate_dispatch(spark):
    schema = "seq bigint, Name string, port string, protocol string, source string, description array<string>, plugin string"
    rows = [(1, "a", "1", "t", "OPENVAS", ["d"], None), (2, "a", "1", "t", "OPENVAS", None, None), (3, "b", "1", "t", "OPENVAS", [" "], None)]
    kept, report = c.consolidate(spark.createDataFrame(rows, schema), PROFILES["openvas"])
    assert [r.seq for r in kept.collect()] == [1] and {r.stage: r.records for r in report.collect()} == {"input": 3, "strategy": 2, "no_description": 1, "final": 1}
    assert c.strategy_for("TENABLEWAS") is None and c.strategy_for("TENABLEWAS", {"tenablewas": "tenable"}) is c.merge_tenable
    kept, _ = c.consolidate(spark.createDataFrame(rows, schema).withColumn("source", F.lit("other")), PROFILES["default"], allow_duplicates=True)
    assert kept.count() == 1
    first, removed = c.first_seen(spark.createDataFrame(rows, schema), F.col("plugin"))
    assert first.count() == 0 and removed.count() == 3


KEYED = "seq bigint, Name string, port string, protocol string"


def test_wildcards(spark):
    e = linkage.with_keys(spark.createDataFrame([(1, "x", "443", "tcp"), (2, "y|z", "1", "t"), (3, "q", None, None)], KEYED), "openvas")
    b = linkage.with_keys(spark.createDataFrame([(10, "x", None, "tcp"), (11, "x", "80", "tcp"), (12, "q", "5", "udp"), (13, "q", None, "udp")], KEYED), "openvas")
    got = {r.ext_key: (r.base_key, round(r.score, 4)) for r in linkage.best_wildcard(e, b).collect()}
    assert got == {"x|443|tcp": ("x|*|tcp", 0.7667), "q|*|*": ("q|5|udp", 0.5333)}


def test_fuzzy_without_block_equals_brute_force(spark):
    from scoria.functions.similarity import indel_ratio_of

    rng = random.Random(3)
    words = ["heap", "overflow", "weak", "cipher", "suite", "banner", "path", "traversal", "panel", "mail"]
    names = [" ".join(rng.choice(words) for _ in range(rng.randrange(1, 5))) for _ in range(60)]
    cands = list(dict.fromkeys(n if rng.random() < 0.3 else n.replace("e", "", 1) for n in names))
    got = {r.name: (r.candidate, round(r.score, 9)) for r in linkage.fuzzy_names(spark.createDataFrame([(n,) for n in names], "name string"), spark.createDataFrame(list(zip(cands, range(len(cands)))), "name string, rank int")).collect()}
    want = {}
    for n in names:
        best = max(range(len(cands)), key=lambda i: (indel_ratio_of(n, cands[i]), -i))
        if indel_ratio_of(n, cands[best]) >= 0.85:
            want[n] = (cands[best], round(indel_ratio_of(n, cands[best]), 9))
    assert got == want


def greedy_model(ext, base):
    """One-to-one by key in order of arrival, as a plain loop."""
    used, out = set(), {}
    for seq, key in ext:
        hit = next((b for b, k in base if k == key and b not in used), None)
        if hit is not None:
            used.add(hit)
        out[seq] = hit
    return out


def test_assignment_against_loop(spark):
    rng = random.Random(5)
    ext = [(i, rng.choice("abc")) for i in range(40)]
    base = [(100 + i, rng.choice("abcd")) for i in range(30)]
    e = spark.createDataFrame(ext, "seq bigint, match_key string")
    b = spark.createDataFrame(base, "seq bigint, key string")
    assert {r.ext_seq: r.base_seq for r in linkage.assign_by_key(e, b).collect()} == greedy_model(ext, base)


def test_fallback_prefers_port_and_protocol(spark):
    rows = spark.createDataFrame([("a", "1", "tcp", 1), ("a", "2", "TCP", 2), ("a", "9", "x", 3), ("z", None, None, 4)], "name string, port string, protocol string, ext_seq bigint")
    free = spark.createDataFrame([("a", "2", "tcp", 10), ("a", "1", "udp", 11)], "name string, port string, protocol string, base_seq bigint")
    got = {r.ext_seq: r.base_seq for r in linkage.assign_fallback(rows, free).collect()}
    assert got == {1: 10, 2: 11, 3: None, 4: None}


def test_link_end_to_end(spark):
    schema = "seq bigint, Name string, port string, protocol string, source string"
    e = spark.createDataFrame([(1, "Heap Overflow", "1", "tcp", "OPENVAS"), (2, "Heap Overflow", "1", "tcp", "OPENVAS"), (3, "Heap Overflow", "1", "tcp", "OPENVAS"), (4, "Weak Cipher Suite", "2", "tcp", "OPENVAS"), (5, "invented", "3", "tcp", "OPENVAS")], schema)
    b = spark.createDataFrame([(10, "heap overflow", "1", "tcp", "OPENVAS"), (11, "heap  overflow", "1", "tcp", "OPENVAS"), (12, "Weak Cipher Suites", "9", "tcp", "OPENVAS"), (13, "absent one", "9", "tcp", "OPENVAS")], schema)
    got = {(r.ext_seq, r.base_seq): r.status for r in linkage.link(e, b, allow_duplicates=True).collect()}
    assert got == {(1, 10): "MATCHED_COMPOSITE", (2, 11): "MATCHED_COMPOSITE", (3, None): "UNMATCHED_EXCESS", (4, 12): "MATCHED_FUZZY", (5, None): "UNMATCHED", (None, 13): "ABSENT"}


def test_bands_and_stats(spark):
    frame = spark.createDataFrame([(0.70,), (0.7001,), (0.60,), (0.40,), (0.0,)], "s double")
    assert [r.b for r in frame.select(evaluate.band(F.col("s")).alias("b")).collect()] == ["Moderately Similar", "Highly Similar", "Slightly Similar", "Divergent", "Divergent"]
    one = evaluate.column_stats(spark.createDataFrame([("f", 0.5)], "field string, score double")).first()
    assert one.std_v is None and one.median_v == 0.5


def test_multisets(spark):
    found = spark.createDataFrame([("a",), ("b",), ("c",), ("c",)], "k string")
    expected = spark.createDataFrame([("a",), ("a",), ("b",)], "k string")
    counts = evaluate.multiset_counts(found, expected, ["k"])
    r = evaluate.multiset_accuracy(counts).first()
    assert (r.tp, r.fp, r.fn, r.precision, round(r.recall, 4), round(r.f1, 4)) == (2, 2, 1, 0.5, 0.6667, 0.5714)
    published = evaluate.multiset_accuracy(spark.createDataFrame([(6101, 6101), (599, 0), (0, 242)], "found bigint, expected bigint")).first()
    assert (round(published.precision, 4), round(published.recall, 4), round(published.f1, 4)) == (0.9106, 0.9618, 0.9355)
    assert evaluate.multiset_accuracy(counts.limit(0)).first().f1 == 0.0


def test_numbering_is_global(spark):
    frame = spark.createDataFrame([(i, f"n{i % 7}") for i in range(100)], "seq bigint, Name string").repartition(5)
    got = sorted(datasets.numbered(frame, [F.lower("Name"), F.col("seq")]).collect(), key=lambda r: r.id)
    assert [r.id for r in got] == list(range(1, 101)) and [(r.Name, r.seq) for r in got] == sorted((r.Name, r.seq) for r in got)
    assert datasets.header_order(["zz", "severity", "aa", "Name"]) == ["Name", "severity", "aa", "zz"]


def test_model_cascade_and_latest(spark):
    models = [("gpt4", "gpt_4o"), ("llama3", "llama_3_70b")]
    keys = ["x_gpt_4o_mini", "a_gpt4_b", "llama3x_1", "zgpt4", "none"]
    got = [r.m for r in spark.createDataFrame([(k,) for k in keys], "k string").select(linkage.model_cascade(F.col("k"), models).alias("m")).collect()]
    assert got == ["gpt4", "gpt4", "llama3", "gpt4", "unknown"]
    ledger = spark.createDataFrame([("r", "failed", 1), ("r", "ok", 2), ("s", "ok", 1), ("s", "error", 3)], "run_id string, status string, run_at int")
    plan = spark.createDataFrame([("r",), ("s",), ("t",)], "run_id string")
    assert sorted(r.run_id for r in linkage.unfinished(plan, ledger).collect()) == ["s", "t"]


def test_profiles(tmp_path, monkeypatch):
    monkeypatch.setenv("SOME_KEY", "v")
    assert with_environment({"a": "${SOME_KEY}", "b": ["${NOPE_X}", "x${SOME_KEY}"]}) == {"a": "v", "b": ["", "x${SOME_KEY}"]}
    p = tmp_path / "p.json"
    p.write_text('{"reader": "acme", "extra": 1, "chunking": {"marker_pattern": "^ID", "other": 2}}')
    assert load_profile(str(p)).chunking.marker_pattern == "^ID"
    p.write_text('{"model": "m", "max_completion_tokens": 7, "api_key": "${SOME_KEY}"}')
    m = load_model(str(p))
    assert (m.max_tokens, m.api_key) == (7, "v")


def test_exact_median(spark):
    rng = random.Random(7)
    values = {"even": [rng.gauss(0, 5) for _ in range(5000)], "odd": [float(rng.randrange(3)) for _ in range(4001)], "two": [1.0, 4.0], "same": [2.0] * 50}
    frame = spark.createDataFrame([(k, v) for k, vs in values.items() for v in vs] + [("odd", None)], "field string, score double")
    got = {r.field: r.median_v for r in evaluate.column_stats(frame, accuracy=100).collect()}
    from statistics import median

    assert got == {k: median(v) for k, v in values.items()}


def test_rouge_l_pairs_reads_whole_fields(spark, tmp_path):
    descriptions = [["It is bad", "so fix it"], ["It is bad", "but leave it"], ["other", " None ", "so fix it"], None, [], ["so fix it"]]
    rows = [(i, "r", d) for i, d in enumerate(descriptions)] + [(9, "s", ["alone"])]
    spark.createDataFrame(rows, "seq bigint, run_id string, description array<string>").write.parquet(str(tmp_path / "records.parquet"))

    def common(a, b):
        if not a or not b:
            return 0
        return common(a[:-1], b[:-1]) + 1 if a[-1] == b[-1] else max(common(a[:-1], b), common(a, b[:-1]))

    texts = ["It is bad. so fix it", "It is bad. but leave it", "other. so fix it", "", "", "so fix it"]
    want = {}
    for i, (a, b) in enumerate(zip(texts, texts[1:])):
        x, y = a.split(), b.split()
        n = common(x, y)
        want[i] = (n, round(2 * n / (len(x) + len(y)), 6) if x or y else 1.0)
    assert {r.seq: (r.common, r.rouge) for r in plans.rouge_l_pairs(spark, str(tmp_path)).collect()} == want
