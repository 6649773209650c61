import random

import pytest
from pyspark.sql import functions as F

from scoria.engine import Engine
from scoria.functions import similarity as sim
from scoria.functions import text as t
from scoria.operators import evaluate, extract, linkage, pages, validate
from scoria.profiles import PROFILES, Profile, load_profile

REPORT = """Contents
2.1 192.0.2.7
High 443/tcp
NVT: Weak cipher
Summary
The service offers weak ciphers.
Solution
Turn them off.
Log general/tcp
NVT: Services
Summary
A service answers.
NVT: Nothing said
"""


def docs(spark):
    return spark.createDataFrame([("r1", REPORT), ("r2", REPORT.replace("Weak", "Strong")), ("r3", None)], "doc_id string, text string")


def test_engine_from_text_to_evaluation(spark, tmp_path):
    engine = Engine.of("openvas", extract.rule_based)
    extraction, result, failed = engine.run(docs(spark).filter("text IS NOT NULL"), str(tmp_path / "out"), ("json",), baseline=spark.createDataFrame([(1, "Weak cipher", ["The service offers weak ciphers."], "443", "tcp", "HIGH"), (2, "Absent one", ["x"], "1", "tcp", "LOW")], "seq bigint, Name string, description array<string>, port string, protocol string, severity string"))
    assert failed == {}
    rows = {(r.Name, r.port, r.severity, tuple(r.description)) for r in extraction.records.collect()}
    assert ("Weak cipher", "443", "HIGH", ("The service offers weak ciphers.",)) in rows and ("Strong cipher", "443", "HIGH", ("The service offers weak ciphers.",)) in rows
    assert {r.Name for r in extraction.removed.collect()} == {"Nothing said"}
    stages = {r.stage: (r.records, r.removed, r.strategy) for r in extraction.report.collect()}
    assert stages["input"][0] == 6 and stages["no_description"][1] >= 1 and stages["final"][2] == "most complete"
    assert extraction.ledger.agg(F.sum("tokens_input").alias("n")).first().n > 20
    kinds = {r.type: r.n for r in result.categories.groupBy("type").agg(F.count("*").alias("n")).collect()}
    assert kinds["Matched"] == 1 and kinds["Absent (not extracted)"] == 1
    with pytest.raises(ValueError, match="no input"):
        validate.check_arguments(inputs=None)
    with pytest.raises(ValueError, match="baseline"):
        validate.check_arguments(True, None, ("csv",), 1)
    assert validate.check_arguments(True, 1, ("csv",), 1) == ("all",) and validate.check_arguments(False, None, ("csv",), 1) == ("csv",)


def test_each_document_is_a_run(spark, tmp_path):
    """The same finding in two reports stays in both; a folder of reports is extracted in one plan, with a ledger."""
    (tmp_path / "in").mkdir()
    for name in ("one.txt", "two.txt"):
        (tmp_path / "in" / name).write_text(REPORT + REPORT.replace("Contents\n", ""))
    (tmp_path / "in" / "three.txt").write_text("nothing here")
    engine = Engine.of("openvas", extract.rule_based)
    ledger = {r.run_id: (r.status, r.records) for r in engine.batch(spark, str(tmp_path / "in"), str(tmp_path / "out")).collect()}
    assert ledger["three.txt"] == ("empty", 0) and ledger["one.txt"] == ledger["two.txt"] and ledger["one.txt"][0] == "ok"
    rows = spark.read.json(str(tmp_path / "out" / "records"))
    assert {(r.report, r.n) for r in rows.filter("Name = 'Weak cipher'").groupBy("report").agg(F.count("*").alias("n")).collect()} == {("one.txt", 1), ("two.txt", 1)}
    web = spark.createDataFrame([(1, "r1", "n", "p", ["d"], "TENABLEWAS"), (2, "r2", "n", "p", ["d"], "TENABLEWAS"), (3, "r2", "n", "p", None, "TENABLEWAS")], "seq bigint, doc_id string, Name string, plugin string, description array<string>, source string")
    from scoria.operators import consolidate

    kept, _ = consolidate.consolidate(web, PROFILES["tenable"], aliases={"tenablewas": "tenable"}, by=("doc_id",))
    assert {(r.seq, r.doc_id) for r in kept.collect()} == {(1, "r1"), (2, "r2")}


SIDES = "seq bigint, Name string, port string, protocol string, description array<string>, severity string"


def sides(spark):
    e = [(1, "Alpha flaw", "1", "tcp", ["same text"], "HIGH"), (2, "Alpha flaw", "9", "udp", ["other words here"], "LOW"), (3, "Alpha flaw", "9", "udp", None, None), (4, "Made up", None, None, ["q"], "LOW"), (5, "Beta flaws", "2", "tcp", ["b"], "LOG")]
    b = [(11, "alpha  flaw", "1", "TCP", ["same text"], "HIGH"), (12, "Alpha flaw", "7", "udp", ["other words"], "LOW"), (13, "Beta flaw", "3", "tcp", ["b"], "LOG"), (14, "Never seen", "3", "tcp", ["b"], "LOG")]
    return spark.createDataFrame(e, SIDES), spark.createDataFrame(b, SIDES)


def test_evaluate_tables(spark):
    e, b = sides(spark)
    out = evaluate.evaluate(e, b, allow_duplicates=True, scanner="openvas")
    kinds = {r.ext_seq or -r.base_seq: (r.category, r.type) for r in out.categories.collect()}
    assert kinds == {1: ("Highly Similar", "Matched"), 2: ("Moderately Similar", "Matched"), 3: ("Non-existent", "Non-existent (excess duplicate)"), 4: ("Non-existent", "Non-existent (LLM invention)"), 5: ("Highly Similar", "Matched"), -14: ("Absent", "Absent (not extracted)")}
    debug = {r.seq: (r.Baseline_Name_matched, r.Status) for r in out.mapping.collect()}
    assert debug == {1: ("alpha  flaw", "MATCHED_COMPOSITE"), 2: ("alpha  flaw", "MATCHED_NAME_ONLY"), 3: ("alpha  flaw", "MATCHED_NAME_ONLY"), 4: (None, "UNMATCHED"), 5: ("Beta flaw", "MATCHED_NAME_ONLY")}
    rows = {r.ext_seq: r for r in out.per_record.collect()}
    assert (rows[1].status, rows[1].description_rouge_l, rows[3].status, rows[3].port_rouge_l, rows[2].description_rouge_l) == ("OK", 1.0, "UNMATCHED_EXCESS", 0.0, 0.8)
    summary = {r.field: (r.matched, round(r.avg_v, 6)) for r in out.summary.collect()}
    assert summary["description"] == (3, round((1 + 0.8 + 1) / 3, 6)) and set(summary) == {"port", "protocol", "description", "severity"}
    row = out.overall.first()
    assert (row.total, row.matched, row.absent, row.non_existent, row.excess, row.invented) == (5, 3, 1, 2, 1, 1)
    both = evaluate.summary_of_all({"one": out, "two": out})
    assert {r.extraction for r in both.collect()} == {"one", "two"}
    none = evaluate.evaluate(e.limit(0), b, allow_duplicates=True, scanner="openvas")
    assert {r.field: (r.matched, r.avg_v) for r in none.summary.collect()}["description"] == (0, 0.0)
    with pytest.raises(ValueError, match="metric"):
        evaluate.evaluate(e, b, "bleu")


def test_semantic_metric_chooses_by_fields(spark):
    e = spark.createDataFrame([(1, "A", "5", "tcp", ["red green"], "x"), (2, "A", "6", "tcp", ["blue"], "x")], SIDES)
    b = spark.createDataFrame([(11, "A", "7", "tcp", ["blue"], "x"), (12, "A", "8", "tcp", ["red green"], "x")], SIDES)
    out = evaluate.evaluate(e, b, "semantic", True, "openvas", ["description"], "token_cosine")
    assert {(r.ext_seq, r.base_seq) for r in out.categories.collect()} == {(1, 12), (2, 11)}
    assert {r.ext_seq: r.base_seq for r in linkage.link(e, b, "openvas", True).collect()} == {1: 11, 2: 12}


def test_services_rows_match_by_content(spark):
    e = spark.createDataFrame([(1, "Services", "1", "tcp", ["web"], "LOG"), (2, "services", "1", "tcp", ["mail"], "LOG")], SIDES)
    b = spark.createDataFrame([(7, "Services", "1", "tcp", ["web"], "LOG"), (8, "Services", "1", "tcp", ["ssh"], "LOG")], SIDES)
    got = {(r.ext_seq, r.base_seq): r.status for r in linkage.link(e, b, "openvas", True).collect()}
    assert got[(1, 7)] == "MATCHED_COMPOSITE" and got[(2, 8)] == "MATCHED_NAME_ONLY"


def test_baseline_first_of_each_name(spark):
    e, b = sides(spark)
    got = {r.ext_seq: r.base_seq for r in linkage.link(e, b, "openvas").collect() if r.ext_seq}
    assert got == {1: 11, 2: None, 3: None, 4: None, 5: 13}


def brute_fallback(rows, free):
    out, left = {}, sorted(free)
    for seq, name, port, protocol in sorted(rows):
        mine = [f for f in left if f[1] == name]
        if not mine:
            out[seq] = None
            continue
        best = max(mine, key=lambda f: ((bool(port) and f[2] == port) + (bool(protocol) and f[3] == protocol), -f[0]))
        left.remove(best)
        out[seq] = best[0]
    return out


def test_fallback_queues_equal_brute_force(spark):
    rng = random.Random(6)
    for n in (30, 200):
        rows = [(i, rng.choice("ab"), rng.choice(["", "1", "2", "3"]), rng.choice(["", "tcp", "udp"])) for i in range(n)]
        free = [(1000 + i, rng.choice("abc"), rng.choice(["", "1", "2", "3"]), rng.choice(["", "tcp", "udp"])) for i in range(n - 10)]
        e = spark.createDataFrame(rows, "ext_seq bigint, name string, port string, protocol string")
        b = spark.createDataFrame(free, "base_seq bigint, name string, port string, protocol string")
        assert {r.ext_seq: r.base_seq for r in linkage.assign_fallback(e, b).collect() if r.ext_seq is not None} == brute_fallback(rows, free)


def test_fuzzy_rounds_equal_brute_force(spark):
    rng = random.Random(3)
    base = ["ab", "a", "abc", "weak cipher suites", "weak cipher suite", "directory listing", "open redirect in alpha", "open redirect in alphas", "stack exhaustion 1.2.3", "x" * 30]
    def messed(s):
        s = list(s)
        for _ in range(rng.randrange(0, 1 + len(s) // 5)):
            k = rng.randrange(len(s) + 1)
            s[k : k + rng.randrange(2)] = rng.choice(["", "z", " ", "-"])
        return "".join(s) or "q"
    names = sorted({messed(rng.choice(base)) for _ in range(150)})
    cands = sorted({messed(rng.choice(base)) for _ in range(120)})
    want = {}
    for n in names:
        score, rank = max((sim.indel_ratio_of(n, c), -i) for i, c in enumerate(cands))
        if score >= 0.85:
            want[n] = (cands[-rank], round(score, 9))
    a = spark.createDataFrame([(n,) for n in names] + [("",)], "name string")
    b = spark.createDataFrame(list(zip(cands, range(len(cands)))), "name string, rank int")
    assert {r.name: (r.candidate, round(r.score, 9)) for r in linkage.fuzzy_names(a, b).collect()} == want
    assert linkage.fuzzy_names(a.limit(0), b).count() == 0 and linkage.fuzzy_names(a, b.limit(0)).count() == 0


def test_token_sort_by_address(spark):
    rows = spark.createDataFrame([("i1", "beta alpha"), ("i1", "nothing alike"), ("i2", "beta alpha"), (None, "beta alpha"), ("i1", "  ")], "ip string, name string")
    base = spark.createDataFrame([("i1", "alpha beta"), ("i1", "alpha betas"), ("i2", "gamma")], "ip string, name string")
    assert {(r.ip, r.name): r.matched_name for r in linkage.blocked_token_sort(rows, base).collect()} == {("i1", "beta alpha"): "alpha beta", ("i1", "nothing alike"): "nothing alike", ("i2", "beta alpha"): "beta alpha", (None, "beta alpha"): "beta alpha", ("i1", "  "): "  "}


def test_published_costs(spark):
    prices = {"gpt5": (0.25, 2.0), "deepseek": (0.28, 0.42), "llama3": (0.59, 0.79), "llama4": (0.11, 0.34), "gpt4": (0.30, 1.20)}
    used = [("deepseek", 1422522), ("gpt4", 1194135), ("gpt5", 1280084), ("llama3", 1422519), ("llama4", 1345762)]
    ledger = spark.createDataFrame([(m, 7696630, o) for m, o in used], "llm string, tokens_input bigint, tokens_output bigint")
    got = {r.llm: round(r.cost, 2) for r in evaluate.token_cost(ledger, prices).collect()}
    assert got == {"deepseek": 2.75, "gpt4": 3.74, "gpt5": 4.48, "llama3": 5.66, "llama4": 1.30, None: 17.95}
    odd = evaluate.token_cost(ledger.limit(1).withColumn("llm", F.lit("new")), prices).collect()
    assert {(r.llm, r.cost, r.priced) for r in odd} == {("new", 0.0, False), (None, 0.0, False)}
    counts = spark.createDataFrame([(6101 + 599, 6101 + 242)], "found bigint, expected bigint").selectExpr("6101L + 599L AS found", "6101L AS expected").unionAll(spark.sql("SELECT 0L, 242L"))
    a = evaluate.multiset_accuracy(counts).first()
    assert (round(a.precision, 4), round(a.recall, 4), round(a.f1, 4), round(a.invented_pct, 2), round(a.missing_pct, 2)) == (0.9106, 0.9618, 0.9355, 8.94, 3.82)


def test_answers_and_retries(spark):
    assert extract.recover_json('Here is it: [{"Name": "a"}]') == [{"Name": "a"}] and extract.recover_json("Based on [nothing") == []
    asked: list = []

    def flaky(prompts):
        if any("fail" in p for p in prompts):
            raise RuntimeError("no answer")
        return ['[{"Name": "n", "identification": ["http://x"]}, {"Name": "", "identification": "y"}, {"Name": "z", "identification": []}]' for _ in prompts]

    rows = spark.createDataFrame([(i, x) for i, x in enumerate(["ok", "fail", "ok"])], "doc_id int, text string").coalesce(1)
    got = {r.doc_id: (r.raw is not None, r.error) for r in extract.call_backend(rows, flaky).collect()}
    assert got == {0: (True, None), 1: (False, "no answer"), 2: (True, None)} and not asked
    answers = spark.createDataFrame([("d", 1, 0, "[]", "some text"), ("d", 2, 0, '[{"Name": "k", "identification": ["u"]}]', "text")], "doc_id string, block_id int, chunk_id int, raw string, text string")
    checked = extract.validate_answer(answers)
    out = {r.block_id: r["items"] for r in extract.retry_with_pairs(checked, flaky, 4096, PROFILES["tenable"]).collect()}
    assert out[1].count("Name") == 1 and '"k"' in out[2]
    assert extract.retry_plain(checked, flaky).count() == 2
    held = spark.createDataFrame([("a", ["u"]), ("b", []), (None, ["u"])], "Name string, identification array<string>")
    assert [r.Name for r in extract.identified_pairs(held).collect()] == ["a"]


def test_score_lines():
    text = "Log 443/tcp\nHigh (CVSS: 7.5)\nNVT: A\nSummary\nx\nNVT: B\nMedium 80/tcp\nNVT: C"
    got = [(r["Name"], r["severity"], r["port"], r.get("cvss")) for r in extract.recover_json(extract.rule_based([text])[0])]
    assert got == [("A", "HIGH", "443", ["7.5"]), ("B", "HIGH", "443", None), ("C", "MEDIUM", "80", None)]


def test_web_scan_rules(spark):
    text = "VULNERABILITY HIGH PLUGIN ID 98056\n\nOpen Redirect Instances (2)\nIdentification\nhttps://a.example/x\nhttps://a.example/y\nVULNERABILITY HIGH PLUGIN ID 98056\nOpen Redirect\nDescription\nIt redirects.\nReference Information\nhttps://r.example\nCWE-601\nRisk Information\nCVSSV3 BASE SCORE 6.1\nPlugin Details\nFamily: Web\n"
    record = extract.recover_json(extract.rule_based_tenable([text])[0])
    assert len(record) == 1 and record[0]["Name"] == "Open Redirect" and [i["instance"] for i in record[0]["instances"]] == ["https://a.example/x", "https://a.example/y"]
    assert (record[0]["description"], record[0]["references"], record[0]["cvss"], record[0]["plugin"], record[0]["plugin_details"]) == (["It redirects."], ["https://r.example", "CWE-601"], ["CVSSV3 BASE SCORE 6.1"], "98056", {"family": "Web"})
    frame = spark.createDataFrame([("Flaw Instances (3)", "http://a.example:8080/x"), ("Flaw", "https://a.example"), ("Flaw", "ftp://x"), ("Flaw", None)], "Name string, url string")
    got = [(r["asset.system_type"], r.name_consolidated, r.port, r.protocol) for r in extract.enrich_assets(frame, "tenable").collect()]
    assert got == [("Web Application", "Flaw", "8080", "http"), ("Web Application", "Flaw", "443", "https"), ("Web Application", "Flaw", None, "ftp"), ("Web Application", "Flaw", None, None)]


def test_bodies_in_order(spark):
    parts = spark.createDataFrame([("d", "body", "zz first", 0), ("d", "summary", "s", 1), ("d", "body", "aa second", 2), ("e", "body", "x", 0)], "doc_id string, kind string, text string, part_no int")
    assert {r.doc_id: r.text for r in pages.body_text(parts, "part_no").collect()} == {"d": "zz first\naa second", "e": "x"}
    with pytest.raises(Exception, match="several bodies"):
        pages.body_text(parts).collect()


def test_profiles_and_ids(spark, tmp_path):
    assert validate.profile_type("cais_prompt.txt") == "cais" and validate.profile_type("p", "out_tenable.json") == "tenable" and validate.profile_type(kind="X") == "x" and validate.profile_type() == "default"
    assert validate.validator_for(Profile(prompt_file="cais_v3.txt")) is validate.validate_assets and validate.validator_for(Profile()) is validate.validate_records
    (tmp_path / "prompt.txt").write_text("Extract {context}")
    (tmp_path / "p.json").write_text('{"reader": "x", "prompt_template": "%s"}' % (tmp_path / "prompt.txt"))
    assert load_profile(str(tmp_path / "p.json")).prompt == "Extract {context}"
    row = spark.createDataFrame([("a", "b"), ("a", "b"), ("ab", None)], "x string, y string").select(t.stable_uuid(F.col("x"), F.col("y")).alias("u")).collect()
    import uuid

    assert row[0].u == row[1].u != row[2].u and uuid.UUID(row[0].u).version == 5
    paths = spark.createDataFrame([("res/OpenVAS_someApp/gpt4/run1/x.json",), ("res/other/gpt4/run1/x.json",), ("x.json",)], "p string").select(*(c.alias(n) for n, c in zip("sb", t.folder_parts(F.col("p"))))).collect()
    assert [tuple(r) for r in paths] == [("openvas", "someapp"), ("other", "other"), ("unknown", "unknown")]


def test_scored_once_for_equal_pairs(spark):
    rows = spark.createDataFrame([(1, "a b", "a c"), (2, "a b", "a c"), (3, "", None), (4, "x", ""), (5, "q", "q")], "i int, x string, y string")
    got = {r.i: r.score for r in sim.score_pairs(rows, "x", "y", sim.rouge_l, equal=1.0).collect()}
    assert got == {1: 0.5, 2: 0.5, 3: 1.0, 4: 0.0, 5: 1.0}


def test_chart_data(spark):
    rows = spark.createDataFrame([("m", "x", 1.0), ("m", "y", 3.0), ("n", "x", 5.0)], "llm string, field string, score double")
    got = {r.llm: (r.x, r.y) for r in evaluate.chart_data("heatmap", rows, row="llm", column="field", value="score", columns=["x", "y"]).collect()}
    assert got == {"m": (1.0, 3.0), "n": (5.0, None)}
    with pytest.raises(ValueError, match="no chart"):
        evaluate.chart_data("pie", rows)


def test_merging_a_large_group(spark):
    """One group of many records gathers its different elements only, in order of their first place."""
    from scoria.operators import consolidate

    rows = [(i, "a" if i % 3 else "a Instances (9)", [f"v{i % 5}", None, f"v{i % 7}"] if i % 2 else None, [], None if i < 10 else f"p{i}") for i in range(3000)]
    frame = spark.createDataFrame(rows, "seq bigint, Name string, tags array<string>, none array<string>, port string")
    got = consolidate.merge_group(frame, [F.lit(None).cast("string")]).collect()
    want: list = []
    for r in sorted(rows, key=lambda r: (-(9 if "Inst" in r[1] else 0), r[0])):
        for x in r[2] or []:
            if x not in want:
                want.append(x)
    assert len(got) == 1 and got[0].tags == want and got[0].none == [] and got[0].port == "p12" and got[0].seq == 0
