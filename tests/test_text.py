from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from scoria.functions import similarity as sim
from scoria.functions import text as t


def one(spark, column, **values):
    ddl = ", ".join(f"{k} {v[0]}" for k, v in values.items())
    return spark.createDataFrame([tuple(v[1] for v in values.values())], ddl).select(column.alias("x")).first().x


def test_normalize_port(spark):
    rows = spark.createDataFrame([("1,443",), ("443.0",), ("general",), ("nan",), ("",), (None,)], "p string").select(t.normalize_port(F.col("p")).alias("x")).collect()
    assert [r.x for r in rows] == ["1443", "4430", "general", "*", "*", "*"]


def test_first_cve(spark):
    rows = spark.createDataFrame([(["url: x", "cve: CVE-2020-1"],), (["see CVE-2021-2 now"],), ([],), (None,)], "r array<string>").select(t.first_cve(F.col("r")).alias("x")).collect()
    assert [r.x for r in rows] == ["CVE-2020-1", "CVE-2021-2", "N/A", "N/A"]


def test_clock_and_names(spark):
    assert one(spark, t.clock(F.col("s")), s=("double", 3661.5)) == "01:01:01.500"
    assert one(spark, t.base_name(F.col("s")), s=("string", "XSS Instances (12)")) == "XSS"
    assert one(spark, t.instance_count(F.col("s")), s=("string", "XSS Instances (12)")) == 12
    assert one(spark, t.report_name(F.col("s")), s=("string", "scan_my_app_1.json")) == "my app 1"
    assert one(spark, t.run_number(F.col("s")), s=("string", "a/run7/x")) == 7
    assert one(spark, t.severity_case(F.col("s"), "capital"), s=("string", " hIGH ")) == "High"
    assert one(spark, t.host_address(F.col("s")), s=("string", "1 x\n2.1 192.0.2.7\n")) == "192.0.2.7"


def test_normalize_list_and_text(spark):
    assert one(spark, t.normalize_list(F.col("a")), a=("array<string>", [" one. ", "None", "", None, "two\tx"])) == "one. two x"
    assert one(spark, t.normalize_text(F.col("a")), a=("string", "a – b…\n\n c...;: ")) == "a - b… c"
    assert one(spark, t.normalize_listlike(F.col("a")), a=("string", "['a', 'null', 'b']")) == "a. b"
    assert one(spark, t.normalize_listlike(F.col("a")), a=("string", None)) == ""


def test_sanitize(spark):
    assert one(spark, t.sanitize(F.col("a")), a=("string", "ﬁx ✓ “q” – é 日☃")) == 'fix [V] "q" - é 日'
    assert one(spark, t.sanitize(F.col("a")), a=("string", None)) is None


def slow_lcs(x, y):
    row = [0] * (len(y) + 1)
    for a in x:
        new = [0]
        for j, b in enumerate(y):
            new.append(row[j] + 1 if a == b else max(row[j + 1], new[j]))
        row = new
    return row[-1]


@settings(max_examples=200, deadline=None)
@given(st.text("abc", max_size=30), st.text("abcd", max_size=30))
def test_lcs_equals_table(x, y):
    assert sim.lcs_length(x, y) == slow_lcs(x, y)


def test_similarity_goldens():
    assert sim.lcs_length("the cat sat on mat".split(), "the dog sat on a mat".split()) == 4
    assert round(sim.rouge_l_f1("the cat sat on mat", "the dog sat on a mat"), 4) == 0.7273
    assert round(sim.indel_ratio_of("abc", "abd"), 4) == 0.6667
    assert sim.indel_ratio_of("ab", "ba") == 0.5
    assert sim.token_sort_of("b a", "a b") == 1.0


def test_field_score_rules(spark):
    frame = spark.createDataFrame([("", ""), ("a", None), ("a b", "a b")], "x string, y string")
    assert [r.s for r in frame.select(sim.field_score(F.col("x"), F.col("y"), sim.rouge_l).alias("s")).collect()] == [1.0, 0.0, 1.0]


def test_lcs_by_fold_agrees(spark):
    frame = spark.createDataFrame([("a b c d", "b d e"), ("", "a"), ("x y", "y x")], "x string, y string")
    x, y = F.filter(F.split("x", " "), lambda v: v != ""), F.filter(F.split("y", " "), lambda v: v != "")
    assert [r.n for r in frame.select(sim.lcs_by_fold(x, y).alias("n")).collect()] == [2, 0, 1]


def test_registered_functions(spark):
    sim.register(spark)
    assert spark.sql("SELECT rouge_l('a b', 'a c') AS x, lcs_tokens('a b', 'b') AS n, nfkc('ﬁ') AS k").first() == (0.5, 1, "fi")
