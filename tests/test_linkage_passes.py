"""How often the linked queries read and put in order what they link, beside their results."""

import random

from scoria.functions import similarity as sim
from scoria.operators import evaluate, linkage
from scoria.plans import records as plans
from scoria.session import place_within
from tests.test_band_edges import tables  # noqa: F401


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_category_counts_by_source_reads_the_ledger_once_and_no_records_for_sources(spark, tables, monkeypatch):  # noqa: F811
    read, table = [], plans.table
    monkeypatch.setattr(plans, "table", lambda s, d, name: read.append(name) or table(s, d, name))
    out = plans.category_counts_by_source(spark, tables)
    assert read.count("run_ledger") == 1
    assert not [f for f in out.inputFiles() if "records.parquet" in f]
    assert {r.source: r.slightly_similar for r in out.collect()} == dict.fromkeys(("OPENVAS", "NESSUS", "QUALYS"), 8)


def test_only_keys_of_several_partitions_are_joined_to_their_places(spark):
    rng = random.Random(3)
    rows = [(rng.choice(["hot", "hot", None, *"abcdefgh"]), i) for i in rng.sample(range(3000), 900)]
    df = spark.createDataFrame(rows, "k string, s bigint").repartition(3)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        for keys in (["k"], []):
            out = place_within(df, keys, ["s"], "n")
            assert "SortMergeJoin" not in plan_of(out)
            want = {(k, s): 1 + sum(s2 < s and (not keys or k2 == k) for k2, s2 in rows) for k, s in rows}
            assert {(r.k, r.s): r.n for r in out.collect()} == want
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_both_sides_of_a_key_are_numbered_in_one_pass(spark):
    e = spark.createDataFrame([(5, "x"), (3, "x"), (9, "x"), (4, "y"), (7, None), (8, "z")], "seq bigint, match_key string")
    b = spark.createDataFrame([(20, "x"), (11, "x"), (12, "y"), (13, "y"), (14, None)], "seq bigint, key string")
    out = linkage.assign_by_key(e, b)
    assert plan_of(out).count("row_number()") <= plan_of(place_within(e, ["match_key"], ["seq"], "n")).count("row_number()")
    assert {r.ext_seq: r.base_seq for r in out.collect()} == {3: 11, 5: 20, 9: None, 4: 12, 8: None}


def test_no_texts_of_equal_values_nor_of_unlinked_rows_are_made(spark, monkeypatch):
    kind = "seq bigint, solution array<string>, severity string"
    values = [(["a b  c."], "HIGH"), ([], None), (None, ""), (["none"], " x"), (["a", None], "x"), (["a b c"], "LOW high")]
    e = spark.createDataFrame([(i, *values[i // 6]) for i in range(36)] + [(99, ["a"], "q")], kind)
    b = spark.createDataFrame([(100 + i, *values[i % 6]) for i in range(36)], kind)
    links = spark.createDataFrame([(i, 100 + i, "OK") for i in range(36)] + [(99, None, "UNMATCHED"), (None, 300, "ABSENT")], "ext_seq bigint, base_seq bigint, status string")
    staged, cut = [], evaluate.cut_lineage
    monkeypatch.setattr(evaluate, "cut_lineage", lambda df: staged.append(cut(df)) or staged[-1])
    got = {(r.ext_seq, r.field): round(r.score, 9) for r in evaluate.field_scores(links, e, b, ["solution", "severity"]).collect()}
    assert {tuple(r) for r in staged[0].filter("x IS NOT NULL").select("ext_seq", "field").collect()} == {(i, f) for i in range(36) for j, f in enumerate(("solution", "severity")) if values[i // 6][j] != values[i % 6][j]}

    def text(v):
        kept = [x.strip() for x in v or () if x and x.strip().lower() not in ("", "none", "null")] if not isinstance(v, str) else [v]
        return " ".join(". ".join(kept).split()).rstrip(" .,;:")

    def score(x, y):
        return 1.0 if x == y else sim.rouge_l_f1(x, y)

    want = {(i, f): round(score(text(values[i // 6][j]), text(values[i % 6][j])), 9) for i in range(36) for j, f in enumerate(("solution", "severity"))}
    assert got == want | {(99, "solution"): 0.0, (99, "severity"): 0.0}


def test_tokens_of_texts_are_not_broadcast(spark, monkeypatch):
    names = spark.createDataFrame([(f"finding {i} of panel",) for i in range(30)], "name string")
    cands = spark.createDataFrame([(f"finding {i} of panels", i) for i in range(30)], "name string, rank int")
    staged, cut = [], linkage.cut_lineage
    monkeypatch.setattr(linkage, "cut_lineage", lambda df: staged.append((df.columns, plan_of(df))) or cut(df))
    assert linkage.fuzzy_names(names, cands).count() == 30
    joins = [line for columns, plan in staged if "__tokens" in columns for line in plan.splitlines() if "Join [__id" in line]
    assert joins and all("SortMergeJoin" in line for line in joins)
