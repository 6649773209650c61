"""What the linkage computes, beside its results: pairs of names that can't be alike aren't scored, nor any pair several times."""

import random

import pandas as pd
from pyspark.sql import functions as F

from scoria.functions import similarity as sim
from scoria.operators import linkage
from tests.test_engine import brute_fallback


def counted(spark):
    """The indel ratio, and an accumulator of the rows that it is asked for."""
    asked = spark.sparkContext.accumulator(0)

    def batch(a: pd.Series, b: pd.Series) -> pd.Series:
        asked.add(len(a))
        return pd.Series([sim.indel_ratio_of(x, y) for x, y in zip(a, b)], dtype="float64")

    return F.pandas_udf(batch, "double"), asked


def may_be_alike(x, y, least):
    """Whether the numbers of both texts' characters allow it."""
    def n(text, kind):
        return min(8, sum(c in kind for c in text))

    return sum(abs(n(x, k) - n(y, k)) for k in linkage.KINDS) <= (1 - least) * (len(x) + len(y)) + 1e-6


def test_only_pairs_that_may_be_alike_are_scored_and_once(spark):
    rng = random.Random(5)
    products = ["baldriith panel", "crupexand server", "velhola mail", "zulkorek gateway", "dapveland proxy", "Élan Σ shell"]
    bugs = ["session fixation (remote)", "heap overflow vulnerability", "banner disclosure 1.2.33", "aaaaaaaaaaaa entity expansion"]
    def messed(s):
        k = rng.randrange(len(s))
        return s[:k] + rng.choice("xyz-") + s[k + rng.randrange(2):]
    plain = [f"{p} {b}" for p in products for b in bugs]
    names, cands = sorted({messed(n) for n in plain * 2}), sorted({messed(n) for n in plain * 2})
    likeness, asked = counted(spark)
    a, b = spark.createDataFrame([(n,) for n in names], "name string"), spark.createDataFrame(list(zip(cands, range(len(cands)))), "name string, rank int")
    got = {r.name: (r.candidate, round(r.score, 9)) for r in linkage.fuzzy_names(a, b, likeness=likeness).collect()}
    want = {}
    for n in names:
        score, rank = max((sim.indel_ratio_of(n, c), -i) for i, c in enumerate(cands))
        if score >= 0.85:
            want[n] = (cands[-rank], round(score, 9))
    assert got == want
    rounds = (*linkage.ROUNDS, 0.85)
    assert 0 < asked.value <= sum(may_be_alike(x, y, least) for least in rounds for x in names for y in cands)


def test_fallback_of_names_in_one_stream(spark):
    """Names and their rows go over several batches, and no name is a group of its own."""
    rng = random.Random(8)
    rows = [(i, f"n{rng.randrange(25)}", rng.choice(["", "1", "2"]), rng.choice(["", "tcp", "udp"])) for i in range(150)]
    free = [(1000 + i, f"n{rng.randrange(30)}", rng.choice(["", "1", "2"]), rng.choice(["", "tcp", "udp"])) for i in range(140)]
    e = spark.createDataFrame(rows, "ext_seq bigint, name string, port string, protocol string")
    b = spark.createDataFrame(free, "base_seq bigint, name string, port string, protocol string")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        out = linkage.assign_fallback(e, b)
        assert {r.ext_seq: r.base_seq for r in out.collect()} == brute_fallback(rows, free)
        assert "CoGroups" not in out._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
