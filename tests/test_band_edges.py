"""Linked records whose mean score is exactly on a band's edge, in the queries that count bands."""

import itertools

import pytest

from scoria.plans import oracles
from scoria.plans import records as plans
from scoria.schemas import RECORD_DDL, RECORD_FIELDS

#: Words in common, words of either side: the scores 9/11, 32/55, 0 and 1, of mean 0.6, which added up as doubles are 2.4 or the next number above.
SIDES = ((9, 11, 11), (16, 16, 39), (0, 1, 1), (1, 1, 1))
SOURCES = ("OPENVAS", "NESSUS", "QUALYS")


def texts(common, x, y):
    """Two texts of ``x`` and ``y`` words that begin with the same ``common`` ones."""
    return [" ".join([f"w{i}" for i in range(common)] + [f"{side}{i}" for i in range(n - common)]) for side, n in (("x", x), ("y", y))]


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """One pair of records for each way to give the four scores to the four fields."""
    folder, rows = tmp_path_factory.mktemp("edges"), []
    for i, sides in enumerate(itertools.permutations(SIDES)):
        for run, values in zip(("a", "b"), zip(*(texts(*s) for s in sides))):
            fields = {f: v if f == "severity" else [v] for f, v in zip(oracles.FIELDS, values)}
            rows.append({"seq": i + (1000 if run == "b" else 0), "run_id": run, "Name": f"finding {chr(97 + i)} {i * 7919}", "port": "1", "protocol": "tcp", "source": SOURCES[i % 3], **fields})
    records = spark.createDataFrame([{"report": None, **{n: None for n, _ in RECORD_FIELDS}, **r} for r in rows], f"seq bigint, run_id string, {RECORD_DDL}, report string")
    records.write.parquet(f"{folder}/records.parquet")
    ledger = spark.createDataFrame([("a", "gpt4"), ("b", "llama4")], "run_id string, llm string").selectExpr("run_id", "'ok' AS status", "llm", "timestamp '2025-01-01' AS run_at")
    ledger.write.parquet(f"{folder}/run_ledger.parquet")
    return str(folder)


def test_link_scores(spark, tables):
    got = plans.link_scores(spark, tables).collect()
    assert [(r.ext_seq, r.base_seq, r.mean_score, r.category) for r in sorted(got)] == [(i, i + 1000, 0.6, "Slightly Similar") for i in range(24)]


def test_link_summary(spark, tables):
    r = plans.link_summary(spark, tables).first()
    assert (r.total, r.matched, r.highly_similar, r.moderately_similar, r.slightly_similar, r.divergent, r.overall_mean) == (24, 24, 0, 0, 24, 0, 0.6)


def test_category_counts_by_source(spark, tables):
    got = {r.source: (r.highly_similar, r.moderately_similar, r.slightly_similar, r.divergent) for r in plans.category_counts_by_source(spark, tables).collect()}
    assert got == dict.fromkeys(SOURCES, (0, 0, 8, 0))
