import os
import random
from itertools import chain

import pytest
from pyspark.sql import functions as F

from scoria.llm import mixing, tokenizer

needs_vocabulary = pytest.mark.skipif(not os.path.exists(f"{tokenizer.TOKENIZER_DIR}/byte_bpe_50k.tiktoken"), reason="no vocabulary here")
PARTS = ["a", "b", " ", "  ", "\n", " \n", "\t", "aaa", "'s", "'ll", "1", "23", "_", "é", "日本", "ſ", "²", " ", " ", "!!", "\x1c", "\x85", "Ⅳ", "the", " the", "ing", "😀", "́", "<|endoftext|>"]


@pytest.fixture(scope="module")
def published():
    import base64

    import tiktoken

    with open(f"{tokenizer.TOKENIZER_DIR}/byte_bpe_50k.tiktoken", "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    pattern = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


@needs_vocabulary
def test_equals_published_encoder(published):
    encoder = tokenizer.TextEncoder(tokenizer.load_ranks("byte_bpe_50k"))
    rng = random.Random(6)
    texts = ["".join(rng.choice(PARTS) for _ in range(rng.randrange(0, 40))) for _ in range(8000)]
    texts += ["".join(rng.choice("abcdefgxyz") for _ in range(rng.randrange(1, 60))) for _ in range(2000)] + ["a" * 5000, " " * 3000, "ab" * 4000]
    for text, ids in zip(texts, encoder.batch(texts)):
        assert list(chain.from_iterable(ids)) == published.encode_ordinary(text), repr(text)


@needs_vocabulary
def test_forgetting_changes_nothing(published, monkeypatch):
    monkeypatch.setattr(tokenizer, "KEPT", 3)
    encoder = tokenizer.TextEncoder(tokenizer.load_ranks("byte_bpe_50k"))
    for text in ["one two threefold", "sevenfold two", "one two threefold"] * 2:
        assert list(chain.from_iterable(encoder.batch([text])[0])) == published.encode_ordinary(text)


@needs_vocabulary
def test_operator_edges(spark, published):
    rows = [(1, None), (2, ""), (3, " "), (3, "twice"), (3, "twice"), (4, "<|endoftext|>"), (5, "long text " * 20000), (None, "no id")]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("ids", F.lit(0))
    got = tokenizer.token_ids(frame).collect()
    assert sorted((repr(r.doc_id), r.ids) for r in got) == sorted((repr(i), published.encode_ordinary(t or "")) for i, t in rows)
    counts = tokenizer.token_counts(frame, ["doc_id"]).collect()
    assert sorted(r.n_tokens for r in counts) == sorted(len(published.encode_ordinary(t or "")) for _, t in rows)
    assert tokenizer.token_ids(frame.limit(0)).count() == 0


TARGETS = "source string, target_share double, max_copies int"


def mix(spark, docs, targets, **options):
    frame = spark.createDataFrame(docs, "doc_id bigint, source string, n_tokens bigint").withColumn("copies", F.lit(9))
    return mixing.mix_sources(frame, spark.createDataFrame(targets, TARGETS), **options)


def test_shares_and_caps(spark):
    rng = random.Random(9)
    docs = [(i, "big" if i % 3 else "mid", rng.randrange(20, 200)) for i in range(6000)] + [(10000 + i, "tiny", 50) for i in range(10)]
    taken, shares = mix(spark, docs, [("big", 0.6, 1), ("mid", 0.38, 1), ("tiny", 0.01, 4), ("none", 0.01, 2)])
    got = {r.source: r for r in shares.collect()}
    rows = taken.collect()
    assert max(r.copies for r in rows if r.source == "tiny") <= 4 and all(r.copies == 1 for r in rows if r.source != "tiny")
    assert len({r.doc_id for r in rows}) == len(rows)
    for s, share in (("big", 0.6), ("mid", 0.38), ("tiny", 0.01)):
        assert got[s].tokens == sum(r.copies * r.n_tokens for r in rows if r.source == s)
        assert got[s].tokens <= got[s].quota + 1e-6 and got[s].quota - got[s].tokens < 200
        assert abs(got[s].actual_share - share / 0.99) < 0.01
    assert (got["none"].tokens, got["none"].actual_share) == (0, 0.0)


def test_order_is_pareto_and_repeatable(spark):
    docs = [(i, "a", 10) for i in range(2000)]
    one = {r.doc_id for r in mix(spark, docs, [("a", 1.0, 1)], total=5000)[0].collect()}
    two = {r.doc_id for r in mix(spark, docs[::-1], [("a", 1.0, 1)], total=5000)[0].collect()}
    assert one == two and len(one) == 500
    u = spark.createDataFrame(docs, "doc_id bigint, source string, n_tokens bigint").select("doc_id", mixing.uniform(F.col("doc_id"), 17).alias("u")).collect()
    assert one == {r.doc_id for r in sorted(u, key=lambda r: r.u)[:500]}
    assert one != {r.doc_id for r in mix(spark, docs, [("a", 1.0, 1)], total=5000, seed=18)[0].collect()}


def test_weights_raise_odds(spark):
    frame = spark.createDataFrame([(i, "a", 10, 3.0 if i < 1000 else 1.0) for i in range(2000)], "doc_id bigint, source string, n_tokens bigint, weight double")
    taken, _ = mixing.mix_sources(frame, spark.createDataFrame([("a", 1.0, 1)], TARGETS), total=4000)
    ids = [r.doc_id for r in taken.collect()]
    assert len(ids) == 400 and sum(i < 1000 for i in ids) > 260


def test_mixing_edges(spark):
    docs = [(1, None, 5), (2, "a", None), (3, "a", 0), (4, "a", 7), (4, "a", 7), (5, "other", 3)]
    taken, shares = mix(spark, docs, [("a", 0.5, 2), ("b", 0.5, 1)])
    assert sorted((r.doc_id, r.copies) for r in taken.collect()) == [(4, 2), (4, 2)] and shares.count() == 2
    taken, shares = mix(spark, docs[:1], [("a", 1.0, 1)])
    assert taken.count() == 0 and shares.first().actual_share == 0.0


def test_inclusion_follows_weights(spark):
    """Over many seeds documents are drawn as often as their weights say, and dues above the cap stay at it."""
    rng = random.Random(4)
    docs = [(i, "a", rng.choice([5, 10, 20, 40, 400])) for i in range(300)]
    frame = spark.createDataFrame(docs, "doc_id bigint, source string, n_tokens bigint").withColumn("weight", F.col("n_tokens"))
    targets = spark.createDataFrame([("a", 1.0, 2)], TARGETS)
    total = 0.5 * sum(n for _, _, n in docs)
    copies: dict = {}
    seeds = 16
    for seed in range(seeds):
        rows = mixing.mix_sources(frame, targets, total=total, seed=seed)[0].collect()
        tokens = sum(r.copies * r.n_tokens for r in rows)
        assert total - 400 < tokens <= total + 1e-6 and max(r.copies for r in rows) <= 2
        for r in rows:
            copies[r.n_tokens] = copies.get(r.n_tokens, 0) + r.copies
    rate = total / sum(n * n for _, _, n in docs)  # no document is due more than its cap here
    for n in (5, 10, 20, 40, 400):
        of_size = sum(1 for d in docs if d[2] == n)
        assert abs(copies.get(n, 0) / seeds / of_size - rate * n) < 0.08 * max(1, rate * n) + 0.02


def test_dues_are_capped(spark):
    docs = [(i, "a", 10) for i in range(50)] + [(100, "a", 1000)]
    frame = spark.createDataFrame(docs, "doc_id bigint, source string, n_tokens bigint").withColumn("weight", F.col("n_tokens"))
    taken, shares = mixing.mix_sources(frame, spark.createDataFrame([("a", 1.0, 1)], TARGETS), total=1250)
    got = {r.doc_id: r.copies for r in taken.collect()}
    assert got[100] == 1 and len(got) == 26 and shares.first().limits is False and shares.first().most_total == 1500
    taken, shares = mixing.mix_sources(frame, spark.createDataFrame([("a", 0.5, 3), ("b", 0.5, 1)], TARGETS))
    assert {r.copies for r in taken.collect()} == {3} and {r.source: r.limits for r in shares.collect()} == {"a": True, "b": False}
    odd = frame.withColumn("weight", F.when(F.col("doc_id") % 2 == 0, 0.0).when(F.col("doc_id") == 1, F.lit(None).cast("double")).otherwise(1.0))
    assert all(r.doc_id % 2 for r in mixing.mix_sources(odd, spark.createDataFrame([("a", 1.0, 2)], TARGETS))[0].collect())


@needs_vocabulary
def test_shares_are_what_the_mix_holds(spark):
    """The shares of the project's tables, by SQL over the rows of the mix."""
    import duckdb

    from scoria.llm import queries

    data = "/root/testdata/sf0.001"
    if not os.path.isdir(data):
        pytest.skip("no test tables here")
    mix_rows, share_rows = queries.p7_mix(spark, data).toPandas(), queries.p7_shares(spark, data).toPandas()  # noqa: F841
    wrong = duckdb.sql(f"""
        WITH t AS (SELECT source, target_share, max_copies FROM '{data}/mix_targets.parquet'), m AS (SELECT source, count(*) AS docs, sum(copies) AS copies, sum(copies * n_tokens) AS tokens, max(copies) AS most FROM mix_rows GROUP BY source)
        SELECT * FROM t LEFT JOIN m USING (source) LEFT JOIN share_rows s USING (source)
        WHERE s.tokens <> coalesce(m.tokens, 0) OR s.taken_docs <> coalesce(m.docs, 0) OR s.taken_copies <> coalesce(m.copies, 0) OR coalesce(m.most, 0) > t.max_copies OR s.target_share <> t.target_share
        OR abs(s.actual_share - coalesce(m.tokens, 0) / (SELECT sum(tokens) FROM m)) > 1e-9""")
    assert len(share_rows) and wrong.fetchall() == []
