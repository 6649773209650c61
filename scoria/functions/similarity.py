"""Text similarity: longest common subsequence, ROUGE-L, indel and token-sort ratios, and a pluggable semantic score."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scoria.session import ship_package


def lcs_length(x: Sequence, y: Sequence) -> int:
    """Length of the longest common subsequence, on the bits of one big integer: O(len(x) * len(y) / word size).

    What both begin and end with is common anyway; items of one side only change nothing.
    """
    if len(x) > len(y):
        x, y = y, x
    n, begin = len(x), 0
    while begin < n and x[begin] == y[begin]:
        begin += 1
    end = 0
    while end < n - begin and x[-1 - end] == y[-1 - end]:
        end += 1
    if begin + end == n:
        return n
    x, y = x[begin : n - end], y[begin : len(y) - end]
    places: dict = {}
    for i, item in enumerate(x):
        places[item] = places.get(item, 0) | 1 << i
    full = row = (1 << len(x)) - 1
    get = places.get
    for item in y:
        mask = get(item)
        if mask is not None:
            hit = row & mask
            row = (row + hit | row - hit) & full
    return begin + end + len(x) - row.bit_count()


def rouge_l_f1(a: str, b: str) -> float:
    """F1 of precision and recall of the common subsequence of white-space tokens; 0 if either side is empty."""
    x, y = a.split(), b.split()
    if not x or not y:
        return 0.0
    common = lcs_length(x, y)
    return 2 * common / (len(x) + len(y))


def indel_ratio_of(a: str, b: str) -> float:
    """1 - insertions and deletions over both lengths; two empty texts are alike."""
    total = len(a) + len(b)
    return 2 * lcs_length(a, b) / total if total else 1.0


def token_sort_of(a: str, b: str) -> float:
    return indel_ratio_of(" ".join(sorted(a.split())), " ".join(sorted(b.split())))


def token_cosine(a: str, b: str) -> float:
    """Cosine of token counts: a stand-in for a semantic model, and not to be read as one's score."""
    x, y = Counter(a.lower().split()), Counter(b.lower().split())
    norm = math.sqrt(sum(v * v for v in x.values()) * sum(v * v for v in y.values()))
    return sum(v * y[k] for k, v in x.items()) / norm if norm else 0.0


def pairwise(score: Callable[[str, str], float], kind: str = "double") -> Callable[[Column, Column], Column]:
    """A vectorised function of two text columns; null if either is null. Equal pairs of a batch are scored once."""

    def batch(a: pd.Series, b: pd.Series) -> pd.Series:
        seen: dict[tuple[str, str], float] = {}
        out = []
        for x, y in zip(a, b):
            if x is None or y is None:
                out.append(None)
                continue
            if (x, y) not in seen:
                seen[(x, y)] = score(x, y)
            out.append(seen[(x, y)])
        return pd.Series(out, dtype="float64" if kind == "double" else "Int64")

    batch.__annotations__ = {"a": pd.Series, "b": pd.Series, "return": pd.Series}
    udf = F.pandas_udf(batch, T.DoubleType() if kind == "double" else T.IntegerType())

    def call(a: Column, b: Column) -> Column:
        ship_package()
        return udf(a, b)

    call.udf = udf
    return call


lcs_tokens = pairwise(lambda a, b: lcs_length(a.split(), b.split()), "int")
rouge_l = pairwise(rouge_l_f1)
indel_ratio = pairwise(indel_ratio_of)
token_sort_ratio = pairwise(token_sort_of)

#: Backends of the semantic score by name; each gives a number that is clamped to [0, 1].
SEMANTIC: dict[str, Callable[[str, str], float]] = {"none": lambda a, b: 0.0, "token_cosine": token_cosine}


def semantic_score(a: Column, b: Column, backend: str = "none") -> Column:
    """The named backend's score; 'none' gives 0.0, as where no model is there."""
    score = SEMANTIC[backend]
    return pairwise(lambda x, y: min(1.0, max(0.0, score(x, y))))(a, b)


def field_score(a: Column, b: Column, score: Callable[[Column, Column], Column]) -> Column:
    """Both sides empty: 1; one side empty: 0; else the score."""
    left, right = F.coalesce(a, F.lit("")), F.coalesce(b, F.lit(""))
    return F.when((left == "") & (right == ""), 1.0).when((left == "") | (right == ""), 0.0).otherwise(score(left, right))


def score_pairs(df: DataFrame, x: str, y: str, score: Callable[[Column, Column], Column], name: str = "score", equal: float | None = None) -> DataFrame:
    """Adds ``name``, the field_score of two text columns, with one call for each different pair of texts, across all batches.

    ``equal``: what two equal texts have, where that is known without a call. Pairs without a side to compare need none
    either; the others are made distinct by a digest of both, scored, and joined back.
    """
    left, right = F.coalesce(F.col(x), F.lit("")), F.coalesce(F.col(y), F.lit(""))
    known = F.when((left == "") & (right == ""), 1.0).when((left == "") | (right == ""), 0.0)
    if equal is not None:
        known = F.when((left == right) & (left != ""), equal).otherwise(known)
    digest = F.when(known.isNull(), F.unhex(F.substring(F.sha2(F.to_json(F.struct(left.alias("a"), right.alias("b"))), 256), 1, 32)))
    marked = df.withColumn("__known", known).withColumn("__pair", digest)
    distinct = marked.filter("__pair IS NOT NULL").groupBy("__pair").agg(F.min(x).alias("__x"), F.min(y).alias("__y"))
    scored = distinct.select("__pair", score(F.col("__x"), F.col("__y")).alias("__score"))
    return marked.join(scored, "__pair", "left").withColumn(name, F.coalesce("__known", "__score")).drop("__known", "__pair", "__score")


def lcs_by_fold(x: Column, y: Column) -> Column:
    """lcs of two arrays without Python: one row of the table is carried through a nested fold. For short arrays."""
    zero = F.transform(y, lambda _: F.lit(0))

    def row(previous: Column, item: Column) -> Column:
        def cell(acc: Column, j: Column) -> Column:
            up = F.element_at(previous, j)
            diagonal = F.when(j > 1, F.element_at(previous, F.greatest(j - 1, F.lit(1)))).otherwise(0)
            left = F.when(j > 1, F.element_at(acc, -1)).otherwise(0)
            return F.concat(acc, F.array(F.when(F.element_at(y, j) == item, diagonal + 1).otherwise(F.greatest(up, left))))

        return F.aggregate(F.when(F.size(y) > 0, F.sequence(F.lit(1), F.size(y))).otherwise(F.array().cast("array<int>")), F.array().cast("array<int>"), cell)

    last = F.aggregate(x, zero, row)
    return F.when((F.size(x) > 0) & (F.size(y) > 0), F.element_at(F.when(F.size(last) > 0, last), -1)).otherwise(0)


def register(spark: SparkSession) -> None:
    """Makes the functions usable in SQL under their names."""
    from scoria.functions.text import nfkc

    ship_package(spark)

    for name, f in {"lcs_tokens": lcs_tokens, "rouge_l": rouge_l, "indel_ratio": indel_ratio, "token_sort_ratio": token_sort_ratio, "nfkc": nfkc}.items():
        spark.udf.register(name, getattr(f, "udf", f))
