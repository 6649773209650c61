"""Data set exports: ordered ids, text forms of values, header order, summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scoria.functions.text import first_cve, port_protocol, severity_case
from scoria.schemas import DATASET_FIELDS
from scoria.session import place_within

#: Fixed value: columns that stand first in a CSV header.
FIRST_COLUMNS = ("Name", "severity", "port", "protocol", "description", "solution", "references", "source")


def stringified(c: Column, kind: str, sep: str = ";") -> Column:
    """A value as cell text: arrays of text joined, other nested values as JSON, null as ''."""
    if kind == "array<string>":
        out = F.array_join(c, sep)
    elif kind.startswith(("array", "map", "struct")):
        out = F.to_json(c)
    else:
        out = c.cast("string")
    return F.coalesce(out, F.lit(""))


def numbered(df: DataFrame, order: list[Column], name: str = "id") -> DataFrame:
    """Adds 1, 2, 3 ... in a total order, without bringing all rows to one task."""
    keys = [f"__o{i}" for i in range(len(order))]
    return place_within(df.select("*", *(o.alias(k) for o, k in zip(order, keys))), [], keys, name).drop(*keys)


def dataset(records: DataFrame, sep: str = ";") -> DataFrame:
    """Records in the data set's form: sorted by name without regard to case, numbered, all values as text, severity in capitals."""
    kinds = dict(records.dtypes)
    frame = numbered(records, [F.lower("Name"), F.col("seq")])
    out = []
    for c in DATASET_FIELDS:
        if c == "id":
            out.append(F.col("id"))
        elif c not in kinds:
            out.append(F.lit("").alias(c))
        elif c == "severity":
            out.append(F.coalesce(severity_case(F.col(c)), F.lit("")).alias(c))
        else:
            out.append(stringified(F.col(f"`{c}`"), kinds[c], sep).alias(c))
    return frame.select(*out)


def header_order(columns: list[str], first: tuple[str, ...] = FIRST_COLUMNS) -> list[str]:
    """Known columns first, in their order, then the rest by name."""
    return [c for c in first if c in columns] + sorted(c for c in columns if c not in first)


def or_placeholder(df: DataFrame, text: str = "no records") -> DataFrame:
    """``df``, or one row with ``text`` in its first column if it has none."""
    none = df.limit(1).agg(F.count(F.lit(1)).alias("n")).filter("n = 0")
    cells = [F.lit(text).cast(t).alias(c) if i == 0 else F.lit(None).cast(t).alias(c) for i, (c, t) in enumerate(df.dtypes)]
    return df.unionByName(none.select(*cells))


def severity_counts(df: DataFrame) -> DataFrame:
    """Records per severity; Risk stands for it where it is filled, 'Unknown' where neither is."""
    names = [c for c in ("Risk", "severity") if c in df.columns]
    return df.groupBy(F.coalesce(*(F.col(c) for c in names), F.lit("Unknown")).alias("severity")).agg(F.count(F.lit(1)).alias("n"))


def summary_lines(records: DataFrame) -> DataFrame:
    """One line per record: name, severity, port/protocol and first CVE."""
    line = F.format_string("%s | %s | %s | %s", F.coalesce("Name", F.lit("N/A")), F.coalesce(severity_case(F.col("severity")), F.lit("N/A")), port_protocol(F.col("port"), F.col("protocol")), first_cve(F.col("references")))
    return records.select("seq", line.alias("line"))


def top_per_group(df: DataFrame, by: list[str], order: list[Column], n: int, place: str = "place") -> DataFrame:
    """The first ``n`` rows of each group in a total order, with their ``place`` from 1: a top-k report.

    The engine limits each task's rows of a group to ``n`` before they meet, so no group is sorted as a whole.
    """
    return df.withColumn(place, F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter(F.col(place) <= n)
