"""Problem 1: records that differ only in how they are written become one record with its number of copies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scoria.llm.canonical import canonical_key
from scoria.session import cut_lineage, skew_join

KEY_FIELDS = ("Name", "port", "protocol")


def _field(entries: Column, name: str) -> Column:
    """The first entry of that name in any letter case that has a value."""
    hits = F.filter(entries, lambda e: (F.lower(F.trim(e["key"])) == name.lower()) & e["value"].isNotNull())
    return F.get(hits, F.lit(0))["value"]


def canonical_json_key(raw: Column, fields: tuple[str, ...] = KEY_FIELDS) -> Column:
    """Canonical text of a JSON object's ``fields``.

    A null text counts as an object without fields. A text that is no JSON object stands for itself, byte for byte.
    """
    parsed = F.from_json(raw, "map<string,string>")
    entries = F.map_entries(parsed)
    key = canonical_key(*(_field(entries, f) for f in fields))
    return F.when(raw.isNotNull() & parsed.isNull(), F.concat(F.lit("\u0002"), raw)).otherwise(key)


def _digest(raw: Column) -> Column:
    """128 bits that stand for a byte string in joins; null has one of another length."""
    return F.coalesce(F.unhex(F.substring(F.sha2(raw, 256), 1, 32)), F.lit(b"\x00"))


def collapse_formatting(df: DataFrame, raw: str = "raw", id_col: str = "raw_id", fields: tuple[str, ...] = KEY_FIELDS) -> tuple[DataFrame, DataFrame]:
    """Returns (survivors, groups).

    survivors: one row per distinct byte string: ``digest`` (of it), ``copies``, ``first_id``, ``key``, ``group_first``,
    ``group_copies``. groups: one row per canonical text: ``key``, ``group_first`` (smallest id), ``group_copies``,
    ``spellings``.

    Byte-identical rows are counted first, with map-side combine, so a text with a third of all rows is shuffled once per
    task only; only distinct texts are parsed and canonicalised; the second grouping is on the full canonical text. After
    the first grouping the raw text isn't carried any further. Null texts form the group of records without any value; an
    empty table gives empty results; further columns of ``df`` are left alone.
    """
    distinct = df.groupBy(F.col(raw).alias("__raw")).agg(F.count(F.lit(1)).alias("copies"), F.min(id_col).alias("first_id"))
    keyed = cut_lineage(distinct.select(_digest(F.col("__raw")).alias("digest"), "copies", "first_id", canonical_json_key(F.col("__raw"), fields).alias("key")))
    groups = keyed.groupBy("key").agg(F.min("first_id").alias("group_first"), F.sum("copies").alias("group_copies"), F.count(F.lit(1)).alias("spellings"))
    # a group has as many survivors as it has spellings
    survivors = skew_join(keyed, groups.withColumnRenamed("spellings", "__spellings"), "key", "__spellings", keyed.count()).drop("__spellings")
    return survivors, groups


def formatting_duplicates(df: DataFrame, raw: str = "raw", id_col: str = "raw_id", fields: tuple[str, ...] = KEY_FIELDS) -> DataFrame:
    """Each row that is not the first of its group, with the group's first: ``group_first``, ``id``. Ties can't occur: ids are unique.

    Rows meet their group by the digest of their text; groups of one row have no such row and take no part.
    """
    survivors, _ = collapse_formatting(df, raw, id_col, fields)
    dim = cut_lineage(survivors.filter("group_copies > 1").select("digest", "copies", "group_first"))
    rows = df.select(F.col(id_col).alias("id"), _digest(F.col(raw)).alias("digest"))
    return skew_join(rows, dim, "digest", "copies", df.count()).filter(F.col("id") != F.col("group_first")).select("group_first", "id")
