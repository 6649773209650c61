"""Problem 4: one surviving record per group of duplicates, chosen field by field."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scoria.llm.canonical import canonical_key

#: The severities that count as such.
SEVERITIES = ("CRITICAL", "HIGH", "MEDIUM", "LOW", "INFO", "LOG")
FIELDS = ("description", "severity", "instances")
WHITE = r"[\p{Z}\t-\r\x1c-\x1f\x85]+"
#: Rows of one group are ranked in parts first, then the parts' best: at least PARTS, and one for each PART_ROWS rows of the table.
PARTS, PART_ROWS = 16, 1_000_000


def visible_chars(texts: Column) -> Column:
    """Characters other than white space, over all elements of an array; 0 for null."""
    return F.coalesce(F.length(F.regexp_replace(F.array_join(texts, ""), WHITE, "")), F.lit(0))


def is_severity(value: Column) -> Column:
    """Whether a value is a severity, in any letter case and with white space around."""
    return F.coalesce(F.upper(F.regexp_replace(value, f"^{WHITE}|{WHITE}$", "")).isin(*SEVERITIES), F.lit(False))


def rank_fields(df: DataFrame, group: list[Column], id_col: str = "seq", recency: str = "extracted_at", trust: dict[str, int] | None = None, source: str = "source") -> DataFrame:
    """One row per group of two or more: ``first_id``, ``members`` and, per field, ``best_<field>`` (null if no member has a value).

    Completeness ranks first, then ``trust`` (a rank by source, the highest first; none unless given, sources without one
    have 0), then recency (null counts as oldest), then the smaller id. The ranking is done in two windows over narrow
    rows: within pieces of each group, whose number follows the table's rows, then over the pieces' best - at most three
    rows a piece - so no group, however large, is sorted in one task. Rows whose group columns are all null are one group.
    """
    recent = F.desc_nulls_last("__recent")
    known = F.create_map(*(F.lit(x) for kv in (trust or {}).items() for x in kv)) if trust else None
    rows = df.select(
        F.sha2(F.to_json(F.struct(*(g.alias(f"g{i}") for i, g in enumerate(group)))), 256).substr(1, 32).alias("__group"),
        F.col(id_col).alias("__id"),
        F.col(recency).alias("__recent"),
        (F.coalesce(F.try_element_at(known, F.col(source)), F.lit(0)) if trust else F.lit(0)).alias("__trust"),
        visible_chars(F.col("description")).alias("__description"),
        is_severity(F.col("severity")).cast("int").alias("__severity"),
        F.greatest(F.coalesce(F.size("instances"), F.lit(0)), F.lit(0)).alias("__instances"),
    ).withColumn("__part", F.pmod(F.xxhash64("__id"), F.lit(max(PARTS, df.count() // PART_ROWS))))

    def ranked(frame: DataFrame, by: list[str]) -> DataFrame:
        for f in FIELDS:
            frame = frame.withColumn(f"__rank_{f}", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc(f"__{f}"), F.desc("__trust"), recent, F.asc("__id"))))
        return frame

    piece = Window.partitionBy("__group", "__part")
    local = ranked(rows, ["__group", "__part"]).withColumn("__n", F.count(F.lit(1)).over(piece)).withColumn("__first", F.min("__id").over(piece))
    some_first = F.least(*(F.col(f"__rank_{f}") for f in FIELDS)) == 1
    # the piece's count and smallest id go with one of its rows only
    local = local.filter(some_first).withColumn("__n", F.when(F.col("__rank_description") == 1, F.col("__n")))
    final = ranked(local, ["__group"])
    best = [F.max(F.when((F.col(f"__rank_{f}") == 1) & (F.col(f"__{f}") > 0), F.col("__id"))).alias(f"best_{f}") for f in FIELDS]
    return final.groupBy("__group").agg(F.min("__first").alias("first_id"), F.sum("__n").alias("members"), *best).filter(F.col("members") > 1)


def duplicate_findings(df: DataFrame) -> DataFrame:
    """rank_fields over findings that one run extracted more than once: same run, canonical Name, port and protocol.

    Records without a run_id are one run of their own.
    """
    return rank_fields(df, [F.col("run_id"), canonical_key(F.col("Name"), F.col("port"), F.col("protocol"))])


def best_fields(ranked: DataFrame) -> DataFrame:
    """The ranking as rows (first_id, field, best_id), without fields that no member has a value for."""
    pairs = F.array(*(F.struct(F.lit(f).alias("field"), F.col(f"best_{f}").alias("best_id")) for f in FIELDS))
    return ranked.select("first_id", F.explode(pairs).alias("p")).select("first_id", "p.field", "p.best_id").filter(F.col("best_id").isNotNull())


def surviving_records(df: DataFrame, ranked: DataFrame, id_col: str = "seq") -> DataFrame:
    """Builds the survivors: the columns of each group's first record, with description, severity and instances of its best ones.

    ``members`` is added (``group_members`` where ``df`` has that name). The wide rows are read and shuffled once, by a join
    on the unique id with the up to four ids that each group names; only those rows meet by group.
    """
    members = "group_members" if "members" in df.columns else "members"
    best = [f"__best_{f}" for f in FIELDS]
    named = ranked.select("first_id", "members", *(F.col(f"best_{f}").alias(b) for f, b in zip(FIELDS, best)))
    named = named.select(F.col("first_id").alias("__first"), F.col("members").alias("__members"), *best, F.explode(F.array_distinct(F.array_compact(F.array("first_id", *best)))).alias("__id"))
    rows = df.withColumn("__id", F.col(id_col)).join(named, "__id")

    def of(column: str, owner: str) -> Column:
        return F.first(F.when(F.col("__id") == F.col(owner), F.struct(F.col(f"`{column}`").alias("v"))), True)["v"].alias(column)

    chosen = [of(c, f"__best_{c}" if c in FIELDS else "__first") for c in df.columns]
    return rows.groupBy("__first").agg(*chosen, F.first("__members").alias(members)).drop("__first")
