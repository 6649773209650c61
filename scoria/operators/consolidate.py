"""Deduplication and merging of records, by strategy, with audit tables.

Where one row per group is kept, the rank is an ordering struct and the row a struct beside it, so one aggregation with
map-side combine does it: no group is sorted or held as a whole. ``seq`` is the order of arrival and breaks all ties.
"""

from __future__ import annotations

import inspect
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scoria.functions.text import base_name, instance_count, is_filled, severity_rank, stripped
from scoria.operators.validate import with_description
from scoria.profiles import Profile
from scoria.session import cut_lineage


def filled_fields(df: DataFrame, skip: tuple[str, ...] = ("seq",)) -> Column:
    """How many fields of a row say something."""
    counted = [is_filled(F.col(f"`{n}`"), t).cast("int") for n, t in df.dtypes if n not in skip and not n.startswith("__")]
    total = F.lit(0)
    for c in counted:
        total = total + c
    return total


def keep_one(df: DataFrame, keys: list[Column], rank: list[Column]) -> DataFrame:
    """The row with the smallest ``rank`` per key (null keys are a group), and ``__place``, the group's smallest seq."""
    names = [f"__k{i}" for i in range(len(keys))]
    row = F.struct(*(F.col(f"`{c}`") for c in df.columns))
    keyed = df.select(*(k.alias(n) for k, n in zip(keys, names)), F.struct(*(r.alias(f"r{i}") for i, r in enumerate(rank))).alias("__rank"), row.alias("__row"), "seq")
    best = keyed.groupBy(*names).agg(F.min_by("__row", "__rank").alias("__row"), F.min("seq").alias("__place"))
    return best.select("__row.*", "__place")


def most_complete(df: DataFrame, keys: list[Column] | str = "Name", skip: tuple[str, ...] = ("seq",)) -> DataFrame:
    """Per key the record with the most filled fields, the first of them on a tie; ``place`` is where the key first stood."""
    keys = [F.col(f"`{keys}`")] if isinstance(keys, str) else keys
    return keep_one(df, keys, [-filled_fields(df, skip), F.col("seq")]).withColumnRenamed("__place", "place")


def dedup_openvas(df: DataFrame, skip: tuple[str, ...] = ("seq",), by: tuple[str, ...] = ()) -> DataFrame:
    """Most complete per (name stripped, port, protocol), within ``by``; 'Services' rows only collapse when they are the same throughout."""
    name = stripped(F.coalesce("Name", F.lit("")))
    content = F.sha2(F.to_json(F.struct(*(F.col(f"`{c}`") for c in df.columns if c not in skip))), 256)
    return most_complete(df, [name, F.col("port"), F.col("protocol"), F.when(name == "Services", content), *map(F.col, by)], skip)


def _first_filled(c: str, kind: str) -> Column:
    return F.min_by(F.col(f"`{c}`"), F.when(is_filled(F.col(f"`{c}`"), kind), F.col("seq")))


def merge_tenable(df: DataFrame, fill: tuple[str, ...] = ("description", "solution", "cvss", "references"), by: tuple[str, ...] = ()) -> DataFrame:
    """Per (name, plugin), within ``by``, the first record, with all instances in order, and empty ``fill`` fields from the next that has them."""
    kinds = dict(df.dtypes)
    fill = tuple(c for c in fill if c in kinds)
    plain = [c for c in df.columns if c not in (*fill, "instances")]
    aggs = [F.min_by(F.struct(*(F.col(f"`{c}`") for c in plain)), "seq").alias("__first")]
    aggs += [F.coalesce(_first_filled(c, kinds[c]), F.min_by(F.col(f"`{c}`"), "seq")).alias(c) for c in fill]
    if "instances" in kinds:
        listed = F.array_sort(F.collect_list(F.struct("seq", "instances")))
        aggs.append(F.flatten(F.transform(F.filter(listed, lambda s: s["instances"].isNotNull()), lambda s: s["instances"])).alias("instances"))
    keys = {f"__k{i}": F.col(c) for i, c in enumerate(("Name", "plugin", *by))}
    return df.withColumns(keys).groupBy(*keys).agg(*aggs).select("__first.*", *fill, *(["instances"] if "instances" in kinds else []))


def merge_group(df: DataFrame, keys: list[Column], by_instances: bool = True) -> DataFrame:
    """Merges groups: the representative has the highest 'Instances (N)' (or comes first); arrays are united in order without repeats; scalars come from the best record that has them; the highest severity stays.

    What is gathered per group is its different array elements, each with its first place, not its records: a group of any
    number of records costs what its result holds.
    """
    order = F.struct((-instance_count(F.col("Name"))).alias("n"), F.col("seq")) if by_instances else F.struct(F.col("seq"))
    names = [f"__k{i}" for i in range(len(keys))]
    frame = df.select("*", *(k.alias(n) for k, n in zip(keys, names)), order.alias("__o"))
    aggs, arrays = [], [name for name, kind in df.dtypes if kind.startswith("array") and name not in ("severity", "seq", "Name")]
    for name, kind in df.dtypes:
        c = F.col(f"`{name}`")
        if name == "severity":
            aggs.append(F.min_by(c, F.struct((-severity_rank(c)).alias("r"), F.col("__o"))).alias(name))
        elif name in ("seq", "Name"):
            aggs.append(F.min_by(c, "__o").alias(name))
        elif name not in arrays:
            aggs.append(F.min_by(c, F.when(is_filled(c, kind), F.col("__o"))).alias(name))
    out = frame.groupBy(*names).agg(*aggs)
    for name in arrays:
        each = frame.select(*names, "__o", F.posexplode(f"`{name}`").alias("__i", "__v")).groupBy(*names, "__v").agg(F.min(F.struct("__o", "__i")).alias("__at"))
        united = F.transform(F.array_sort(F.collect_list(F.struct("__at", "__v"))), lambda s: s["__v"])
        held = each.groupBy(*(F.col(n).alias(f"{n}_") for n in names)).agg(united.alias(name))
        same = F.lit(True)
        for n in names:
            same = same & F.col(n).eqNullSafe(F.col(f"{n}_"))
        out = out.join(held, same, "left").withColumn(name, F.coalesce(F.col(f"`{name}`"), F.array().cast(dict(df.dtypes)[name]))).drop(*(f"{n}_" for n in names))
    return out.select(*df.columns)


def highest_severity(df: DataFrame, by: list[str], name: str = "highest") -> DataFrame:
    """Per group its highest severity, in capitals, the first of equal ones; groups without any are left out."""
    best = F.min_by(F.upper(stripped(F.col("severity"))), F.struct((-severity_rank(F.col("severity"))).alias("r"), "seq"))
    return df.filter("severity IS NOT NULL").groupBy(*by).agg(best.alias(name))


def base_and_instances(df: DataFrame) -> DataFrame:
    """Joins base records with their instances records by (base name, plugin); instances without a base get one made from themselves."""
    frame = df.withColumn("__base", base_name(F.col("Name"))).withColumn("__is", instance_count(F.col("Name")) > 0)
    base = frame.filter("NOT __is").drop("__is", "instances")
    found = frame.filter("__is").groupBy("__base", "plugin").agg(
        F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("seq", "instances"))), lambda s: F.coalesce(s["instances"], F.array().cast(dict(df.dtypes)["instances"])))).alias("instances"),
        F.min_by(F.struct(*(F.col(f"`{c}`") for c in df.columns if c not in ("instances", "plugin"))), "seq").alias("__any"),
    )
    joined = base.alias("b").join(found.alias("i"), F.col("b.__base").eqNullSafe(F.col("i.__base")) & F.col("b.plugin").eqNullSafe(F.col("i.plugin")), "full_outer")
    out = []
    for c in df.columns:
        if c == "instances":
            out.append(F.col("i.instances"))
        elif c == "plugin":
            out.append(F.coalesce("b.plugin", "i.plugin").alias(c))
        elif c == "Name":
            out.append(F.coalesce("b.Name", "i.__base").alias(c))
        else:
            out.append(F.when(F.col("b.seq").isNotNull(), F.col(f"b.{c}")).otherwise(F.col(f"i.__any.{c}")).alias(c))
    return joined.select(*out)


def first_seen(df: DataFrame, key: Column) -> tuple[DataFrame, DataFrame]:
    """(kept, removed): the first row of each key; rows with a null key are removed."""
    first = df.select(key.alias("__key"), "seq").filter("__key IS NOT NULL").groupBy("__key").agg(F.min("seq").alias("seq")).select("seq")
    return df.join(first, "seq", "left_semi"), df.join(first, "seq", "left_anti")


Strategy = Callable[[DataFrame], DataFrame]


@dataclass(frozen=True)
class About:
    """What reports say of a strategy, and the keys of its groups when many sources are consolidated in one plan (null: records stay as they are)."""

    name: str
    description: str = "a strategy of its own"
    reason: str = "deduplication"
    keys: Callable[[], list[Column]] | None = None


STRATEGIES: dict[str, Strategy] = {"openvas": lambda df, by=(): dedup_openvas(df, by=by).drop("place"), "tenable": merge_tenable}
ABOUT: dict[str, About] = {
    "openvas": About("most complete", "the most complete record of each name, port and protocol", "deduplication", lambda: [stripped(F.coalesce("Name", F.lit(""))), F.col("port"), F.col("protocol")]),
    "tenable": About("merge of instances", "records of one name and plugin, with all their instances", "instance consolidation", lambda: [base_name(F.col("Name"))]),
}


def register_strategy(source: str, strategy: Strategy, about: About | None = None) -> None:
    STRATEGIES[source.lower()] = strategy
    ABOUT[source.lower()] = about or About(getattr(strategy, "__name__", source))


def strategy_for(source: str | None, aliases: dict[str, str] | None = None) -> Strategy | None:
    """By the source's exact name in lower case, or its alias."""
    name = (source or "").lower()
    return STRATEGIES.get((aliases or {}).get(name, name))


def consolidate(df: DataFrame, profile: Profile, allow_duplicates: bool = False, aliases: dict[str, str] | None = None, source: str | None = None, by: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """(records, report) of one run, or of many that the columns ``by`` tell apart: its source's strategy, else pass-through or the most complete by the profile's field; then the description filter.

    ``source``: the run's; without it that of its first record (one row is read). report: ``stage_no``, ``stage``,
    ``records``, ``removed`` by the stage, and the ``strategy`` and ``reason`` of what was removed.
    """
    if source is None:
        head = df.select("source", "seq").orderBy("seq").limit(1).collect()
        source = head[0].source if head and head[0].source else profile.reader
    strategy = strategy_for(source, aliases)
    if strategy:
        name = source.lower()
        about = ABOUT[(aliases or {}).get(name, name)]
    elif allow_duplicates:
        strategy, about = lambda x, by=(): x, About("pass-through", "records as they are", "none")
    else:
        keys = [F.col(f"`{c}`") for c in (profile.consolidation_field, *by)]
        strategy, about = lambda x, by=(): most_complete(x, keys).drop("place"), About("most complete", f"the most complete record of each {profile.consolidation_field}")
    # a strategy of one's own that knows no ``by`` sees all runs together
    apart = by and "by" in inspect.signature(strategy).parameters
    merged = cut_lineage(strategy(df, by=by) if apart else strategy(df))
    kept, removed = with_description(merged, profile.description_field)
    counts = stage_counts(input=df, strategy=merged, no_description=removed, final=kept)
    before = F.lag("records").over(Window.orderBy("stage_no"))  # four rows
    lost = F.when(F.col("stage") == "strategy", before - F.col("records")).when(F.col("stage") == "no_description", F.col("records")).otherwise(0)
    reason = F.when(F.col("stage") == "strategy", about.reason).when(F.col("stage") == "no_description", "no valid description")
    return kept, counts.select("stage_no", "stage", "records", lost.cast("bigint").alias("removed"), F.lit(about.name).alias("strategy"), reason.alias("reason"))


def consolidate_by_source(df: DataFrame, name: str = "Name", aliases: dict[str, str] | None = None) -> DataFrame:
    """Records of many sources in one plan: each source's rows are grouped by its strategy's keys and merged as in merge_group.

    Rows of sources without a strategy stay as they are; unnamed rows of the others are left out.
    """
    known = [x for x, y in ABOUT.items() if y.keys]
    source = F.lower(F.coalesce("source", F.lit("")))
    for alias, target in (aliases or {}).items():
        source = F.when(source == alias.lower(), target).otherwise(source)
    own = df.filter(~source.isin(*known))
    for x in known:
        mine = df.filter((source == x) & (F.length(stripped(F.coalesce(F.col(name), F.lit("")))) > 0))
        own = own.unionByName(merge_group(mine, [F.col("source"), *ABOUT[x].keys()]))
    return own


def stage_counts(**stages: DataFrame) -> DataFrame:
    out = None
    for i, (name, df) in enumerate(stages.items()):
        row = df.agg(F.lit(i).alias("stage_no"), F.lit(name).alias("stage"), F.count(F.lit(1)).alias("records"))
        out = row if out is None else out.unionByName(row)
    return out


def merged_groups(df: DataFrame, key: Column) -> DataFrame:
    """Audit: groups of more than one record: ``key``, ``size``, ``first_seq``, ``last_seq``."""
    return df.groupBy(key.alias("key")).agg(F.count(F.lit(1)).alias("size"), F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq")).filter("size > 1")


def group_members(df: DataFrame, groups: DataFrame, key: Column, most: int = 20) -> DataFrame:
    """The first ``most`` members of each of ``groups`` (of merged_groups; null keys are one): ``key``, ``place``, ``seq``, ``Name``, ``port``, ``protocol``, ``severity``.

    Each group's rows are ranked as they are partitioned, so the few rows that are kept come from every task before they meet.
    """
    rows = df.select(key.alias("key"), "seq", "Name", "port", "protocol", "severity")
    rows = rows.join(groups.select(F.col("key").alias("__key"), F.lit(True).alias("__in")), F.col("key").eqNullSafe(F.col("__key")), "left_semi")
    local = F.row_number().over(Window.partitionBy("key", "__part").orderBy("seq"))
    few = rows.withColumn("__part", F.pmod(F.xxhash64("seq"), F.lit(64))).withColumn("__r", local).filter(F.col("__r") <= most)
    place = F.row_number().over(Window.partitionBy("key").orderBy("seq"))
    return few.withColumn("place", place).filter(F.col("place") <= most).select("key", "place", "seq", "Name", "port", "protocol", "severity")
