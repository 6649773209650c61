"""Scores of linked records, bands, statistics, accuracy of multisets, token totals and cross-run tables."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scoria.functions.similarity import SEMANTIC, rouge_l, score_pairs, semantic_score
from scoria.functions.text import normalize_list, normalize_text
from scoria.operators.linkage import link_steps, mapping_debug, mean_field_score
from scoria.session import cut_lineage

#: Bands of the mean score (strictly above), highest first.
BANDS = (("Highly Similar", 0.7), ("Moderately Similar", 0.6), ("Slightly Similar", 0.4))
LOWEST_BAND = "Divergent"


def band(score: Column) -> Column:
    out = F.lit(LOWEST_BAND)
    for name, above in reversed(BANDS):
        out = F.when(score > above, name).otherwise(out)
    return out


def common_columns(extraction: DataFrame, baseline: DataFrame, skip: tuple[str, ...] = ("Name", "seq")) -> list[str]:
    """The columns of both sides that are compared, in the extraction's order."""
    return [c for c in extraction.columns if c in baseline.columns and c not in skip and not c.startswith("__")]


def comparable(df: DataFrame, c: str, side: str | None = None) -> Column:
    """A column's text for scoring: lists joined, other nested values as JSON, anything else as text."""
    kind, col = dict(df.dtypes)[c], F.col(f"{side}.`{c}`" if side else f"`{c}`")
    if kind == "array<string>":
        return normalize_list(col)
    return normalize_text(F.to_json(col) if kind.startswith(("array", "struct", "map")) else col.cast("string"))


def field_scores(links: DataFrame, extraction: DataFrame, baseline: DataFrame, fields: list[str], score: Callable[[Column, Column], Column] = rouge_l, equal: float | None = 1.0) -> DataFrame:
    """``ext_seq``, ``base_seq``, ``status``, ``field``, ``score`` of linked rows, one row per field; unlinked rows score 0, absent rows have none.

    The fields' texts are put side by side in rows first, so one vectorised call scores all fields, each different pair of
    texts once. ``equal``: what equal texts score, where the score says so of all (null: they are scored like others).
    Unlinked rows need no texts, nor do equal values if equal texts score 1, as two empty ones do.
    """
    rows = links.filter("ext_seq IS NOT NULL AND base_seq IS NOT NULL").alias("l")
    joined = rows.join(extraction.alias("e"), F.col("l.ext_seq") == F.col("e.seq")).join(baseline.alias("b"), F.col("l.base_seq") == F.col("b.seq"))
    pairs = []
    for c in fields:
        kinds = {dict(side.dtypes)[c] for side in (extraction, baseline)}
        comparable_as_is = equal == 1.0 and len(kinds) == 1 and "map<" not in kinds.pop()
        same = F.col(f"e.`{c}`").eqNullSafe(F.col(f"b.`{c}`")) if comparable_as_is else F.lit(False)
        x, y = (F.when(~same, comparable(side, c, name)) for side, name in ((extraction, "e"), (baseline, "b")))
        pairs.append(F.struct(F.lit(c).alias("field"), same.alias("same"), x.alias("x"), y.alias("y")))
    # the texts are read several times, and made once
    each = cut_lineage(joined.select("ext_seq", "base_seq", "status", F.explode(F.array(*pairs)).alias("p")).select("ext_seq", "base_seq", "status", "p.*"))
    out = ("ext_seq", "base_seq", "status", "field", "score")
    unlinked = links.filter("ext_seq IS NOT NULL AND base_seq IS NULL").select("ext_seq", "base_seq", "status", F.explode(F.array(*map(F.lit, fields))).alias("field"), F.lit(0.0).alias("score"))
    alike = each.filter("same").withColumn("score", F.lit(1.0)).select(*out)
    scored = score_pairs(each.filter("NOT same"), "x", "y", score, "score", equal).select(*out)
    return scored.unionByName(alike).unionByName(unlinked)


#: Fixed value: decimals of a mean score. Doubles added up in another order differ below them, different means of common words above.
MEAN_DECIMALS = 14


def mean_score() -> Column:
    """Mean of ``score``, the same in whatever order rows arrive, so that a mean on a band's edge isn't now and then above it."""
    return F.round(F.avg("score"), MEAN_DECIMALS).alias("mean_score")


def row_means(scores: DataFrame) -> DataFrame:
    return scores.groupBy("ext_seq", "status").agg(mean_score())


#: What a category row is.
MATCHED, EXCESS, INVENTED, ABSENT = "Matched", "Non-existent (excess duplicate)", "Non-existent (LLM invention)", "Absent (not extracted)"


def categorize(links: DataFrame, scores: DataFrame, inventions: bool = True) -> DataFrame:
    """``ext_seq``, ``base_seq``, ``mean_score``, ``category``, ``type``: the band of linked rows, 'Non-existent' for unlinked ones (if ``inventions``), 'Absent' for unused baseline rows.

    ``type`` parts unlinked rows into those whose counterpart was used up and those without one.
    """
    means = scores.groupBy("ext_seq").agg(mean_score())
    joined = links.join(means, "ext_seq", "left")
    absent, unlinked = F.col("status") == "ABSENT", F.col("base_seq").isNull()
    category = F.when(absent, "Absent").when(unlinked, "Non-existent").otherwise(band(F.col("mean_score")))
    kind = F.when(absent, ABSENT).when(unlinked & (F.col("status") == "UNMATCHED_EXCESS"), EXCESS).when(unlinked, INVENTED).otherwise(MATCHED)
    out = joined.select("ext_seq", "base_seq", "mean_score", category.alias("category"), kind.alias("type"))
    return out if inventions else out.filter("category <> 'Non-existent'")


def category_counts(categories: DataFrame, by: list[str]) -> DataFrame:
    """Per group one column for each category, and of the non-existent ones the ``excess`` and the ``invented``."""
    names = (*(b for b, _ in BANDS), LOWEST_BAND, "Non-existent", "Absent")
    columns = [F.count_if(F.col("category") == c).alias(c.lower().replace(" ", "_").replace("-", "_")) for c in names]
    columns += [F.count_if(F.col("type") == EXCESS).alias("excess"), F.count_if(F.col("type") == INVENTED).alias("invented")]
    return categories.groupBy(*by).agg(*columns)


#: Different values that a median's bracket may hold at most, before they are put in order.
BRACKET = 100_000


def column_stats(long: DataFrame, name: str = "field", value: str = "score", accuracy: int = 2000) -> DataFrame:
    """Per column ``matched``, ``avg_v``, ``std_v`` (sample; null for one row), ``min_v``, ``max_v``, ``median_v`` (exact).

    The median is found without any task holding a column's values: approximate quantiles give a bracket around the middle,
    which is narrowed again, on the values within it, until it has no more than BRACKET different ones or gets no smaller;
    only these are put in order.
    """
    seen = long.filter(F.col(value).isNotNull()).select(F.col(name).alias("__name"), F.col(value).alias("__v"))
    half = 4.0 / accuracy
    edges = F.percentile_approx(value, F.array(F.lit(max(0.0, 0.5 - half)), F.lit(min(1.0, 0.5 + half))), accuracy)
    moments = (F.count(value).alias("matched"), F.avg(value).alias("avg_v"), F.stddev_samp(value).alias("std_v"), F.min(value).alias("min_v"), F.max(value).alias("max_v"))
    stats = cut_lineage(long.groupBy(name).agg(*moments, edges.alias("__edges")))
    # one row per column, from here to the medians
    bounds = stats.filter("matched > 0").select(F.col(name).alias("__name"), F.col("matched").alias("__all"), F.col("__edges")[0].alias("__lo"), F.col("__edges")[1].alias("__hi"))
    most = None
    while True:
        within = seen.join(F.broadcast(bounds), "__name")
        inside = (F.col("__v") >= F.col("__lo")) & (F.col("__v") <= F.col("__hi"))
        sizes = cut_lineage(within.groupBy("__name", "__all", "__lo", "__hi").agg(F.count_if(F.col("__v") < F.col("__lo")).alias("__under"), F.count_if(inside).alias("__in"), F.approx_count_distinct(F.when(inside, F.col("__v"))).alias("__kinds")))
        largest = sizes.agg(F.max("__kinds")).first()[0] or 0
        if largest <= BRACKET or most is not None and largest >= most:
            break
        most = largest
        # where the middle is among the values of the bracket, and a narrower one around it
        rows = within.filter(inside).join(F.broadcast(sizes.select("__name", "__under", "__in")), "__name")
        grid = F.percentile_approx("__v", F.array(*(F.lit(i / 64) for i in range(65))), accuracy)
        places = rows.groupBy("__name", "__all", "__under", "__in").agg(grid.alias("__g"))
        at = (F.col("__all") / 2 - F.col("__under")) / F.col("__in") * 64
        bounds = cut_lineage(places.select("__name", "__all", F.col("__g")[F.greatest(F.floor(at - 1.5), F.lit(0)).cast("int")].alias("__lo"), F.col("__g")[F.least(F.ceil(at + 1.5), F.lit(64)).cast("int")].alias("__hi")))
    counted = within.filter(inside).groupBy("__name", "__v").agg(F.count(F.lit(1)).alias("__c")).join(F.broadcast(sizes.select("__name", "__all", "__under")), "__name")
    ranked = counted.withColumn("__upto", F.col("__under") + F.sum("__c").over(Window.partitionBy("__name").orderBy("__v")))
    lower, upper = F.floor((F.col("__all") + 1) / 2), F.floor(F.col("__all") / 2) + 1
    medians = ranked.groupBy("__name").agg(((F.min(F.when(F.col("__upto") >= lower, F.col("__v"))) + F.min(F.when(F.col("__upto") >= upper, F.col("__v")))) / 2).alias("median_v"))
    out = stats.join(medians, F.col(name).eqNullSafe(F.col("__name")), "left")
    return out.select(name, "matched", "avg_v", "std_v", "min_v", "max_v", "median_v")


def run_summary(links: DataFrame, categories: DataFrame, stats: DataFrame, description: str = "description") -> DataFrame:
    """One row of an extraction: totals, one column per category, mean of the column means, and the description's mean."""
    counts = category_counts(categories, [])
    totals = links.agg(F.count("ext_seq").alias("total"), F.count_if(F.col("ext_seq").isNotNull() & F.col("base_seq").isNotNull()).alias("matched"))
    means = stats.agg(F.avg("avg_v").alias("overall_mean"), F.max(F.when(F.col("field") == description, F.col("avg_v"))).alias("description_mean"))
    rows = totals.unionByName(counts, True).unionByName(means, True)
    return rows.agg(*(F.max(c).alias(c) for c in rows.columns))


def multiset_counts(found: DataFrame, expected: DataFrame, keys: list[str]) -> DataFrame:
    """Per key ``found``, ``expected``: how often it stands on either side."""
    a = found.groupBy(*keys).agg(F.count(F.lit(1)).alias("found"))
    b = expected.groupBy(*keys).agg(F.count(F.lit(1)).alias("expected"))
    return a.join(b, keys, "full_outer").fillna(0, ["found", "expected"])


def multiset_accuracy(counts: DataFrame) -> DataFrame:
    """``tp``, ``fp``, ``fn``, ``precision``, ``recall``, ``f1``, and ``found_pct``, ``invented_pct``, ``missing_pct`` of multisets; 0 where a denominator is 0."""
    sums = counts.agg(
        F.coalesce(F.sum(F.least("found", "expected")), F.lit(0)).alias("tp"),
        F.coalesce(F.sum(F.greatest(F.col("found") - F.col("expected"), F.lit(0))), F.lit(0)).alias("fp"),
        F.coalesce(F.sum(F.greatest(F.col("expected") - F.col("found"), F.lit(0))), F.lit(0)).alias("fn"),
    )
    return sums.withColumns({k: F.coalesce(F.try_divide(*v), F.lit(0.0)) for k, v in {"precision": (F.col("tp"), F.col("tp") + F.col("fp")), "recall": (F.col("tp"), F.col("tp") + F.col("fn")), "f1": (2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")), "found_pct": (100.0 * F.col("tp"), F.col("tp") + F.col("fn")), "invented_pct": (100.0 * F.col("fp"), F.col("tp") + F.col("fp")), "missing_pct": (100.0 * F.col("fn"), F.col("tp") + F.col("fn"))}.items()})


def surplus_and_deficit(counts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Keys that stand too often and keys that stand too seldom, with the difference."""
    diff = F.col("found") - F.col("expected")
    return counts.withColumn("diff", diff).filter("diff > 0"), counts.withColumn("diff", -diff).filter("diff > 0")


def token_totals(ledger: DataFrame, by: str = "llm") -> DataFrame:
    """Tokens in and out and calls per model, and of all (``by`` null)."""
    return ledger.rollup(by).agg(F.sum("tokens_input").alias("tokens_input"), F.sum("tokens_output").alias("tokens_output"), F.count(F.lit(1)).alias("calls"))


def token_cost(ledger: DataFrame, prices: dict[str, tuple[float, float]], by: str = "llm", unit: float = 1e6) -> DataFrame:
    """token_totals with ``cost``, by the given prices of ``unit`` tokens in and out per model; the last row (``by`` null) adds up.

    Models without a price cost nothing, as their tokens can't be valued; ``priced`` says so.
    """
    rates = F.create_map(*(F.lit(x) for k, (i, o) in prices.items() for x in (k, F.struct(F.lit(float(i)).alias("i"), F.lit(float(o)).alias("o"))))) if prices else F.lit(None).cast("map<string,struct<i:double,o:double>>")
    own = F.try_element_at(rates, F.col(by))
    cost = (F.coalesce("tokens_input", F.lit(0)) * own["i"] + F.coalesce("tokens_output", F.lit(0)) * own["o"]) / unit
    rows = ledger.withColumn("__cost", cost)
    return rows.rollup(by).agg(F.sum("tokens_input").alias("tokens_input"), F.sum("tokens_output").alias("tokens_output"), F.count(F.lit(1)).alias("calls"), F.coalesce(F.sum("__cost"), F.lit(0.0)).alias("cost"), (F.count("__cost") == F.count(F.lit(1))).alias("priced"))


def pivot_counts(df: DataFrame, rows: list[str], column: Column, values: list[str], total: str = "total") -> DataFrame:
    """Counts per row group and value, 0 where there are none, and their total; the values are given, so no extra pass finds them."""
    out = df.withColumn("__c", column).groupBy(*rows).pivot("__c", values).agg(F.count(F.lit(1))).fillna(0, values)
    sums = df.groupBy(*rows).agg(F.count(F.lit(1)).alias(total))
    key = [F.col(f"a.{r}").eqNullSafe(F.col(f"b.{r}")) for r in rows]
    cond = key[0]
    for k in key[1:]:
        cond = cond & k
    return out.alias("a").join(sums.alias("b"), cond).select(*(f"a.{r}" for r in rows), *(f"a.`{v}`" for v in values), f"b.{total}")


def severity_table(records: DataFrame, reports: DataFrame, severities: list[str]) -> DataFrame:
    """Records per (report, source) and severity, with total; reports without records are there with zeros. Ordered by total."""
    sev = F.upper(F.trim(F.coalesce("severity", F.lit("UNKNOWN"))))
    counted = [F.count_if(sev == s).alias(s) for s in severities]
    table = records.groupBy("report", "source").agg(*counted, F.count(F.lit(1)).alias("total"))
    empty = reports.select("report").distinct().join(records.select("report").distinct(), "report", "left_anti")
    zeros = empty.select("report", F.lit(None).cast("string").alias("source"), *(F.lit(0).cast("bigint").alias(s) for s in severities), F.lit(0).cast("bigint").alias("total"))
    return table.unionByName(zeros).orderBy(F.desc("total"), "report", "source")


def mean_heatmap(scores: DataFrame, row: str, column: str, value: str, columns: list[str]) -> DataFrame:
    return scores.groupBy(row).agg(*(F.avg(F.when(F.col(column) == c, F.col(value))).alias(c) for c in columns))


def spread_by_run(counts: DataFrame, groups: list[str], values: list[str]) -> DataFrame:
    """Sample deviation over the runs of a group, per value column."""
    return counts.groupBy(*groups).agg(*(F.stddev_samp(v).alias(f"std_{v}") for v in values))


def mean_and_spread(rates: DataFrame, models: DataFrame, group: str, value: str) -> DataFrame:
    """Mean and deviation of ``value`` per (group, llm), with a row of zeros for models that a group has no runs of."""
    stats = rates.groupBy(group, "llm").agg(F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"))
    every = models.agg(F.collect_set("llm")).scalar()  # a handful of models
    frame = rates.select(group).distinct().select(group, F.explode(every).alias("llm"))
    return frame.join(stats, [group, "llm"], "left").fillna(0.0, ["mean", "std"])


def category_shares(counts: DataFrame, group: str, category: str = "category", value: str = "n", outside: tuple[str, ...] = ("Non-existent",)) -> DataFrame:
    """Mean count per category over the runs, and its part of the group's sum; the ``outside`` categories don't count for the sum."""
    means = counts.filter(~F.col(category).isin(*outside)).groupBy(group, category).agg(F.avg(value).alias("mean_n"))
    total = F.sum("mean_n").over(Window.partitionBy(group))
    return means.withColumn("share", F.coalesce(F.try_divide("mean_n", total), F.lit(0.0)))


def run_times(runs: DataFrame, start: str, end: str, group: str) -> DataFrame:
    """Runs and seconds per group."""
    return runs.groupBy(group).agg(F.count(F.lit(1)).alias("runs"), F.sum(F.col(end).cast("double") - F.col(start).cast("double")).alias("seconds"))


def with_zero_columns(stats: DataFrame, fields: list[str]) -> DataFrame:
    """Column statistics with a row of zeros for fields without any linked row."""
    spark = stats.sparkSession
    every = spark.range(1).select(F.explode(F.array(*map(F.lit, fields))).alias("field"))
    out = every.join(stats, "field", "left")
    none = F.coalesce("matched", F.lit(0)) == 0
    return out.select("field", *(F.when(none, F.lit(0).cast(kind)).otherwise(F.col(c)).alias(c) for c, kind in stats.dtypes if c != "field"))


@dataclass(frozen=True)
class Evaluation:
    """The tables of one evaluation: ``per_record`` (a column per field), ``summary`` (per field), ``categories``, ``mapping``, and ``overall`` (one row)."""

    per_record: DataFrame
    summary: DataFrame
    categories: DataFrame
    mapping: DataFrame
    overall: DataFrame


def evaluate(extraction: DataFrame, baseline: DataFrame, metric: str = "rouge", allow_duplicates: bool = False, scanner: str | None = None, fields: list[str] | None = None, backend: str = "none") -> Evaluation:
    """Compares an extraction with a baseline: links the records, scores the fields that both have, and gives all tables.

    Both need ``seq`` (unique) and ``Name``. metric 'rouge': ROUGE-L of the fields; 'semantic': the named ``backend`` of
    similarity.SEMANTIC, which then also decides among baseline rows of one name, by the mean of the fields and 0.5 for an
    equal port and protocol. ``allow_duplicates``: baseline records of one name all take part, else the first of each.
    """
    if metric not in ("rouge", "semantic"):
        raise ValueError(f"metric is 'rouge' or 'semantic', not {metric!r}")
    fields = fields if fields is not None else common_columns(extraction, baseline)
    if metric == "rouge":
        linkage = link_steps(extraction, baseline, scanner, allow_duplicates)
        scores = field_scores(linkage.links, extraction, baseline, fields)
    else:
        texts = [f"__t{i}" for i in range(len(fields))]
        with_texts = [df.withColumns({t: comparable(df, f) for t, f in zip(texts, fields)}) for df in (extraction, baseline)]
        linkage = link_steps(*with_texts, scanner, allow_duplicates, score=mean_field_score(texts, SEMANTIC[backend]), fields=tuple(texts))
        scores = field_scores(linkage.links, extraction, baseline, fields, lambda x, y: semantic_score(x, y, backend), None)
    scores = cut_lineage(scores)
    categories = categorize(linkage.links, scores)
    names = extraction.select(F.col("seq").alias("ext_seq"), "Name")
    suffix = "rouge_l" if metric == "rouge" else "semantic"
    status = F.when(F.col("base_seq").isNotNull(), "OK").otherwise(F.first("status"))
    per_record = scores.groupBy("ext_seq", "base_seq").agg(status.alias("status"), *(F.max(F.when(F.col("field") == f, F.col("score"))).alias(f"{f}_{suffix}") for f in fields)).join(names, "ext_seq")
    stats = cut_lineage(with_zero_columns(column_stats(scores.filter("base_seq IS NOT NULL")), fields))
    return Evaluation(per_record, stats, categories, mapping_debug(linkage), run_summary(linkage.links, categories, stats))


def summary_of_all(evaluations: dict[str, Evaluation]) -> DataFrame:
    """One row per extraction: ``extraction`` and its overall row."""
    out = None
    for name, e in evaluations.items():
        row = e.overall.select(F.lit(name).alias("extraction"), "*")
        out = row if out is None else out.unionByName(row)
    return out


#: The data of charts by kind: what is drawn is up to the caller.
CHARTS: dict[str, Callable[..., DataFrame]] = {
    "heatmap": mean_heatmap,
    "spread": spread_by_run,
    "mean_and_spread": mean_and_spread,
    "share": category_shares,
    "severity": severity_table,
    "errors": category_counts,
    "times": run_times,
}


def chart_data(kind: str, *tables: DataFrame, **options) -> DataFrame:  # noqa: ANN003
    """The rows behind a chart of a kind of CHARTS, from its tables and options."""
    if kind not in CHARTS:
        raise ValueError(f"no chart {kind!r}; there are {', '.join(sorted(CHARTS))}")
    return CHARTS[kind](*tables, **options)
