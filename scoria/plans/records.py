"""Queries over extracted records: recovery, validation, consolidation, linkage, scores and tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scoria.functions import similarity as sim
from scoria.functions import text as t
from scoria.operators import consolidate as c
from scoria.operators import datasets, evaluate, extract, linkage, validate
from scoria.plans import oracles
from scoria.plans.texts import norm_name_sql, norm_port_sql, strip_sql, wild_sql
from scoria.profiles import PROFILES
from scoria.schemas import SEVERITY_ORDER
from scoria.session import cut_lineage, staging_folder, table
from scoria.sources import writers
from scoria.streaming import streams

#: The flat columns that oracles can list without the nested ones.
FLAT = ("seq", "Name", "port", "protocol", "severity", "plugin", "source", "report", "description", "solution", "references")


def _records(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    return table(spark, sf_dir, "records").select(*(f"`{x}`" for x in columns or FLAT))


def _of_model(spark: SparkSession, sf_dir: str, llm: str) -> DataFrame:
    """Records of the runs of one model, by the runs' latest ledger rows."""
    runs = linkage.latest_runs(table(spark, sf_dir, "run_ledger")).filter(F.col("llm") == llm).select("run_id")
    return table(spark, sf_dir, "records").join(runs, "run_id", "left_semi").select(*(f"`{x}`" for x in FLAT), "run_id")


def json_recover(spark: SparkSession, sf_dir: str) -> DataFrame:
    answers = table(spark, sf_dir, "responses").select("response_id", extract.recovered_list(F.col("raw")).alias("items"))
    return answers.select("response_id", F.coalesce(F.json_array_length("items"), F.lit(0)).alias("n_items"))


def answer_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers beside their block's text: validity, tokens, errors."""
    r = table(spark, sf_dir, "responses").select("response_id", "doc_id", "block_id", "raw")
    b = table(spark, sf_dir, "blocks").select("doc_id", "block_id", "text")
    out = extract.validate_answer(r.join(b, ["doc_id", "block_id"], "left"), 1500)
    return out.select("response_id", "json_valid", "token_valid", "token_count", "needs_redivision", F.array_join("errors", "; ").alias("errors"))


def retry_two_pass(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks whose answer has to be asked again, by the rule-based backend, piece by piece."""
    r = table(spark, sf_dir, "responses").select("doc_id", "block_id", "chunk_id", "raw").filter("doc_id IS NOT NULL")
    b = table(spark, sf_dir, "blocks").select("doc_id", "block_id", "text")
    answers = extract.validate_answer(r.join(b, ["doc_id", "block_id"]), 4096)
    out = extract.retry_redivided(answers, extract.rule_based, 4096, PROFILES["openvas"])
    return out.select("doc_id", "block_id", "chunk_id", "piece_no", F.json_array_length("items").alias("n_items"))


def rule_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings of every block by the rule-based backend, with headers inherited."""
    b = table(spark, sf_dir, "blocks")
    answered = extract.call_backend(b.select("doc_id", "block_id", F.lit(0).alias("chunk_id"), "text").filter("text IS NOT NULL"), extract.rule_based)
    found = extract.records_of(answered.withColumn("items", extract.recovered_list(F.col("raw"))))
    full = extract.inherit_header(found, b.select("doc_id", "block_id", "port", "protocol", "severity"))
    return full.select("doc_id", "block_id", "item_no", "Name", "port", "protocol", "severity")


def inherit_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of the stored answers with port, protocol and severity of their blocks where they have none; those of unknown documents as they are."""
    r = table(spark, sf_dir, "responses").select("response_id", "doc_id", "block_id", "chunk_id", extract.recovered_list(F.col("raw")).alias("items"))
    found = extract.records_of(r, ("response_id", "doc_id", "block_id", "chunk_id"))
    full = extract.inherit_header(found, table(spark, sf_dir, "blocks").select("doc_id", "block_id", "port", "protocol", "severity"))
    return full.select("response_id", "item_no", "Name", "port", "protocol", "severity")


def token_ledger_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens in and out per model and in total, by the local counter, over answers and their blocks."""
    r = table(spark, sf_dir, "responses").select("doc_id", "block_id", "chunk_id", "raw")
    b = table(spark, sf_dir, "blocks").select("doc_id", "block_id", "text")
    runs = linkage.latest_runs(table(spark, sf_dir, "run_ledger")).select(F.col("run_id").alias("doc_id"), "llm")
    ledger = extract.token_ledger(r.join(b, ["doc_id", "block_id"])).join(runs, "doc_id")
    return evaluate.token_totals(ledger).withColumn("llm", F.coalesce("llm", F.lit("all")))


def token_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with costs, by prices of a million tokens in and out for some of the models."""
    r = table(spark, sf_dir, "responses").select("doc_id", "block_id", "chunk_id", "raw")
    b = table(spark, sf_dir, "blocks").select("doc_id", "block_id", "text")
    runs = linkage.latest_runs(table(spark, sf_dir, "run_ledger")).select(F.col("run_id").alias("doc_id"), "llm")
    ledger = extract.token_ledger(r.join(b, ["doc_id", "block_id"])).join(runs, "doc_id")
    out = evaluate.token_cost(ledger, {"gpt4": (3.0, 12.0), "gpt5": (2.5, 20.0), "llama4": (1.0, 3.5)})
    return out.withColumns({"llm": F.coalesce("llm", F.lit("all")), "cost": F.round("cost", 6)})


def validated_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = validate.validate_records(_records(spark, sf_dir))
    return out.groupBy("severity", "source").agg(F.count(F.lit(1)).alias("n"), F.sum(F.size("description")).alias("texts"))


#: How asset_records writes each field: a column of records, or a constant; and as what it is written.
ASSET_SOURCES = {
    "id": "CAST(seq AS STRING)", "asset.name": "report", "asset.display_fqdn": "lower(report)", "asset.host_name": "report", "asset.operating_system": "source", "asset.system_type": "'Network Service'",
    "definition.name": "Name", "definition.severity": "severity", "definition.solution": "get(solution, 0)", "definition.id": "plugin", "definition.family": "plugin_details.family", "definition.type": "protocol",
    "definition.cve": "get(`references`, 0)", "definition.synopsis": "get(impact, 0)", "definition.plugin_published": "plugin_details.publication_date", "definition.patch_published": "plugin_details.modification_date",
    "definition.cvss3.base_score": "CAST(seq % 100 / 10.0D AS STRING)", "definition.epss.score": "CASE seq % 3 WHEN 0 THEN 'none' WHEN 1 THEN CAST(seq % 7 AS STRING) END", "definition.exploitability_ease": "port",
    "output": "get(detection_result, 0)", "port": "port", "protocol": "protocol", "scan.id": "run_id", "severity": "severity", "state": "CASE WHEN seq % 2 = 0 THEN 'OPEN' END", "age_in_days": "CASE seq % 4 WHEN 0 THEN 'unknown' WHEN 1 THEN CAST(seq AS STRING) WHEN 2 THEN '1.5' END",
}


def asset_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records written as asset findings, in all kinds of fields, and read back by the asset validator; fields that no record has are null."""
    r = table(spark, sf_dir, "records")
    written = [F.expr(x).alias(name) for name, x in ASSET_SOURCES.items()]
    written += [F.array_join("description", "\n").alias("definition.description"), F.col("references").alias("definition.references"), F.get("cvss", F.lit(0)).alias("definition.see_also"), F.col("seq").alias("definition.cvss2.base_score")]
    out = validate.validate_assets(r.select("seq", F.to_json(F.struct(*written)).alias("raw")))
    kinds = dict(out.dtypes)
    shown = [F.coalesce(F.size(F.col(f"`{n}`")), F.lit(-1)).alias(n.replace(".", "_") + "_n") if kinds[n].startswith("array") else F.col(f"`{n}`").alias(n.replace(".", "_")) for n in kinds if n != "seq"]
    return out.select("seq", *shown)


def description_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept, removed = validate.with_description(_records(spark, sf_dir))
    return c.stage_counts(kept=kept, removed=removed).drop("stage_no")


def integrity_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reports of the records, the inventory's addresses, and the addresses of the hosts that runs name."""
    reports = table(spark, sf_dir, "records").select(F.col("report").alias("container")).filter("report IS NOT NULL")
    inventory = table(spark, sf_dir, "inventory")
    baseline = table(spark, sf_dir, "run_ledger").join(inventory, F.col("extractor") == F.col("container")).select("ip")
    return validate.integrity(reports, inventory.select("container", "ip"), baseline, "container", "ip")


def dedup_most_complete(spark: SparkSession, sf_dir: str) -> DataFrame:
    return c.most_complete(_records(spark, sf_dir), "Name").select("seq", "Name", "place")


def dedup_composite(spark: SparkSession, sf_dir: str) -> DataFrame:
    return c.dedup_openvas(_records(spark, sf_dir).filter("source = 'OPENVAS'")).select("seq", "place")


def dedup_first_seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept, removed = c.first_seen(_records(spark, sf_dir), F.col("plugin"))
    return kept.select("seq", F.lit("kept").alias("outcome")).unionByName(removed.select("seq", F.lit("removed").alias("outcome")))


def merge_backfill(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = table(spark, sf_dir, "records").filter("source = 'TENABLEWAS'").select("seq", "run_id", "Name", "plugin", "description", "solution", "cvss", "references", "instances")
    merged = c.merge_tenable(r.withColumn("plugin", F.concat_ws("|", "run_id", "plugin")))
    return merged.select("seq", "Name", F.size("instances").alias("n_instances"), F.array_join("description", "|").alias("description"), F.array_join("solution", "|").alias("solution"))


def merge_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = _records(spark, sf_dir, "seq", "run_id", "Name", "severity", "port", "references", "source")
    merged = c.merge_group(r, [F.col("run_id"), F.col("Name"), F.col("source")])
    return merged.select("seq", "severity", "port", F.array_join("references", "|").alias("refs"))


def severity_max(spark: SparkSession, sf_dir: str) -> DataFrame:
    return c.highest_severity(_records(spark, sf_dir, "seq", "run_id", "severity"), ["run_id"])


def base_instances_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records with instances as instances records of their name, joined with the records without."""
    r = table(spark, sf_dir, "records").select("seq", "Name", "plugin", "severity", "instances")
    n = F.size("instances")
    named = r.withColumn("Name", F.when(n > 0, F.concat("Name", F.lit(" Instances ("), n.cast("string"), F.lit(")"))).otherwise(F.col("Name")))
    return c.base_and_instances(named).select("seq", "Name", "plugin", F.coalesce(F.size("instances"), F.lit(-1)).alias("n_instances"))


def pair_completeness(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = table(spark, sf_dir, "records").select("seq", "Name", "plugin", "instances")
    n = F.size("instances")
    named = r.withColumn("Name", F.when(n > 0, F.concat("Name", F.lit(" Instances ("), n.cast("string"), F.lit(")"))).otherwise(F.col("Name"))).drop("instances")
    out = extract.complete_pairs(named)
    return out.groupBy("base_name", "plugin").agg(F.count_if("is_instances").alias("instances_rows"), F.count_if(~F.col("is_instances")).alias("base_rows"))


def url_ports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ports of the instances' URLs, some of them written with a port, with another scheme, or without one."""
    urls = table(spark, sf_dir, "records").select("seq", F.explode("instances").alias("i")).select("seq", F.col("i.instance").alias("url"))
    host = F.regexp_extract("url", r"^\w+://([^/?#]*)", 1)
    rest = F.regexp_replace("url", r"^\w+://[^/?#]*", "")
    schemes = F.element_at(F.array(*map(F.lit, ("https://", "http://", "HTTP://", "ftp://", ""))), F.pmod("seq", F.lit(5)).cast("int") + 1)
    port = F.when(F.pmod(F.floor(F.col("seq") / 5), F.lit(3)) == 0, F.concat(F.lit(":"), (8000 + F.pmod("seq", F.lit(7))).cast("string"))).otherwise("")
    made = urls.select(F.concat(schemes, host, port, rest).alias("url"))
    return made.groupBy(extract.url_port(F.col("url")).alias("port")).agg(F.count(F.lit(1)).alias("n"))


def consolidation_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages of three sources' consolidation: one with a strategy, one by another name of a strategy, one without."""
    out = None
    for source, profile in (("OPENVAS", "openvas"), ("TENABLEWAS", "tenable"), ("NESSUS", "nessus")):
        _, report = c.consolidate(_records(spark, sf_dir).filter(F.col("source") == source), PROFILES[profile], aliases={"tenablewas": "tenable"}, source=source)
        report = report.select(F.lit(source).alias("source"), "stage", "records", "removed", "strategy", "reason")
        out = report if out is None else out.unionByName(report)
    return out


def scanner_detection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The kind of scanner that each source's records are taken to be from."""
    records = table(spark, sf_dir, "records").select("source", "Name")
    sources = sorted({r.source for r in records.select("source").distinct().collect() if r.source is not None})  # five sources
    out = None
    for s in sources:
        mine = records.filter(F.col("source") == s)
        row = mine.groupBy("source").agg(F.count(F.lit(1)).alias("n")).withColumn("scanner", F.lit(linkage.detect_scanner(mine)))
        out = row if out is None else out.unionByName(row)
    return out


def merged_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return c.merged_groups(_records(spark, sf_dir, "seq", "Name"), F.lower(F.trim("Name")))


def by_source_consolidation(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _records(spark, sf_dir, "seq", "Name", "port", "protocol", "severity", "source", "references")
    return c.consolidate_by_source(rows, aliases={"TENABLEWAS": "tenable"}).select("seq", "source", "severity", F.coalesce(F.size("references"), F.lit(-1)).alias("n_refs"))


def match_wildcard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct keys of one model's records against another's: best match, wildcards counted."""
    e = linkage.with_keys(_of_model(spark, sf_dir, "gpt4"), "openvas")
    b = linkage.with_keys(_of_model(spark, sf_dir, "llama4"), "openvas")
    return linkage.best_wildcard(e, b).select("ext_key", "base_key", F.round("score", 6).alias("score"))


def match_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, b = linkage.with_keys(_of_model(spark, sf_dir, "gpt4"), "openvas"), linkage.with_keys(_of_model(spark, sf_dir, "llama4"), "openvas")
    return linkage.exact_names(e, b).select("name_norm", F.when(F.col("known"), "both").otherwise("left").alias("side"))


def match_fuzzy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part names against each other's brand-mates: most alike other name within the brand, by edit ratio."""
    parts = table(spark, sf_dir, "part").select(F.col("p_brand").alias("brand"), F.concat_ws(" ", "p_name", "p_type").alias("name")).distinct()
    cands = parts.withColumn("rank", F.row_number().over(Window.partitionBy("brand").orderBy("name")))
    other = parts.withColumn("name", F.concat("name", F.lit(" x")))
    return linkage.fuzzy_names(other, cands, 0.85, "brand").withColumn("score", F.round("score", 6))


def match_fuzzy_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Record names that have no exact counterpart among the other model's, with the most alike one."""
    e = linkage.with_keys(_of_model(spark, sf_dir, "gpt4"), "openvas")
    b = linkage.with_keys(_of_model(spark, sf_dir, "llama4"), "openvas")
    rest = e.select(F.col("name_norm").alias("name")).distinct().join(b.select(F.col("name_norm").alias("name")), "name", "left_anti")
    cands = b.groupBy(F.col("name_norm").alias("name")).agg(F.min("seq").alias("rank"))
    return linkage.fuzzy_names(rest, cands).withColumn("score", F.round("score", 6))


def match_token_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names per host address with word order disregarded."""
    ip = table(spark, sf_dir, "inventory").select(F.col("container").alias("report"), "ip")
    e = _of_model(spark, sf_dir, "gpt4").join(ip, "report").select("ip", F.lower("Name").alias("name"))
    b = _of_model(spark, sf_dir, "llama4").join(ip, "report").select("ip", F.lower("Name").alias("name"))
    return linkage.blocked_token_sort(e, b).groupBy("ip", "matched_name").agg(F.count(F.lit(1)).alias("n"))


def assign_one_to_one(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = linkage.with_keys(_of_model(spark, sf_dir, "gpt4"), "openvas").withColumn("match_key", F.col("key"))
    b = linkage.with_keys(_of_model(spark, sf_dir, "llama4"), "openvas")
    return linkage.assign_by_key(e, b)


def anti_absent(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, b = linkage.with_keys(_of_model(spark, sf_dir, "gpt4"), "openvas"), linkage.with_keys(_of_model(spark, sf_dir, "llama4"), "openvas")
    return linkage.without_key(b, e).select("seq")


def _both_models(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Records of the two models that are linked; both are read several times, and the ledger once."""
    runs = cut_lineage(linkage.latest_runs(table(spark, sf_dir, "run_ledger").select("run_id", "run_at", "status", "llm")).filter(F.col("llm").isin("gpt4", "llama4")).select("run_id", "llm"))
    records = table(spark, sf_dir, "records")
    return tuple(records.join(runs.filter(F.col("llm") == llm).select("run_id"), "run_id", "left_semi").select(*(f"`{x}`" for x in FLAT)) for llm in ("gpt4", "llama4"))


def _linked(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    e, b = _both_models(spark, sf_dir)
    return linkage.link(e, b, "openvas", True), e, b


def link_mapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How each record of one model was matched with the other's, with the likeness of both names."""
    e, b = _of_model(spark, sf_dir, "gpt4").drop("run_id"), _of_model(spark, sf_dir, "llama4").drop("run_id")
    return linkage.mapping_debug(linkage.link_steps(e, b, "openvas", True)).withColumn("match_score", F.round("match_score", 6))


def link_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _linked(spark, sf_dir)[0]


def link_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean ROUGE-L of each linked record and its band."""
    links, e, b = _linked(spark, sf_dir)
    scores = evaluate.field_scores(links, e, b, ["description", "solution", "severity", "references"])
    return evaluate.categorize(links, scores).withColumn("mean_score", F.round("mean_score", 6))


def link_field_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    links, e, b = _linked(spark, sf_dir)
    scores = evaluate.field_scores(links.filter("base_seq IS NOT NULL"), e, b, ["description", "solution", "severity", "references"])
    stats = evaluate.column_stats(scores)
    return stats.select("field", "matched", *(F.round(c, 6).alias(c) for c in ("avg_v", "std_v", "min_v", "max_v", "median_v")))


def link_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row over a linked extraction: totals, categories, means."""
    links, e, b = _linked(spark, sf_dir)
    scores = cut_lineage(evaluate.field_scores(links, e, b, ["description", "solution", "severity", "references"]))
    stats = evaluate.column_stats(scores.filter("base_seq IS NOT NULL"))
    out = evaluate.run_summary(links, evaluate.categorize(links, scores), stats)
    return out.withColumns({c: F.round(c, 6) for c in ("overall_mean", "description_mean")})


def removed_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records without a description that says anything."""
    _, removed = validate.with_description(_records(spark, sf_dir))
    return writers.removed_records(removed, n=20)


def rouge_l_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole description of each record against the run's next record: common words and ROUGE-L."""
    r = table(spark, sf_dir, "records").select("seq", "run_id", F.coalesce(t.normalize_list(F.col("description")), F.lit("")).alias("x"))
    y = F.lead("x").over(Window.partitionBy("run_id").orderBy("seq"))
    pairs = r.withColumn("y", y).filter("y IS NOT NULL").select("seq", "x", "y", sim.lcs_tokens(F.col("x"), F.col("y")).alias("common"))
    # normalised text has single blanks; the score follows from the common words, which are counted once
    score = sim.field_score(F.col("x"), F.col("y"), lambda x, y: 2 * F.col("common") / (F.size(F.split(x, " ")) + F.size(F.split(y, " "))))
    return pairs.select("seq", "common", F.round(score, 6).alias("rouge"))


def score_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.groupBy(evaluate.band(F.col("value") / 100).alias("category")).agg(F.count(F.lit(1)).alias("n"))


def column_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    cols = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
    long = table(spark, sf_dir, "lineitem").select(*cols).unpivot([], cols, "field", "score")
    stats = evaluate.column_stats(long)
    return stats.select("field", "matched", *(F.round(x, 4).alias(x) for x in ("avg_v", "std_v", "min_v", "max_v", "median_v")))


def multiset_prf(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = ["report", "Name"]
    counts = evaluate.multiset_counts(_of_model(spark, sf_dir, "gpt4").select(*keys), _of_model(spark, sf_dir, "llama4").select(*keys), keys)
    out = evaluate.multiset_accuracy(counts)
    return out.select("tp", "fp", "fn", *(F.round(x, 6).alias(x) for x in ("precision", "recall", "f1", "found_pct", "invented_pct", "missing_pct")))


def multiset_surplus(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = ["report", "Name"]
    counts = evaluate.multiset_counts(_of_model(spark, sf_dir, "gpt4").select(*keys), _of_model(spark, sf_dir, "llama4").select(*keys), keys)
    more, less = evaluate.surplus_and_deficit(counts)
    return more.withColumn("side", F.lit("surplus")).unionByName(less.withColumn("side", F.lit("deficit"))).select("side", *keys, "diff")


def severity_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    reports = table(spark, sf_dir, "inventory").select(F.col("container").alias("report"))
    return evaluate.severity_table(_records(spark, sf_dir), reports, list(SEVERITY_ORDER))


def source_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.pivot_counts(_records(spark, sf_dir, "report", "source"), ["report"], F.col("source"), ["OPENVAS", "TENABLEWAS", "NESSUS", "QUALYS", "RAPID7"])


def heatmap(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").withColumn("dow", F.concat(F.lit("d"), F.dayofweek("ts").cast("string")))
    out = evaluate.mean_heatmap(e, "event_type", "dow", "value", [f"d{i}" for i in range(1, 8)])
    return out.select("event_type", *(F.round(f"d{i}", 6).alias(f"d{i}") for i in range(1, 8)))


def _run_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = linkage.latest_runs(table(spark, sf_dir, "run_ledger")).select("run_id", "llm", "scanner")
    r = table(spark, sf_dir, "records").groupBy("run_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.upper(F.trim("severity")) == "CRITICAL").alias("critical"))
    return r.join(runs, "run_id")


def run_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = evaluate.spread_by_run(_run_counts(spark, sf_dir), ["scanner", "llm"], ["n", "critical"])
    return out.select("scanner", "llm", F.round("std_n", 6).alias("std_n"), F.round("std_critical", 6).alias("std_critical"))


def run_mean_std(spark: SparkSession, sf_dir: str) -> DataFrame:
    rates = _run_counts(spark, sf_dir).withColumn("rate", F.col("critical") / F.col("n"))
    models = table(spark, sf_dir, "run_ledger").select("llm").filter("llm IS NOT NULL")
    out = evaluate.mean_and_spread(rates, models, "scanner", "rate")
    return out.select("scanner", "llm", F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"))


def category_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = table(spark, sf_dir, "events").groupBy("user_id", F.to_date("ts").alias("day"), F.col("event_type").alias("category")).agg(F.count(F.lit(1)).alias("n"))
    out = evaluate.category_shares(counts, "user_id", outside=("error",))
    return out.select("user_id", "category", F.round("mean_n", 6).alias("mean_n"), F.round("share", 6).alias("share"))


def run_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records' time from extraction to load, per scanner source."""
    out = evaluate.run_times(table(spark, sf_dir, "records"), "extracted_at", "loaded_at", "source")
    return out.select("source", "runs", F.round("seconds", 0).alias("seconds"))


def dataset_sort_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = datasets.numbered(_records(spark, sf_dir), [F.lower("Name"), F.col("seq")])
    return out.select("id", "seq", "Name")


def export_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = dict(_records(spark, sf_dir).dtypes)
    return _records(spark, sf_dir).select("seq", datasets.stringified(F.col("description"), kinds["description"]).alias("description"), datasets.stringified(F.col("port"), "string").alias("port"))


def dataset_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return datasets.dataset(table(spark, sf_dir, "records"))


def severity_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    return datasets.severity_counts(_records(spark, sf_dir))


def summary_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return datasets.summary_lines(_records(spark, sf_dir))


def report_address(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records per address, by report name or, where that is missing, the run's extractor; unmapped ones under null."""
    runs = linkage.latest_runs(table(spark, sf_dir, "run_ledger")).select("run_id", "extractor")
    r = table(spark, sf_dir, "records").select("seq", "run_id", "report").join(runs, "run_id", "left")
    dim = table(spark, sf_dir, "inventory").select(F.col("container").alias("key"), F.col("ip").alias("value"))
    found, missing = linkage.lookup_with_alternative(r, dim, "report", "extractor", "ip")
    return found.select("ip").unionByName(missing.select(F.lit(None).cast("string").alias("ip"))).groupBy("ip").agg(F.count(F.lit(1)).alias("n"))


def plan_resume(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Experiments still to run: hosts with a baseline, each scanner and model of interest, two runs; finished ones left out."""
    runs = table(spark, sf_dir, "run_ledger")
    bases = runs.select(F.regexp_replace("baseline", "_baseline$", "").alias("base")).filter("base IS NOT NULL").distinct()
    reports = table(spark, sf_dir, "inventory").select(F.col("container").alias("base"))
    plan, _, _ = linkage.experiment_plan(bases, reports, ["openvas", "nessus"], ["gpt4", "llama4"], 2)
    done = runs.withColumn("run_id", F.concat_ws("__", "extractor", "scanner", "llm", F.concat(F.lit("run"), F.col("run_num").cast("string"))))
    return linkage.unfinished(plan, done).select("run_id", "base", "scanner", "llm", "run_num")


def plan_unpaired(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hosts with a baseline but no report, and reports without a baseline."""
    bases = table(spark, sf_dir, "run_ledger").select(F.regexp_replace("baseline", "_baseline$", "").alias("base")).filter("base IS NOT NULL").distinct()
    reports = table(spark, sf_dir, "inventory").select(F.col("container").alias("base"))
    more = bases.unionByName(spark.createDataFrame([("no_such_host",)], "base string"))
    _, no_report, no_baseline = linkage.experiment_plan(more, reports, ["openvas"], ["gpt4"], 1)
    return no_report.select("base", F.lit("no report").alias("issue")).unionByName(no_baseline.select("base", F.lit("no baseline").alias("issue")))


def latest_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linkage.latest_runs(table(spark, sf_dir, "run_ledger")).select("run_id", F.lower(F.trim("status")).alias("status"), "run_at")


def model_of_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    models = [("gpt4", "gpt_4o"), ("gpt5", "gpt_5"), ("llama3", "llama_3"), ("llama4", "llama_4"), ("deepseek", "deepseek_coder")]
    files = table(spark, sf_dir, "run_ledger").select(t.model_key(F.concat_ws("-", "extractor", "llm")).alias("file_key"))
    return files.groupBy(linkage.model_cascade(F.col("file_key"), models).alias("model")).agg(F.count(F.lit(1)).alias("n"))


def first_existing_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per run the first of its possible outputs that another table has."""
    runs = table(spark, sf_dir, "run_ledger").select(F.col("run_id").alias("item")).distinct()
    cands = runs.select("item", F.posexplode(F.array(F.concat("item", F.lit(".xlsx")), F.concat("item", F.lit(".json")))).alias("priority", "path"))
    return linkage.first_existing(cands, table(spark, sf_dir, "run_ledger").select(F.col("output_file").alias("path")))


def semantic_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cosine of each vector with the mean vector of its label."""
    e = table(spark, sf_dir, "embeddings")
    parts = e.select("vec_id", "label", F.posexplode("embedding").alias("i", "x")).withColumn("x", F.col("x").cast("double"))
    mean = parts.groupBy("label", "i").agg(F.avg("x").alias("m"))
    both = parts.join(mean, ["label", "i"]).groupBy("vec_id").agg(F.sum(F.col("x") * F.col("m")).alias("xy"), F.sum(F.col("x") * F.col("x")).alias("xx"), F.sum(F.col("m") * F.col("m")).alias("yy"))
    return both.select("vec_id", F.round(F.try_divide("xy", F.sqrt(F.col("xx") * F.col("yy"))), 4).alias("score"))


def semantic_text_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The semantic score of each record's name and the run's next record's, by the stand-in backend, clamped and field by field as scores are."""
    r = table(spark, sf_dir, "records").select("seq", "run_id", F.col("Name").alias("x"))
    pairs = r.withColumn("y", F.lead("x").over(Window.partitionBy("run_id").orderBy("seq")))
    scored = sim.score_pairs(pairs, "x", "y", lambda a, b: sim.semantic_score(a, b, "token_cosine"))
    return scored.select("seq", F.round("score", 6).alias("score"))


def topk_per_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three most expensive items per return flag: a top-k report."""
    order = [F.desc("l_extendedprice"), *map(F.col, ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate"))]
    li = datasets.top_per_group(table(spark, sf_dir, "lineitem"), ["l_returnflag"], order, 3)
    return li.select("l_returnflag", "place", "l_orderkey", "l_extendedprice")


def stream_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = streams.windowed_counts(table(spark, sf_dir, "events"), size="6 hours")
    return out.select("window_start", "event_type", "n", F.round("total", 4).alias("total"))


def stream_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = streams.distinct_findings(table(spark, sf_dir, "records"))
    return r.agg(F.count(F.lit(1)).alias("n_findings"))


def _staged(spark: SparkSession) -> tuple[str, str]:
    """A place for a stream's result and one for its checkpoint."""
    folder = f"{staging_folder(spark)}/{uuid.uuid4().hex}"
    return f"{folder}/result", f"{folder}/checkpoint"


def stream_windows_live(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same windows, by a stream over the table's files that runs until all is read."""
    result, checkpoint = _staged(spark)
    streams.whole_result(streams.windowed_counts(streams.table_stream(spark, sf_dir, "events"), size="6 hours"), result, checkpoint)
    return spark.read.parquet(result).select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "event_type", "n", F.round("total", 4).alias("total"))


def stream_distinct_live(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same deduplication, by a stream with its state."""
    result, checkpoint = _staged(spark)
    stream = streams.table_stream(spark, sf_dir, "records").select("Name", "port", "protocol", "extracted_at")
    streams.run_once(streams.distinct_findings(stream), result, checkpoint)
    return spark.read.parquet(result).agg(F.count(F.lit(1)).alias("n_findings"))


def category_counts_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Categories of the linked extraction per source of its records, absent baseline records under theirs."""
    e, b = _both_models(spark, sf_dir)
    linked = linkage.link_steps(e, b, "openvas", True, along=("source",))
    cats = evaluate.categorize(linked.links, evaluate.field_scores(linked.links, e, b, list(oracles.FIELDS)))
    of_e, of_b = linked.resolved.select(F.col("seq").alias("ext_seq"), F.col("source").alias("__e")), linked.baseline.select(F.col("seq").alias("base_seq"), F.col("source").alias("__b"))
    sources = cats.join(of_e, "ext_seq", "left").join(of_b, "base_seq", "left")
    return evaluate.category_counts(sources.withColumn("source", F.coalesce("__e", "__b")), ["source"])


QUERIES: tuple[Callable[[SparkSession, str], DataFrame], ...] = (
    json_recover, answer_validation, retry_two_pass, rule_extraction, inherit_headers, token_ledger_totals, token_cost, validated_records, asset_records, description_filter, integrity_sets, dedup_most_complete, dedup_composite,
    dedup_first_seen, merge_backfill, merge_groups, severity_max, base_instances_join, pair_completeness, url_ports, consolidation_report, scanner_detection, merged_audit, by_source_consolidation, match_wildcard, match_exact, match_fuzzy,
    match_fuzzy_names, match_token_sort, assign_one_to_one, anti_absent, link_mapping, link_models, link_scores, link_field_stats, link_summary, removed_audit, rouge_l_pairs, score_bands, column_stats, multiset_prf, multiset_surplus, severity_pivot, source_pivot,
    heatmap, run_spread, run_mean_std, category_share, run_times, dataset_sort_id, export_cells, dataset_rows, severity_metadata, summary_lines, report_address, plan_resume, plan_unpaired, latest_ledger, model_of_file,
    first_existing_file, semantic_score, semantic_text_scores, topk_per_group, stream_windows, stream_distinct, stream_windows_live, stream_distinct_live, category_counts_by_source,
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in QUERIES}


_LATEST = "latest AS (SELECT * FROM run_ledger QUALIFY row_number() OVER (PARTITION BY run_id ORDER BY run_at DESC NULLS LAST, status DESC NULLS LAST) = 1)"


def _model_sql(llm: str) -> str:
    key = f"{norm_name_sql('Name')} || '|' || {norm_port_sql('port')} || '|' || {wild_sql('protocol')}"
    return f"(SELECT *, {norm_name_sql('Name')} AS name_norm, {key} AS key FROM records WHERE run_id IN (SELECT run_id FROM latest WHERE llm = '{llm}'))"


def _filled() -> str:
    texts = [f"(coalesce({x}, '') <> '')::INT" for x in ("Name", "port", "protocol", "severity", "plugin", "source", "report")]
    lists = [f"(coalesce(len({x}), 0) > 0)::INT" for x in ("description", "solution", '"references"')]
    return " + ".join(texts + lists)


def oracle_sql() -> dict[str, str]:
    e, b = _model_sql("gpt4"), _model_sql("llama4")
    words = r"len(regexp_extract_all({}, '[\p{{L}}\p{{N}}\p{{M}}_]+|[^\p{{L}}\p{{N}}\p{{M}}_\s]'))"
    rank = "CASE upper(trim(severity)) WHEN 'CRITICAL' THEN 4.0 WHEN 'HIGH' THEN 3.0 WHEN 'MEDIUM' THEN 2.0 WHEN 'LOW' THEN 1.0 WHEN 'INFO' THEN 0.5 ELSE 0.0 END"
    named = "(SELECT seq, plugin, severity, coalesce(len(instances), -1) AS k, Name AS base_name, coalesce(len(instances), -1) > 0 AS is_instances FROM records)"
    sev = "upper(trim(coalesce(severity, 'UNKNOWN')))"
    counts = f"WITH {_LATEST}, c AS (SELECT coalesce(x.report, y.report) AS report, coalesce(x.Name, y.Name) AS Name, coalesce(x.n, 0) AS f, coalesce(y.n, 0) AS e FROM (SELECT report, Name, count(*) AS n FROM {e} GROUP BY ALL) x FULL JOIN (SELECT report, Name, count(*) AS n FROM {b} GROUP BY ALL) y ON x.report = y.report AND x.Name = y.Name)"
    run_counts = f"WITH {_LATEST}, rc AS (SELECT r.run_id, llm, scanner, n, critical FROM (SELECT run_id, count(*) AS n, count(*) FILTER (upper(trim(severity)) = 'CRITICAL') AS critical FROM records GROUP BY run_id) r JOIN latest l ON r.run_id = l.run_id)"
    return oracles.oracle_sql() | {
        "token_ledger_totals": f"WITH {_LATEST}, t AS (SELECT l.llm, {words.format('text')} AS i, {words.format('raw')} AS o FROM responses r JOIN blocks b ON r.doc_id = b.doc_id AND r.block_id = b.block_id JOIN latest l ON l.run_id = r.doc_id) SELECT coalesce(llm, 'all') AS llm, sum(coalesce(i, 0)) AS tokens_input, sum(coalesce(o, 0)) AS tokens_output, count(*) AS calls FROM t GROUP BY ROLLUP (llm)",
        "validated_records": rf"SELECT CASE WHEN upper(severity) = 'INFO' THEN 'LOG' ELSE coalesce(severity, '') END AS severity, coalesce(source, '') AS source, count(*) AS n, sum(coalesce(len(description), 0)) AS texts FROM records WHERE {strip_sql('''coalesce(Name, '')''')} <> '' AND NOT regexp_matches({strip_sql('Name')}, '(?i)^\s*VULNERABILITY\s+(CRITICAL|HIGH|MEDIUM|LOW|INFO|LOG)\s+PLUGIN\s+ID\s+\d+') GROUP BY 1, 2",
        "asset_records": oracles.assets_sql(ASSET_SOURCES),
        "description_filter": f"WITH k AS (SELECT coalesce(len(list_filter(description, lambda x: length({strip_sql('x')}) > 0)), 0) > 0 AS ok FROM records) SELECT 'kept' AS stage, count(*) FILTER (ok) AS records FROM k UNION ALL SELECT 'removed', count(*) FILTER (NOT ok) FROM k",
        "removed_audit": f"""SELECT 'description_filter' AS stage, seq, CASE WHEN length(Name) > 20 THEN Name[1:20] || '...' ELSE coalesce(Name, '') END AS name, severity, port FROM records WHERE coalesce(len(list_filter(description, lambda x: length({strip_sql('x')}) > 0)), 0) = 0""",
        "integrity_sets": """WITH f AS (SELECT DISTINCT report AS k FROM records WHERE report IS NOT NULL), m AS (SELECT container AS k, ip FROM inventory), b AS (SELECT DISTINCT ip FROM run_ledger JOIN inventory ON extractor = container WHERE ip IS NOT NULL)
          SELECT 'file without mapping' AS issue, k AS value FROM f WHERE k NOT IN (SELECT k FROM m) UNION ALL SELECT 'mapping without file', k FROM (SELECT DISTINCT k FROM m) WHERE k NOT IN (SELECT k FROM f) UNION ALL SELECT 'address not found', k FROM m WHERE ip IS NULL
          UNION ALL SELECT DISTINCT 'address not in baseline', ip FROM m WHERE ip IS NOT NULL AND ip NOT IN (SELECT ip FROM b) UNION ALL SELECT 'baseline address not mapped', ip FROM b WHERE ip NOT IN (SELECT ip FROM m WHERE ip IS NOT NULL)
          UNION ALL SELECT 'address of several files', ip FROM m WHERE ip IS NOT NULL GROUP BY ip HAVING count(DISTINCT k) > 1""",
        "dedup_most_complete": f"SELECT seq, Name, place FROM (SELECT seq, Name, min(seq) OVER (PARTITION BY Name) AS place, row_number() OVER (PARTITION BY Name ORDER BY {_filled()} DESC, seq) AS r FROM records) WHERE r = 1",
        "dedup_composite": f"SELECT seq, place FROM (SELECT seq, min(seq) OVER w AS place, row_number() OVER (PARTITION BY {strip_sql('''coalesce(Name, '')''')}, port, protocol ORDER BY {_filled()} DESC, seq) AS r FROM records WHERE source = 'OPENVAS' WINDOW w AS (PARTITION BY {strip_sql('''coalesce(Name, '')''')}, port, protocol)) WHERE r = 1",
        "dedup_first_seen": "SELECT seq, CASE WHEN plugin IS NOT NULL AND row_number() OVER (PARTITION BY plugin ORDER BY seq) = 1 THEN 'kept' ELSE 'removed' END AS outcome FROM records",
        "merge_backfill": """WITH g AS (SELECT min(seq) AS seq, any_value(Name) AS Name, sum(coalesce(len(instances), 0)) AS n_instances, coalesce(arg_min(description, seq) FILTER (len(description) > 0), arg_min_null(description, seq)) AS d, coalesce(arg_min(solution, seq) FILTER (len(solution) > 0), arg_min_null(solution, seq)) AS s FROM records WHERE source = 'TENABLEWAS' GROUP BY run_id, plugin, records.Name)
          SELECT seq, Name, n_instances, array_to_string(d, '|') AS description, array_to_string(s, '|') AS solution FROM g""",
        "severity_max": f"SELECT run_id, upper(arg_min({strip_sql('severity')}, (-({rank}), seq))) AS highest FROM records WHERE severity IS NOT NULL GROUP BY run_id",
        "pair_completeness": f"SELECT base_name, plugin, count(*) FILTER (is_instances) AS instances_rows, count(*) FILTER (NOT is_instances) AS base_rows FROM {named} GROUP BY base_name, plugin HAVING count(DISTINCT is_instances) = 2",
        "url_ports": r"WITH u AS (SELECT seq, unnest(instances).instance AS u FROM records), v AS (SELECT ['https://', 'http://', 'HTTP://', 'ftp://', ''][seq % 5 + 1] || regexp_extract(u, '^\w+://([^/?#]*)', 1) || CASE WHEN (seq // 5) % 3 = 0 THEN ':' || (8000 + seq % 7) ELSE '' END || regexp_replace(u, '^\w+://[^/?#]*', '') AS u FROM u) SELECT TRY_CAST(coalesce(nullif(regexp_extract(u, '^\w+://[^/?#]*:(\d+)(?:[/?#]|$)', 1), ''), CASE lower(regexp_extract(u, '^(\w+)://', 1)) WHEN 'https' THEN '443' WHEN 'http' THEN '80' END) AS INT) AS port, count(*) AS n FROM v GROUP BY 1",
        "merged_audit": "SELECT lower(trim(Name)) AS key, count(*) AS size, min(seq) AS first_seq, max(seq) AS last_seq FROM records GROUP BY 1 HAVING count(*) > 1",
        "match_exact": f"WITH {_LATEST}, x AS (SELECT DISTINCT name_norm FROM {e}), y AS (SELECT DISTINCT name_norm FROM {b}) SELECT name_norm, CASE WHEN name_norm IN (SELECT name_norm FROM y) THEN 'both' ELSE 'left' END AS side FROM x",
        "match_wildcard": f"""WITH {_LATEST}, x AS (SELECT DISTINCT key, string_split(key, '|') AS p FROM {e}), y AS (SELECT key, string_split(key, '|') AS p, min(seq) AS s FROM {b} GROUP BY ALL)
          SELECT ext_key, base_key, round(score, 6) AS score FROM (SELECT x.key AS ext_key, y.key AS base_key, s, list_sum(list_transform(list_zip(x.p, y.p), lambda z: CASE WHEN z[1] = '*' OR z[2] = '*' THEN 0.3::DOUBLE WHEN z[1] = z[2] THEN 1.0 ELSE 0.0 END)) / len(x.p) AS score
          FROM x JOIN y ON len(x.p) = len(y.p) AND len(list_filter(list_zip(x.p, y.p), lambda z: NOT (z[1] = '*' OR z[2] = '*' OR z[1] = z[2]))) = 0) QUALIFY row_number() OVER (PARTITION BY ext_key ORDER BY score DESC, s) = 1""",
        "assign_one_to_one": f"WITH {_LATEST}, x AS (SELECT key, seq, row_number() OVER (PARTITION BY key ORDER BY seq) AS n FROM {e}), y AS (SELECT key, seq, row_number() OVER (PARTITION BY key ORDER BY seq) AS n FROM {b}) SELECT x.seq AS ext_seq, y.seq AS base_seq FROM x LEFT JOIN y ON x.key = y.key AND x.n = y.n",
        "anti_absent": f"WITH {_LATEST} SELECT seq FROM {b} WHERE key NOT IN (SELECT key FROM {e})",
        "score_bands": "SELECT CASE WHEN value / 100 > 0.7 THEN 'Highly Similar' WHEN value / 100 > 0.6 THEN 'Moderately Similar' WHEN value / 100 > 0.4 THEN 'Slightly Similar' ELSE 'Divergent' END AS category, count(*) AS n FROM events GROUP BY 1",
        "column_stats": " UNION ALL ".join(f"SELECT '{x}' AS field, count({x}) AS matched, round(avg({x}), 4) AS avg_v, round(stddev_samp({x}), 4) AS std_v, round(min({x}), 4) AS min_v, round(max({x}), 4) AS max_v, round(quantile_cont({x}, 0.5), 4) AS median_v FROM lineitem" for x in ("l_quantity", "l_extendedprice", "l_discount", "l_tax")),
        "multiset_prf": counts + ", s AS (SELECT sum(least(f, e)) AS tp, sum(greatest(f - e, 0)) AS fp, sum(greatest(e - f, 0)) AS fn FROM c) SELECT tp::BIGINT AS tp, fp::BIGINT AS fp, fn::BIGINT AS fn, round(tp / (tp + fp), 6) AS precision, round(tp / (tp + fn), 6) AS recall, round(2 * tp / (2 * tp + fp + fn), 6) AS f1, round(100 * tp / (tp + fn), 6) AS found_pct, round(100 * fp / (tp + fp), 6) AS invented_pct, round(100 * fn / (tp + fn), 6) AS missing_pct FROM s",
        "multiset_surplus": counts + " SELECT CASE WHEN f > e THEN 'surplus' ELSE 'deficit' END AS side, report, Name, abs(f - e) AS diff FROM c WHERE f <> e",
        "severity_pivot": f"""SELECT report, source, {', '.join(f"count(*) FILTER ({sev} = '{s}') AS {s}" for s in SEVERITY_ORDER)}, count(*) AS total FROM records GROUP BY report, source UNION ALL SELECT container, NULL, {', '.join('0' for _ in SEVERITY_ORDER)}, 0 FROM inventory WHERE container NOT IN (SELECT report FROM records WHERE report IS NOT NULL)""",
        "source_pivot": "SELECT report, " + ", ".join(f"count(*) FILTER (source = '{s}') AS {s}" for s in ("OPENVAS", "TENABLEWAS", "NESSUS", "QUALYS", "RAPID7")) + ", count(*) AS total FROM records GROUP BY report",
        "heatmap": "SELECT event_type, " + ", ".join(f"round(avg(value) FILTER (dayofweek(ts) + 1 = {i}), 6) AS d{i}" for i in range(1, 8)) + " FROM events GROUP BY event_type",
        "run_spread": run_counts + " SELECT scanner, llm, round(stddev_samp(n), 6) AS std_n, round(stddev_samp(critical), 6) AS std_critical FROM rc GROUP BY scanner, llm",
        "run_mean_std": run_counts + ", s AS (SELECT scanner, llm, avg(critical / n) AS m, stddev_samp(critical / n) AS d FROM rc GROUP BY scanner, llm), f AS (SELECT * FROM (SELECT DISTINCT scanner FROM rc), (SELECT DISTINCT llm FROM run_ledger WHERE llm IS NOT NULL)) SELECT f.scanner, f.llm, round(coalesce(m, 0), 6) AS mean, round(coalesce(d, 0), 6) AS std FROM f LEFT JOIN s ON f.scanner = s.scanner AND f.llm = s.llm",
        "category_share": "WITH c AS (SELECT user_id, CAST(ts AS DATE) AS day, event_type, count(*) AS n FROM events GROUP BY ALL), m AS (SELECT user_id, event_type AS category, avg(n) AS mean_n FROM c WHERE event_type <> 'error' GROUP BY ALL) SELECT user_id, category, round(mean_n, 6) AS mean_n, round(mean_n / sum(mean_n) OVER (PARTITION BY user_id), 6) AS share FROM m",
        "run_times": "SELECT source, count(*) AS runs, round(sum(epoch(loaded_at) - epoch(extracted_at)), 0) AS seconds FROM records GROUP BY source",
        "dataset_sort_id": "SELECT row_number() OVER (ORDER BY lower(Name), seq) AS id, seq, Name FROM records",
        "export_cells": "SELECT seq, coalesce(array_to_string(description, ';'), '') AS description, coalesce(port, '') AS port FROM records",
        "severity_metadata": "SELECT coalesce(severity, 'Unknown') AS severity, count(*) AS n FROM records GROUP BY 1",
        "report_address": f"WITH {_LATEST} SELECT coalesce(a.ip, b.ip) AS ip, count(*) AS n FROM records r LEFT JOIN latest l ON r.run_id = l.run_id LEFT JOIN inventory a ON a.container = r.report LEFT JOIN inventory b ON b.container = l.extractor GROUP BY 1",
        "plan_resume": """WITH b AS (SELECT DISTINCT regexp_replace(baseline, '_baseline$', '') AS base FROM run_ledger WHERE baseline IS NOT NULL), p AS (SELECT base FROM b WHERE base IN (SELECT container FROM inventory)),
          plan AS (SELECT base, scanner, llm, run_num, concat_ws('__', base, scanner, llm, 'run' || run_num) AS run_id FROM p, (VALUES ('openvas'), ('nessus')) s(scanner), (VALUES ('gpt4'), ('llama4')) m(llm), (VALUES (1), (2)) r(run_num)),
          d AS (SELECT concat_ws('__', extractor, scanner, llm, 'run' || run_num) AS run_id, status, run_at FROM run_ledger), l AS (SELECT * FROM d QUALIFY row_number() OVER (PARTITION BY run_id ORDER BY run_at DESC NULLS LAST, status DESC NULLS LAST) = 1)
          SELECT run_id, base, scanner, llm, run_num FROM plan WHERE run_id NOT IN (SELECT run_id FROM l WHERE lower(trim(status)) = 'ok')""",
        "plan_unpaired": "WITH b AS (SELECT DISTINCT regexp_replace(baseline, '_baseline$', '') AS base FROM run_ledger WHERE baseline IS NOT NULL UNION ALL SELECT 'no_such_host') SELECT base, 'no report' AS issue FROM b WHERE base NOT IN (SELECT container FROM inventory) UNION ALL SELECT container, 'no baseline' FROM inventory WHERE container NOT IN (SELECT base FROM b)",
        "latest_ledger": f"WITH {_LATEST} SELECT run_id, lower(trim(status)) AS status, run_at FROM latest",
        "first_existing_file": "SELECT item, path FROM (SELECT DISTINCT run_id AS item, x.path, x.p FROM run_ledger, LATERAL (SELECT run_id || '.xlsx' AS path, 0 AS p UNION ALL SELECT run_id || '.json', 1) x WHERE x.path IN (SELECT output_file FROM run_ledger)) QUALIFY row_number() OVER (PARTITION BY item ORDER BY p) = 1",
        "semantic_score": "WITH p AS (SELECT vec_id, label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i FROM embeddings), m AS (SELECT label, i, avg(x) AS m FROM p GROUP BY ALL) SELECT vec_id, round(sum(x * m) / sqrt(sum(x * x) * sum(m * m)), 4) AS score FROM p JOIN m USING (label, i) GROUP BY vec_id",
        "topk_per_group": "SELECT l_returnflag, place, l_orderkey, l_extendedprice FROM (SELECT *, row_number() OVER (PARTITION BY l_returnflag ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate) AS place FROM lineitem) WHERE place <= 3",
        "stream_windows": "SELECT time_bucket(INTERVAL 6 HOURS, ts) AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL",
        "stream_windows_live": "SELECT time_bucket(INTERVAL 6 HOURS, ts) AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL",
        "stream_distinct_live": f"SELECT count(*) AS n_findings FROM (SELECT DISTINCT {norm_name_sql('Name')}, coalesce(port, ''), lower(coalesce(protocol, '')) FROM records)",
        "stream_distinct": f"SELECT count(*) AS n_findings FROM (SELECT DISTINCT {norm_name_sql('Name')}, coalesce(port, ''), lower(coalesce(protocol, '')) FROM records)",
        "model_of_file": "SELECT CASE WHEN contains(k, 'gpt4') THEN 'gpt4' WHEN contains(k, 'gpt5') THEN 'gpt5' WHEN contains(k, 'llama3') THEN 'llama3' WHEN contains(k, 'llama4') THEN 'llama4' WHEN contains(k, 'deepseek') THEN 'deepseek' ELSE 'unknown' END AS model, count(*) AS n FROM (SELECT lower(translate(concat_ws('-', extractor, llm), '/:-.', '____')) AS k FROM run_ledger) GROUP BY 1",
    }
