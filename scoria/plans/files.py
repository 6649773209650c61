"""Queries through files: what is written is read again, over whole tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scoria.operators import extract, linkage
from scoria.plans.oracles import LATEST, WORDS
from scoria.session import staging_folder, table
from scoria.sources import readers, writers

FLAT = ("seq", "Name", "severity", "port", "protocol", "description", "references", "source")


def _place(spark: SparkSession) -> str:
    return f"{staging_folder(spark)}/{uuid.uuid4().hex}"


def _cells(spark: SparkSession, sf_dir: str, sep: str) -> DataFrame:
    path = _place(spark)
    writers.write_csv(table(spark, sf_dir, "records").select(*(f"`{c}`" for c in FLAT)), path, sep=sep)
    back = readers.read_csv(spark, path, sep=sep)
    return back.select(F.col("seq").cast("bigint").alias("seq"), *(F.coalesce(c, F.lit("")).alias(c) for c in ("Name", "severity", "port", "protocol", "source")), *(F.md5(F.coalesce(c, F.lit(""))).alias(f"{c}_md5") for c in ("description", "references")))


def csv_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records as comma-separated text and back: arrays joined, nulls empty, quotes and line ends kept."""
    return _cells(spark, sf_dir, ",")


def tsv_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cells(spark, sf_dir, "\t")


def json_lines_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records as JSON Lines with all fields and back, nested ones as they were."""
    records, path = table(spark, sf_dir, "records"), _place(spark)
    writers.write_json_lines(records, path)
    back = readers.read_json_lines(spark, path, records.schema)
    return back.select("seq", "Name", F.array_join("description", "|").alias("description"), F.coalesce(F.size("instances"), F.lit(-1)).alias("n_instances"), F.get("instances", F.lit(0))["http_status_code"].alias("first_code"), "plugin_details.family")


def workbook_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two tables as a workbook folder, each read by its name."""
    path = _place(spark)
    inventory = table(spark, sf_dir, "inventory")
    writers.write_workbook({"hosts": inventory, "risks": inventory.groupBy("risk_profile").agg(F.count(F.lit(1)).alias("n"))}, path)
    hosts = readers.read_workbook(spark, path, "hosts", []).select("container", "ip", "risk_profile")
    return hosts.unionByName(readers.read_workbook(spark, path, "risks", []).select(F.lit("all").alias("container"), F.col("n").cast("string").alias("ip"), "risk_profile"))


def ledger_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ledgers written by run, one run of each model replaced by an empty call, and read again."""
    answers = table(spark, sf_dir, "responses").select("doc_id", "block_id", "chunk_id", "raw").filter("doc_id IS NOT NULL")
    texts = table(spark, sf_dir, "blocks").select("doc_id", "block_id", "text")
    ledger = extract.token_ledger(answers.join(texts, ["doc_id", "block_id"])).withColumnRenamed("doc_id", "run_id")
    path = _place(spark)
    writers.write_token_ledger(ledger, path)
    runs = linkage.latest_runs(table(spark, sf_dir, "run_ledger")).groupBy("llm").agg(F.min("run_id").alias("run_id")).select("run_id")
    again = runs.join(ledger.select("run_id").distinct(), "run_id", "left_semi").select(F.lit(0).alias("block_id"), F.lit(0).alias("chunk_id"), F.lit(0).alias("tokens_input"), F.lit(0).alias("tokens_output"), "run_id")
    writers.write_token_ledger(again.select(*ledger.columns), path)
    return spark.read.parquet(path).groupBy("run_id").agg(F.count(F.lit(1)).alias("calls"), F.sum("tokens_input").alias("tokens_input"), F.sum("tokens_output").alias("tokens_output"))


def address_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The inventory as a text of addresses, and what is read from it; lines of other forms are passed over."""
    path = _place(spark)
    line = F.concat("container", F.lit(".pdf: "), F.coalesce(F.concat(F.lit("IP="), F.when(F.length("container") % 5 != 0, F.col("ip"))), F.lit("NOT FOUND")))
    lines = table(spark, sf_dir, "inventory").select(line.alias("value"))
    lines.unionByName(lines.limit(1).select(F.lit("no address here").alias("value"))).write.text(path)
    return readers.read_address_map(spark, path)


def folder_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Result folders by the names of baselines, but for case and marks."""
    names = table(spark, sf_dir, "run_ledger").select(F.col("baseline").alias("name")).distinct()
    spelt = F.concat(F.lit("results/"), F.upper(F.translate("container", "_", "-")), F.lit("--Baseline/"))
    folders = table(spark, sf_dir, "inventory").select(spelt.alias("path"))
    return readers.resolve_dirs(names, folders.unionByName(folders.select(F.concat(F.lit("z/"), "path").alias("path"))))


QUERIES: tuple[Callable[[SparkSession, str], DataFrame], ...] = (csv_round_trip, tsv_round_trip, json_lines_round_trip, workbook_round_trip, ledger_round_trip, address_map, folder_lookup)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in QUERIES}


def oracle_sql() -> dict[str, str]:
    cells = """SELECT seq, coalesce(Name, '') AS Name, coalesce(severity, '') AS severity, coalesce(port, '') AS port, coalesce(protocol, '') AS protocol, coalesce(source, '') AS source,
      md5(coalesce(array_to_string(description, '; '), '')) AS description_md5, md5(coalesce(array_to_string("references", '; '), '')) AS references_md5 FROM records"""
    key = "regexp_replace(lower({0}), '[^a-z0-9]', '', 'g')"
    return {
        "csv_round_trip": cells,
        "tsv_round_trip": cells,
        "json_lines_round_trip": "SELECT seq, Name, array_to_string(description, '|') AS description, coalesce(len(instances), -1) AS n_instances, instances[1].http_status_code AS first_code, plugin_details.family AS family FROM records",
        "workbook_round_trip": "SELECT container, ip, risk_profile FROM inventory UNION ALL SELECT 'all', count(*)::VARCHAR, risk_profile FROM inventory GROUP BY risk_profile",
        "ledger_round_trip": f"""WITH {LATEST}, l AS (SELECT r.doc_id AS run_id, coalesce({WORDS.format('text')}, 0) AS i, coalesce({WORDS.format('raw')}, 0) AS o FROM responses r JOIN blocks b ON r.doc_id = b.doc_id AND r.block_id = b.block_id),
          f AS (SELECT min(run_id) AS run_id FROM latest GROUP BY llm)
          SELECT run_id, CASE WHEN run_id IN (SELECT run_id FROM f) THEN 1 ELSE count(*) END AS calls, CASE WHEN run_id IN (SELECT run_id FROM f) THEN 0 ELSE sum(i) END AS tokens_input, CASE WHEN run_id IN (SELECT run_id FROM f) THEN 0 ELSE sum(o) END AS tokens_output FROM l GROUP BY run_id""",
        "address_map": "SELECT container || '.pdf' AS file, CASE WHEN length(container) % 5 <> 0 THEN ip END AS address FROM inventory",
        "folder_lookup": f"""WITH p AS (SELECT 'results/' || upper(translate(container, '_', '-')) || '--Baseline/' AS path, {key.format("container || 'baseline'")} AS k FROM inventory), f AS (SELECT k, min(path) AS path FROM p GROUP BY k)
          SELECT name, path FROM (SELECT DISTINCT baseline AS name FROM run_ledger) n LEFT JOIN f ON {key.format('n.name')} = f.k""",
    }
