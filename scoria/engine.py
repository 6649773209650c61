"""From report texts to records, and from records to an evaluation, in one call each."""

from __future__ import annotations

from dataclasses import dataclass, replace
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scoria.operators import blocks, chunks, consolidate, datasets, evaluate, extract, pages, validate
from scoria.profiles import ModelProfile, Profile, profile
from scoria.session import cut_lineage
from scoria.sources import readers, writers


@dataclass(frozen=True)
class Extraction:
    """``records`` with ``seq`` and ``doc_id``; what had no valid description; the consolidation's report; tokens per call."""

    records: DataFrame
    removed: DataFrame
    report: DataFrame
    ledger: DataFrame


@dataclass(frozen=True)
class Engine:
    """An extraction's settings: the scanner's profile, the model's, a backend, and what to do beside.

    ``retry``: answers that don't hold are asked again. ``check``: records are validated. ``allow_duplicates``: sources
    without a strategy keep all records. ``aliases``: strategies by other names of sources.
    """

    backend: extract.Backend
    scanner: Profile
    model: ModelProfile = ModelProfile("local")
    retry: bool = False
    check: bool = False
    allow_duplicates: bool = False
    aliases: tuple[tuple[str, str], ...] = ()

    @classmethod
    def of(cls, scanner: str, backend: extract.Backend, **options: Any) -> Engine:
        return cls(backend, profile(scanner), **options)

    def blocks(self, docs: DataFrame) -> DataFrame:
        """Session blocks of whole report texts (``doc_id``, ``text``): summaries give the first block its context."""
        parts = pages.split_summary(docs.select("doc_id", "text"), self.scanner.reader)
        context = blocks.header_context(parts.filter("kind = 'summary'").select("doc_id", "text")) if self.scanner.reader == "openvas" else None
        return blocks.session_blocks(pages.body_text(parts), self.scanner.reader, context)

    def extract(self, docs: DataFrame) -> Extraction:
        """Records of report texts (``doc_id``, ``text``), in the order of documents, blocks, chunks and answers."""
        # a backend is asked once: what it says is written down
        found = cut_lineage(self.blocks(docs))
        cut = chunks.chunk_blocks(found, self.scanner, self.model.max_tokens, self.model.reserve_for_response, self.model.max_chunk_size)
        asked = chunks.build_prompt(cut, self.scanner.prompt)
        answers = cut_lineage(extract.call_backend(asked.select("doc_id", "block_id", "chunk_id", "text", "prompt"), self.backend, "prompt"))
        ledger = extract.token_ledger(answers)
        checked = extract.validate_answer(answers, self.model.max_tokens)
        if self.retry:
            checked = extract.retry_with_pairs(checked, self.backend, self.model.max_tokens, self.scanner)
        each = extract.records_of(checked.withColumn("piece_no", F.lit(-1)) if not self.retry else checked, ("doc_id", "block_id", "chunk_id", "piece_no"))
        full = extract.inherit_header(each, found.select("doc_id", "block_id", "port", "protocol", "severity"))
        order = ["doc_id", "block_id", "chunk_id", "piece_no", "item_no"]
        rows = datasets.numbered(full, [F.col(c) for c in order], "seq").drop(*order[1:])
        rows = validate.validator_for(self.scanner)(rows) if self.check and not self.scanner.asset_records else rows
        rows = cut_lineage(rows)
        # each document is a run of its own
        kept, report = consolidate.consolidate(rows, self.scanner, self.allow_duplicates, dict(self.aliases), by=("doc_id",))
        _, removed = validate.with_description(rows, self.scanner.description_field)
        return Extraction(kept, removed, report, ledger)

    def batch(self, spark: SparkSession, folder: str, out: str, glob: str = "*.txt") -> DataFrame:
        """All report texts of a folder in one plan: records as JSON Lines below ``out``, a folder per report, and a row per report in ``out``'s ledger, which is returned.

        ledger: ``run_id`` (the file), ``status`` ('ok', or 'empty' without records), ``records``, ``tokens_input``, ``tokens_output``, ``run_at``.
        """
        docs = readers.read_text_files(spark, folder, glob)
        extraction = self.extract(docs)
        records = cut_lineage(extraction.records)
        records.withColumn("report", F.col("doc_id")).drop("doc_id").write.mode("overwrite").option("ignoreNullFields", "false").partitionBy("report").json(f"{out.rstrip('/')}/records")
        tokens = extraction.ledger.groupBy("doc_id").agg(F.sum("tokens_input").alias("tokens_input"), F.sum("tokens_output").alias("tokens_output"))
        rows = docs.select("doc_id").join(records.groupBy("doc_id").agg(F.count(F.lit(1)).alias("records")), "doc_id", "left").join(tokens, "doc_id", "left")
        status = F.when(F.col("records").isNull(), "empty").otherwise("ok")
        rows = rows.select(F.col("doc_id").alias("run_id"), status.alias("status"), *(F.coalesce(c, F.lit(0).cast("bigint")).alias(c) for c in ("records", "tokens_input", "tokens_output")), F.current_timestamp().alias("run_at"))
        rows.write.mode("append").parquet(f"{out.rstrip('/')}/ledger")
        return spark.read.parquet(f"{out.rstrip('/')}/ledger")

    def run(self, docs: DataFrame, path: str, formats: tuple[str, ...] = ("json",), baseline: DataFrame | None = None, metric: str = "rouge") -> tuple[Extraction, evaluate.Evaluation | None, dict[str, str]]:
        """Extracts, writes the records in the formats, and evaluates them if there is a baseline: (extraction, evaluation, formats that failed)."""
        formats = validate.check_arguments(baseline is not None, baseline, formats, docs)
        extraction = self.extract(docs)
        extraction = replace(extraction, records=cut_lineage(extraction.records))
        failed = writers.write(extraction.records, path, formats)
        result = evaluate.evaluate(extraction.records, baseline, metric, self.allow_duplicates, "openvas" if self.scanner.reader == "openvas" else None) if baseline is not None else None
        return extraction, result, failed
