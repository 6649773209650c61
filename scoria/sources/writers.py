"""Sinks: JSON, JSON Lines, CSV, TSV, workbooks (a folder of named tables, or XLSX by the standard library), reports."""

from __future__ import annotations

import json
import zipfile
from collections.abc import Callable, Iterable
from xml.sax.saxutils import escape

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scoria.functions.text import clock, ellipsis
from scoria.operators.datasets import header_order, or_placeholder, severity_counts, stringified
from scoria.operators.validate import require_named
from scoria.session import cut_lineage, modified_at
from scoria.sources.readers import read_records


def write_json_lines(df: DataFrame, path: str, fields: Iterable[str] | None = None) -> None:
    """One object a line, all fields in order, nulls written."""
    columns = [f"`{f}`" for f in fields] if fields else df.columns
    df.select(*columns).write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def write_json_array(df: DataFrame, path: str) -> int:
    """One indented JSON array in one file, row by row as partitions arrive; for results that one file is meant for."""
    n = 0
    with open(path, "w", encoding="utf-8") as f:
        f.write("[")
        for row in df.select(F.to_json(F.struct(*(f"`{c}`" for c in df.columns)), {"ignoreNullFields": "false"}).alias("j")).toLocalIterator():
            f.write(",\n" if n else "\n")
            f.write(json.dumps(json.loads(row.j), ensure_ascii=False, indent=2))
            n += 1
        f.write("\n]\n")
    return n


def write_csv(df: DataFrame, path: str, sep: str = ",", encoding: str = "UTF-8", array_sep: str = "; ", double_quotes_twice: bool = False) -> None:
    """Known columns first, all values as text; an empty input has a placeholder row. ``double_quotes_twice``: the older writer's escaping."""
    kinds = dict(df.dtypes)
    cells = [stringified(F.col(f"`{c}`"), kinds[c], array_sep) for c in header_order(df.columns)]
    if double_quotes_twice:
        cells = [F.replace(c, F.lit('"'), F.lit('""')) for c in cells]
    out = or_placeholder(df.select(*(c.alias(n) for c, n in zip(cells, header_order(df.columns)))))
    out.write.mode("overwrite").options(header=True, sep=sep, encoding=encoding, escape='"', emptyValue="", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False).csv(path)


def write_tsv(df: DataFrame, path: str) -> None:
    write_csv(df, path, sep="\t")


def metadata(df: DataFrame, converter: str) -> DataFrame:
    """The sidecar of an export: ``item``, ``value``: date, total, converter, and the count of each severity."""
    spark = df.sparkSession
    head = spark.range(1).select(F.explode(F.array(F.struct(F.lit("generated").alias("item"), F.date_format(F.current_timestamp(), "yyyy-MM-dd HH:mm:ss").alias("value")), F.struct(F.lit("converter").alias("item"), F.lit(converter).alias("value")))).alias("m")).select("m.*")
    total = df.agg(F.lit("total").alias("item"), F.count(F.lit(1)).cast("string").alias("value"))
    severities = severity_counts(df).select(F.concat(F.lit("severity "), "severity").alias("item"), F.col("n").cast("string").alias("value"))
    return head.unionByName(total).unionByName(severities)


def write_workbook(tables: dict[str, DataFrame], path: str) -> None:
    """A folder with one parquet table per sheet."""
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{path.rstrip('/')}/{name}")


def _column(n: int) -> str:
    out = ""
    while n:
        n, r = divmod(n - 1, 26)
        out = chr(65 + r) + out
    return out


def write_xlsx(tables: dict[str, DataFrame], path: str) -> None:
    """An XLSX file with one sheet per table, a frozen header row in bold on a dark ground, and wrapped cells; rows are streamed from the executors."""
    main = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
    rel = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as book:
        for n, df in enumerate(tables.values(), 1):
            with book.open(f"xl/worksheets/sheet{n}.xml", "w", force_zip64=True) as f:
                kinds = dict(df.dtypes)
                widths = "".join(f'<col min="{i}" max="{i}" width="{60 if kinds[c].startswith("array") else 24}" customWidth="1"/>' for i, c in enumerate(df.columns, 1))
                view = '<sheetViews><sheetView workbookViewId="0"><pane ySplit="1" topLeftCell="A2" activePane="bottomLeft" state="frozen"/></sheetView></sheetViews>'
                f.write(f'<worksheet xmlns="{main}">{view}<cols>{widths}</cols><sheetData>'.encode())
                rows = df.select(*(stringified(F.col(f"`{c}`"), kinds[c], "\n").alias(c) for c in df.columns)).toLocalIterator()
                for r, values in enumerate([df.columns], 1):
                    f.write(_row(r, values, 1))
                for r, values in enumerate(rows, 2):
                    f.write(_row(r, values, 0))
                f.write(b"</sheetData></worksheet>")
        sheets = "".join(f'<sheet name="{escape(name)}" sheetId="{n}" r:id="rId{n}"/>' for n, name in enumerate(tables, 1))
        book.writestr("xl/workbook.xml", f'<workbook xmlns="{main}" xmlns:r="{rel}"><sheets>{sheets}</sheets></workbook>')
        links = "".join(f'<Relationship Id="rId{n}" Type="{rel}/worksheet" Target="worksheets/sheet{n}.xml"/>' for n in range(1, len(tables) + 1))
        links += f'<Relationship Id="rId0" Type="{rel}/styles" Target="styles.xml"/>'
        package = "http://schemas.openxmlformats.org/package/2006"
        book.writestr("xl/_rels/workbook.xml.rels", f'<Relationships xmlns="{package}/relationships">{links}</Relationships>')
        book.writestr("xl/styles.xml", f'<styleSheet xmlns="{main}"><fonts count="2"><font/><font><b/><color rgb="FFFFFFFF"/></font></fonts><fills count="3"><fill><patternFill patternType="none"/></fill><fill><patternFill patternType="gray125"/></fill><fill><patternFill patternType="solid"><fgColor rgb="FF34495E"/></patternFill></fill></fills><borders count="1"><border/></borders><cellStyleXfs count="1"><xf/></cellStyleXfs><cellXfs count="2"><xf applyAlignment="1"><alignment vertical="top" wrapText="1"/></xf><xf fontId="1" fillId="2" applyFont="1" applyFill="1"/></cellXfs></styleSheet>')
        book.writestr("_rels/.rels", f'<Relationships xmlns="{package}/relationships"><Relationship Id="rId1" Type="{rel}/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        kinds_xml = "".join(f'<Override PartName="/xl/worksheets/sheet{n}.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/>' for n in range(1, len(tables) + 1))
        book.writestr("[Content_Types].xml", f'<Types xmlns="{package}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/><Override PartName="/xl/styles.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.styles+xml"/>{kinds_xml}</Types>')


def _row(r: int, values: Iterable[str], style: int) -> bytes:
    cells = "".join(f'<c r="{_column(i)}{r}" s="{style}" t="inlineStr"><is><t xml:space="preserve">{escape(_allowed(v or ""))}</t></is></c>' for i, v in enumerate(values, 1))
    return f'<row r="{r}">{cells}</row>'.encode("utf-8", "replace")


def _allowed(text: str) -> str:
    return "".join(c for c in text if c >= " " or c in "\t\n\r")


#: Writers by format name.
FORMATS: dict[str, Callable[[DataFrame, str], None]] = {
    "csv": lambda df, p: write_csv(df, p + ".csv"),
    "tsv": lambda df, p: write_tsv(df, p + ".tsv"),
    "json": lambda df, p: write_json_lines(df, p + ".jsonl"),
    "xlsx": lambda df, p: write_xlsx({"Vulnerabilities": df, "Metadata": metadata(df, "xlsx")}, p + ".xlsx"),
}


def write(df: DataFrame, path: str, formats: Iterable[str], check: bool = False) -> dict[str, str]:
    """Writes each format ('all' for every one, 'none' for none); returns what failed, by format. One failure doesn't stop the others.

    More than one format reads the rows from a copy, so the plan runs once. ``check``: all records must have a name.
    """
    names = list(FORMATS) if "all" in formats else [f for f in formats if f != "none"]
    failed = {}
    if check and names:
        require_named(df)
    if len(names) > 1:
        df = cut_lineage(df)
    for name in names:
        try:
            FORMATS[name](df, path)
        except Exception as e:  # noqa: BLE001
            failed[name] = str(e)
    return failed


def is_fresh(spark: SparkSession, source: str, target: str) -> bool:
    """Whether ``target`` is there and not older than ``source``, on whatever file systems they are."""
    made, changed = modified_at(spark, target), modified_at(spark, source)
    return made is not None and (changed is None or made >= changed)


def convert(spark: SparkSession, source: str, path: str, formats: Iterable[str], reuse: bool = True) -> dict[str, str]:
    """A JSON array of records to other formats in one call; formats that are there and not older than the source are kept."""
    endings = {"csv": ".csv", "tsv": ".tsv", "json": ".jsonl", "xlsx": ".xlsx"}
    names = list(FORMATS) if "all" in formats else [f for f in formats if f != "none"]
    due = [f for f in names if not (reuse and f in endings and is_fresh(spark, source, path + endings[f]))]
    return write(read_records(spark, source), path, due, check=True) if due else {}


def accuracy_report(accuracy: DataFrame) -> str:
    """Text of a one-row accuracy table."""
    r = accuracy.first()
    return "".join(f"{k}: {r[k]:.4f}\n" if isinstance(r[k], float) else f"{k}: {r[k]}\n" for k in ("tp", "fp", "fn", "precision", "recall", "f1"))


def removed_records(removed: DataFrame, stage: str = "description_filter", n: int = 100) -> DataFrame:
    """Audit rows of records that a stage removed: ``stage``, ``seq``, ``name`` (cut to ``n`` characters), ``severity``, ``port``."""
    return removed.select(F.lit(stage).alias("stage"), "seq", ellipsis(F.coalesce("Name", F.lit("")), n).alias("name"), "severity", "port")


def removed_log(removed: DataFrame, most: int = 1000) -> str:
    """Text of removed records: their number, and the first ``most`` with name, port, protocol, severity and what the description was."""
    text = F.regexp_replace(F.array_join("description", " ") if dict(removed.dtypes)["description"].startswith("array") else F.col("description"), "\n", " ")
    rows = removed.select("seq", F.coalesce("Name", F.lit("(no name)")).alias("Name"), *(F.coalesce(c, F.lit("")).alias(c) for c in ("port", "protocol", "severity")), ellipsis(F.trim(text), 200).alias("text"))
    total = removed.count()
    lines = ["REMOVED RECORDS", "Records without a valid description.", f"Total: {total}", ""]
    for i, r in enumerate(rows.orderBy("seq").limit(most).collect(), 1):
        lines += [f"{i}. {r.Name}", f"   port {r.port}, protocol {r.protocol}, severity {r.severity}"] + ([f"   description: {r.text}"] if r.text else [])
    return "\n".join(lines) + "\n"


def consolidation_log(report: DataFrame, groups: DataFrame, most: int = 50, members: DataFrame | None = None) -> str:
    """Text of a consolidation: records after each stage, and the ``most`` largest merged groups, with ``members`` (of group_members) if given."""
    stages = report.orderBy("stage_no").collect()
    lines = ["CONSOLIDATION"]
    if stages and "strategy" in report.columns:
        lines.append(f"strategy: {stages[0].strategy}")
    for r in stages:
        why = f" ({r.removed} removed: {r.reason})" if "reason" in report.columns and r.removed else ""
        lines.append(f"{r.stage}: {r.records}{why}")
    lines += ["", "LARGEST GROUPS"]
    largest = groups.orderBy(F.desc("size"), "key").limit(most)
    of: dict = {}
    if members is not None:
        # ``most`` groups of a few members each
        few = members.join(F.broadcast(largest.select(F.col("key").alias("__k"))), F.col("key").eqNullSafe(F.col("__k")), "left_semi")
        for m in few.orderBy("key", "place").collect():
            of.setdefault(m.key, []).append(f"  {m.place}. {m.Name or '(no name)'}: port {m.port or ''}, protocol {m.protocol or ''}, severity {m.severity or ''}")
    for r in largest.collect():
        lines.append(f"{r['size']} x {r.key or '(no name)'} (seq {r.first_seq} to {r.last_seq})")
        lines += of.get(r.key, [])
    return "\n".join(lines) + "\n"


def difference_workbook(more: DataFrame, less: DataFrame, path: str) -> None:
    """Two sheets: what stands too often and what is absent, from evaluate.surplus_and_deficit."""
    write_xlsx({"non-existent": more, "absent": less}, path)


def write_layout(summaries: DataFrame, path: str) -> None:
    """Summaries as text files, with a header line before each document's."""
    text = F.concat(F.lit("### "), F.col("doc_id").cast("string"), F.lit("\n"), F.coalesce("text", F.lit("")))
    summaries.filter("kind = 'summary'").select(text.alias("value")).write.mode("overwrite").text(path)


def evaluation_workbook(scores: DataFrame, summary: DataFrame, categories: DataFrame, mapping: DataFrame, path: str) -> None:
    """The four tables of an evaluation, as a folder of named tables."""
    write_workbook({"Per_Vulnerability": scores, "Summary": summary, "Categorization": categories, "Mapping_Debug": mapping}, path)


def final_report(times: DataFrame, tokens: DataFrame) -> str:
    """Text of an experiment's runs, seconds, tokens and, where ``tokens`` has it, cost per group; both tables have a row per group."""
    lines = ["RUNS"]
    total = 0.0
    for r in times.select(*times.columns, clock(F.col("seconds")).alias("clock")).collect():
        total += r.seconds or 0.0
        lines.append(f"{r[0]}: {r.runs} runs, {r.clock}")
    lines += [f"all: {total:.3f} s", "", "TOKENS"]
    priced = "cost" in tokens.columns
    lines += [f"{r[0] or 'all'}: {r.tokens_input} in, {r.tokens_output} out, {r.calls} calls" + (f", cost {r.cost:.2f}" if priced else "") for r in tokens.collect()]
    return "\n".join(lines) + "\n"


def write_token_ledger(ledger: DataFrame, path: str, run: str = "run_id") -> None:
    """A token ledger, one folder per run; a run that is written again replaces its own rows only.

    Rows are written beside the ledger and take their place when all are there, as the committer does.
    """
    ledger.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(run).parquet(path)


def write_summary(summary: DataFrame, path: str) -> None:
    """The rows of all extractions, see evaluate.summary_of_all, as one sheet."""
    write_xlsx({"Summary": summary}, path)


def append_ledger(spark: SparkSession, rows: list[dict], schema: str, path: str) -> None:
    """Adds rows to a run ledger; the latest row of a run counts when it is read."""
    spark.createDataFrame(rows, schema).write.mode("append").parquet(path)
