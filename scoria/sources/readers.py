"""Sources: text, JSON arrays, CSV, mappings, ledgers and named tables of a workbook."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scoria.functions.text import report_name
from scoria.schemas import RECORD_DDL
from scoria.session import path_exists, place_within, shipped


def read_text_files(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """Whole files: ``doc_id`` (file name), ``text``; folders are searched through."""
    return spark.read.text(path, wholetext=True, recursiveFileLookup=True, pathGlobFilter=glob).select(F.col("_metadata.file_name").alias("doc_id"), F.col("value").alias("text"))


def read_binary(spark: SparkSession, path: str, glob: str = "*.pdf") -> DataFrame:
    """``path`` and ``content`` of files, for a page parser."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(path).select("path", "content")


def read_record_files(spark: SparkSession, path: str, schema: T.StructType | str = RECORD_DDL) -> tuple[DataFrame, DataFrame]:
    """(records, files) of JSON arrays of records, one or many files.

    records: ``report`` from the file name and ``seq`` (from 1), the place by file name and place in the file, on any
    cluster. files: ``file``, ``records`` and ``error``: what isn't a list, or can't be read, has no records and says so.
    """
    ddl = schema if isinstance(schema, str) else ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)
    texts = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("file"), F.col("_metadata.file_path").alias("path"), "value")
    body = F.regexp_replace("value", r"^[\x{FEFF}\s]+", "")
    listed, readable = body.startswith("["), F.try_parse_json(body).isNotNull()
    items = F.when(listed & readable, F.from_json(body, f"array<struct<{', '.join(_struct_fields(ddl))}>>"))
    error = F.when(~readable, "can't be read").when(~listed, "must be a list")
    files = texts.select("file", F.coalesce(F.size(items), F.lit(0)).alias("records"), error.alias("error")).withColumn("records", F.greatest("records", F.lit(0)))
    each = texts.select("file", "path", F.posexplode(items).alias("__place", "r")).select("r.*", report_name(F.col("file")).alias("report"), "path", "__place")
    return place_within(each, [], ["path", "__place"], "seq").drop("path", "__place"), files


def _struct_fields(ddl: str) -> list[str]:
    return [f"`{f.name}`:{f.dataType.simpleString()}" for f in T.StructType.fromDDL(ddl)]


def read_records(spark: SparkSession, path: str, schema: T.StructType | str = RECORD_DDL) -> DataFrame:
    """The records of read_record_files; unreadable files and such that hold no list have no rows."""
    return read_record_files(spark, path, schema)[0]


def union_records(*frames: DataFrame) -> DataFrame:
    """All rows under the union of all columns, in order of appearance; what a side lacks is null."""
    out = frames[0]
    for df in frames[1:]:
        out = out.unionByName(df, allowMissingColumns=True)
    return out


def read_json_lines(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def read_csv(spark: SparkSession, path: str, sep: str = ",", encoding: str = "UTF-8") -> DataFrame:
    """Header names columns; all values are text; quotes are doubled within values."""
    return spark.read.options(header=True, sep=sep, encoding=encoding, multiLine=True, escape='"').csv(path)


def read_address_map(spark: SparkSession, path: str) -> DataFrame:
    """``file``, ``address`` of lines 'file: IP=address' or 'file: NOT FOUND' (null)."""
    line = F.col("value")
    pattern = r"^(.*?): (?:IP=(\S+)|NOT FOUND)\s*$"
    rows = spark.read.text(path).filter(line.rlike(pattern))
    return rows.select(F.regexp_extract(line, pattern, 1).alias("file"), F.nullif(F.regexp_extract(line, pattern, 2), F.lit("")).alias("address"))


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    """Token ledgers, JSON arrays in many files, with ``file``; invalid files are passed over."""
    schema = "block_idx int, chunk_text string, tokens_input bigint, tokens_output bigint"
    rows = spark.read.schema(schema).options(multiLine=True, mode="DROPMALFORMED", recursiveFileLookup=True, pathGlobFilter="*.json").json(path)
    return rows.withColumn("file", F.col("_metadata.file_name"))


def folder_key(path: Column) -> Column:
    """The last part of a path without case and marks."""
    last = F.element_at(F.split(F.regexp_replace(path, "/+$", ""), "/"), -1)
    return F.regexp_replace(F.lower(last), "[^a-z0-9]", "")


def result_dirs(listing: DataFrame, name: str) -> DataFrame:
    """Folders of ``listing`` (``path``) whose last part is ``name`` but for case and marks."""
    return listing.filter(folder_key(F.col("path")) == re.sub("[^a-z0-9]", "", name.lower()))


def resolve_dirs(names: DataFrame, listing: DataFrame, name: str = "name") -> DataFrame:
    """``names`` with the ``path`` of the folder that each names but for case and marks: the first by path, null if there is none."""
    first = listing.groupBy(folder_key(F.col("path")).alias("__key")).agg(F.min("path").alias("path"))
    keyed = names.withColumn("__key", F.regexp_replace(F.lower(F.col(name)), "[^a-z0-9]", ""))
    return keyed.join(first, "__key", "left").drop("__key")


def list_files(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """``path``, ``modified`` and ``size`` of files below a folder."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(path)
    return files.select("path", F.col("modificationTime").alias("modified"), F.col("length").alias("size"))


_NS = {"m": "http://schemas.openxmlformats.org/spreadsheetml/2006/main"}
_REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"


def sheet_rows(content: bytes) -> dict[str, list[list[str | None]]]:
    """The sheets of an XLSX file by name, as rows of cell texts; with the standard library only."""
    book = zipfile.ZipFile(io.BytesIO(content))
    shared: list[str] = []
    if "xl/sharedStrings.xml" in book.namelist():
        root = ElementTree.fromstring(book.read("xl/sharedStrings.xml"))
        shared = ["".join(t.text or "" for t in si.iter(f"{{{_NS['m']}}}t")) for si in root.findall("m:si", _NS)]
    rels = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(book.read("xl/_rels/workbook.xml.rels"))}
    out: dict[str, list[list[str | None]]] = {}
    for sheet in ElementTree.fromstring(book.read("xl/workbook.xml")).find("m:sheets", _NS):
        target = rels[sheet.get(_REL)].lstrip("/")
        root = ElementTree.fromstring(book.read(target if target.startswith("xl/") else f"xl/{target}"))
        rows = []
        for row in root.iter(f"{{{_NS['m']}}}row"):
            cells: list[str | None] = []
            for cell in row.findall("m:c", _NS):
                letters = re.sub("[0-9]", "", cell.get("r") or "")
                at = 0
                for ch in letters:
                    at = at * 26 + ord(ch) - 64
                while letters and len(cells) < at - 1:
                    cells.append(None)
                value = cell.find("m:v", _NS)
                if cell.get("t") == "s" and value is not None:
                    cells.append(shared[int(value.text)])
                elif cell.get("t") == "inlineStr":
                    cells.append("".join(t.text or "" for t in cell.iter(f"{{{_NS['m']}}}t")))
                else:
                    cells.append(value.text if value is not None else None)
            rows.append(cells)
        out[sheet.get("name")] = rows
    return out


def read_workbook(spark: SparkSession, path: str, sheet: str, columns: list[str], fallback: str | None = None) -> DataFrame:
    """A sheet of XLSX files, or of workbook folders' tables: ``path``, ``row_no`` and ``columns`` as text.

    A folder with a subfolder ``sheet`` is read as parquet. In files, a missing sheet is replaced by ``fallback``; missing
    columns are null.
    """
    if path_exists(spark, f"{path.rstrip('/')}/{sheet}"):
        return spark.read.parquet(f"{path.rstrip('/')}/{sheet}")
    schema = "path string, row_no int, " + ", ".join(f"`{c}` string" for c in columns)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for p, content in zip(pdf["path"], pdf["content"]):
                sheets = sheet_rows(bytes(content))
                rows = sheets.get(sheet) or sheets.get(fallback or "") or []
                head = {str(h): i for i, h in enumerate(rows[0])} if rows else {}
                for n, row in enumerate(rows[1:], 1):
                    out.append((p, n, *(row[head[c]] if c in head and head[c] < len(row) else None for c in columns)))
            yield pd.DataFrame(out, columns=["path", "row_no", *columns])

    return shipped(read_binary(spark, path, "*.xlsx")).mapInPandas(run, schema)
