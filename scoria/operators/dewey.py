"""Deeply nested answers to related flat tables, by Dewey labels.

Each node of an answer's tree gets a label: the places of its ancestors and its own, joined by dots. A node's parent has
the label without its last part, so links need no ids made up and no shuffle; nodes are put into tables by their schema
path. One pass over the answers gives all nodes; a table is a filter on it.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scoria.schemas import RECORD_FIELDS, TEXT_ARRAYS
from scoria.session import cut_lineage, shipped

#: Schema paths of the tables, and the child names that they have in results.
TABLES = {
    "record": "records",
    "record/instances": "instances",
    "record/references": "references",
    "record/plugin_details": "plugin_details",
    "record/instances/headers": "headers",
}
#: Nested fields of a record that become tables of their own.
CHILDREN = ("instances", "references", "plugin_details")
_DECODER = json.JSONDecoder()
#: What may begin a JSON list or object; prose in braces doesn't look like an object.
_OPENING = re.compile(r"[\[{]")
_OBJECT = re.compile(r'\{\s*(?:$|["}])')
_SPACE = re.compile(r"\s*")


def _breaks_off(raw: str, at: int) -> bool:
    """Whether the list or object beginning at ``at``, which doesn't decode, is an incomplete one and not prose in brackets.

    A list is followed item by item: it is incomplete if the text ends within it, or if something structured stands in it
    before what can't be read, or is that itself. ``[1, 2 and more]`` is prose.
    """
    if raw[at] == "{":
        return bool(_OBJECT.match(raw, at))
    structured, pos = False, at + 1
    while True:
        pos = _SPACE.match(raw, pos).end()
        if pos == len(raw) or raw[pos] == '"' and raw.find('"', pos + 1) < 0:
            return True
        try:
            value, pos = _DECODER.raw_decode(raw, pos)
        except RecursionError:
            return True
        except ValueError:
            if structured or raw[pos] not in "[{":
                return structured
            if raw[pos] == "{":
                return bool(_OBJECT.match(raw, pos))
            pos += 1  # a list within the list: it decides
            continue
        structured |= isinstance(value, (dict, list))
        pos = _SPACE.match(raw, pos).end()
        if pos == len(raw):
            return True
        if raw[pos] != ",":
            return structured
        pos += 1


def answer_json(raw: str | None) -> Any:
    """The JSON list or object of an answer, fenced or within prose or alone; None where there is none or it is incomplete.

    Of the places where one may begin the first counts that decodes to an object or to a list with anything structured in
    it (a mark like ``[1]`` in prose is passed over), or else to an empty list. A list or object that breaks off makes the
    answer incomplete, whatever its first items are: its inner parts are not taken for answers.
    """
    if not raw:
        return None
    pos, fallback = 0, None
    while m := _OPENING.search(raw, pos):
        at = m.start()
        try:
            value, end = _DECODER.raw_decode(raw, at)
        except (ValueError, RecursionError):
            if _breaks_off(raw, at):
                return None
            pos = at + 1
            continue
        if isinstance(value, dict) or any(isinstance(x, (dict, list)) for x in value):
            return value
        if fallback is None:
            fallback = value
        pos = end
    return fallback


def record_list(answer: Any) -> list[Any]:
    """The list whose places number the records: the answer itself, the list that an object holds, or the lone record.

    Of an object's lists the one named vulnerabilities comes first, then the first with an object that has a Name.
    """
    if isinstance(answer, list):
        return answer
    if not isinstance(answer, dict):
        return []
    if answer.get("Name") is not None:
        return [answer]
    lists = [v for v in answer.values() if isinstance(v, list)]
    named = answer.get("vulnerabilities")
    if isinstance(named, list):
        return named
    return next((v for v in lists if any(isinstance(x, dict) and x.get("Name") is not None for x in v)), lists[0] if lists else [])


def unwrapped(value: Any) -> Any:
    """A nested field's value; where it is itself the text of a JSON list or object, what that text holds."""
    if isinstance(value, str) and value.strip()[:1] in ("[", "{"):
        try:
            return json.loads(value)
        except (ValueError, RecursionError):
            return value
    return value


def _is_node(value: Any) -> bool:
    if isinstance(value, str):
        return bool(value.strip())
    return isinstance(value, dict) and any(v is not None for v in value.values())


def _places(value: Any) -> list[tuple[int, Any]]:
    """Children with their places; a single child in place of a list has place 0."""
    value = unwrapped(value)
    found = enumerate(value) if isinstance(value, list) else [(0, value)]
    return [(i, v) for i, v in found if _is_node(v)]


def nodes_of(raw: str | None) -> Iterator[tuple[str, str, Any]]:
    """(label, schema path, value) of an answer's records, in order, and of all their children."""
    for i, record in enumerate(record_list(answer_json(raw))):
        if not isinstance(record, dict) or record.get("Name") is None:
            continue
        yield str(i), "record", {k: v for k, v in record.items() if k not in CHILDREN}
        for field in CHILDREN:
            for j, child in _places(record.get(field)):
                rest = child
                info = unwrapped(child.get("http_info")) if field == "instances" and isinstance(child, dict) else None
                if isinstance(info, dict):
                    rest = {k: v for k, v in child.items() if k != "http_info"} | {k: v for k, v in info.items() if k != "response_headers"}
                yield f"{i}.{j}", f"record/{field}", rest
                if isinstance(info, dict):
                    for k, header in _places(info.get("response_headers")):
                        yield f"{i}.{j}.{k}", "record/instances/headers", header


def label_nodes(df: DataFrame, id_col: str = "response_id", raw: str = "raw") -> DataFrame:
    """One row per node: ``id``, ``label``, ``parent`` (null for records), ``path``, ``value`` (JSON text).

    Null, empty and incomplete answers, and lists without records, have no nodes. Values of any depth and size stay JSON
    text; repeated answers come out each under their own id. No shuffle; other columns of ``df`` are not read.
    """
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = [(i, label, path, json.dumps(value, ensure_ascii=False)) for i, text in zip(pdf.iloc[:, 0], pdf.iloc[:, 1]) for label, path, value in nodes_of(text)]
            yield pd.DataFrame(out, columns=["id", "label", "path", "value"])

    nodes = shipped(df).filter(F.col(raw).isNotNull()).select(F.col(id_col).alias("id"), F.col(raw).alias("raw")).mapInPandas(run, f"id {kind}, label string, path string, value string")
    parent = F.when(F.instr("label", ".") > 0, F.regexp_replace("label", r"\.[0-9]+$", ""))
    return nodes.select("id", "label", parent.alias("parent"), "path", "value")


def child_rows(nodes: DataFrame) -> DataFrame:
    """The children of records by their labels: ``id``, ``rec_no``, ``child``, ``child_no``, ``sub_no`` (-1 above headers)."""
    part = F.split("label", r"\.")
    name = F.element_at(F.create_map(*(F.lit(x) for kv in TABLES.items() for x in kv)), F.col("path"))
    below = nodes.filter(F.col("path") != "record")
    return below.select("id", F.get(part, F.lit(0)).cast("int").alias("rec_no"), name.alias("child"), F.get(part, F.lit(1)).cast("int").alias("child_no"), F.coalesce(F.get(part, F.lit(2)).cast("int"), F.lit(-1)).alias("sub_no"))


#: Columns of the flat tables, all text but for the record's lists of texts; a reference or header that is a bare string is its ``value``.
COLUMNS = {
    "records": tuple(n for n, _ in RECORD_FIELDS if n not in CHILDREN),
    "instances": ("instance", "input_type", "input_name", "payload", "proof", "output", "request_method", "http_status_code", "http_protocol", "response_content_type"),
    "references": ("type", "value"),
    "plugin_details": ("publication_date", "modification_date", "family", "severity", "plugin_id"),
    "headers": ("name", "value"),
}


def flat_table(nodes: DataFrame, name: str) -> DataFrame:
    """One of the tables: ``id``, ``label``, ``parent``, the columns of COLUMNS, and ``extra``: all other fields of the node as JSON text.

    Missing fields are null; so is ``extra`` without other fields. Where a record's list of texts is one text or the text of
    a list, it is that list. The parent's row has (id, label) = (id, parent) in the table above.
    """
    path = next(p for p, n in TABLES.items() if n == name)
    mine = nodes.filter(F.col("path") == path)
    plain = F.col("value").startswith('"')
    fields = F.when(plain, F.create_map(F.lit("value"), F.from_json(F.concat(F.lit('{"value":'), "value", F.lit("}")), "value string")["value"])).otherwise(F.from_json("value", "map<string,string>"))
    rows = mine.select("id", "label", "parent", fields.alias("f"))
    columns = []
    for c in COLUMNS[name]:
        value = F.col("f")[c]
        if name == "records" and c in TEXT_ARRAYS:
            read = F.from_json(F.when(F.ltrim(value).startswith("["), value), "array<string>")
            value = F.coalesce(read, F.when(value.isNotNull(), F.array(value)))
        columns.append(value.alias(c))
    others = F.map_filter("f", lambda k, v: ~k.isin(*COLUMNS[name]))
    return rows.select("id", "label", "parent", *columns, F.when(F.size(others) > 0, F.to_json(others)).alias("extra"))


def flat_tables(df: DataFrame, id_col: str = "response_id", raw: str = "raw") -> dict[str, DataFrame]:
    """All tables by name. The answers are parsed once; the nodes are written down, and each table reads its part of them."""
    nodes = cut_lineage(label_nodes(df, id_col, raw))
    return {name: flat_table(nodes, name) for name in COLUMNS}
