"""Answers of an extraction backend: calls, tolerant JSON recovery, validation, retry and inherited attributes."""

from __future__ import annotations

import json
import re
import urllib.request
from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scoria.functions.text import base_name, instance_count, is_filled
from scoria.operators.blocks import HEADER
from scoria.operators.chunks import redivide, word_count
from scoria.profiles import PLUGIN_HEADER, Profile
from scoria.schemas import RECORD_FIELDS
from scoria.session import cut_lineage, ship_package, shipped

#: A backend gets prompts and gives answers; it is called once per batch, in a worker.
Backend = Callable[[list[str]], list[str]]
#: Fixed value: what stands in for a prompt template's tokens where there is no template.
TEMPLATE_TOKENS = 800
#: Words that an answer's introduction begins with.
INTRODUCTIONS = ("Here", "Based")
#: What an asset is, by scanner.
SYSTEM_TYPES = {"tenable": "Web Application", "openvas": "Network Service"}
#: Sections of a web scan and the record fields that they fill.
WEB_SECTIONS = {
    "description": "description",
    "solution": "solution",
    "risk information": "cvss",
    "reference information": "references",
    "plugin details": "plugin_details",
    "identification": "instances",
}
#: Fixed value: the line that gives a finding's severity and score.
SCORE_LINE = re.compile(r"(?i)^(Critical|High|Medium|Low|Log)\s*\(CVSS:\s*([\d.]+)\)")
#: Sections of a report and the record fields that they fill.
SECTIONS = {
    "summary": "description",
    "vulnerability detection result": "detection_result",
    "vulnerability detection method": "detection_method",
    "product detection result": "product_detection_result",
    "impact": "impact",
    "solution": "solution",
    "vulnerability insight": "insight",
    "log method": "log_method",
    "references": "references",
}


def rule_based(prompts: list[str]) -> list[str]:
    """A deterministic backend for OpenVAS-like text: name by NVT:, header for severity and port, score line for severity and CVSS, sections to fields.

    It approximates what a model does under the extraction rules; it isn't claimed to equal one.
    """
    head = re.compile(HEADER)
    out = []
    for text in prompts:
        records: list[dict[str, Any]] = []
        port = protocol = severity = field = score = None
        for line in (text or "").split("\n"):
            bare = line.strip()
            if m := head.match(bare):
                severity, port, protocol, field, score = m[1].upper(), m[2], m[3], None, None
            elif m := SCORE_LINE.match(bare):
                severity, score, field = m[1].upper(), m[2], None
            elif bare.startswith("NVT:"):
                records.append({"Name": bare[4:].strip(), "port": port, "protocol": protocol, "severity": severity, "source": "OPENVAS"} | ({"cvss": [score]} if score else {}))
                field = score = None
            elif bare.lower().rstrip(":") in SECTIONS:
                field = SECTIONS[bare.lower().rstrip(":")]
            elif bare and field and records:
                records[-1].setdefault(field, []).append(bare)
        out.append(json.dumps(records, ensure_ascii=False))
    return out


def rule_based_tenable(prompts: list[str]) -> list[str]:
    """The same for web-scan text: a finding begins with its plugin header, the next line that says something is its name.

    Findings of one name and plugin, with and without 'Instances (N)', become one record; URLs of the former are its instances.
    """
    head, detail = re.compile(f"(?i){PLUGIN_HEADER}"), re.compile(r"(?i)^(publication date|modification date|family|severity|plugin id)\s*:?\s+(.+)$")
    out = []
    for text in prompts:
        records: dict[tuple[str, str], dict[str, Any]] = {}
        mine: dict[str, Any] | None = None
        severity = plugin = section = ""
        named = True
        for line in (text or "").split("\n"):
            bare = line.strip()
            if m := head.search(bare):
                severity, plugin, named, mine, section = m[1].upper(), re.search(r"\d+", m[0][m.end(1) - m.start() :])[0], False, None, ""
            elif not bare:
                continue
            elif not named:
                named = True
                name = re.sub(r"\s*Instances \(\d+\)\s*$", "", bare)
                mine = records.setdefault((name, plugin), {"Name": name, "severity": severity, "plugin": plugin, "source": "TENABLEWAS", "instances": [], "plugin_details": {}})
            elif mine is None:
                continue
            elif bare.lower() in WEB_SECTIONS:
                section = WEB_SECTIONS[bare.lower()]
            elif bare.upper().startswith("CVSS"):
                mine.setdefault("cvss", []).append(bare)
            elif m := re.match(r"https?://\S+$", bare):
                mine["references" if section == "references" else "instances"] = [*mine.get("references" if section == "references" else "instances", []), bare if section == "references" else {"instance": bare}]
            elif section == "plugin_details" and (m := detail.match(bare)):
                mine["plugin_details"][m[1].lower().replace(" ", "_")] = m[2]
            elif section and section not in ("plugin_details", "instances"):
                mine.setdefault(section, []).append(bare)
        out.append(json.dumps(list(records.values()), ensure_ascii=False))
    return out


def http_backend(url: str, body: Callable[[str], dict], answer: Callable[[dict], str], headers: dict[str, str] | None = None, timeout: float = 120.0) -> Backend:
    """A backend that posts one request per prompt to an HTTP endpoint: ``body`` makes its JSON, ``answer`` takes the text from the reply's."""

    def ask(prompts: list[str]) -> list[str]:
        out = []
        for p in prompts:
            data = json.dumps(body(p)).encode("utf-8")
            request = urllib.request.Request(url, data, {"Content-Type": "application/json", **(headers or {})})  # noqa: S310
            with urllib.request.urlopen(request, timeout=timeout) as reply:  # noqa: S310
                out.append(answer(json.loads(reply.read())))
        return out

    return ask


def replay(answers: dict[str, str]) -> Backend:
    """A backend that gives recorded answers by prompt; unknown prompts get an empty list."""
    return lambda prompts: [answers.get(p, "[]") for p in prompts]


def call_backend(chunks: DataFrame, backend: Backend, prompt: str = "text", fail_fast: bool = False) -> DataFrame:
    """Adds ``raw`` and ``error``: one answer per row. A batch that fails is asked again row by row, and a row that fails has the error's text; with ``fail_fast`` quota, rate and time errors end the job."""
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in chunks.schema)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def ask(prompts: list[str]) -> list[tuple[str | None, str | None]]:
            try:
                return [(x, None) for x in backend(prompts)]
            except Exception as e:  # noqa: BLE001
                if fail_fast and re.search("quota|rate limit|timeout", str(e), re.I):
                    raise
                return [(None, str(e))] if len(prompts) == 1 else [a for p in prompts for a in ask([p])]

        for pdf in batches:
            answers = ask(pdf[prompt].tolist())
            yield pdf.assign(raw=[a for a, _ in answers], error=[e for _, e in answers])

    return shipped(chunks).mapInPandas(run, f"{fields}, raw string, error string")


def recovered_list(raw: Column) -> Column:
    """The JSON list text of an answer; '[]' if none is found.

    In order: the answer as a whole (a list; the list under ``vulnerabilities``; the first list whose first item has a
    Name - a readable object without one ends the search); what is between the first [ and the last ]; a fenced block;
    what follows an introduction of a few words.
    """
    ship_package()

    @F.pandas_udf(T.StringType())
    def recover(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: json.dumps(recover_json(t), ensure_ascii=False))

    return recover(raw)


def _read(text: str) -> tuple[bool, Any]:
    try:
        return True, json.loads(text)
    except (ValueError, RecursionError):
        return False, None


def recover_json(text: str | None) -> list[Any]:
    if not text:
        return []
    ok, value = _read(text)
    if ok and isinstance(value, list):
        return value
    if ok and isinstance(value, dict):
        if "vulnerabilities" in value:
            return value["vulnerabilities"] if isinstance(value["vulnerabilities"], list) else []
        return next((v for v in value.values() if isinstance(v, list) and v and isinstance(v[0], dict) and "Name" in v[0]), [])
    tries = [text[text.find("[") : text.rfind("]") + 1]]
    if (fence := re.search(r"```json(.*?)```", text, re.S)) is not None:
        tries.append(fence[1].strip())
    cleaned = text.strip()
    if cleaned.startswith(INTRODUCTIONS) and "[" in cleaned:
        tries.append(cleaned[cleaned.find("[") :])
    for candidate in tries:
        ok, value = _read(candidate) if candidate else (False, None)
        if ok and isinstance(value, list):
            return value
    return []


def validate_answer(df: DataFrame, max_tokens: int = 4096, template_tokens: int | None = None) -> DataFrame:
    """Adds ``items`` (JSON list text) and ``json_valid``, ``token_valid``, ``token_count``, ``errors``, ``needs_redivision``.

    From ``raw`` and ``text``. An empty list isn't valid. The answer is over budget within 500 tokens of the limit; a chunk
    with more than 60 % of it is to be divided anyway.
    """
    raw = F.coalesce("raw", F.lit(""))
    counts = F.lit(TEMPLATE_TOKENS if template_tokens is None else template_tokens) + word_count(F.col("text")) + word_count(raw)

    def uneven(opening: str, closing: str) -> Column:
        return F.length(F.regexp_replace(raw, f"[^{opening}]", "")) != F.length(F.regexp_replace(raw, f"[^{closing}]", ""))

    df = df.withColumn("items", recovered_list(F.col("raw"))).withColumn("json_valid", F.col("items") != "[]").withColumn("token_count", counts)
    df = df.withColumn("token_valid", F.col("token_count") <= max_tokens - 500)
    bad = ~F.col("json_valid")
    errors = F.array(
        F.when(bad, "invalid JSON or not a list"),
        F.when(~F.col("token_valid"), "over the token limit"),
        F.when(bad & (raw.contains("...") | F.lower(raw).contains("truncated")), "truncated answer"),
        F.when(bad & uneven(r"\[", r"\]"), "unbalanced brackets"),
        F.when(bad & uneven("{", "}"), "unbalanced braces"),
    )
    df = df.withColumn("errors", F.array_compact(errors))
    return df.withColumn("needs_redivision", bad | ~F.col("token_valid") | (word_count(F.col("text")) > max_tokens * 0.6))


def retry_redivided(answers: DataFrame, backend: Backend, max_tokens: int = 4096, profile: Profile | None = None) -> DataFrame:
    """Second pass: answers to be divided are asked again piece by piece; ``doc_id``, ``block_id``, ``chunk_id``, ``piece_no`` (-1: whole), ``items``.

    Pieces whose call fails are left out. The plan is bounded: one division, no loop.
    """
    keys = ["doc_id", "block_id", "chunk_id"]
    good = answers.filter("NOT needs_redivision").select(*keys, F.lit(-1).alias("piece_no"), "items")
    pieces = redivide(answers.filter("needs_redivision").select(*keys, "text", "token_valid", "errors"), max_tokens, profile)
    again = call_backend(pieces, backend).filter("error IS NULL")
    return good.unionByName(again.select(*keys, "piece_no", recovered_list(F.col("raw")).alias("items")))


def retry_plain(answers: DataFrame, backend: Backend, max_tokens: int = 4096, retries: int = 2) -> DataFrame:
    """Answers (with validate_answer's columns) that are not valid but needn't be divided are asked again, up to ``retries`` times.

    The plan is bounded: each retry asks what the one before left over. Columns as validate_answer gives them.
    """
    checks = ("items", "json_valid", "token_count", "token_valid", "errors", "needs_redivision")
    open_ = (~F.col("json_valid") | ~F.col("token_valid")) & ~F.col("needs_redivision")
    done, left = answers.filter(~open_), answers.filter(open_)
    for _ in range(retries):
        again = call_backend(left.drop("raw", "error", *checks), backend).drop("error")
        again = cut_lineage(validate_answer(again, max_tokens).select(*[c for c in answers.columns if c != "error"]))
        done = done.unionByName(again.filter("json_valid"), True)
        left = again.filter("NOT json_valid")
    return done.unionByName(left, True)


def identified_pairs(records: DataFrame, identification: str = "identification") -> DataFrame:
    """Records that have a Name and something in their ``identification`` (text or a list)."""
    kind = dict(records.dtypes)[identification]
    return records.filter(is_filled(F.col("Name"), "string") & is_filled(F.col(f"`{identification}`"), kind))


def retry_with_pairs(answers: DataFrame, backend: Backend, max_tokens: int = 4096, profile: Profile | None = None) -> DataFrame:
    """The whole retry: plain retries, then division; and where the profile's findings come in pairs, only items with a Name and identification.

    ``doc_id``, ``block_id``, ``chunk_id``, ``piece_no``, ``items``.
    """
    out = retry_redivided(retry_plain(answers, backend, max_tokens), backend, max_tokens, profile)
    if not (profile and profile.chunking.has_pairs):
        return out
    items = F.from_json("items", "array<string>")
    fields = F.transform(items, lambda x: F.from_json(x, "struct<Name:string,identification:string>"))
    full = F.filter(F.arrays_zip(items.alias("item"), fields.alias("f")), lambda z: is_filled(z["f"]["Name"], "string") & is_filled(z["f"]["identification"], "string") & (z["f"]["identification"] != "[]"))
    return out.withColumn("items", F.concat(F.lit("["), F.array_join(F.transform(full, lambda z: z["item"]), ","), F.lit("]")))


def records_of(answers: DataFrame, keep: tuple[str, ...] = ("doc_id", "block_id", "chunk_id")) -> DataFrame:
    """One row per object of ``items``: ``keep``, ``item_no`` and the record's fields; scalars where lists belong become lists; other items are dropped."""
    items = F.variant_get(F.try_parse_json("items"), "$", "array<variant>")
    each = answers.select(*keep, F.posexplode(items).alias("item_no", "v")).filter(F.schema_of_variant("v").startswith("OBJECT"))
    columns = []
    for name, kind in RECORD_FIELDS:
        path = f'$["{name}"]'
        as_kind = F.try_variant_get("v", path, kind)
        if kind == "array<string>":
            one = F.try_variant_get("v", path, "string")
            as_kind = F.coalesce(as_kind, F.when(F.trim(one) != "", F.array(one)), F.array().cast("array<string>"))
        columns.append(as_kind.alias(name))
    return each.select(*keep, "item_no", *columns)


def inherit_header(records: DataFrame, blocks: DataFrame, forced_block: int | None = 0, skip: bool = False) -> DataFrame:
    """Fills port, protocol and severity from the record's block where they say nothing (null, '', 'null'; for the port also 0).

    In the block ``forced_block`` the first record of each chunk takes them in any case. ``skip``: leave all as it is.
    """
    if skip:
        return records
    first = F.row_number().over(Window.partitionBy("doc_id", "block_id", "chunk_id").orderBy("item_no")) == 1
    r = records.withColumn("__first", first).alias("r")
    joined = r.join(blocks.select("doc_id", "block_id", "port", "protocol", "severity").alias("b"), ["doc_id", "block_id"], "left")
    forced = F.col("r.__first") & (F.col("block_id") == forced_block) if forced_block is not None else F.lit(False)

    def filled(name: str, empty: tuple[str, ...]) -> Column:
        mine, theirs = F.col(f"r.{name}"), F.col(f"b.{name}")
        says_nothing = mine.isNull() | F.lower(F.trim(mine)).isin(*empty)
        return F.when(theirs.isNotNull() & (says_nothing | forced), theirs).otherwise(mine).alias(name)

    new = {"port": filled("port", ("", "null", "0")), "protocol": filled("protocol", ("", "null")), "severity": filled("severity", ("", "null"))}
    return joined.select(*(new.get(c, F.col(c) if c in ("doc_id", "block_id") else F.col(f"r.{c}")) for c in records.columns))


def complete_pairs(records: DataFrame, plugin: str = "plugin") -> DataFrame:
    """Only records whose base name and plugin have both a base and an instances record; bases first."""
    kinds = records.withColumn("base_name", base_name(F.col("Name"))).withColumn("is_instances", instance_count(F.col("Name")) > 0)
    both = kinds.groupBy("base_name", F.col(plugin).alias("__plugin")).agg(F.bool_or("is_instances").alias("i"), F.bool_or(~F.col("is_instances")).alias("b")).filter("i AND b")
    k, m = kinds.alias("k"), both.alias("m")
    return k.join(m, (F.col("k.base_name") == F.col("m.base_name")) & F.col(f"k.{plugin}").eqNullSafe(F.col("m.__plugin")), "left_semi")


def url_port(url: Column) -> Column:
    """The port that a URL names, or its scheme's: 443 and 80; null otherwise."""
    explicit = F.nullif(F.regexp_extract(url, r"^\w+://[^/?#]*:(\d+)(?:[/?#]|$)", 1), F.lit(""))
    scheme = F.lower(F.regexp_extract(url, r"^(\w+)://", 1))
    return F.coalesce(explicit, F.when(scheme == "https", "443").when(scheme == "http", "80")).cast("int")


def enrich_assets(records: DataFrame, scanner: str, url: str = "url") -> DataFrame:
    """Asset attributes by scanner: ``asset.system_type``, for web scans port and protocol from the ``url``, and ``name_consolidated``, the name without its number of instances."""
    out = records.withColumn("asset.system_type", F.lit(SYSTEM_TYPES.get(scanner))).withColumn("name_consolidated", base_name(F.col("Name")))
    if scanner == "tenable":
        scheme = F.nullif(F.lower(F.regexp_extract(url, r"^(\w+)://", 1)), F.lit(""))
        out = out.withColumn("port", url_port(F.col(url)).cast("string")).withColumn("protocol", scheme)
    return out


def token_ledger(calls: DataFrame) -> DataFrame:
    """``doc_id``, ``block_id``, ``chunk_id``, ``tokens_input``, ``tokens_output`` of each call, by the local counter."""
    return calls.select("doc_id", "block_id", "chunk_id", word_count(F.col("text")).alias("tokens_input"), word_count(F.col("raw")).alias("tokens_output"))
