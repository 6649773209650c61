"""Text functions as Columns: cleaning, normalising, keys and parsers. All stay on the JVM but for Unicode NFKC."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scoria.session import ship_package

#: Footer lines that are dropped.
FOOTER = r"(?i)^\s*Page\s+\d+\s+of\s+\d+"
#: Characters that are replaced when text is made safe for any code page.
SAFE_CHARACTERS = {
    "✗": "[X]",
    "✓": "[V]",
    "•": "*",
    "·": "*",
    "‣": "→",
    "‐": "-",
    "‑": "-",
    "‒": "-",
    "–": "-",
    "—": "-",
    "―": "-",
    "‘": "'",
    "’": "'",
    "“": '"',
    "”": '"',
}
#: Misspellings put right in names.
TYPOS = {"certicate": "certificate", "extaction": "extraction"}
#: Python's idea of white space in Java's pattern syntax.
WS = r"[\p{Z}\t-\r\x1c-\x1f\x85]"
#: The same characters, for trimming without a pattern, which looks at the ends only.
WS_CHARACTERS = "\t\n\v\f\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def stripped(c: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.btrim(c, F.lit(WS_CHARACTERS))


def is_footer(line: Column) -> Column:
    return line.rlike(FOOTER)


def clean_layout(text: Column) -> Column:
    """Layout text of a page: tabs to four blanks, glyph references out, arrows and curly quotes plain, runs of blanks to one, right-trimmed."""
    text = F.replace(text, F.lit("\t"), F.lit("    "))
    text = F.regexp_replace(text, r"\(cid:\d+\)", "")
    text = F.replace(text, F.lit("→"), F.lit("->"))
    text = F.translate(text, "’“”", "'\"\"")
    return F.rtrim(F.regexp_replace(text, " {2,}", " "), F.lit(WS_CHARACTERS))


def page_or_placeholder(text: Column, page_no: Column) -> Column:
    """A page without text gets a line that says so."""
    return F.when(F.coalesce(F.length(stripped(text)), F.lit(0)) > 0, text).otherwise(F.concat(F.lit("[page "), page_no.cast("string"), F.lit(" - no text found]\n")))


@F.pandas_udf(T.StringType())
def _nfkc(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: t if t is None or t.isascii() else unicodedata.normalize("NFKC", t))


def nfkc(text: Column | str) -> Column:
    """Unicode compatibility form; Spark has none of its own."""
    ship_package()
    return _nfkc(text)


nfkc.udf = _nfkc


def sanitize(text: Column) -> Column:
    """NFKC, then the safe characters, then nothing but ASCII, letters, numbers and white space."""
    out = nfkc(text)
    for found, instead in SAFE_CHARACTERS.items():
        out = F.replace(out, F.lit(found), F.lit(instead))
    return F.regexp_replace(out, r"[^\x00-\x7F\p{L}\p{N}\p{Z}\x85]", "")


def normalize_name(name: Column) -> Column:
    """For matching: '' for null, stripped, lower case, misspellings put right, runs of white space to one blank."""
    out = F.lower(stripped(F.coalesce(name.cast("string"), F.lit(""))))
    for wrong, right in TYPOS.items():
        out = F.replace(out, F.lit(wrong), F.lit(right))
    return F.regexp_replace(out, f"{WS}+", " ")


def normalize_text(text: Column) -> Column:
    """A field's text for scoring: line breaks, tabs and bullets to blanks, dashes plain, runs shortened, end marks off."""
    out = F.translate(F.coalesce(text, F.lit("")), "•–—", " --")
    out = stripped(F.regexp_replace(out, f"{WS}+", " "))
    out = F.regexp_replace(F.regexp_replace(out, r"\.{2,}", "."), ",{2,}", ",")
    return F.regexp_replace(out, r"[ .,;:]+$", "")


def normalize_list(items: Column) -> Column:
    """A list field's text for scoring: items that say something, joined by '. '."""
    kept = F.filter(F.transform(items, stripped), lambda x: ~F.lower(x).isin("", "none", "null"))
    return normalize_text(F.array_join(kept, ". "))


def normalize_listlike(text: Column) -> Column:
    """Text that may be a list written out (from a workbook cell): its items where it reads as a JSON-like list, else the text.

    Lists are read after quotes are made double; what doesn't read loses brackets and quotes.
    """
    trimmed = stripped(F.coalesce(text, F.lit("")))
    looks = trimmed.rlike(r"(?s)^\[.*\]$|^\(.*\)$")
    items = F.from_json(F.translate(F.concat(F.lit("["), F.substring(trimmed, F.lit(2), F.length(trimmed) - 2), F.lit("]")), "'", '"'), "array<string>")
    bare = F.replace(F.regexp_replace(F.regexp_replace(trimmed, r"^[\[\]()]+|[\[\]()]+$", ""), "['\"]", ""), F.lit(","), F.lit(", "))
    return F.when(looks & items.isNotNull(), normalize_list(items)).when(looks, normalize_text(bare)).otherwise(normalize_text(text))


def normalize_port(port: Column) -> Column:
    """Digits without thousands marks, 'general', or '*' for anything else; a decimal point goes too, so 443.0 is 4430."""
    plain = F.regexp_replace(stripped(F.coalesce(port.cast("string"), F.lit(""))), "[,.]", "")
    return F.when(plain.rlike("^[0-9]+$") | (F.lower(plain) == "general"), plain).otherwise("*")


def or_wildcard(value: Column, lower: bool = True) -> Column:
    text = stripped(F.coalesce(value.cast("string"), F.lit("")))
    text = F.lower(text) if lower else text
    return F.when(text == "", "*").otherwise(text)


def composite_key(scanner: str, columns: list[str], ports: bool = True) -> Column:
    """Matching key: name, port and protocol (openvas); name, severity and plugin (tenable); else the name.

    Rows named 'services' match by content only: the key is a digest of the whole row but for ``seq``, which only numbers
    rows. ``ports``: whether ports are normalised.
    """
    name = normalize_name(F.col("Name"))
    if scanner == "openvas":
        port = normalize_port(F.col("port")) if ports else or_wildcard(F.col("port"), False)
        content = F.concat(F.lit("services_exact|"), F.sha2(F.to_json(F.struct(*(F.col(f"`{c}`") for c in sorted(columns) if c != "seq"))), 256))
        return F.when(name == "services", content).otherwise(F.concat_ws("|", name, port, or_wildcard(F.col("protocol"))))
    if scanner == "tenable":
        return F.concat_ws("|", name, or_wildcard(F.col("severity")), or_wildcard(F.col("plugin"), False))
    return name


def report_name(file_name: Column) -> Column:
    """Report name from a file name: what follows the first '_', without extension, '_' as blanks."""
    return F.replace(F.regexp_replace(F.regexp_replace(file_name, r"\.[^.]*$", ""), "^[^_]*_", ""), F.lit("_"), F.lit(" "))


def report_key(name: Column) -> Column:
    """Key for looking reports up: without .pdf, '_' and '-' as blanks, lower case, stripped."""
    return F.lower(stripped(F.translate(F.regexp_replace(name, r"(?i)\.pdf$", ""), "_-", "  ")))


def host_address(text: Column) -> Column:
    """The address in a report's section 2.1; null if there is none."""
    return F.nullif(F.regexp_extract(text, r"(?md)^2\.1\s+([\d.]+)", 1), F.lit(""))


def first_cve(references: Column) -> Column:
    """The first CVE of a list of references: a 'cve:' entry, or the first token with CVE- in it; 'N/A' if there is none."""
    tagged = F.get(F.filter(references, lambda r: F.lower(stripped(r)).startswith("cve:")), F.lit(0))
    found = F.get(F.filter(references, lambda r: F.upper(r).contains("CVE-")), F.lit(0))
    token = F.get(F.filter(F.split(found, r"\s+"), lambda t: F.upper(t).contains("CVE-")), F.lit(0))
    return F.coalesce(stripped(F.regexp_replace(stripped(tagged), "(?i)^cve:", "")), token, F.lit("N/A"))


def port_protocol(port: Column, protocol: Column) -> Column:
    """'443/tcp', the one that is there, or 'N/A'."""
    has_port, has_protocol = F.coalesce(port, F.lit("")) != "", F.coalesce(protocol, F.lit("")) != ""
    return F.when(has_port & has_protocol, F.concat_ws("/", port, protocol)).when(has_port, port).when(has_protocol, protocol).otherwise("N/A")


def model_key(name: Column) -> Column:
    return F.lower(F.translate(name, "/:-.", "____"))


def run_number(path: Column) -> Column:
    """N of 'runN' in a path; null if there is none."""
    return F.regexp_extract(path, r"run(\d+)", 1).try_cast("int")


def folder_parts(path: Column) -> tuple[Column, Column]:
    """(scanner, baseline) from a result file's path: the fourth part from its end, with the scanner's name before the baseline's.

    A folder that begins with no known scanner is both; paths without such a folder are 'unknown'. In lower case.
    """
    folder = F.lower(F.try_element_at(F.split(F.replace(path, F.lit("\\"), F.lit("/")), "/"), F.lit(-4)))
    pattern = "^(openvas|tenable)_*(.*)$"
    known = folder.rlike(pattern)
    scanner = F.when(folder.isNull(), "unknown").when(known, F.regexp_extract(folder, pattern, 1)).otherwise(folder)
    return scanner, F.when(folder.isNull(), "unknown").when(known, F.regexp_extract(folder, pattern, 2)).otherwise(folder)


def stable_uuid(*values: Column) -> Column:
    """An id in the form of a UUID (version 5 layout) from values: the same for the same values, in every run."""
    digest = F.sha1(F.to_json(F.struct(*(v.alias(f"v{i}") for i, v in enumerate(values))), {"ignoreNullFields": "false"}))
    variant = F.substring(F.lit("89ab"), F.conv(F.substring(digest, 17, 1), 16, 10).cast("int") % 4 + 1, F.lit(1))
    return F.concat_ws("-", F.substring(digest, 1, 8), F.substring(digest, 9, 4), F.concat(F.lit("5"), F.substring(digest, 14, 3)), F.concat(variant, F.substring(digest, 18, 3)), F.substring(digest, 21, 12))


def known_model(file_name: Column, models: list[str]) -> Column:
    """The last of a file name's '_'-parts that is a known model."""
    return F.try_element_at(F.filter(F.split(F.lower(file_name), "_"), lambda p: p.isin(*models)), F.lit(-1))


def bare_key(name: Column) -> Column:
    """Letters and digits only, lower case: for comparing names that differ in marks."""
    return F.regexp_replace(F.lower(name), r"[^a-z0-9]", "")


def severity_case(severity: Column, style: str = "upper") -> Column:
    """'upper', 'capital' (first letter only) or 'log' (upper case, INFO as LOG)."""
    s = stripped(severity)
    if style == "capital":
        return F.concat(F.upper(F.substring(s, 1, 1)), F.lower(F.substring(s, 2, 1 << 30)))
    return F.when(F.upper(s) == "INFO", "LOG").otherwise(F.upper(s)) if style == "log" else F.upper(s)


def severity_rank(severity: Column) -> Column:
    from scoria.schemas import SEVERITY_RANK

    ranks = F.create_map(*(F.lit(x) for kv in SEVERITY_RANK.items() for x in kv))
    return F.coalesce(F.try_element_at(ranks, F.upper(stripped(severity))), F.lit(0.0))


def ellipsis(text: Column, n: int) -> Column:
    return F.when(F.length(text) > n, F.concat(F.substring(text, 1, n), F.lit("..."))).otherwise(text)


def instance_count(name: Column) -> Column:
    """N of an 'Instances (N)' name; 0 if it isn't one."""
    return F.coalesce(F.regexp_extract(name, r"Instances \((\d+)\)", 1).try_cast("int"), F.lit(0))


def base_name(name: Column) -> Column:
    return stripped(F.regexp_replace(name, r"\s*Instances \(\d+\)\s*$", ""))


def clock(seconds: Column) -> Column:
    """Seconds as hh:mm:ss.sss."""
    whole = F.floor(seconds)
    return F.format_string("%02d:%02d:%06.3f", F.floor(whole / 3600).cast("int"), F.floor(F.pmod(whole, F.lit(3600)) / 60).cast("int"), seconds - F.floor(seconds / 60) * 60)


def is_filled(c: Column, kind: str) -> Column:
    """Whether a value says something: not null, '', 0, and no empty list or struct of nulls."""
    if kind.startswith("array") or kind.startswith("map"):
        return F.coalesce(F.size(c) > 0, F.lit(False))
    if kind.startswith("struct"):
        return c.isNotNull() & (F.to_json(c) != "{}")
    if kind in ("string",):
        return F.coalesce(c != "", F.lit(False))
    if kind in ("boolean",):
        return F.coalesce(c, F.lit(False))
    if kind in ("timestamp", "date", "timestamp_ntz", "binary"):
        return c.isNotNull()
    return F.coalesce(c != 0, F.lit(False))
