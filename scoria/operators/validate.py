"""Validation and coercion of records, and integrity of the tables around them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scoria.functions.text import stripped
from scoria.profiles import Profile
from scoria.schemas import ASSET_FIELDS, TEXT_ARRAYS

#: Fixed value: names that are report metadata.
METADATA_NAME = r"(?i)^\s*VULNERABILITY\s+(CRITICAL|HIGH|MEDIUM|LOW|INFO|LOG)\s+PLUGIN\s+ID\s+\d+"


def validate_records(records: DataFrame, identification: str | None = None) -> DataFrame:
    """Records with a real name, missing lists empty, missing severity and source '', INFO as LOG.

    ``identification``: an array column of places; records with URLs there whose name lacks 'Instances' get the number of
    places appended to it. (One without any place has no URL there either, so none is without a number.)
    """
    name = stripped(F.coalesce("Name", F.lit("")))
    kept = records.filter((name != "") & ~name.rlike(METADATA_NAME))
    new: dict[str, Column] = {c: F.coalesce(F.col(c), F.array().cast("array<string>")) for c in (*TEXT_ARRAYS, "references") if c in records.columns}
    if identification:
        urls = F.coalesce(F.exists(identification, lambda x: x.rlike("^https?://")), F.lit(False))
        counted = F.concat(name, F.lit(" Instances ("), F.size(identification).cast("string"), F.lit(")"))
        new["Name"] = F.when(urls & ~name.contains("Instances"), counted).otherwise(F.col("Name"))
    if "severity" in records.columns:
        new["severity"] = F.when(F.upper("severity") == "INFO", "LOG").otherwise(F.coalesce("severity", F.lit("")))
    if "source" in records.columns:
        new["source"] = F.coalesce("source", F.lit(""))
    return kept.withColumns(new)


def validate_assets(raw: DataFrame, json_col: str = "raw") -> DataFrame:
    """Asset findings from JSON text: all dotted fields with their types, records without a definition.name dropped.

    Text fields take any scalar as text; numbers are read from text; a port or age that is no whole number is null; a
    single reference becomes a list of one.
    """
    v = F.try_parse_json(json_col)
    columns = []
    for name, kind in ASSET_FIELDS.items():
        path = f'$["{name}"]'
        text = F.try_variant_get(v, path, "string")
        if kind == "string!":
            c = F.coalesce(text, F.lit(""))
        elif kind == "number":
            c = text.try_cast("double")
        elif kind == "int":
            c = text.try_cast("int")
        elif kind == "list":
            c = F.coalesce(F.try_variant_get(v, path, "array<string>"), F.when(text != "", F.array(text)), F.array().cast("array<string>"))
        else:
            c = text
        columns.append(c.alias(name))
    return raw.filter(v.isNotNull()).select(*(c for c in raw.columns if c != json_col), *columns).filter(stripped(F.col("`definition.name`")) != "")


#: Validators by kind of record; register others under their own kind.
VALIDATORS = {"standard": validate_records, "asset": validate_assets}


#: What profile names say of their kind, in the order in which they are looked for.
PROFILE_TYPES = ("cais", "tenable", "openvas")


def profile_type(prompt: str = "", output: str = "", kind: str = "") -> str:
    """The type of a profile by the name of its prompt, else of its output file, else the type it states, else 'default'."""
    for text in (prompt.lower(), output.lower()):
        for known in PROFILE_TYPES:
            if known in text:
                return known
    return kind.lower() or "default"


def register_validator(kind: str, validator) -> None:  # noqa: ANN001
    VALIDATORS[kind] = validator


def validator_for(profile: Profile):  # noqa: ANN201
    """The validator registered for the profile's type; 'cais' has asset records; the standard one where there is none."""
    kind = profile_type(profile.prompt_file, profile.output_file, profile.type)
    if kind in VALIDATORS:
        return VALIDATORS[kind]
    return VALIDATORS["asset" if kind == "cais" or profile.asset_records else "standard"]


def check_arguments(evaluate: bool = False, baseline: object = None, formats: tuple[str, ...] = (), inputs: object = None) -> tuple[str, ...]:
    """The formats to write, after checking what a run was asked for: there must be input, and a baseline to evaluate against.

    An evaluation needs the workbook: where it wasn't asked for, all formats are written.
    """
    if inputs is None:
        raise ValueError("there is no input")
    if evaluate and baseline is None:
        raise ValueError("an evaluation needs a baseline")
    return ("all",) if evaluate and not {"xlsx", "all"} & set(formats) else tuple(formats)


def require_named(records: DataFrame) -> DataFrame:
    """``records``, if all of them have a ``Name`` or a ``name``; an error otherwise. One aggregate row is read."""
    names = [c for c in ("Name", "name") if c in records.columns]
    if not names:
        raise ValueError("records have neither Name nor name")
    missing = records.agg(F.count_if(F.coalesce(*(F.col(c) for c in names)).isNull()).alias("n")).first().n
    if missing:
        raise ValueError(f"{missing} records have no name")
    return records


def has_text(texts: Column) -> Column:
    """Whether an array has a non-blank item."""
    return F.coalesce(F.exists(texts, lambda x: F.length(stripped(x)) > 0), F.lit(False))


def with_description(records: DataFrame, field: str = "description") -> tuple[DataFrame, DataFrame]:
    """(kept, removed) by whether the description says anything; the field may be text or a list of texts."""
    is_array = dict(records.dtypes)[field].startswith("array")
    ok = has_text(F.col(f"`{field}`")) if is_array else F.coalesce(F.length(stripped(F.col(f"`{field}`"))) > 0, F.lit(False))
    return records.filter(ok), records.filter(~ok)


def integrity(files: DataFrame, mapping: DataFrame, baseline: DataFrame, file_key: str, address: str) -> DataFrame:
    """Issues between report files, their addresses and a baseline: ``issue``, ``value``; an empty result passes.

    files: ``file_key``; mapping: ``file_key``, ``address`` (null: not found); baseline: ``address``.
    """
    f = files.select(file_key).distinct()
    m = mapping.select(file_key, address)
    known, base = m.filter(F.col(address).isNotNull()), baseline.select(address).filter(F.col(address).isNotNull()).distinct()

    def issue(name: str, df: DataFrame, col: str) -> DataFrame:
        return df.select(F.lit(name).alias("issue"), F.col(col).cast("string").alias("value"))

    parts = [
        issue("file without mapping", f.join(m, file_key, "left_anti"), file_key),
        issue("mapping without file", m.select(file_key).distinct().join(f, file_key, "left_anti"), file_key),
        issue("address not found", m.filter(F.col(address).isNull()), file_key),
        issue("address not in baseline", known.select(address).distinct().join(base, address, "left_anti"), address),
        issue("baseline address not mapped", base.join(known, address, "left_anti"), address),
        issue("address of several files", known.groupBy(address).agg(F.countDistinct(file_key).alias("n")).filter("n > 1"), address),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
