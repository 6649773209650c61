"""Scanner and model profiles: typed settings, defaults for the known readers, and loading of JSON settings with ${ENV}."""

from __future__ import annotations

import json
import os
import re
from dataclasses import dataclass, field, fields, replace
from typing import Any


@dataclass(frozen=True)
class Chunking:
    """How a scanner's text is packed: marker pattern (searched in lines), markers per chunk, and whether markers come in pairs."""

    marker_pattern: str | None = None
    has_pairs: bool = False
    max_vulnerabilities_per_chunk: int = 3
    scanner_type: str = "unknown"


@dataclass(frozen=True)
class Profile:
    reader: str = "default"
    consolidation_field: str = "Name"
    name_field: str = "Name"
    description_field: str = "description"
    prompt: str = "{context}"
    chunking: Chunking = field(default_factory=Chunking)
    prompt_file: str = ""
    output_file: str = ""
    type: str = ""

    @property
    def asset_records(self) -> bool:
        """Whether the profile's records are asset findings (dotted fields)."""
        return self.reader.startswith("cais")


@dataclass(frozen=True)
class ModelProfile:
    model: str
    max_tokens: int = 4096
    max_chunk_size: int = 8000
    reserve_for_response: int = 1000
    temperature: float = 0.0
    endpoint: str = ""
    api_key: str = ""


#: Marker patterns of the readers.
NVT_LINE = r"^\s*NVT:\s"
PLUGIN_HEADER = r"VULNERABILITY\s+(CRITICAL|HIGH|MEDIUM|LOW|INFO)\s+PLUGIN\s+ID\s+\d+"

#: The readers' patterns, whether their markers come in pairs, and markers a chunk.
PROFILES: dict[str, Profile] = {
    "openvas": Profile("openvas", chunking=Chunking(r"^\s*(?:High|Medium|Low|Log|Critical)\s+\d+/\w+|^\s*NVT:", False, 5, "openvas")),
    "tenable": Profile("tenable", chunking=Chunking(PLUGIN_HEADER, True, 3, "tenable_was")),
    "nessus": Profile("nessus", chunking=Chunking(r"^\s*Plugin ID:\s*\d+", False, 4, "nessus")),
    "qualys": Profile("qualys", chunking=Chunking(r"^\s*QID:\s*\d+", False, 4, "qualys")),
    "rapid7": Profile("rapid7", chunking=Chunking(r"^\s*Vulnerability:\s", False, 5, "rapid7")),
    "default": Profile("default", chunking=Chunking(r"^\s*Vulnerability:", False, 4, "generic")),
}
for _name in ("cais_default", "cais_openvas", "cais"):
    PROFILES[_name] = Profile(_name, "name_consolidated", "definition.name", "definition.description")
PROFILES["cais_tenable"] = PROFILES["cais"]


def register_profile(name: str, profile: Profile) -> None:
    """Adds or replaces a profile: a new scanner needs settings only."""
    PROFILES[name] = profile


def profile(name: str) -> Profile:
    """A profile by name, in any letter case; unknown names get the default profile."""
    return PROFILES.get(name.lower(), PROFILES["default"])


def with_environment(value: Any) -> Any:
    """Replaces string values that are wholly ``${NAME}`` by the environment's value, at any depth; unset names give ''."""
    if isinstance(value, dict):
        return {k: with_environment(v) for k, v in value.items()}
    if isinstance(value, list):
        return [with_environment(v) for v in value]
    if isinstance(value, str) and (m := re.fullmatch(r"\$\{(\w+)\}", value)):
        return os.environ.get(m[1], "")
    return value


def load_profile(path: str) -> Profile:
    """A scanner profile from a JSON file; unknown keys are ignored."""
    with open(path, encoding="utf-8") as f:
        data = with_environment(json.load(f))
    known = {f.name for f in fields(Profile)} - {"chunking"}
    base = Profile(**{k: v for k, v in data.items() if k in known})
    if data.get("prompt_template"):
        base = replace(base, prompt=load_prompt(data["prompt_template"]), prompt_file=data["prompt_template"])
    chunking = {k: v for k, v in (data.get("chunking") or {}).items() if k in {f.name for f in fields(Chunking)}}
    return replace(base, chunking=Chunking(**chunking))


def load_prompt(template: str) -> str:
    """A prompt: the text of the file that ``template`` names, if there is one, else ``template`` itself."""
    if len(template) < 1024 and os.path.isfile(template):
        with open(template, encoding="utf-8") as f:
            return f.read()
    return template


def load_model(path: str) -> ModelProfile:
    """A model profile from a JSON file; either spelling of the token limit is read."""
    with open(path, encoding="utf-8") as f:
        data = with_environment(json.load(f))
    data.setdefault("max_tokens", data.get("max_completion_tokens", 4096))
    return ModelProfile(**{k: v for k, v in data.items() if k in {f.name for f in fields(ModelProfile)}})
