"""Record schemas: the standard finding record, the dotted asset-finding record, and their field orders."""

from __future__ import annotations

#: The narrative arrays of a record.
TEXT_ARRAYS = ("description", "detection_result", "detection_method", "product_detection_result", "impact", "solution", "insight", "log_method", "cvss")
PLUGIN_DETAILS = "struct<publication_date:string,modification_date:string,family:string,severity:string,plugin_id:string>"
INSTANCE = "struct<instance:string,input_type:string,input_name:string,payload:string,proof:string,output:string,request_method:string,http_status_code:int,http_protocol:string,response_content_type:string>"

#: The record's fields and their types, in order.
RECORD_FIELDS = (
    ("Name", "string"),
    *((c, "array<string>") for c in TEXT_ARRAYS),
    ("port", "string"),
    ("protocol", "string"),
    ("severity", "string"),
    ("references", "array<string>"),
    ("plugin", "string"),
    ("plugin_details", PLUGIN_DETAILS),
    ("instances", f"array<{INSTANCE}>"),
    ("source", "string"),
)
RECORD_DDL = ", ".join(f"`{n}` {t}" for n, t in RECORD_FIELDS)
#: Field order of data set exports: the record's fields between id and report.
DATASET_FIELDS = ("id", *(n for n, _ in RECORD_FIELDS), "report")

#: Severities from highest to lowest, and their ranks.
SEVERITY_ORDER = ("CRITICAL", "HIGH", "MEDIUM", "LOW", "INFO", "LOG")
SEVERITY_RANK = {"CRITICAL": 4.0, "HIGH": 3.0, "MEDIUM": 2.0, "LOW": 1.0, "INFO": 0.5, "LOG": 0.0}

#: The dotted fields of an asset-finding record and their types.
ASSET_FIELDS = {
    "id": "string!",
    "asset.name": "string",
    "asset.display_fqdn": "string",
    "asset.display_ipv4_address": "string",
    "asset.host_name": "string",
    "asset.operating_system": "string",
    "asset.system_type": "string",
    "definition.name": "string!",
    "definition.severity": "string!",
    "definition.description": "string",
    "definition.solution": "string",
    "definition.id": "string",
    "definition.family": "string",
    "definition.type": "string",
    "definition.cve": "string",
    "definition.cwe": "string",
    "definition.cpe": "string",
    "definition.references": "list",
    "definition.see_also": "list",
    "definition.cvss3.base_score": "number",
    "definition.cvss3.base_vector": "string",
    "definition.cvss2.base_score": "number",
    "definition.cvss2.base_vector": "string",
    "definition.synopsis": "string",
    "definition.plugin_published": "string",
    "definition.vulnerability_published": "string",
    "definition.patch_published": "string",
    "definition.epss.score": "number",
    "definition.exploitability_ease": "string",
    "output": "string",
    "port": "int",
    "protocol": "string",
    "scan.id": "string",
    "scan.target": "string",
    "severity": "string!",
    "state": "string",
    "first_observed": "string",
    "last_seen": "string",
    "age_in_days": "int",
}
