"""Queries over report texts: lines, cleaning, keys, blocks and chunks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scoria.functions import text as t
from scoria.operators import blocks, chunks, pages
from scoria.profiles import PROFILES
from scoria.session import table

WS = r"[\p{Z}\t\n\v\f\r\x1c-\x1f\x{85}]"


def _docs(spark: SparkSession, sf_dir: str, kind: str, source: str) -> DataFrame:
    """Documents of one stated kind and source; those of unknown kind or source are left out, as in the SQL."""
    return table(spark, sf_dir, "documents").filter((F.col("kind") == kind) & (F.col("source") == source)).select("doc_id", "text")


def line_explode_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines per document without page footers and blank lines, and their characters."""
    lines = pages.text_lines(table(spark, sf_dir, "documents")).filter(~t.is_footer(F.col("line")) & (F.length(t.stripped(F.col("line"))) > 0))
    return lines.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_lines"), F.sum(F.length("line")).alias("n_chars"))


def layout_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(t.clean_layout(F.col("text"))).alias("clean_md5"))


def nfkc_sanitize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", t.sanitize(F.col("text")).alias("safe_text"))


def page_stitch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents' texts with each blank-line part as a page, cleaned and stitched again."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", r"\n\n")).alias("page_no", "text"))
    return pages.stitch_pages(pages.clean_pages(docs)).select("doc_id", F.length("text").alias("n_chars"))


def name_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = table(spark, sf_dir, "records").select(t.normalize_name(F.col("Name")).alias("name_norm"))
    return names.groupBy("name_norm").agg(F.count(F.lit(1)).alias("n"))


def field_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "records").select("seq", F.md5(t.normalize_list(F.col("description"))).alias("text_md5"))


def listlike_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References as a workbook's cell has them, a list written out, read and normalised."""
    written = F.concat(F.lit("['"), F.array_join("references", "', '"), F.lit("']"))
    cell = F.when(F.size("references") > 0, written).when(F.size("references") == 0, "[]")
    return table(spark, sf_dir, "records").select("seq", t.normalize_listlike(cell).alias("text"))


def composite_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    frame = table(spark, sf_dir, "records").select("Name", "port", "protocol", "severity", "plugin")
    keys = frame.select(t.composite_key("openvas", frame.columns).alias("openvas_key"), t.composite_key("tenable", frame.columns).alias("tenable_key"))
    return keys.groupBy("openvas_key", "tenable_key").agg(F.count(F.lit(1)).alias("n"))


def cve_first_reference(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "records").select("seq", t.first_cve(F.col("references")).alias("cve"), t.port_protocol(F.col("port"), F.col("protocol")).alias("shown"))


def severity_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.col("severity")
    forms = table(spark, sf_dir, "records").select(t.severity_case(s).alias("upper_form"), t.severity_case(s, "capital").alias("capital_form"), t.severity_rank(s).alias("severity_rank"))
    return forms.groupBy("upper_form", "capital_form", "severity_rank").agg(F.count(F.lit(1)).alias("n"))


def name_parsers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parsers of run names over the ledger."""
    runs = table(spark, sf_dir, "run_ledger")
    path = F.concat_ws("/", F.lit("out"), "extractor", "scanner", "llm", F.concat(F.lit("run"), F.col("run_num").cast("string")), "output_file")
    model = t.known_model(F.concat_ws("_", "extractor", "llm"), ["deepseek", "gpt4", "gpt5", "llama3", "llama4", "qwen3"])
    out = runs.select(t.report_name("output_file").alias("report_name"), t.report_key(F.col("baseline")).alias("report_key"), t.run_number(path).alias("run_no"), model.alias("model"), t.bare_key(F.col("baseline")).alias("bare"), t.model_key(F.col("llm")).alias("model_key"))
    return out.groupBy(*out.columns).agg(F.count(F.lit(1)).alias("n"))


def ellipsis_and_clock(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", t.clock(F.round(F.col("value") * 100, 3)).alias("clock"), t.ellipsis(F.col("props"), 6).alias("short"))


def block_gaps_islands(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = blocks.header_blocks(_docs(spark, sf_dir, "body", "openvas"))
    return out.select("doc_id", "block_id", "severity", "port", "protocol", F.md5("text").alias("text_md5"))


def block_severity_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = blocks.severity_blocks(_docs(spark, sf_dir, "body", "tenable"))
    return out.select("doc_id", "block_id", "severity", F.md5("text").alias("text_md5"))


def block_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    return blocks.session_blocks(_docs(spark, sf_dir, "body", "nessus"), "nessus").select("doc_id", "block_id", F.length("text").alias("n_chars"))


def context_last_header(spark: SparkSession, sf_dir: str) -> DataFrame:
    return blocks.header_context(_docs(spark, sf_dir, "summary", "openvas"))


def summary_body_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = pages.split_summary(table(spark, sf_dir, "documents").filter("text IS NOT NULL").select("doc_id", "text"), "openvas")
    return out.select("doc_id", "kind", F.length("text").alias("n_chars"))


def summary_body_split_tenable(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = pages.split_summary(table(spark, sf_dir, "documents").filter("text IS NOT NULL").select("doc_id", "text"), "tenable")
    return out.select("doc_id", "kind", F.length("text").alias("n_chars"))


def host_addresses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The address in each text's section 2.1; the section is put into the texts here, where the inventory knows their report."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "report", "text")
    known = table(spark, sf_dir, "inventory").select(F.col("container").alias("report"), "ip")
    section = F.when(F.col("ip").isNotNull(), F.concat(F.lit("\n2.1 "), "ip", F.lit(" and more\n2.1 0.0.0.0\n"))).otherwise(F.lit("\n 2.1 198.51.100.1\n"))
    texts = docs.join(known, "report", "left").select("doc_id", F.concat(F.lit("x 2.1 203.0.113.9"), section, F.coalesce("text", F.lit(""))).alias("text"))
    return texts.select("doc_id", t.host_address(F.col("text")).alias("address"))


def chunk_token_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = chunks.token_windows(table(spark, sf_dir, "blocks").select("doc_id", "block_id", "text"), 300, 100)
    return out.select("doc_id", "block_id", "chunk_id", F.length("text").alias("n_chars"))


def chunk_marker_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = chunks.marker_chunks(table(spark, sf_dir, "blocks").select("doc_id", "block_id", "text"), 1500, PROFILES["openvas"])
    return out.select("doc_id", "block_id", "chunk_id", F.length("text").alias("n_chars"), F.md5("text").alias("text_md5"))


def chunk_both_cuts(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = chunks.chunk_blocks(table(spark, sf_dir, "blocks").select("doc_id", "block_id", "text"), PROFILES["openvas"], 1300, 1000, 1500)
    return out.select("doc_id", "block_id", "chunk_id", F.length("text").alias("n_chars"))


def pattern_detect(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = chunks.detect_pattern(table(spark, sf_dir, "documents").filter("text IS NOT NULL").select("doc_id", "text"), PROFILES["nessus"])
    return out.select("doc_id", "scanner_type", "markers", "has_pairs", "max_per_chunk")


def chunk_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = chunks.chunk_quality(table(spark, sf_dir, "blocks").filter("text IS NOT NULL").select("doc_id", "block_id", "text"), r"^\s*NVT:\s", 1492)
    out = chunks.quality_hints(out)
    return out.select("doc_id", "block_id", "size_ok", "markers", "clean_start", "clean_end", "pair_kinds.instances", "pair_kinds.bases", F.size("hints").alias("n_hints"))


def prompt_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = chunks.build_prompt(table(spark, sf_dir, "blocks").select("doc_id", "block_id", "text"), "Extract findings from:\n{context}\nAnswer in JSON.")
    return out.select("doc_id", "block_id", F.length("prompt").alias("n_chars"))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct findings per report and severity, from report text: lines, blocks, findings, deduplication, counts.

    Only documents stated to be bodies are read, as in the SQL; those of unknown kind are left out, and so are their findings.
    """
    docs = table(spark, sf_dir, "documents").filter((F.col("kind") == "body") & (F.col("source") == "openvas"))
    found = blocks.header_blocks(docs.select("doc_id", "text"))
    names = F.regexp_extract_all("text", F.lit(r"(?m)^\s*NVT:[ \t]*([^\n]*)"), 1)
    findings = found.select("doc_id", F.upper("severity").alias("severity"), "port", "protocol", F.explode(names).alias("Name"))
    keyed = findings.join(docs.select("doc_id", "report"), "doc_id").select("report", "severity", t.normalize_name(F.col("Name")).alias("name"), "port", "protocol").distinct()
    return keyed.groupBy("report", "severity").agg(F.count(F.lit(1)).alias("findings"))


QUERIES: tuple[Callable[[SparkSession, str], DataFrame], ...] = (
    flagship, line_explode_filter, layout_clean, nfkc_sanitize, page_stitch, name_normalize, field_normalize, listlike_normalize, composite_keys, cve_first_reference, severity_forms, name_parsers, ellipsis_and_clock,
    block_gaps_islands, block_severity_buckets, block_whole, context_last_header, summary_body_split, summary_body_split_tenable, host_addresses, chunk_token_windows, chunk_marker_packing, chunk_both_cuts, pattern_detect, chunk_quality, prompt_build,
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in QUERIES}


_HEAD = blocks.HEADER.removeprefix("(?i)")


def strip_sql(c: str) -> str:
    return rf"regexp_replace({c}, '^{WS}+|{WS}+$', '', 'g')"


def norm_name_sql(c: str) -> str:
    return rf"regexp_replace(replace(replace(lower({strip_sql(f'''coalesce({c}, '')''')}), 'certicate', 'certificate'), 'extaction', 'extraction'), '{WS}+', ' ', 'g')"


def norm_text_sql(c: str) -> str:
    inner = rf"regexp_replace(regexp_replace({strip_sql(rf'''regexp_replace(translate({c}, '•–—', ' --'), '{WS}+', ' ', 'g')''')}, '\.{{2,}}', '.', 'g'), ',{{2,}}', ',', 'g')"
    return rf"regexp_replace({inner}, '[ .,;:]+$', '')"


def norm_port_sql(c: str) -> str:
    plain = rf"regexp_replace({strip_sql(f'''coalesce({c}, '')''')}, '[,.]', '', 'g')"
    return f"CASE WHEN regexp_full_match({plain}, '[0-9]+') OR lower({plain}) = 'general' THEN {plain} ELSE '*' END"


def wild_sql(c: str, lower: bool = True) -> str:
    s = strip_sql(f"coalesce({c}, '')")
    return f"coalesce(nullif({f'lower({s})' if lower else s}, ''), '*')"


def lines_sql(where: str = "text IS NOT NULL") -> str:
    return rf"(SELECT doc_id, report, unnest(parts) AS line, generate_subscripts(parts, 1) - 1 AS line_no FROM (SELECT doc_id, report, string_split_regex(text, '\r\n|\r|\n') AS parts FROM documents WHERE {where}))"


def header_blocks_sql(where: str) -> str:
    s = strip_sql("line")
    return rf"""l AS (SELECT *, {s} AS bare, regexp_matches({s}, '(?i){_HEAD}') AS head FROM {lines_sql(where)}),
      a AS (SELECT *, lag(bare, 2) OVER w AS above, CASE WHEN first_value(head) OVER w THEN 0 ELSE 1 END + sum(CASE WHEN head THEN 1 ELSE 0 END) OVER w AS block_id FROM l WINDOW w AS (PARTITION BY doc_id ORDER BY line_no)),
      e AS (SELECT doc_id, arg_min(above, line_no) AS early FROM a WHERE starts_with(bare, 'NVT:') AND above IS NOT NULL AND line_no = (SELECT min(line_no) FROM a b WHERE b.doc_id = a.doc_id AND starts_with(b.bare, 'NVT:')) GROUP BY doc_id),
      v AS (SELECT a.*, early, last_value(CASE WHEN head THEN bare END IGNORE NULLS) OVER (PARTITION BY a.doc_id ORDER BY line_no) AS hline FROM a LEFT JOIN e ON a.doc_id = e.doc_id),
      h AS (SELECT *, coalesce(hline, CASE WHEN regexp_matches(early, '(?i){_HEAD}') THEN early END) AS attr, CASE WHEN hline IS NULL AND NOT regexp_matches(early, '(?i){_HEAD}') THEN early END AS alt FROM v),
      blk AS (SELECT doc_id, any_value(report) AS report, greatest(block_id, 1) AS block_id, max(nullif(regexp_extract(attr, '(?i){_HEAD}', 1), '')) AS severity,
        max(coalesce(nullif(regexp_extract(attr, '(?i){_HEAD}', 2), ''), nullif(regexp_extract(alt, '(?i)^(\d+|general)/([a-zA-Z0-9_-]+)', 1), ''))) AS port,
        max(coalesce(nullif(regexp_extract(attr, '(?i){_HEAD}', 3), ''), nullif(regexp_extract(alt, '(?i)^(\d+|general)/([a-zA-Z0-9_-]+)', 2), ''))) AS protocol,
        string_agg(line, chr(10) ORDER BY line_no) AS text FROM h GROUP BY doc_id, greatest(block_id, 1))"""


def oracle_sql() -> dict[str, str]:
    openvas_body = "kind = 'body' AND source = 'openvas' AND text IS NOT NULL"
    return {
        "flagship": rf"""WITH {header_blocks_sql(openvas_body)},
          f AS (SELECT report, upper(severity) AS severity, port, protocol, unnest(regexp_extract_all(text, '(?m)^\s*NVT:[ \t]*([^\n]*)', 1)) AS name FROM blk)
          SELECT report, severity, count(*) AS findings FROM (SELECT DISTINCT report, severity, port, protocol, {norm_name_sql('name')} AS name FROM f) GROUP BY report, severity""",
        "line_explode_filter": rf"SELECT doc_id, count(*) AS n_lines, sum(length(line)) AS n_chars FROM {lines_sql()} WHERE NOT regexp_matches(line, '(?i)^\s*Page\s+\d+\s+of\s+\d+') AND length({strip_sql('line')}) > 0 GROUP BY doc_id",
        "layout_clean": rf"SELECT doc_id, md5(regexp_replace(regexp_replace(translate(replace(regexp_replace(replace(text, chr(9), '    '), '\(cid:\d+\)', '', 'g'), '→', '->'), '’“”', chr(39) || chr(34) || chr(34)), ' {{2,}}', ' ', 'g'), '{WS}+$', '', 'g')) AS clean_md5 FROM documents",
        "name_normalize": f"SELECT {norm_name_sql('Name')} AS name_norm, count(*) AS n FROM records GROUP BY 1",
        "field_normalize": rf"SELECT seq, md5(coalesce({norm_text_sql(f'''array_to_string(list_filter(list_transform(description, lambda x: {strip_sql('x')}), lambda x: lower(x) NOT IN ('', 'none', 'null')), '. ')''')}, '')) AS text_md5 FROM records",
        "composite_keys": f"SELECT {norm_name_sql('Name')} || '|' || {norm_port_sql('port')} || '|' || {wild_sql('protocol')} AS openvas_key, {norm_name_sql('Name')} || '|' || {wild_sql('severity')} || '|' || {wild_sql('plugin', False)} AS tenable_key, count(*) AS n FROM records GROUP BY 1, 2",
        "cve_first_reference": rf"""SELECT seq, coalesce({strip_sql(rf'''regexp_replace({strip_sql(rf"list_filter({chr(34)}references{chr(34)}, lambda r: starts_with(lower({strip_sql('r')}), 'cve:'))[1]")}, '(?i)^cve:', '')''')},
          list_filter(string_split_regex(list_filter("references", lambda r: contains(upper(r), 'CVE-'))[1], '\s+'), lambda x: contains(upper(x), 'CVE-'))[1], 'N/A') AS cve,
          CASE WHEN coalesce(port, '') <> '' AND coalesce(protocol, '') <> '' THEN port || '/' || protocol WHEN coalesce(port, '') <> '' THEN port WHEN coalesce(protocol, '') <> '' THEN protocol ELSE 'N/A' END AS shown FROM records""",
        "severity_forms": f"""WITH s AS (SELECT {strip_sql('severity')} AS s FROM records)
          SELECT upper(s) AS upper_form, upper(s[1]) || lower(s[2:]) AS capital_form, CASE upper(s) WHEN 'CRITICAL' THEN 4.0 WHEN 'HIGH' THEN 3.0 WHEN 'MEDIUM' THEN 2.0 WHEN 'LOW' THEN 1.0 WHEN 'INFO' THEN 0.5 ELSE 0.0 END AS severity_rank, count(*) AS n FROM s GROUP BY 1, 2, 3""",
        "name_parsers": rf"""SELECT replace(regexp_replace(regexp_replace(output_file, '\.[^.]*$', ''), '^[^_]*_', ''), '_', ' ') AS report_name, lower({strip_sql(rf"translate(regexp_replace(baseline, '(?i)\.pdf$', ''), '_-', '  ')")}) AS report_key,
          CAST(run_num AS INT) AS run_no, list_filter(string_split(lower(concat_ws('_', extractor, llm)), '_'), lambda p: p IN ('deepseek', 'gpt4', 'gpt5', 'llama3', 'llama4', 'qwen3'))[-1] AS model,
          regexp_replace(lower(baseline), '[^a-z0-9]', '', 'g') AS bare, lower(translate(llm, '/:-.', '____')) AS model_key, count(*) AS n FROM run_ledger GROUP BY ALL""",
        "block_gaps_islands": f"WITH {header_blocks_sql(openvas_body)} SELECT doc_id, block_id, severity, port, protocol, md5(text) AS text_md5 FROM blk",
        "block_severity_buckets": rf"""WITH l AS (SELECT *, upper(nullif(regexp_extract(line, '(?i)VULNERABILITY\s+(CRITICAL|HIGH|MEDIUM|LOW|INFO)\s+PLUGIN\s+ID\s+\d+', 1), '')) AS own FROM {lines_sql("kind = 'body' AND source = 'tenable' AND text IS NOT NULL")}),
          f AS (SELECT *, last_value(own IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY line_no) AS sev FROM l),
          e AS (SELECT doc_id, arg_min(upper(regexp_extract(line, '(?i)^\s*SEVERITY\s+(CRITICAL|HIGH|MEDIUM|LOW|INFO)\s*$', 1)), line_no) AS early FROM f WHERE sev IS NULL AND regexp_matches(line, '(?i)^\s*SEVERITY\s+(CRITICAL|HIGH|MEDIUM|LOW|INFO)\s*$') GROUP BY doc_id),
          g AS (SELECT f.doc_id, line, line_no, coalesce(sev, early) AS severity FROM f LEFT JOIN e ON f.doc_id = e.doc_id WHERE f.doc_id IN (SELECT doc_id FROM l WHERE own IS NOT NULL))
          SELECT doc_id, list_position(['CRITICAL', 'HIGH', 'MEDIUM', 'LOW', 'INFO'], severity) AS block_id, severity, md5(string_agg(line, chr(10) ORDER BY line_no)) AS text_md5 FROM g WHERE severity IS NOT NULL GROUP BY doc_id, severity""",
        "block_whole": "SELECT doc_id, 1 AS block_id, length(text) AS n_chars FROM documents WHERE kind = 'body' AND source = 'nessus'",
        "context_last_header": rf"""WITH l AS (SELECT doc_id, {strip_sql('line')} AS line, line_no FROM {lines_sql("kind = 'summary' AND source = 'openvas' AND text IS NOT NULL")}),
          n AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY line_no) AS n FROM l WHERE line <> ''),
          f AS (SELECT doc_id, max(n) AS last, max(CASE WHEN regexp_matches(line, '(?i){_HEAD}') THEN n END) AS h FROM n GROUP BY doc_id)
          SELECT n.doc_id, nullif(regexp_extract(max(CASE WHEN n = h THEN line END), '(?i){_HEAD}', 1), '') AS severity, nullif(regexp_extract(max(CASE WHEN n = h THEN line END), '(?i){_HEAD}', 2), '') AS port,
          nullif(regexp_extract(max(CASE WHEN n = h THEN line END), '(?i){_HEAD}', 3), '') AS protocol, string_agg(line, chr(10) ORDER BY n) AS context
          FROM n JOIN f ON n.doc_id = f.doc_id WHERE n <= coalesce(h, last) AND n > coalesce(h, last) - 5 GROUP BY n.doc_id""",
        "summary_body_split": r"""WITH s AS (SELECT doc_id, text, regexp_extract(text, '(?s)^(.*?)(?:^|\n)\s*NVT:', 0) AS upto FROM documents WHERE text IS NOT NULL),
          c AS (SELECT doc_id, text, CASE WHEN upto = '' THEN 0 ELSE length(regexp_replace(upto, '(?s)(^|\n)\s*NVT:$', '\1')) END AS cut FROM s),
          d AS (SELECT doc_id, text, CASE WHEN cut > 0 OR regexp_matches(text, '^\s*NVT:') THEN cut ELSE 0 END AS cut FROM c)
          SELECT doc_id, 'body' AS kind, length(text) - cut AS n_chars FROM d UNION ALL SELECT doc_id, 'summary', cut FROM d WHERE regexp_matches(text[1:cut], '\S')""",
        "pattern_detect": r"""WITH m AS (SELECT doc_id, len(regexp_extract_all(text, '(?m)^\s*Plugin ID:\s*\d+')) AS a, len(regexp_extract_all(text, '(?m)^\s*NVT:\s')) AS b, len(regexp_extract_all(text, '(?m)^\s*VULNERABILITY\s+(CRITICAL|HIGH|MEDIUM|LOW)\s+PLUGIN\s+ID\s+\d+')) AS c FROM documents WHERE text IS NOT NULL)
          SELECT doc_id, CASE WHEN a > 0 THEN 'nessus' WHEN b > 0 THEN 'openvas' WHEN c > 0 THEN 'tenable_was' ELSE 'unknown' END AS scanner_type, CASE WHEN a > 0 THEN a WHEN b > 0 THEN b ELSE c END AS markers,
          a = 0 AND b = 0 AND c > 0 AS has_pairs, CASE WHEN a > 0 THEN 4 WHEN b > 0 THEN 5 ELSE 3 END AS max_per_chunk FROM m""",
        "chunk_quality": r"""WITH t AS (SELECT doc_id, block_id, text, string_split(text, chr(10)) AS l FROM blocks WHERE text IS NOT NULL), u AS (SELECT *, CASE WHEN len(l) > 10 THEN l[-10:] ELSE l END AS e FROM t),
          w AS (SELECT *, list_max(list_transform(e, lambda x, i: CASE WHEN regexp_matches(x, '^\s*NVT:\s') THEN i ELSE 0 END)) AS k FROM u),
          q AS (SELECT doc_id, block_id, length(text) <= 1492 AS size_ok, len(regexp_extract_all(text, '(?m)^\s*NVT:\s')) AS markers, len(list_filter(l[1:15], lambda x: regexp_matches(x, '^\s*NVT:\s'))) > 0 AS clean_start,
            k = 0 OR length(array_to_string(e[k + 1:], chr(10))) > 100 AS clean_end, len(regexp_extract_all(text, 'Instances \(\d+\)')) AS instances, len(regexp_extract_all(text, '(?i)PLUGIN\s+ID')) AS bases FROM w)
          SELECT *, (NOT size_ok)::INT + (markers = 0)::INT + (NOT clean_start)::INT + (NOT clean_end)::INT AS n_hints FROM q""",
    }
