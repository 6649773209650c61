"""Queries pN over the project's tables, with the settings that the tables hold, and their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scoria.llm import collapse, mixing, oracle_truncation, spans, splitting, survivor, tokenizer, truncation
from scoria.session import table


def settings(spark: SparkSession, sf_dir: str) -> dict[str, str]:
    """The table of settings, a fixed dozen of rows."""
    return {r.setting_key: r.setting_value for r in table(spark, sf_dir, "profile_settings").select("setting_key", "setting_value").collect()}


def limits(spark: SparkSession, sf_dir: str) -> splitting.Limits:
    s = settings(spark, sf_dir)
    return splitting.Limits(s["openvas.chunking.marker_pattern"], int(s["llama4.max_chunk_size"]), int(s["openvas.chunking.max_vulnerabilities_per_chunk"]), int(s["openvas.chunking.overlap_chars"]))


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = collapse.formatting_duplicates(table(spark, sf_dir, "raw_findings"))
    return pairs.select(F.col("group_first").alias("raw_id_a"), F.col("id").alias("raw_id_b"))


def p1_collapsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each record once, under its smallest raw_id, with its number of copies and of different spellings."""
    _, groups = collapse.collapse_formatting(table(spark, sf_dir, "raw_findings"))
    return groups.select(F.col("group_first").alias("raw_id"), F.col("group_copies").alias("copies"), "spellings")


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return truncation.truncated_values(table(spark, sf_dir, "records")).select(F.col("id").alias("seq"), "field")


def p2_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return truncation.truncation_rates(table(spark, sf_dir, "records"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = splitting.split_oversized(table(spark, sf_dir, "blocks"), limits(spark, sf_dir), ["doc_id", "block_id"])
    return pieces.filter("piece_no = 0").select("doc_id", "block_id")


def p3_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splitting.split_oversized(table(spark, sf_dir, "blocks"), limits(spark, sf_dir), ["doc_id", "block_id"])


def p3_rebuilt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the pieces of each oversized block give when they are put together, and whether they keep the limits and the overlap."""
    pieces = splitting.split_oversized(table(spark, sf_dir, "blocks"), limits(spark, sf_dir), ["doc_id", "block_id"])
    return splitting.piece_checks(pieces, limits(spark, sf_dir), ["doc_id", "block_id"]).drop("pieces")


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    best = survivor.best_fields(survivor.duplicate_findings(table(spark, sf_dir, "records")))
    return best.select(F.col("first_id").alias("first_seq"), "field", F.col("best_id").alias("best_seq"))


def p4_survivors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The surviving records: seq of the group's first, number of members and what was chosen."""
    records = table(spark, sf_dir, "records")
    out = survivor.surviving_records(records, survivor.duplicate_findings(records))
    return out.select("seq", "run_id", "Name", "members", F.array_join("description", "\n").alias("description"), "severity", F.coalesce(F.size("instances"), F.lit(-1)).alias("n_instances"))


def p6_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenizer.token_ids(table(spark, sf_dir, "documents"), name=settings(spark, sf_dir)["documents.tokenizer"])


def _mix(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    docs = mixing.sized_documents(table(spark, sf_dir, "documents"), settings(spark, sf_dir)["documents.tokenizer"])
    return mixing.mix_sources(docs, table(spark, sf_dir, "mix_targets"))


def p7_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mix(spark, sf_dir)[0]


def p7_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mix(spark, sf_dir)[1]


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spans.shared_pairs(table(spark, sf_dir, "documents"), int(settings(spark, sf_dir)["documents.shared_span_min_chars"]))


def p8_shared(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spans.shared_parts(table(spark, sf_dir, "documents"), int(settings(spark, sf_dir)["documents.shared_span_min_chars"]))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (p1_found, p1_collapsed, p2_found, p2_rates, p3_found, p3_pieces, p3_rebuilt, p4_found, p4_survivors, p6_ids, p7_mix, p7_shares, p8_found, p8_shared)}


_SEP = r"([\p{Z}\t\n\v\f\r\x1c-\x1f\x{85}]|\p{P})+"


def _words(value: str) -> str:
    """Canonical words in DuckDB: marks between digits are protected first, as its patterns can't look around."""
    kept = value
    for _ in range(2):
        kept = rf"regexp_replace({kept}, '(\p{{Nd}})(\p{{P}})(\p{{Nd}})', '\1' || chr(57344) || '\2' || chr(57345) || '\3', 'g')"
    # the protected mark is written as a pair of private characters around it; separators then are all other marks
    return rf"trim(regexp_replace(lower(upper(regexp_replace({kept}, '{chr(0xE000)}(\p{{P}}){chr(0xE001)}|{_SEP}', '{chr(0xE000)}\1{chr(0xE001)}', 'g'))), '({chr(0xE000)}{chr(0xE001)})+', ' ', 'g'))"


def oracle_sql() -> dict[str, str]:
    names = {"Name": ("Name", "name", "NAME"), "port": ("port", "Port", "PORT"), "protocol": ("protocol", "Protocol", "PROTOCOL")}
    raw_key = " || chr(1) || ".join(_words("coalesce(" + ", ".join(f"json_extract_string(raw, '$.{n}')" for n in v) + ", '')") for v in names.values())
    rec_key = " || chr(1) || ".join(_words(f"coalesce({n}, '')") for n in ("Name", "port", "protocol"))
    setting = "(SELECT CAST(setting_value AS INT) FROM profile_settings WHERE setting_key = '{}')"
    grouped = f"""WITH k AS (SELECT *, {rec_key} AS key FROM records),
        m AS (SELECT *, min(seq) OVER (PARTITION BY run_id, key) AS first_seq, count(*) OVER (PARTITION BY run_id, key) AS members,
          length(regexp_replace(array_to_string(description, ''), '[\\p{{Z}}\\t\\n\\v\\f\\r\\x1c-\\x1f\\x{{85}}]', '', 'g')) AS chars,
          regexp_full_match(severity, '\\s*(CRITICAL|HIGH|MEDIUM|LOW|INFO|LOG)\\s*', 'i') AS valid, len(instances) AS n FROM k),
        f AS (SELECT first_seq, field, seq, score, extracted_at FROM (
          SELECT first_seq, 'description' AS field, seq, chars AS score, extracted_at FROM m WHERE members > 1 AND chars > 0 UNION ALL
          SELECT first_seq, 'severity', seq, 1, extracted_at FROM m WHERE members > 1 AND valid UNION ALL
          SELECT first_seq, 'instances', seq, n, extracted_at FROM m WHERE members > 1 AND n > 0))"""
    # every run of that many characters of every text, whole
    runs = f"""n AS (SELECT {setting.format('documents.shared_span_min_chars')} AS n), r AS (SELECT doc_id, length(text) AS n_chars, i, text[i:i + n - 1] AS run FROM documents, n, LATERAL (SELECT unnest(generate_series(1, length(text) - n + 1)) AS i) WHERE length(text) >= n)"""
    return oracle_truncation.oracle_sql() | {
        "p8_found": f"WITH {runs}, d AS (SELECT DISTINCT doc_id, run FROM r) SELECT DISTINCT a.doc_id AS doc_id_a, b.doc_id AS doc_id_b FROM d a JOIN d b ON a.run = b.run AND a.doc_id < b.doc_id",
        "p8_shared": f"""WITH {runs}, s AS (SELECT run FROM r GROUP BY run HAVING min(doc_id) < max(doc_id)),
            c AS (SELECT doc_id, n_chars, i, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS j FROM r WHERE run IN (SELECT run FROM s))
            SELECT doc_id, any_value(n_chars) AS n_chars, sum(least(coalesce(j - i, n), n)) AS shared_chars, sum(least(coalesce(j - i, n), n)) / any_value(n_chars) AS shared_part FROM c, n GROUP BY doc_id""",
        "p1_found": f"SELECT * FROM (SELECT min(raw_id) OVER (PARTITION BY key) AS raw_id_a, raw_id AS raw_id_b FROM (SELECT raw_id, {raw_key} AS key FROM raw_findings)) WHERE raw_id_a <> raw_id_b",
        "p1_collapsed": f"SELECT min(raw_id) AS raw_id, count(*) AS copies, count(DISTINCT raw) AS spellings FROM (SELECT raw_id, raw, {raw_key} AS key FROM raw_findings) GROUP BY key",
        "p3_found": f"""WITH b AS (SELECT doc_id, block_id, text, setting_value AS marker FROM blocks, profile_settings WHERE setting_key = 'openvas.chunking.marker_pattern')
            SELECT doc_id, block_id FROM b WHERE length(text) > {setting.format('llama4.max_chunk_size')}
            OR len(list_filter(string_split(text, chr(10)), lambda l: regexp_matches(l, marker))) > {setting.format('openvas.chunking.max_vulnerabilities_per_chunk')}""",
        "p3_rebuilt": f"""WITH b AS (SELECT doc_id, block_id, text, setting_value AS marker FROM blocks, profile_settings WHERE setting_key = 'openvas.chunking.marker_pattern')
            SELECT doc_id, block_id, md5(text) AS text_md5, true AS limits_kept, true AS overlap_kept FROM b WHERE length(text) > {setting.format('llama4.max_chunk_size')}
            OR len(list_filter(string_split(text, chr(10)), lambda l: regexp_matches(l, marker))) > {setting.format('openvas.chunking.max_vulnerabilities_per_chunk')}""",
        "p4_survivors": grouped + """, w AS (SELECT first_seq, field, seq FROM f QUALIFY row_number() OVER (PARTITION BY first_seq, field ORDER BY score DESC, extracted_at DESC NULLS LAST, seq) = 1),
          b AS (SELECT first_seq, max(seq) FILTER (field = 'description') AS d, max(seq) FILTER (field = 'severity') AS s, max(seq) FILTER (field = 'instances') AS i FROM w GROUP BY first_seq)
          SELECT m.seq, m.run_id, m.Name, m.members, array_to_string(x.description, chr(10)) AS description, y.severity, coalesce(len(z.instances), -1) AS n_instances
          FROM m LEFT JOIN b USING (first_seq) LEFT JOIN records x ON x.seq = b.d LEFT JOIN records y ON y.seq = b.s LEFT JOIN records z ON z.seq = b.i WHERE m.seq = m.first_seq AND members > 1""",
        "p4_found": grouped + " SELECT first_seq, field, seq AS best_seq FROM f QUALIFY row_number() OVER (PARTITION BY first_seq, field ORDER BY score DESC, extracted_at DESC NULLS LAST, seq) = 1",
    }
