"""SQL of queries that need more than a line: likeness of texts by bits, linkage, answers, merges and data sets."""

from __future__ import annotations

import re

from scoria.operators.pages import EXPORT_MARK, FIRST_FINDING
from scoria.plans.texts import _HEAD, WS, norm_name_sql, norm_port_sql, norm_text_sql, strip_sql, wild_sql
from scoria.schemas import ASSET_FIELDS, DATASET_FIELDS, RECORD_FIELDS, SEVERITY_RANK

#: The longest sequence whose places fit one 128-bit number with room for a carry.
BITS = 126


def masks_sql(items: str) -> str:
    """Of a list, a map from each item to the bits of its places."""
    return f"map_from_entries(list_transform(list_distinct({items}), lambda t: struct_pack(k := t, v := list_sum(list_transform(generate_series(1, len({items})), lambda i: CASE WHEN {items}[i] = t THEN 1::HUGEINT << (i - 1)::INT ELSE 0::HUGEINT END))::HUGEINT)))"


def lcs_sql(masks: str, size: str, other: str) -> str:
    """Length of the longest common subsequence of a list (its ``masks`` and ``size``, at most BITS) and another list."""
    full = f"((1::HUGEINT << ({size})::INT) - 1)"
    return f"(({size}) - bit_count(list_reduce(list_transform({other}, lambda t: coalesce({masks}[t], 0::HUGEINT)), lambda v, m: ((v + (v & m)) | (v - (v & m))) & {full}, {full})))"


def long_lcs_sql(x: str, y: str) -> str:
    """The same of lists of any length, row by row of the table."""
    cells = "list_transform(generate_series(1, len(hit)), lambda j: [hit[j], row[j], row[j + 1]])"
    step = f"list_reduce({cells}, lambda acc, c: list_append(acc, CASE WHEN c[1] = 1 THEN c[2] + 1 ELSE greatest(c[3], acc[-1]) END), [0])"
    hits = f"list_transform({y}, lambda t: list_transform({x}, lambda s: CASE WHEN s = t THEN 1 ELSE 0 END))"
    return f"list_reduce({hits}, lambda row, hit: {step}, list_transform(generate_series(0, len({x})), lambda i: 0))[-1]"


def chars(text: str) -> str:
    return f"string_split({text}, '')"


def best_alike_sql(names: str, candidates: str, least: float = 0.85, block: str = "", form: str = "{0}") -> str:
    """Per name of ``names`` (name, and ``block``) the most alike of ``candidates`` (name, rank, and ``block``)."""
    own = f", {block}" if block else ""
    same = f"x.{block} = y.{block} AND " if block else ""
    score = f"2.0 * {lcs_sql('x.m', 'x.n', 'y.c')} / (x.n + y.n)"
    return f"""(SELECT name, candidate{own}, score FROM (
        SELECT x.name, y.name AS candidate, rank{f', x.{block}' if block else ''}, {score} AS score
        FROM (SELECT DISTINCT name{own}, {masks_sql(chars(form.format('name')))} AS m, length({form.format('name')}) AS n FROM {names} WHERE name <> '') x
        JOIN (SELECT name{own}, min(rank) AS rank, any_value({chars(form.format('name'))}) AS c, any_value(length({form.format('name')})) AS n FROM {candidates} WHERE name <> '' GROUP BY name{own}) y
        ON {same}2.0 * least(x.n, y.n) >= {least} * (x.n + y.n) - 1e-9 WHERE x.n <= {BITS}) WHERE score >= {least}
        QUALIFY row_number() OVER (PARTITION BY name{own} ORDER BY score DESC, rank) = 1)"""


LATEST = "latest AS (SELECT * FROM run_ledger QUALIFY row_number() OVER (PARTITION BY run_id ORDER BY run_at DESC NULLS LAST, status DESC NULLS LAST) = 1)"


def model_sql(llm: str) -> str:
    key = f"{norm_name_sql('Name')} || '|' || {norm_port_sql('port')} || '|' || {wild_sql('protocol')}"
    return f"(SELECT *, {norm_name_sql('Name')} AS name_norm, {key} AS key FROM records WHERE run_id IN (SELECT run_id FROM latest WHERE llm = '{llm}'))"


def resolved_sql() -> str:
    """CTEs of the linkage up to what each extraction row resolves to (``res``), of gpt4's records (``e``) with llama4's (``b``)."""
    return f"""{LATEST}, e AS {model_sql('gpt4')}, b AS {model_sql('llama4')},
      x AS (SELECT DISTINCT key, string_split(key, '|') AS p FROM e), y AS (SELECT key, string_split(key, '|') AS p, min(seq) AS s FROM b GROUP BY ALL),
      comp AS (SELECT ext_key, base_key FROM (SELECT x.key AS ext_key, y.key AS base_key, s, list_sum(list_transform(list_zip(x.p, y.p), lambda z: CASE WHEN z[1] = '*' OR z[2] = '*' THEN 0.3::DOUBLE WHEN z[1] = z[2] THEN 1.0 ELSE 0.0 END)) / len(x.p) AS score
        FROM x JOIN y ON len(x.p) = len(y.p) AND len(list_filter(list_zip(x.p, y.p), lambda z: NOT (z[1] = '*' OR z[2] = '*' OR z[1] = z[2]))) = 0) QUALIFY row_number() OVER (PARTITION BY ext_key ORDER BY score DESC, s) = 1),
      keyname AS (SELECT key AS base_key, arg_max(name_norm, seq) AS key_name FROM b GROUP BY key),
      names AS (SELECT name_norm AS name, min(seq) AS rank, arg_min(Name, seq) AS shown FROM b GROUP BY name_norm),
      rest AS (SELECT DISTINCT name_norm AS name FROM e WHERE name_norm NOT IN (SELECT name FROM names)),
      alike AS {best_alike_sql('rest', 'names')},
      own AS (SELECT e.*, comp.base_key, CASE WHEN comp.base_key IS NOT NULL THEN key_name WHEN names.name IS NOT NULL THEN names.name ELSE candidate END AS own_name, names.name IS NOT NULL AS exact
        FROM e LEFT JOIN comp ON e.key = comp.ext_key LEFT JOIN keyname USING (base_key) LEFT JOIN names ON e.name_norm = names.name LEFT JOIN alike ON e.name_norm = alike.name),
      final AS (SELECT name_norm AS nn, arg_max_null(own_name, seq) AS match_name FROM own GROUP BY name_norm),
      res AS (SELECT own.*, match_name FROM own JOIN final ON own.name_norm = final.nn)"""


def mapping_sql() -> str:
    ratio = f"2.0 * {lcs_sql('m', 'length(nn)', chars('match_name'))} / (length(nn) + length(match_name))"
    return f"""WITH {resolved_sql()}, sc AS (SELECT nn, CASE WHEN match_name IS NULL THEN 0.0 WHEN nn = match_name THEN 1.0 ELSE {ratio} END AS score FROM (SELECT *, {masks_sql(chars('nn'))} AS m FROM final))
      SELECT seq, res.Name AS Extraction_Name, name_norm AS Extraction_Name_norm, key AS Composite_Key, shown AS Baseline_Name_matched, round(score, 6) AS match_score,
      CASE WHEN match_name IS NULL THEN 'UNMATCHED' WHEN base_key IS NOT NULL THEN 'MATCHED_COMPOSITE' ELSE 'MATCHED_NAME_ONLY' END AS Status FROM res LEFT JOIN names ON match_name = names.name JOIN sc ON sc.nn = name_norm"""


def links_sql() -> str:
    """CTEs up to ``links``: rows of a key in order, then, name by name and row by row, the best free row of the name."""
    return f"""RECURSIVE {resolved_sql()},
      ke AS (SELECT seq, base_key, row_number() OVER (PARTITION BY base_key ORDER BY seq) AS n FROM res WHERE base_key IS NOT NULL), kb AS (SELECT seq, key, row_number() OVER (PARTITION BY key ORDER BY seq) AS n FROM b),
      bykey AS (SELECT ke.seq AS ext_seq, kb.seq AS base_seq FROM ke LEFT JOIN kb ON ke.base_key = kb.key AND ke.n = kb.n),
      tidy AS (SELECT seq, name_norm AS name, trim(coalesce(port, '')) AS port, lower(trim(coalesce(protocol, ''))) AS protocol FROM b WHERE seq NOT IN (SELECT base_seq FROM bykey WHERE base_seq IS NOT NULL)),
      free AS (SELECT name, list(struct_pack(q := seq, port := port, protocol := protocol) ORDER BY seq) AS f FROM tidy GROUP BY name),
      ask AS (SELECT seq, match_name AS name, trim(coalesce(port, '')) AS port, lower(trim(coalesce(protocol, ''))) AS protocol, row_number() OVER (PARTITION BY match_name ORDER BY seq) AS n FROM res WHERE base_key IS NULL AND match_name IS NOT NULL),
      went(name, step, used, ext_seq, base_seq) AS (SELECT DISTINCT name, 0::BIGINT, []::BIGINT[], NULL::BIGINT, NULL::BIGINT FROM ask UNION ALL
        SELECT name, n, CASE WHEN pick IS NULL THEN used ELSE list_append(used, pick) END, seq, pick FROM (SELECT w.name, a.n, w.used, a.seq,
          list_sort(list_transform(list_filter(coalesce(f.f, []), lambda r: NOT list_contains(w.used, r.q)), lambda r: struct_pack(s := -((a.port <> '' AND r.port = a.port)::INT + (a.protocol <> '' AND r.protocol = a.protocol)::INT), q := r.q)))[1].q AS pick
          FROM went w JOIN ask a ON a.name = w.name AND a.n = w.step + 1 LEFT JOIN free f ON f.name = w.name)),
      got AS (SELECT ext_seq, base_seq FROM bykey UNION ALL SELECT ext_seq, base_seq FROM went WHERE step > 0),
      links AS (SELECT r.seq AS ext_seq, got.base_seq, CASE WHEN base_key IS NULL AND match_name IS NULL THEN 'UNMATCHED' WHEN got.base_seq IS NULL THEN 'UNMATCHED_EXCESS' WHEN base_key IS NOT NULL THEN 'MATCHED_COMPOSITE' WHEN exact THEN 'MATCHED_NAME_ONLY' ELSE 'MATCHED_FUZZY' END AS status FROM res r LEFT JOIN got ON r.seq = got.ext_seq
        UNION ALL SELECT NULL, seq, 'ABSENT' FROM b WHERE seq NOT IN (SELECT base_seq FROM got WHERE base_seq IS NOT NULL))"""


FIELDS = ("description", "solution", "severity", "references")


def norm_list_sql(c: str) -> str:
    return f"coalesce({norm_text_sql(f'''array_to_string(list_filter(list_transform({c}, lambda x: {strip_sql('x')}), lambda x: lower(x) NOT IN ('', 'none', 'null')), '. ')''')}, '')"


def scores_sql() -> str:
    """CTEs up to ``scores``: ROUGE-L of the linked rows' fields, 0 for rows without a counterpart; each pair of texts once."""
    def text(side: str, f: str) -> str:
        c = f'{side}."{f}"'
        return f"coalesce({norm_text_sql(c)}, '')" if f == "severity" else norm_list_sql(c)

    each = " UNION ALL ".join(f"SELECT ext_seq, base_seq, status, '{f}' AS field, {text('e', f)} AS x, {text('b', f)} AS y FROM links JOIN e ON ext_seq = e.seq LEFT JOIN b ON base_seq = b.seq" for f in FIELDS)
    swap = "CASE WHEN len(string_split(x, ' ')) <= len(string_split(y, ' ')) THEN x ELSE y END"
    other = "CASE WHEN len(string_split(x, ' ')) <= len(string_split(y, ' ')) THEN y ELSE x END"
    lcs = f"CASE WHEN len(s) <= {BITS} THEN {lcs_sql('m', 'len(s)', 'l')} ELSE {long_lcs_sql('s', 'l')} END"
    return f"""{links_sql()}, each AS ({each}),
      pairs AS (SELECT DISTINCT x, y FROM each WHERE base_seq IS NOT NULL AND x <> '' AND y <> '' AND x <> y),
      parts AS (SELECT x, y, string_split({swap}, ' ') AS s, string_split({other}, ' ') AS l FROM pairs), masked AS (SELECT *, CASE WHEN len(s) <= {BITS} THEN {masks_sql('s')} END AS m FROM parts),
      rated AS (SELECT x, y, 2.0 * {lcs} / (len(s) + len(l)) AS score FROM masked),
      scores AS (SELECT ext_seq, base_seq, status, field, CASE WHEN base_seq IS NULL THEN 0.0 WHEN each.x = each.y THEN 1.0 WHEN each.x = '' OR each.y = '' THEN 0.0 ELSE score END AS score FROM each LEFT JOIN rated ON each.x = rated.x AND each.y = rated.y)"""


def band_sql(c: str) -> str:
    return f"CASE WHEN {c} > 0.7 THEN 'Highly Similar' WHEN {c} > 0.6 THEN 'Moderately Similar' WHEN {c} > 0.4 THEN 'Slightly Similar' ELSE 'Divergent' END"


CATEGORIES = f"""cats AS (SELECT l.ext_seq, l.base_seq, m AS mean_score, CASE WHEN status = 'ABSENT' THEN 'Absent' WHEN l.base_seq IS NULL THEN 'Non-existent' ELSE {band_sql('m')} END AS category,
  CASE WHEN status = 'ABSENT' THEN 'Absent (not extracted)' WHEN status = 'UNMATCHED_EXCESS' THEN 'Non-existent (excess duplicate)' WHEN l.base_seq IS NULL THEN 'Non-existent (LLM invention)' ELSE 'Matched' END AS type
  FROM links l LEFT JOIN (SELECT ext_seq, avg(score) AS m FROM scores GROUP BY ext_seq) USING (ext_seq))"""
STATS = "stats AS (SELECT field, count(score) AS matched, avg(score) AS avg_v, stddev_samp(score) AS std_v, min(score) AS min_v, max(score) AS max_v, quantile_cont(score, 0.5) AS median_v FROM scores WHERE base_seq IS NOT NULL GROUP BY field)"


def rouge_pairs_sql() -> str:
    lcs = f"CASE WHEN len(s) <= {BITS} THEN {lcs_sql('m', 'len(s)', 'l')} ELSE {long_lcs_sql('s', 'l')} END"
    return f"""WITH r AS (SELECT seq, run_id, {norm_list_sql('description')} AS x FROM records), p AS (SELECT seq, x, lead(x) OVER (PARTITION BY run_id ORDER BY seq) AS y FROM r),
      q AS (SELECT seq, x, y, list_filter(string_split(x, ' '), lambda w: w <> '') AS a, list_filter(string_split(y, ' '), lambda w: w <> '') AS b FROM p WHERE y IS NOT NULL),
      o AS (SELECT seq, x, y, CASE WHEN len(a) <= len(b) THEN a ELSE b END AS s, CASE WHEN len(a) <= len(b) THEN b ELSE a END AS l FROM q), d AS (SELECT DISTINCT s, l FROM o WHERE len(s) > 0),
      c AS (SELECT s, l, {lcs} AS common FROM (SELECT *, CASE WHEN len(s) <= {BITS} THEN {masks_sql('s')} END AS m FROM d))
      SELECT seq, coalesce(common, 0) AS common, round(CASE WHEN x = '' AND y = '' THEN 1.0 WHEN x = '' OR y = '' THEN 0.0 ELSE 2.0 * common / (len(o.s) + len(o.l)) END, 6) AS rouge FROM o LEFT JOIN c ON o.s = c.s AND o.l = c.l"""


def items_sql() -> str:
    """CTE ``ans``: each answer's list as JSON (``l``), by the recovery's rules, '[]' where there is none."""
    lists = "list_filter(json_keys(raw), lambda k: json_type(raw, '$.\"' || k || '\"') = 'ARRAY' AND json_type(raw, '$.\"' || k || '\"[0]') = 'OBJECT' AND json_exists(raw, '$.\"' || k || '\"[0].Name'))"
    cut = r"raw[instr(raw, '['):length(raw) - instr(reverse(raw), ']') + 1]"
    fence = r"trim(regexp_extract(raw, '(?s)```json(.*?)```', 1), E' \n\t\r')"
    return f"""ans AS (SELECT *, CASE WHEN raw IS NULL OR raw = '' THEN '[]'::JSON WHEN json_valid(raw) AND json_type(raw) = 'ARRAY' THEN raw::JSON
        WHEN json_valid(raw) AND json_type(raw) = 'OBJECT' THEN CASE WHEN json_exists(raw, '$.vulnerabilities') THEN CASE WHEN json_type(raw, '$.vulnerabilities') = 'ARRAY' THEN json_extract(raw, '$.vulnerabilities') ELSE '[]'::JSON END
          WHEN len({lists}) > 0 THEN json_extract(raw, '$."' || {lists}[1] || '"') ELSE '[]'::JSON END
        WHEN instr(raw, '[') > 0 AND json_valid({cut}) AND json_type({cut}) = 'ARRAY' THEN ({cut})::JSON
        WHEN json_valid({fence}) AND json_type({fence}) = 'ARRAY' THEN ({fence})::JSON ELSE '[]'::JSON END AS l FROM responses)"""


WORDS = r"len(regexp_extract_all({}, '[\p{{L}}\p{{N}}\p{{M}}_]+|[^\p{{L}}\p{{N}}\p{{M}}_\s]'))"


def answer_validation_sql() -> str:
    count = lambda ch: f"length(raw0) - length(replace(raw0, '{ch}', ''))"
    return f"""WITH {items_sql()}, v AS (SELECT response_id, coalesce(raw, '') AS raw0, json_array_length(l) > 0 AS ok, 800 + coalesce({WORDS.format('text')}, 0) + coalesce({WORDS.format("coalesce(raw, '')")}, 0) AS n, coalesce({WORDS.format('text')}, 0) AS tn
        FROM ans LEFT JOIN blocks b ON ans.doc_id = b.doc_id AND ans.block_id = b.block_id)
      SELECT response_id, ok AS json_valid, n <= 1000 AS token_valid, n AS token_count, NOT ok OR n > 1000 OR tn > 900 AS needs_redivision,
      coalesce(array_to_string([CASE WHEN NOT ok THEN 'invalid JSON or not a list' END, CASE WHEN n > 1000 THEN 'over the token limit' END, CASE WHEN NOT ok AND (contains(raw0, '...') OR contains(lower(raw0), 'truncated')) THEN 'truncated answer' END,
        CASE WHEN NOT ok AND {count('[')} <> {count(']')} THEN 'unbalanced brackets' END, CASE WHEN NOT ok AND {count('{')} <> {count('}')} THEN 'unbalanced braces' END], '; '), '') AS errors FROM v"""


def filled_sql(c: str, empty: str, first: str = "") -> str:
    nothing = f"{c} IS NULL OR lower(trim({c})) IN ({empty})"
    return f"CASE WHEN b_{c} IS NOT NULL AND ({nothing}{f' OR {first}' if first else ''}) THEN b_{c} ELSE {c} END AS {c}"


def inherit_sql() -> str:
    text = lambda c: f"CASE WHEN json_type(r, '$.{c}') IN ('OBJECT', 'ARRAY') THEN NULL ELSE json_extract_string(r, '$.{c}') END AS {c}"
    first = "first_of"
    return f"""WITH {items_sql()}, i AS (SELECT response_id, doc_id, block_id, chunk_id, unnest(from_json(l, '["JSON"]')) AS r, generate_subscripts(from_json(l, '["JSON"]'), 1) - 1 AS item_no FROM ans),
      o AS (SELECT *, block_id = 0 AND row_number() OVER (PARTITION BY doc_id, block_id, chunk_id ORDER BY item_no, response_id) = 1 AS first_of FROM i WHERE json_type(r) = 'OBJECT'),
      f AS (SELECT response_id, item_no, first_of, o.doc_id, o.block_id, {text('Name')}, {text('port')}, {text('protocol')}, {text('severity')} FROM o),
      j AS (SELECT f.*, b.port AS b_port, b.protocol AS b_protocol, b.severity AS b_severity FROM f LEFT JOIN blocks b ON f.doc_id = b.doc_id AND f.block_id = b.block_id)
      SELECT response_id, item_no, Name, {filled_sql('port', "'', 'null', '0'", first)}, {filled_sql('protocol', "'', 'null'", first)}, {filled_sql('severity', "'', 'null'", first)} FROM j"""


def rule_extraction_sql() -> str:
    return rf"""WITH l AS (SELECT doc_id, block_id, unnest(p) AS line, generate_subscripts(p, 1) AS no FROM (SELECT doc_id, block_id, string_split(text, chr(10)) AS p FROM blocks WHERE text IS NOT NULL)),
      t AS (SELECT *, {strip_sql('line')} AS bare FROM l), h AS (SELECT *, regexp_matches(bare, '(?i){_HEAD}') AS head FROM t),
      f AS (SELECT *, last_value(CASE WHEN head THEN bare END IGNORE NULLS) OVER (PARTITION BY doc_id, block_id ORDER BY no) AS hl FROM h),
      r AS (SELECT doc_id, block_id, row_number() OVER (PARTITION BY doc_id, block_id ORDER BY no) - 1 AS item_no, {strip_sql('bare[5:]')} AS Name, nullif(regexp_extract(hl, '(?i){_HEAD}', 2), '') AS port, nullif(regexp_extract(hl, '(?i){_HEAD}', 3), '') AS protocol, upper(nullif(regexp_extract(hl, '(?i){_HEAD}', 1), '')) AS severity FROM f WHERE starts_with(bare, 'NVT:') AND NOT head),
      j AS (SELECT r.*, r.block_id = 0 AND item_no = 0 AS first_of, b.port AS b_port, b.protocol AS b_protocol, b.severity AS b_severity FROM r LEFT JOIN blocks b ON r.doc_id = b.doc_id AND r.block_id = b.block_id)
      SELECT doc_id, block_id, item_no, Name, {filled_sql('port', "'', 'null', '0'", 'first_of')}, {filled_sql('protocol', "'', 'null'", 'first_of')}, {filled_sql('severity', "'', 'null'", 'first_of')} FROM j"""


RANK = "CASE upper({0}) " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in SEVERITY_RANK.items()) + " ELSE 0.0 END"


def merged_sql(rows: str, keys: str, chosen: str) -> str:
    """Groups of ``rows`` merged: the first's name, the highest severity, the first port that is filled, references in order without repeats."""
    rank = RANK.format(strip_sql("severity"))
    return f"""WITH g AS (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY n DESC, seq) AS o FROM (SELECT *, coalesce(TRY_CAST(nullif(regexp_extract(Name, 'Instances \\((\\d+)\\)', 1), '') AS INT), 0) AS n FROM {rows})),
      m AS (SELECT {keys}, arg_min(seq, o) AS seq, arg_min_null(severity, (-({rank}), o)) AS severity, arg_min(port, o) FILTER (port <> '') AS port, list_filter(flatten(list("references" ORDER BY o) FILTER ("references" IS NOT NULL)), lambda x: true) AS refs FROM g GROUP BY {keys}),
      u AS (SELECT *, list_filter(list_transform(refs, lambda x, i: CASE WHEN list_position(refs, x) = i THEN x END), lambda x: x IS NOT NULL) AS united FROM m)
      {chosen}"""


def by_source_sql() -> str:
    """Sources with a strategy, merged by its keys; the others' rows as they are."""
    name, pattern = strip_sql("coalesce(Name, '')"), r"\s*Instances \(\d+\)\s*$"
    base = strip_sql(f"regexp_replace(Name, '{pattern}', '')")
    groups = {"OPENVAS": f"{name} AS k1, port AS k2, protocol AS k3", "TENABLEWAS": f"{base} AS k1, NULL AS k2, NULL AS k3"}
    parts = []
    for source, keys in groups.items():
        inner = f"(SELECT *, {keys} FROM records WHERE source = '{source}' AND {name} <> '')"
        chosen = f"SELECT seq, '{source}' AS source, severity, len(united) AS n_refs FROM u"
        parts.append(f"SELECT * FROM ({merged_sql(inner, 'k1, k2, k3', chosen)})")
    return " UNION ALL ".join([*parts, """SELECT seq, source, severity, coalesce(len("references"), -1) AS n_refs FROM records WHERE source NOT IN ('OPENVAS', 'TENABLEWAS') OR source IS NULL"""])


def consolidation_report_sql() -> str:
    """Counts of each stage, for a source of each kind of strategy."""
    says = f"coalesce(len(list_filter(description, lambda x: length({strip_sql('x')}) > 0)), 0) > 0"
    texts = [f"(coalesce({x}, '') <> '')::INT" for x in ("Name", "port", "protocol", "severity", "plugin", "source", "report")]
    filled = " + ".join(texts + [f"(coalesce(len({x}), 0) > 0)::INT" for x in ("description", "solution", '"references"')])
    best = f"(SELECT description FROM records WHERE source = '{{0}}' QUALIFY row_number() OVER (PARTITION BY {{1}} ORDER BY {filled} DESC, seq) = 1)"
    merged = "(SELECT coalesce(arg_min(description, seq) FILTER (len(description) > 0), arg_min_null(description, seq)) AS description FROM records WHERE source = 'TENABLEWAS' GROUP BY Name, plugin)"
    name = strip_sql("coalesce(Name, '')")
    runs = [
        ("OPENVAS", best.format("OPENVAS", f"{name}, port, protocol"), "most complete", "deduplication"),
        ("TENABLEWAS", merged, "merge of instances", "instance consolidation"),
        ("NESSUS", best.format("NESSUS", "Name"), "most complete", "deduplication"),
    ]
    out = []
    for source, rows, strategy, reason in runs:
        n, m, bad = f"(SELECT count(*) FROM records WHERE source = '{source}')", f"(SELECT count(*) FROM {rows})", f"(SELECT count(*) FROM {rows} WHERE NOT ({says}))"
        for stage, records, removed, why in (("input", n, "0", "NULL"), ("strategy", m, f"{n} - {m}", f"'{reason}'"), ("no_description", bad, bad, "'no valid description'"), ("final", f"{m} - {bad}", "0", "NULL")):
            out.append(f"SELECT '{source}' AS source, '{stage}' AS stage, {records} AS records, {removed} AS removed, '{strategy}' AS strategy, {why} AS reason")
    return " UNION ALL ".join(out)


def tenable_split_sql() -> str:
    """Summaries and bodies before and after the line of the last export mark above the first sign of a finding."""
    mark = EXPORT_MARK
    first = "least(" + ", ".join(f"CASE WHEN regexp_matches(text, '(?i){x}') THEN length(regexp_extract(text, '(?is)^(.*?){x}', 1)) END" for x in (p.replace("(CRITICAL", "(?:CRITICAL") for p in FIRST_FINDING)) + ")"
    return rf"""WITH f AS (SELECT doc_id, text, {first} AS f FROM documents WHERE text IS NOT NULL), h AS (SELECT *, text[1:coalesce(f, 0)] AS head FROM f),
      c AS (SELECT doc_id, text, f, CASE WHEN contains(head, '{mark}') THEN length(regexp_extract(head, '(?s)^(.*\n)?[^\n]*{mark}', 1)) ELSE coalesce(f, 0) END AS cut FROM h),
      p AS (SELECT doc_id, regexp_replace(text[1:cut], '{WS}+$', '') AS s, CASE WHEN f IS NOT NULL THEN regexp_replace(text[cut + 1:], '{mark}[^\n]*', '', 'g') ELSE text[cut + 1:] END AS b FROM c)
      SELECT doc_id, 'body' AS kind, length(b) AS n_chars FROM p UNION ALL SELECT doc_id, 'summary', length(s) FROM p WHERE regexp_matches(s, '\S')"""


def assets_sql(sources: dict[str, str]) -> str:
    """Asset findings with their types, from what each field was written as."""
    out = ["seq"]
    lists = {"definition.references": 'coalesce(len("references"), 0)', "definition.see_also": "CASE WHEN cvss[1] <> '' THEN 1 ELSE 0 END"}
    for name, kind in ASSET_FIELDS.items():
        column, x = name.replace(".", "_"), sources.get(name)
        if name in lists:
            out.append(f"{lists[name]} AS {column}_n")
            continue
        if name == "definition.description":
            x = "array_to_string(description, chr(10))"
        elif name == "definition.cvss2.base_score":
            x = "seq::VARCHAR"
        elif x is None:
            x = "NULL"
        for spark, duck in (("STRING", "VARCHAR"), ("`", '"'), ("10.0D", "10.0::DOUBLE")):
            x = x.replace(spark, duck)
        x = re.sub(r"get\(([^,]+), 0\)", r"\1[1]", x)
        kinds = {"string!": f"coalesce({x}, '')", "number": f"TRY_CAST({x} AS DOUBLE)", "int": f"CASE WHEN regexp_full_match({x}, '-?[0-9]+') THEN TRY_CAST({x} AS INT) END"}
        out.append(f"{kinds.get(kind, x)} AS {column}")
    named = strip_sql("coalesce(Name, '')")
    return f"SELECT {', '.join(out)} FROM records WHERE {named} <> ''"


def dataset_sql() -> str:
    kinds = dict(RECORD_FIELDS)

    def struct(v: str, kind: str) -> str:
        names = [p.split(":")[0].strip() for p in kind.removeprefix("struct<").removesuffix(">").split(",")]
        return "'{' || concat_ws(',', " + ", ".join(f"CASE WHEN {v}.{n} IS NOT NULL THEN '\"{n}\":' || to_json({v}.{n}) END" for n in names) + ") || '}'"

    out = []
    for c in DATASET_FIELDS:
        q = f'"{c}"'
        if c == "id":
            out.append("row_number() OVER (ORDER BY lower(Name), seq) AS id")
        elif c == "severity":
            out.append(f"coalesce(upper({strip_sql('severity')}), '') AS severity")
        elif kinds.get(c) == "array<string>":
            out.append(f"coalesce(array_to_string({q}, ';'), '') AS {q}")
        elif kinds.get(c, "").startswith("array<struct"):
            each = struct("x", kinds[c].removeprefix("array<").removesuffix(">"))
            out.append(f"coalesce('[' || array_to_string(list_transform({q}, lambda x: CASE WHEN x IS NULL THEN 'null' ELSE {each} END), ',') || ']', '') AS {q}")
        elif kinds.get(c, "").startswith("struct"):
            out.append(f"CASE WHEN {q} IS NULL THEN '' ELSE {struct(q, kinds[c])} END AS {q}")
        else:
            out.append(f"coalesce({q}, '') AS {q}")
    return f"SELECT {', '.join(out)} FROM records"


def oracle_sql() -> dict[str, str]:
    named = "(SELECT *, CASE WHEN len(instances) > 0 THEN Name || ' Instances (' || len(instances) || ')' ELSE Name END AS full_name, coalesce(len(instances), 0) > 0 AS is_i FROM records)"
    shown = "CASE WHEN coalesce(port, '') <> '' AND coalesce(protocol, '') <> '' THEN port || '/' || protocol WHEN coalesce(port, '') <> '' THEN port WHEN coalesce(protocol, '') <> '' THEN protocol ELSE 'N/A' END"
    tagged = rf"""list_filter("references", lambda r: starts_with(lower({strip_sql('r')}), 'cve:'))[1]"""
    cve = rf"""coalesce({strip_sql(rf"regexp_replace({strip_sql(tagged)}, '(?i)^cve:', '')")}, list_filter(string_split_regex(list_filter("references", lambda r: contains(upper(r), 'CVE-'))[1], '\s+'), lambda x: contains(upper(x), 'CVE-'))[1], 'N/A')"""
    ip = "(SELECT i.ip, lower(r.Name) AS name FROM {0} r JOIN inventory i ON r.report = i.container)"
    sorted_words = "array_to_string(list_sort(list_filter(string_split_regex({0}, '[\\s\\p{{Z}}]+'), lambda w: w <> '')), ' ')"
    parts = "(SELECT DISTINCT p_brand AS brand, concat_ws(' ', p_name, p_type) AS name FROM part)"
    return {
        "summary_lines": f"SELECT seq, coalesce(Name, 'N/A') || ' | ' || coalesce(upper({strip_sql('severity')}), 'N/A') || ' | ' || {shown} || ' | ' || {cve} AS line FROM records",
        "ellipsis_and_clock": "WITH s AS (SELECT event_id, round(value * 100, 3) AS s, props FROM events) SELECT event_id, printf('%02d:%02d:%06.3f', (floor(floor(s) / 3600))::INT, (floor((floor(s)::BIGINT % 3600) / 60))::INT, s - floor(s / 60) * 60) AS clock, CASE WHEN length(props) > 6 THEN props[1:6] || '...' ELSE props END AS short FROM s",
        "dataset_rows": dataset_sql(),
        "json_recover": f"WITH {items_sql()} SELECT response_id, json_array_length(l) AS n_items FROM ans",
        "answer_validation": answer_validation_sql(),
        "inherit_headers": inherit_sql(),
        "rule_extraction": rule_extraction_sql(),
        "merge_groups": merged_sql("records", "run_id, Name, source", "SELECT seq, severity, port, coalesce(array_to_string(united, '|'), '') AS refs FROM u"),
        "base_instances_join": f"""WITH n AS (SELECT *, {strip_sql("regexp_replace(full_name, '\\s*Instances \\(\\d+\\)\\s*$', '')")} AS base FROM {named}), b AS (SELECT seq, Name, plugin, base FROM n WHERE is_i IS NOT TRUE),
          i AS (SELECT base, plugin, sum(len(instances)) AS n, min(seq) AS seq FROM n WHERE is_i GROUP BY base, plugin)
          SELECT coalesce(b.seq, i.seq) AS seq, coalesce(b.Name, i.base) AS Name, coalesce(b.plugin, i.plugin) AS plugin, coalesce(i.n, -1) AS n_instances FROM b FULL JOIN i ON b.base IS NOT DISTINCT FROM i.base AND b.plugin IS NOT DISTINCT FROM i.plugin""",
        "match_fuzzy": f"""SELECT name, candidate, brand, round(score, 6) AS score FROM {best_alike_sql(f"(SELECT brand, name || ' x' AS name FROM {parts})", f"(SELECT *, row_number() OVER (PARTITION BY brand ORDER BY name) AS rank FROM {parts})", 0.85, 'brand')}""",
        "match_fuzzy_names": f"WITH {resolved_sql()} SELECT name, candidate, round(score, 6) AS score FROM alike",
        "match_token_sort": f"""WITH {LATEST}, e AS (SELECT ip, name FROM {ip.format(model_sql('gpt4'))}), b AS (SELECT DISTINCT ip, name FROM {ip.format(model_sql('llama4'))}),
          w AS {best_alike_sql('e', '(SELECT *, row_number() OVER (PARTITION BY ip ORDER BY name) AS rank FROM b)', 0.85, 'ip', sorted_words)}
          SELECT e.ip, coalesce(candidate, e.name) AS matched_name, count(*) AS n FROM e LEFT JOIN w ON e.ip = w.ip AND e.name = w.name GROUP BY ALL""",
        "link_mapping": mapping_sql(),
        "link_models": f"WITH {links_sql()} SELECT * FROM links",
        "link_scores": f"WITH {scores_sql()}, {CATEGORIES} SELECT ext_seq, base_seq, round(mean_score, 6) AS mean_score, category, type FROM cats",
        "link_field_stats": f"WITH {scores_sql()}, {STATS} SELECT field, matched, {', '.join(f'round({c}, 6) AS {c}' for c in ('avg_v', 'std_v', 'min_v', 'max_v', 'median_v'))} FROM stats",
        "link_summary": f"""WITH {scores_sql()}, {CATEGORIES}, {STATS} SELECT (SELECT count(ext_seq) FROM links) AS total, (SELECT count(*) FROM links WHERE ext_seq IS NOT NULL AND base_seq IS NOT NULL) AS matched,
          count(*) FILTER (category = 'Highly Similar') AS highly_similar, count(*) FILTER (category = 'Moderately Similar') AS moderately_similar, count(*) FILTER (category = 'Slightly Similar') AS slightly_similar, count(*) FILTER (category = 'Divergent') AS divergent,
          count(*) FILTER (category = 'Non-existent') AS non_existent, count(*) FILTER (category = 'Absent') AS absent, count(*) FILTER (type LIKE '%excess%') AS excess, count(*) FILTER (type LIKE '%invention%') AS invented,
          round((SELECT avg(avg_v) FROM stats), 6) AS overall_mean, round((SELECT avg_v FROM stats WHERE field = 'description'), 6) AS description_mean FROM cats""",
        "category_counts_by_source": f"""WITH {scores_sql()}, {CATEGORIES} SELECT coalesce(e.source, b.source) AS source, count(*) FILTER (category = 'Highly Similar') AS highly_similar, count(*) FILTER (category = 'Moderately Similar') AS moderately_similar,
          count(*) FILTER (category = 'Slightly Similar') AS slightly_similar, count(*) FILTER (category = 'Divergent') AS divergent, count(*) FILTER (category = 'Non-existent') AS non_existent, count(*) FILTER (category = 'Absent') AS absent,
          count(*) FILTER (type LIKE '%excess%') AS excess, count(*) FILTER (type LIKE '%invention%') AS invented FROM cats LEFT JOIN e ON cats.ext_seq = e.seq LEFT JOIN b ON cats.base_seq = b.seq GROUP BY 1""",
        "listlike_normalize": f"""SELECT seq, {norm_list_sql('"references"')} AS text FROM records""",
        "semantic_text_scores": """WITH p AS (SELECT seq, coalesce(Name, '') AS x, coalesce(lead(Name) OVER (PARTITION BY run_id ORDER BY seq), '') AS y FROM records),
          t AS (SELECT seq, x, y, list_filter(string_split_regex(lower(x), '[\\s\\p{Z}]+'), lambda w: w <> '') AS a, list_filter(string_split_regex(lower(y), '[\\s\\p{Z}]+'), lambda w: w <> '') AS b FROM p),
          n AS (SELECT seq, x, y, list_sum(list_transform(list_distinct(a), lambda w: len(list_filter(a, lambda u: u = w)) * len(list_filter(b, lambda u: u = w)))) AS ab, list_sum(list_transform(list_distinct(a), lambda w: len(list_filter(a, lambda u: u = w)) ** 2)) AS aa, list_sum(list_transform(list_distinct(b), lambda w: len(list_filter(b, lambda u: u = w)) ** 2)) AS bb FROM t)
          SELECT seq, round(CASE WHEN x = '' AND y = '' THEN 1.0 WHEN x = '' OR y = '' THEN 0.0 ELSE least(1.0, greatest(0.0, coalesce(ab / sqrt(aa * bb), 0.0))) END, 6) AS score FROM n""",
        "rouge_l_pairs": rouge_pairs_sql(),
        "by_source_consolidation": by_source_sql(),
        "consolidation_report": consolidation_report_sql(),
        "summary_body_split_tenable": tenable_split_sql(),
        "chunk_token_windows": r"""WITH t AS (SELECT doc_id, block_id, regexp_extract_all(text, '[\s\p{Z}\x1c-\x1f\x{85}\v]*(?:[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s\p{Z}\x1c-\x1f\x{85}\v])|[\s\p{Z}\x1c-\x1f\x{85}\v]+$') AS t FROM blocks WHERE text <> ''),
          k AS (SELECT doc_id, block_id, unnest(t) AS tok, (generate_subscripts(t, 1) - 1) // 200 AS chunk_id FROM t) SELECT doc_id, block_id, chunk_id, sum(length(tok)) AS n_chars FROM k GROUP BY ALL""",
        "host_addresses": "SELECT d.doc_id, i.ip AS address FROM documents d LEFT JOIN inventory i ON d.report = i.container",
        "scanner_detection": "SELECT source, CASE WHEN upper(source) = 'OPENVAS' THEN 'openvas' WHEN upper(source) IN ('TENABLE', 'NESSUS') THEN 'tenable' ELSE 'generic' END AS scanner, count(*) AS n FROM records WHERE source IS NOT NULL GROUP BY ALL",
        "token_cost": f"""WITH {LATEST}, p(m, i, o) AS (VALUES ('gpt4', 3.0, 12.0), ('gpt5', 2.5, 20.0), ('llama4', 1.0, 3.5)), t AS (SELECT l.llm, coalesce({WORDS.format('text')}, 0) AS i, coalesce({WORDS.format('raw')}, 0) AS o FROM responses r JOIN blocks b ON r.doc_id = b.doc_id AND r.block_id = b.block_id JOIN latest l ON l.run_id = r.doc_id)
          SELECT coalesce(llm, 'all') AS llm, sum(t.i) AS tokens_input, sum(t.o) AS tokens_output, count(*) AS calls, round(coalesce(sum((t.i * p.i + t.o * p.o) / 1e6), 0), 6) AS cost, bool_and(p.m IS NOT NULL) AS priced FROM t LEFT JOIN p ON t.llm = p.m GROUP BY ROLLUP (llm)""",
    }
