"""The SQL of cut texts for DuckDB, whose patterns can't look around: marks that are looked at are put back instead."""

from __future__ import annotations

from scoria.llm.truncation import END_PART, FIELDS, MIN_ENDS, MIN_INSIDE, MIN_INSIDE_PAIR

_WS = r"[\s\p{Z}\v\x1c-\x1f\x{85}]"
_SAYS = r"[^\s\p{Z}\v\x1c-\x1f\x{85}]"
_LEFT_OUT = r"(?:\s*(?:\[\s*)?(?:\.\.\.+|…)(?:\s*\])?|-|�|&\w{1,6})\s*$"


def cut_texts_sql() -> str:
    """CTEs up to ``cut`` (``text``), of the elements of all records."""
    elements = ", ".join(f"coalesce({f}, [])" for f in FIELDS)
    shape = r"regexp_replace(regexp_replace(regexp_replace(regexp_replace(w, '0x[0-9a-f]+', '0x', 'g'), '\p{Lu}\p{L}*', 'A', 'g'), '[\p{Ll}\p{Lt}\p{Lm}\p{Lo}]+', 'a', 'g'), '[0-9]+', '#', 'g')"
    word = rf"""CASE WHEN regexp_matches(w, '[0-9/_@]|[.:-].') THEN {shape} WHEN i > 1 AND regexp_matches(w, '^["''(\[]*\p{{Lu}}') THEN 'N' || regexp_extract(w, '[^\p{{L}}]*$', 0) ELSE lower(w) END"""
    bounded = "least({0}ends, 2 * ({0}ends - {0}most))"
    own, pair = bounded.format(""), bounded.format("pair_")
    return rf"""el AS (SELECT unnest(flatten([{elements}])) AS text FROM records), texts AS (SELECT text, count(*) AS copies FROM el WHERE regexp_matches(text, '{_SAYS}') GROUP BY text),
      cleaned AS (SELECT text, copies, regexp_replace(regexp_replace(text, '^{_WS}+|{_WS}+$', '', 'g'), '{_LEFT_OUT}', '') AS c FROM texts),
      split AS (SELECT text, copies, string_split(regexp_replace(c, '([.!?]["'')\]]*)\s+(["''(\[]*\p{{Lu}})', '\1' || chr(10) || '\2', 'g'), chr(10)) AS parts FROM cleaned),
      sentences AS (SELECT text, copies, unnest(list_transform(parts, lambda p, i: struct_pack(final := i = len(parts), sentence := trim(p))), recursive := true) FROM split),
      shaped AS (SELECT text, copies, final, sentence, string_split(regexp_replace(regexp_replace(array_to_string(list_concat(['^', '^'], list_transform(list_filter(string_split_regex(sentence, '\s+'), lambda w: w <> ''), lambda w, i: {word})), ' '),
        '\bN(?: N\b)+', 'N', 'g'), '\bN (#)', 'N\1', 'g'), ' ') AS words FROM sentences WHERE regexp_matches(sentence, '{_SAYS}')),
      once AS (SELECT any_value(words) AS words, sum(copies) AS copies FROM shaped GROUP BY sentence HAVING len(any_value(words)) > 2),
      occurrences AS (SELECT copies, len(words) AS n, words, unnest(generate_series(3, len(words))) AS k FROM once),
      grams AS (SELECT words[k - 2] AS w1, words[k - 1] AS w2, words[k] AS w3, sum(CASE WHEN k < n THEN copies ELSE 0 END) AS inside, sum(CASE WHEN k = n THEN copies ELSE 0 END) AS ends, count(*) FILTER (k = n) AS end_kinds, count(*) FILTER (k < n) AS inside_kinds,
        max(CASE WHEN k = n THEN copies ELSE 0 END) AS most FROM occurrences GROUP BY ALL),
      finals AS (SELECT text, words[-3] AS w1, words[-2] AS w2, words[-1] AS w3, len(list_filter(generate_series(3, len(words) - 1), lambda k: words[k] = words[-1] AND words[k - 1] = words[-2] AND words[k - 2] = words[-3])) AS own FROM shaped WHERE final AND len(words) > 2),
      wanted AS (SELECT DISTINCT w1, w2, w3 FROM finals), sizes AS (SELECT w1, w2, list(DISTINCT length(w3)) AS sizes FROM wanted GROUP BY ALL),
      begun0 AS (SELECT g.w1, g.w2, unnest(list_concat(list_transform(list_filter(sizes, lambda k: k < length(g.w3)), lambda k: g.w3[1:k]), CASE WHEN regexp_matches(g.w3, '^A[^A-Za-z]') THEN ['N', 'N' || g.w3[2:2]] ELSE [] END, CASE WHEN regexp_matches(g.w3, '^[Aa][^A-Za-z]') THEN ['a name'] ELSE [] END)) AS w3, inside + ends AS n, inside_kinds + end_kinds AS kinds
        FROM grams g JOIN sizes p ON g.w1 = p.w1 AND g.w2 = p.w2),
      begun AS (SELECT w1, w2, w3, sum(n) AS longer, sum(kinds) AS longer_kinds FROM begun0 GROUP BY ALL),
      triples AS (SELECT w.w1, w.w2, w.w3, coalesce(g.inside, 0) + coalesce(b.longer, 0) AS inside, coalesce(g.ends, 0) AS ends, coalesce(g.end_kinds, 0) AS end_kinds, coalesce(g.inside_kinds, 0) + coalesce(b.longer_kinds, 0) AS inside_kinds, coalesce(g.most, 0) AS most
        FROM wanted w LEFT JOIN grams g ON w.w1 = g.w1 AND w.w2 = g.w2 AND w.w3 = g.w3 LEFT JOIN begun b ON w.w1 = b.w1 AND w.w2 = b.w2 AND w.w3 = b.w3),
      pairs AS (SELECT p.w2, p.w3, coalesce(g.inside, 0) + coalesce(b.longer, 0) AS pair_inside, coalesce(g.ends, 0) AS pair_ends, coalesce(g.most, 0) AS pair_most FROM (SELECT DISTINCT w2, w3 FROM wanted) p
        LEFT JOIN (SELECT w2, w3, sum(inside) AS inside, sum(ends) AS ends, max(most) AS most FROM grams GROUP BY ALL) g ON p.w2 = g.w2 AND p.w3 = g.w3 LEFT JOIN (SELECT w2, w3, sum(longer) AS longer FROM begun GROUP BY ALL) b ON p.w2 = b.w2 AND p.w3 = b.w3),
      counted AS (SELECT f.text, f.own, t.* EXCLUDE (w1, w2, w3), p.* EXCLUDE (w2, w3), CASE WHEN f.w2 <> '^' AND regexp_full_match(f.w3, '\p{{Ll}}+') THEN coalesce(n.longer, 0) ELSE 0 END AS names FROM finals f JOIN triples t ON f.w1 = t.w1 AND f.w2 = t.w2 AND f.w3 = t.w3
        JOIN pairs p ON f.w2 = p.w2 AND f.w3 = p.w3 LEFT JOIN (SELECT w1, w2, longer FROM begun WHERE w3 = 'a name') n ON f.w1 = n.w1 AND f.w2 = n.w2),
      cut AS (SELECT text FROM counted WHERE CASE WHEN end_kinds >= {MIN_ENDS} AND end_kinds >= {END_PART} * (inside_kinds + end_kinds) AND {own} >= {END_PART} * (inside + {own}) THEN false WHEN inside_kinds - own >= {MIN_INSIDE} OR names >= {MIN_INSIDE} THEN true
        ELSE own = 0 AND pair_inside >= {MIN_INSIDE_PAIR} AND {pair} < {END_PART} * (pair_inside + {pair}) END),
      last_texts AS (SELECT seq, source, field, list_filter(elements, lambda x: regexp_matches(x, '{_SAYS}'))[-1] AS text FROM ({' UNION ALL '.join(f"SELECT seq, source, '{f}' AS field, {f} AS elements FROM records" for f in FIELDS)}))"""


def oracle_sql() -> dict[str, str]:
    cut = cut_texts_sql()
    return {
        "p2_found": f"WITH {cut} SELECT seq, field FROM last_texts WHERE text IN (SELECT text FROM cut)",
        "p2_rates": f"WITH {cut} SELECT source, field, count(*) AS texts, count(c.text) AS cut, count(c.text) / count(*) AS cut_share FROM last_texts l LEFT JOIN (SELECT DISTINCT text FROM cut) c ON l.text = c.text WHERE l.text IS NOT NULL GROUP BY source, field",
    }
