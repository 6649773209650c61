"""Queries of problem 5: nested answers as related flat tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scoria.operators import dewey
from scoria.schemas import TEXT_ARRAYS
from scoria.session import cut_lineage, table


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = dewey.child_rows(dewey.label_nodes(table(spark, sf_dir, "responses")))
    return rows.withColumnRenamed("id", "response_id").select("response_id", "rec_no", "child", "child_no", "sub_no")


def _flat(name: str) -> Callable[[SparkSession, str], DataFrame]:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        """One flat table; the record's lists of texts are joined by line ends here."""
        out = dewey.flat_table(dewey.label_nodes(table(spark, sf_dir, "responses")), name).withColumnRenamed("id", "response_id")
        return out.withColumns({c: F.array_join(c, "\n") for c, kind in out.dtypes if kind == "array<string>"})

    return query


def p5_orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per table its rows and how many of them have no parent in the table above; records need none."""
    nodes = cut_lineage(dewey.label_nodes(table(spark, sf_dir, "responses")).select("id", "label", "parent", "path"))
    parents = nodes.select("id", F.col("label").alias("parent"), F.col("path").alias("above")).distinct()
    linked = nodes.withColumn("above", F.regexp_replace("path", "/[^/]+$", "")).join(parents.withColumn("known", F.lit(1)), ["id", "parent", "above"], "left")
    orphan = F.col("parent").isNotNull() & F.col("known").isNull()
    return linked.groupBy("path").agg(F.count(F.lit(1)).alias("n"), F.count_if(orphan).alias("orphans"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"p5_found": p5_found, "p5_orphans": p5_orphans} | {f"p5_{n}": _flat(n) for n in dewey.COLUMNS}


_TEXTS = tuple(c for c in dewey.COLUMNS["records"] if c in TEXT_ARRAYS)


def _held(v: str) -> str:
    """What a nested field's JSON holds: itself, or the JSON list or object whose text it is."""
    text = f"({v} ->> '$')"
    return f"CASE WHEN json_type({v}) = 'VARCHAR' AND regexp_matches({text}, '^\\s*[\\[{{]') AND json_valid({text}) THEN {text}::JSON ELSE {v} END"


def _places(v: str) -> str:
    """Children and their places; one that isn't in a list has place 0."""
    return f"CASE WHEN json_type({v}) = 'ARRAY' THEN from_json({v}, '[\"JSON\"]') ELSE [{v}] END"


def _node(v: str) -> str:
    return f"CASE json_type({v}) WHEN 'VARCHAR' THEN regexp_matches({v} ->> '$', '\\S') WHEN 'OBJECT' THEN len(list_filter(json_keys({v}), lambda k: json_type(json_extract({v}, '$.\"' || k || '\"')) <> 'NULL')) > 0 ELSE false END"


def nodes_sql() -> str:
    """Answers' records (``rec``) and children (``kid``) in DuckDB: an answer is JSON as a whole, in a fence, or from a line's first bracket to the last."""
    kids = " UNION ALL ".join(f"SELECT response_id, rec_no, '{c}' AS child, {_held(f'json_extract(rec, {chr(39)}$.{c}{chr(39)})')} AS held FROM rec" for c in dewey.CHILDREN)
    return rf"""WITH tries AS (SELECT response_id, [raw, regexp_extract(raw, '(?s)```\w*\s*(.*?)\s*```', 1), regexp_extract(raw, '(?s)(?:^|\n)([\[{{].*[\]}}])', 1)] AS t FROM responses WHERE raw IS NOT NULL),
      ans AS (SELECT response_id, list_filter(t, lambda x: regexp_matches(x, '^\s*[\[{{]') AND json_valid(x))[1]::JSON AS j FROM tries),
      lst AS (SELECT response_id, CASE WHEN json_type(j) = 'ARRAY' THEN j WHEN json_type(j, '$.Name') <> 'NULL' THEN json_array(j) WHEN json_type(j, '$.vulnerabilities') = 'ARRAY' THEN json_extract(j, '$.vulnerabilities')
        ELSE json_extract(j, '$."' || coalesce(list_filter(json_keys(j), lambda k: json_type(json_extract(j, '$."' || k || '"')) = 'ARRAY' AND len(list_filter(from_json(json_extract(j, '$."' || k || '"'), '["JSON"]'), lambda x: coalesce(json_type(x, '$.Name'), 'NULL') <> 'NULL')) > 0),
          list_filter(json_keys(j), lambda k: json_type(json_extract(j, '$."' || k || '"')) = 'ARRAY'))[1] || '"') END AS l FROM ans WHERE j IS NOT NULL),
      each AS (SELECT response_id, unnest(from_json(l, '["JSON"]')) AS rec, generate_subscripts(from_json(l, '["JSON"]'), 1) - 1 AS rec_no FROM lst WHERE json_type(l) = 'ARRAY'),
      rec AS (SELECT * FROM each WHERE json_type(rec) = 'OBJECT' AND coalesce(json_type(rec, '$.Name'), 'NULL') <> 'NULL'),
      held AS ({kids}),
      kid0 AS (SELECT response_id, rec_no, child, unnest({_places('held')}) AS v, generate_subscripts({_places('held')}, 1) - 1 AS child_no FROM held WHERE held IS NOT NULL),
      kid1 AS (SELECT * FROM kid0 WHERE {_node('v')}),
      info AS (SELECT response_id, rec_no, child_no, {_held("json_extract(v, '$.http_info')")} AS info FROM kid1 WHERE child = 'instances' AND json_type(v) = 'OBJECT'),
      hdr0 AS (SELECT response_id, rec_no, child_no, {_held("json_extract(info, '$.response_headers')")} AS held FROM info WHERE json_type(info) = 'OBJECT'),
      hdr1 AS (SELECT response_id, rec_no, child_no, unnest({_places('held')}) AS v, generate_subscripts({_places('held')}, 1) - 1 AS sub_no FROM hdr0 WHERE held IS NOT NULL),
      kid AS (SELECT response_id, rec_no, child, child_no, -1 AS sub_no, v FROM kid1 UNION ALL SELECT response_id, rec_no, 'headers', child_no, sub_no, v FROM hdr1 WHERE {_node('v')})"""


def oracle_sql() -> dict[str, str]:
    def field(v: str, c: str) -> str:
        return f"json_extract_string({v}, '$.{c}')"

    def texts(c: str) -> str:
        v = _held(f"json_extract(rec, '$.{c}')")
        return f"CASE WHEN json_type({v}) = 'ARRAY' THEN array_to_string(from_json({v}, '[\"VARCHAR\"]'), chr(10)) ELSE {field('rec', c)} END AS {c}"

    label = "rec_no || '.' || child_no || CASE WHEN sub_no < 0 THEN '' ELSE '.' || sub_no END"
    parent = "rec_no::VARCHAR || CASE WHEN sub_no < 0 THEN '' ELSE '.' || child_no END"
    plain = "CASE WHEN json_type(v) = 'VARCHAR' THEN v ->> '$' END"
    out = {
        "p5_found": nodes_sql() + " SELECT response_id, rec_no, child, child_no, sub_no FROM kid",
        "p5_orphans": nodes_sql() + " SELECT 'record' AS path, count(*) AS n, 0 AS orphans FROM rec UNION ALL SELECT 'record/' || CASE child WHEN 'headers' THEN 'instances/headers' ELSE child END, count(*), 0 FROM kid GROUP BY 1",
    }
    for name, columns in dewey.COLUMNS.items():
        if name == "records":
            chosen = ", ".join(texts(c) if c in _TEXTS else f"{field('rec', c)} AS {c}" for c in columns)
            out["p5_records"] = f"{nodes_sql()} SELECT response_id, rec_no::VARCHAR AS label, NULL AS parent, {chosen}, NULL AS extra FROM rec"
            continue
        http = "(SELECT any_value(info) FROM info i WHERE i.response_id = kid.response_id AND i.rec_no = kid.rec_no AND i.child_no = kid.child_no)" if name == "instances" else ""
        chosen = ", ".join((f"coalesce({plain}, {field('v', c)})" if c == "value" else f"coalesce({field('v', c)}, {field(http, c)})" if http else field("v", c)) + f" AS {c}" for c in columns)
        out[f"p5_{name}"] = f"{nodes_sql()} SELECT response_id, {label} AS label, {parent} AS parent, {chosen}, NULL AS extra FROM kid WHERE child = '{name}'"
    return out
