import json

from scoria.operators import dewey

RECORD = {
    "Name": "a",
    "instances": json.dumps([{"instance": "u", "http_info": {"request_method": "GET", "response_headers": {"name": "h", "value": None}}}, None, {}, {"instance": None}, "plain"]),
    "references": "CVE-1",
    "plugin_details": [{"family": None}, {"family": "f"}],
}


def children(raw):
    return [(label, path.split("/")[-1]) for label, path, _ in dewey.nodes_of(raw) if path != "record"]


def test_places_and_forms():
    assert children(json.dumps([7, RECORD])) == [("1.0", "instances"), ("1.0.0", "headers"), ("1.4", "instances"), ("1.0", "references"), ("1.1", "plugin_details")]
    assert children(json.dumps(RECORD))[0] == ("0.0", "instances")
    assert children(json.dumps({"status": 1, "items": [RECORD]}))[0] == ("0.0", "instances")


def test_wrapping():
    body = json.dumps([RECORD])
    for raw in (f"```json\n{body}\n```", f"Found (see [1]):\n{body}\n(no more)", f"Result {{partial}}:\n{body}"):
        assert children(raw) == children(body)


def test_nothing_to_find():
    body = json.dumps([RECORD])
    for raw in (None, "", "  ", "no [1] list", "[]", "{}", "null", body[:-1], body[: len(body) // 2], "```\n" + body[:40] + "\n```", '{"error": "x"}', "[" * 100000):
        assert children(raw) == []
    assert children(json.dumps([{"Name": None, "references": "x"}, {"references": ["y"]}])) == []


def test_incomplete_lists_of_any_beginning():
    """Whatever the first items are: an incomplete list has no records, not even whole ones within it."""
    record = json.dumps(RECORD)
    for first in ("7", "-1.5e3", '"see next chunk"', "null", "true", "[1]", "{}", '"a [b] {c}"', "7, null, [], {}"):
        for ends in (f"[{first}, {record}", f"[{first}, {record},", f"[{first}, {record[:-9]}", f"[\n {first},\n {record}, {{", f"[{first}, {record}, oops]", f"Found (see [1]):\n[{first}, {record}\n```"):
            assert children(ends) == [], ends
        assert children(f"[{first}, {record}]") and children(f"Found [1, 2 and 3] in [see above] {{all}}:\n[{first}, {record}]")
    assert children("[[[[" + record) == [] and children("[" * 3000 + record) == []


def test_all_fields_are_kept(spark):
    record = {"Name": "n", "solution": "one", "impact": ["a", {"b": 1}, None], "cvss": '["x", "y"]', "severity": 3, "insight": None, "log_method": "[no list", "odd": {"k": [1]}, "more": "t"}
    rows = [(1, json.dumps([record | {"instances": [{"instance": "u", "uri": "v"}], "references": [{"type": "t", "value": 5, "note": "z"}, "R"], "plugin_details": {"plugin_id": 1, "cpe": None}}]))]
    tables = {n: t.collect() for n, t in dewey.flat_tables(spark.createDataFrame(rows, "response_id bigint, raw string")).items()}
    r = tables["records"][0]
    assert (r.Name, r.solution, r.impact, r.cvss, r.severity, r.insight, r.log_method) == ("n", ["one"], ["a", '{"b":1}', None], ["x", "y"], "3", None, ["[no list"])
    assert json.loads(r.extra) == {"odd": '{"k":[1]}', "more": "t"}
    assert json.loads(tables["instances"][0].extra) == {"uri": "v"} and tables["plugin_details"][0].plugin_id == "1"
    assert [(x.type, x.value, x.extra) for x in sorted(tables["references"], key=lambda x: x.label)] == [("t", "5", '{"note":"z"}'), (None, "R", None)]


def test_tables_and_links(spark):
    rows = [(1, json.dumps([RECORD]), "clash"), (2, None, "x"), (3, json.dumps([RECORD]), "y"), (3, "broken [", "z")]
    nodes = dewey.label_nodes(spark.createDataFrame(rows, "response_id bigint, raw string, label string"))
    got = nodes.collect()
    labels = {(r.id, r.label) for r in got}
    assert all(r.parent is None or (r.id, r.parent) in labels for r in got) and {r.id for r in got} == {1, 3}
    instances = dewey.flat_table(nodes, "instances").filter("id = 1").orderBy("label").collect()
    assert (instances[0].instance, instances[0].request_method, instances[0].parent) == ("u", "GET", "0")
    refs = dewey.flat_table(nodes, "references").filter("id = 1").first()
    assert (refs.value, refs.parent) == ("CVE-1", "0")
    rows = sorted((r.child, r.child_no, r.sub_no) for r in dewey.child_rows(nodes).filter("id = 1").collect())
    assert rows == [("headers", 0, 0), ("instances", 0, -1), ("instances", 4, -1), ("plugin_details", 1, -1), ("references", 0, -1)]
    empty = dewey.label_nodes(spark.createDataFrame([], "response_id bigint, raw string"))
    assert empty.count() == 0
