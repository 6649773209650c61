import json

from pyspark.sql import functions as F

from scoria.sources import readers, writers
from scoria.streaming import streams


def records(spark):
    rows = [("b", ["x", 'say "hi"'], "HIGH", "443", 1), ("A", None, None, None, 2)]
    return spark.createDataFrame(rows, "Name string, description array<string>, severity string, port string, seq bigint")


def test_csv_round_trip(spark, tmp_path):
    writers.write_csv(records(spark), str(tmp_path / "c"))
    back = readers.read_csv(spark, str(tmp_path / "c")).orderBy("seq").collect()
    assert back[0].asDict() == {"Name": "b", "severity": "HIGH", "port": "443", "description": 'x; say "hi"', "seq": "1"} or back[0].description == 'x; say "hi"'
    writers.write_tsv(records(spark).limit(0), str(tmp_path / "t"))
    assert readers.read_csv(spark, str(tmp_path / "t"), sep="\t").first().Name == "no records"


def test_json_round_trip(spark, tmp_path):
    path = tmp_path / "scan_my_app.json"
    assert writers.write_json_array(records(spark), str(path)) == 2
    assert [r["Name"] for r in json.loads(path.read_text())] == ["b", "A"]
    back = readers.read_records(spark, str(path))
    assert {(r.Name, r.report) for r in back.collect()} == {("b", "my app"), ("A", "my app")}
    writers.write_json_lines(records(spark), str(tmp_path / "l"), ["seq", "Name"])
    assert readers.read_json_lines(spark, str(tmp_path / "l"), "seq bigint, Name string").count() == 2


def test_workbooks(spark, tmp_path):
    writers.write_xlsx({"Vulnerabilities": records(spark), "Metadata": writers.metadata(records(spark), "xlsx")}, str(tmp_path / "w.xlsx"))
    got = readers.read_workbook(spark, str(tmp_path), "Vulnerabilities", ["Name", "severity", "nope"]).orderBy("row_no").collect()
    assert [(r.Name, r.severity, r.nope) for r in got] == [("b", "HIGH", None), ("A", "", None)]
    assert readers.read_workbook(spark, str(tmp_path), "missing", ["item"], "Metadata").count() == 5
    writers.write_workbook({"s": records(spark)}, str(tmp_path / "dir"))
    assert readers.read_workbook(spark, str(tmp_path / "dir"), "s", []).count() == 2


def test_dispatch_isolates_failures(spark, tmp_path, monkeypatch):
    monkeypatch.setitem(writers.FORMATS, "tsv", lambda df, p: 1 / 0)
    assert set(writers.write(records(spark), str(tmp_path / "o"), ["csv", "tsv"])) == {"tsv"}
    assert writers.write(records(spark), str(tmp_path / "o"), ["none"]) == {}


def test_small_sources(spark, tmp_path):
    (tmp_path / "m.txt").write_text("a.pdf: IP=192.0.2.1\nb.pdf: NOT FOUND\nnoise\n")
    assert [(r.file, r.address) for r in readers.read_address_map(spark, str(tmp_path / "m.txt")).collect()] == [("a.pdf", "192.0.2.1"), ("b.pdf", None)]
    (tmp_path / "led").mkdir()
    (tmp_path / "led" / "x.json").write_text('[{"block_idx": 1, "chunk_text": "t", "tokens_input": 2, "tokens_output": 3}]')
    (tmp_path / "led" / "bad.json").write_text("{oops")
    assert readers.read_ledger(spark, str(tmp_path / "led")).agg(F.sum("tokens_input").alias("n")).first().n == 2
    assert readers.read_text_files(spark, str(tmp_path), "*.txt").first().doc_id == "m.txt"
    dirs = spark.createDataFrame([("r/My-Base_1/",), ("r/other",)], "path string")
    assert readers.result_dirs(dirs, "mybase1").count() == 1
    assert readers.list_files(spark, str(tmp_path), "*.txt").first().size > 0


def test_streams(spark, tmp_path):
    rows = [(1, "2024-01-01 00:10:00", "a", 1.0), (2, "2024-01-01 00:50:00", "a", 2.0), (3, "2024-01-01 09:00:00", "b", 1.0)]
    events = spark.createDataFrame(rows, "event_id bigint, ts string, event_type string, value double").withColumn("ts", F.to_timestamp("ts"))
    events.write.parquet(str(tmp_path / "e"))
    stream = streams.windowed_counts(streams.text_stream(spark, str(tmp_path / "e"), events.schema))
    streams.run_once(stream, str(tmp_path / "o"), str(tmp_path / "ck"))
    assert spark.read.parquet(str(tmp_path / "o")).filter("event_type = 'a'").first().n == 2
    assert streams.windowed_counts(events).count() == 2
    found = spark.createDataFrame([("A ", "1", "tcp"), ("a", "1", "TCP"), ("a", None, None)], "Name string, port string, protocol string").withColumn("extracted_at", F.current_timestamp())
    found.write.parquet(str(tmp_path / "f"))
    once = streams.distinct_findings(streams.text_stream(spark, str(tmp_path / "f"), found.schema))
    streams.run_once(once, str(tmp_path / "fo"), str(tmp_path / "fk"))
    assert spark.read.parquet(str(tmp_path / "fo")).count() == 2


def test_reports(spark, tmp_path):
    from scoria.operators import consolidate, evaluate

    frame = spark.createDataFrame([("a", 1, "LOW", "1"), ("a", 2, "LOW", None), ("b" * 30, 3, None, None)], "Name string, seq bigint, severity string, port string")
    text = writers.consolidation_log(consolidate.stage_counts(input=frame, final=frame.limit(1)), consolidate.merged_groups(frame, F.col("Name")))
    assert "input: 3" in text and "2 x a (seq 1 to 2)" in text
    assert writers.removed_records(frame, n=5).orderBy("seq").collect()[2].name == "bbbbb..."
    times = spark.createDataFrame([("x", 2, 3661.5)], "base string, runs int, seconds double")
    tokens = evaluate.token_totals(spark.createDataFrame([("m", 3, 4), ("m", 1, 1)], "llm string, tokens_input int, tokens_output int"))
    report = writers.final_report(times, tokens)
    assert "x: 2 runs, 01:01:01.500" in report and "all: 4 in, 5 out, 2 calls" in report
    counts = evaluate.multiset_counts(frame.select("Name"), frame.select("Name").limit(1), ["Name"])
    assert "precision" in writers.accuracy_report(evaluate.multiset_accuracy(counts))
    more, less = evaluate.surplus_and_deficit(counts)
    writers.difference_workbook(more, less, str(tmp_path / "d.xlsx"))
    assert readers.read_workbook(spark, str(tmp_path), "absent", ["Name"]).count() == 0
    writers.write_layout(spark.createDataFrame([("d", "summary", "toc"), ("d", "body", "x")], "doc_id string, kind string, text string"), str(tmp_path / "lay"))
    assert [r.value for r in spark.read.text(str(tmp_path / "lay")).collect()] == ["### d", "toc"]
    writers.append_ledger(spark, [{"run_id": "r", "status": "ok"}], "run_id string, status string", str(tmp_path / "ledger"))
    assert spark.read.parquet(str(tmp_path / "ledger")).count() == 1


def test_record_files(spark, tmp_path):
    """Order by file and place, whatever the splits; what holds no list, or can't be read, says so."""
    folder = tmp_path / "in"
    folder.mkdir()
    for k, name in enumerate(["scan_b.json", "scan_a.json", "scan_c.json"]):
        (folder / name).write_text(json.dumps([{"Name": f"{name[5]}{i}", "description": ["d"], "extra": k} for i in range(40)], indent=1))
    (folder / "one.json").write_text('{"Name": "alone"}')
    (folder / "bad.json").write_text("[{")
    (folder / "empty.json").write_text("\ufeff []")
    rows, files = readers.read_record_files(spark, str(folder))
    got = sorted((r.seq, r.Name, r.report) for r in rows.collect())
    assert got == [(i + 1, f"{'abc'[i // 40]}{i % 40}", "abc"[i // 40]) for i in range(120)]
    assert {r.file: (r.records, r.error) for r in files.collect()} == {"scan_a.json": (40, None), "scan_b.json": (40, None), "scan_c.json": (40, None), "one.json": (0, "must be a list"), "bad.json": (0, "can't be read"), "empty.json": (0, None)}
    (tmp_path / "t.txt").write_text("two\nlines\n")
    assert [r.text for r in readers.read_text_files(spark, str(tmp_path), "t.txt").collect()] == ["two\nlines\n"]


def test_conversion_and_freshness(spark, tmp_path):
    import os

    source, target = tmp_path / "scan_x.json", str(tmp_path / "out")
    source.write_text('[{"Name": "n", "description": ["d"], "severity": "LOW"}]')
    assert writers.convert(spark, str(source), target, ["csv", "xlsx"]) == {}
    assert readers.read_csv(spark, target + ".csv").first().Name == "n"
    assert writers.is_fresh(spark, str(source), target + ".xlsx") and not writers.is_fresh(spark, str(source), target + ".none")
    before = os.path.getmtime(target + ".xlsx")
    assert writers.convert(spark, str(source), target, ["xlsx"]) == {} and os.path.getmtime(target + ".xlsx") == before
    os.utime(source, (before + 60, before + 60))
    assert not writers.is_fresh(spark, str(source), target + ".xlsx")
    import pytest

    source.write_text('[{"severity": "LOW"}]')
    with pytest.raises(ValueError, match="no name"):
        writers.convert(spark, str(source), target, ["csv"], reuse=False)


def test_folders_and_columns(spark):
    names = spark.createDataFrame([("My Base-1",), ("nope",)], "name string")
    dirs = spark.createDataFrame([("r/b/my_base1/",), ("r/a/MyBase1",), ("r/other",)], "path string")
    assert {r.name: r.path for r in readers.resolve_dirs(names, dirs).collect()} == {"My Base-1": "r/a/MyBase1", "nope": None}
    both = readers.union_records(spark.createDataFrame([(1, "x")], "a int, b string"), spark.createDataFrame([("y", 2.0)], "b string, c double"))
    assert both.columns == ["a", "b", "c"] and both.filter("b = 'y'").first().a is None


def test_ledger_by_run(spark, tmp_path):
    path = str(tmp_path / "led")
    ledger = spark.createDataFrame([("r1", 0, 5), ("r2", 0, 6)], "run_id string, block_id int, tokens_input int")
    writers.write_token_ledger(ledger, path)
    writers.write_token_ledger(spark.createDataFrame([("r2", 0, 7)], ledger.schema), path)
    assert {(r.run_id, r.tokens_input) for r in spark.read.parquet(path).collect()} == {("r1", 5), ("r2", 7)}


def test_removed_and_member_logs(spark):
    from scoria.operators import consolidate

    frame = spark.createDataFrame([("a", 1, "LOW", "1", "tcp", ["x"]), ("a", 2, "LOW", None, None, None), (None, 3, None, None, None, [" "]), (None, 4, None, None, None, [])], "Name string, seq bigint, severity string, port string, protocol string, description array<string>")
    groups = consolidate.merged_groups(frame, F.col("Name"))
    members = consolidate.group_members(frame, groups, F.col("Name"), 1)
    assert {(r.key, r.place, r.seq) for r in members.collect()} == {("a", 1, 1), (None, 1, 3)}
    text = writers.consolidation_log(consolidate.stage_counts(input=frame), groups, members=members)
    assert "2 x a (seq 1 to 2)\n  1. a: port 1, protocol tcp, severity LOW" in text and "2 x (no name)" in text
    log = writers.removed_log(frame.filter("seq > 1"))
    assert "Total: 3" in log and "1. a\n" in log and "2. (no name)" in log
