import random
import re

from pyspark.sql import functions as F

from scoria.operators import blocks, chunks, pages
from scoria.profiles import PROFILES


def test_marked_continuation(spark):
    rows = [("d", 1, "Summary of the thing\nfirst part\n. . . continues on next page . . ."), ("d", 2, ". . . continued from previous page\nsecond part\nSolution\nfix it")]
    out = pages.stitch_pages(spark.createDataFrame(rows, "doc_id string, page_no int, text string")).first().text
    assert "first part second part" in out and "continues" not in out and "fix it" in out


def test_unmarked_continuation(spark):
    rows = [("d", 1, "Heading.\nThe service answers to every single request"), ("d", 2, "and keeps the session open.\nSolution\nfix")]
    out = pages.stitch_pages(spark.createDataFrame(rows, "doc_id string, page_no int, text string")).first().text
    assert "Heading. and keeps the session open." in out


def test_clean_pages(spark):
    rows = [("d", 1, "a\tb (cid:12)→ “x”\nPage 1 of 9\n\n"), ("d", 2, " "), ("d", 3, None)]
    out = [r.text for r in pages.clean_pages(spark.createDataFrame(rows, "doc_id string, page_no int, text string")).orderBy("page_no").collect()]
    assert out[0] == 'a b -> "x"' and "no text" in out[1] and "no text" in out[2]


def test_split_summary(spark):
    d = spark.createDataFrame([("o", "toc\nmore\n NVT: x\nbody")], "doc_id string, text string")
    got = {r.kind: r.text for r in pages.split_summary(d, "openvas").collect()}
    assert got == {"summary": "toc\nmore\n", "body": " NVT: x\nbody"}
    text = "intro\nWeb Application Scanning Detailed Scan Export: a\nx\nWeb Application Scanning Detailed Scan Export: b\nname\nVULNERABILITY HIGH PLUGIN ID 5\n"
    got = {r.kind: r.text for r in pages.split_summary(spark.createDataFrame([("t", text)], "doc_id string, text string"), "tenable").collect()}
    assert got["summary"].endswith("x") and got["body"] == "\nname\nVULNERABILITY HIGH PLUGIN ID 5\n"
    assert pages.split_summary(spark.createDataFrame([("g", "abc")], "doc_id string, text string"), "other").collect()[0].kind == "body"


def test_header_blocks(spark):
    text = "intro\nHigh 443/tcp\nNVT: a\nx\n2.1.2 low general/icmp\nNVT: b"
    got = blocks.header_blocks(spark.createDataFrame([(1, text), (2, None), (3, "")], "doc_id int, text string")).orderBy("doc_id", "block_id").collect()
    assert [(r.doc_id, r.block_id, r.severity, r.port, r.protocol, r.text) for r in got] == [
        (1, 1, None, None, None, "intro"),
        (1, 2, "High", "443", "tcp", "High 443/tcp\nNVT: a\nx"),
        (1, 3, "low", "general", "icmp", "2.1.2 low general/icmp\nNVT: b"),
        (3, 1, None, None, None, ""),
    ]


def test_header_blocks_with_context(spark):
    summaries = spark.createDataFrame([(1, "a\nb\nMedium 80/tcp\nc")], "doc_id int, text string")
    context = blocks.header_context(summaries)
    got = blocks.header_blocks(spark.createDataFrame([(1, "NVT: a\nx")], "doc_id int, text string"), context).first()
    assert (got.severity, got.port, got.protocol) == ("Medium", "80", "tcp") and got.text == "a\nb\nMedium 80/tcp\n---\nNVT: a\nx"


def test_severity_blocks(spark):
    text = "base\nSEVERITY LOW\nVULNERABILITY HIGH PLUGIN ID 1\nx\nVULNERABILITY CRITICAL PLUGIN ID 2\ny\nVULNERABILITY HIGH PLUGIN ID 3"
    got = blocks.severity_blocks(spark.createDataFrame([(1, text), (2, "none")], "doc_id int, text string")).orderBy("block_id").collect()
    assert [(r.severity, r.text) for r in got] == [
        ("CRITICAL", "VULNERABILITY CRITICAL PLUGIN ID 2\ny"),
        ("HIGH", "VULNERABILITY HIGH PLUGIN ID 1\nx\nVULNERABILITY HIGH PLUGIN ID 3"),
        ("LOW", "base\nSEVERITY LOW"),
    ]


def test_packing_rules():
    p = PROFILES["openvas"]
    assert chunks.pack_sections("pre\nNVT: a\n", 100, p) == ["pre\nNVT: a\n"]
    text = "pre\n" + "".join(f"NVT: {i}\n" + "x" * 20 + "\n" for i in range(12))
    out = chunks.pack_sections(text, 200, p)
    assert "".join(out) == text[4:] and all(len(re.findall("NVT", c)) <= 5 for c in out)
    assert "".join(chunks.pack_sections(text, 200, p, keep_preamble=True)) == text


def independent_packing(sections, size, most):
    """Another way to say it: place sections one after the other and note where a chunk has to end."""
    out = []
    current = ""
    n = 0
    for s in sections:
        if len(s) > size:
            if current:
                out.append(current)
            current, n = "", 0
            out.extend(chunks.pack_lines(s, size, chunks.FLOOR))
            continue
        if n and (n == most or len(current) + len(s) > size):
            out.append(current)
            current, n = "", 0
        current, n = current + s, n + 1
    return out + ([current] if current else [])


def test_packing_against_model():
    rng = random.Random(4)
    for _ in range(200):
        sections = [f"NVT: {i}\n" + "y\n" * rng.choice([1, 5, 40, 900]) for i in range(rng.randrange(1, 15))]
        text, size = "".join(sections), rng.choice([60, 300, 1200])
        if len(text) > size:
            assert chunks.pack_sections(text, size, PROFILES["openvas"]) == independent_packing(sections, size, 5)


def test_windows_join_to_text(spark):
    text = "one two, three.\n four  five"
    got = chunks.token_windows(spark.createDataFrame([(1, text), (2, None), (3, "")], "block_id int, text string"), 5, 2).orderBy("chunk_id").collect()
    assert "".join(r.text for r in got) == text and {r.block_id for r in got} == {1}


def test_redivide_and_quality(spark):
    big = "NVT: a\n" + "word " * 900 + "\nNVT: b\n" + "line\n" * 400
    failed = spark.createDataFrame([(1, big, False, ["truncated answer"])], "block_id int, text string, token_valid boolean, errors array<string>")
    got = chunks.redivide(failed, 4096).orderBy("piece_no").collect()
    assert len(got) > 1 and "".join(r.text for r in got) == big
    q = chunks.chunk_quality(spark.createDataFrame([("NVT: a\nshort",), ("x\n" * 30 + "NVT: z",)], "text string"), r"^\s*NVT:\s").collect()
    assert [(r.markers, r.clean_start, r.clean_end) for r in q] == [(1, True, False), (1, False, False)]


def test_detect_and_prompt(spark):
    frame = spark.createDataFrame([("NVT: x\n",), ("VULNERABILITY LOW PLUGIN ID 3",), ("nothing",)], "text string")
    assert [r.scanner_type for r in chunks.detect_pattern(frame).collect()] == ["openvas", "tenable_was", "unknown"]
    assert chunks.build_prompt(frame.limit(1), "A {context} B").first().prompt == "A NVT: x\n B"
    assert chunks.build_prompt(frame.limit(1), "A").first().prompt == "A\nNVT: x\n"


def test_read_pages_reports_errors(spark):
    def parse(content):
        if content == b"bad":
            raise ValueError("broken")
        return [(1, content.decode())]

    got = pages.read_pages(spark.createDataFrame([("a", bytearray(b"ok")), ("b", bytearray(b"bad"))], "path string, content binary"), parse).orderBy("doc_id").collect()
    assert [r.text for r in got] == ["ok", "ERROR: broken"]
    assert pages.body_text(spark.createDataFrame([("d", "summary", "s"), ("d", "body", "b")], "doc_id string, kind string, text string")).select(F.col("text")).first().text == "b"
