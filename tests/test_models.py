"""Queries that SQL can't say, against small models in Python, over the whole smallest tables."""

import json
import os
import re
import unicodedata

import pyarrow.parquet as pq
import pytest

from scoria.functions.text import SAFE_CHARACTERS
from scoria.operators import chunks, extract
from scoria.plans import catalogue
from scoria.profiles import PROFILES

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")


def rows(name, *columns):
    return pq.read_table(f"{DATA}/{name}.parquet", columns=list(columns)).to_pylist()


def result(spark, name):
    return [r.asDict() for r in catalogue.queries()[name](spark, DATA).collect()]


def safe(text):
    """NFKC, the replaced characters, then nothing but ASCII, letters, numbers and separators."""
    out = unicodedata.normalize("NFKC", text)
    for a, b in SAFE_CHARACTERS.items():
        out = out.replace(a, b)
    return "".join(c for c in out if c.isascii() or unicodedata.category(c)[0] in "LNZ" or c == "\x85")


def test_safe_text(spark):
    want = {r["doc_id"]: None if r["text"] is None else safe(r["text"]) for r in rows("documents", "doc_id", "text")}
    assert {r["doc_id"]: r["safe_text"] for r in result(spark, "nfkc_sanitize")} == want


def test_prompts(spark):
    blank = len("Extract findings from:\n\nAnswer in JSON.")
    want = sorted((r["doc_id"], r["block_id"], None if r["text"] is None else blank + len(safe(r["text"]))) for r in rows("blocks", "doc_id", "block_id", "text"))
    assert sorted((r["doc_id"], r["block_id"], r["n_chars"]) for r in result(spark, "prompt_build")) == want


def test_stitched_pages_keep_their_words(spark):
    """Stitching moves lines and takes marks of page breaks out; all else stays, so lengths are near the cleaned pages' own."""
    got = {r["doc_id"]: r["n_chars"] for r in result(spark, "page_stitch")}
    for r in rows("documents", "doc_id", "text"):
        if r["text"] is None:
            assert r["doc_id"] not in got
            continue
        pages = []
        for i, page in enumerate(r["text"].split("\n\n")):
            lines = [x for x in page.split("\n") if not re.match(r"(?i)\s*Page\s+\d+\s+of\s+\d+", x)]
            text = re.sub(" {2,}", " ", re.sub(r"\(cid:\d+\)", "", "\n".join(lines).replace("\t", "    ")).replace("→", "->")).rstrip()
            pages.append(text or f"[page {i} - no text found]\n")
        plain = "\n".join(pages)
        if not re.search("continue[sd] (on next|from previous) page", plain, re.I) and len(pages) == 1:
            assert got[r["doc_id"]] == len(unicodedata.normalize("NFKC", plain)), r["doc_id"]


def packed(text, size, most, marker):
    """Marker packing by counting on: sections while they fit in size and number, too large ones by lines, pieces of 1000 where lines don't do."""
    if len(text) <= size:
        return [text]
    lines = text.splitlines(keepends=True)
    heads = [i for i, x in enumerate(lines) if re.search(marker, x)]
    out, held, n = [], "", 0
    if not heads:
        for x in lines:
            if held and len(held) + len(x) > size:
                out.append(held)
                held = ""
            held += x
        return out + ([held] if held else [])
    for a, b in zip(heads, [*heads[1:], len(lines)]):
        section = "".join(lines[a:b])
        if held and (n == most or len(held) + len(section) > size):
            out.append(held)
            held, n = "", 0
        if len(section) > size:
            part = ""
            for x in lines[a:b]:
                if part and len(part) + len(x) > size:
                    out.append(part)
                    part = ""
                part += x
            out.append(part)
        else:
            held, n = held + section, n + 1
    return out + ([held] if held else [])


def test_marker_packing(spark):
    rules = PROFILES["openvas"].chunking
    want = []
    for r in rows("blocks", "doc_id", "block_id", "text"):
        # other markers count where the profile's own don't occur
        text = r["text"] or ""
        marker = rules.marker_pattern if re.search(rules.marker_pattern, text, re.M) else "(?!)"
        found = next((a for a in chunks.AUTO if marker == "(?!)" and re.search(a[1], text, re.M)), None)
        most = rules.max_vulnerabilities_per_chunk if marker != "(?!)" else (max(2, found[3] // 2) if found and found[2] else found[3] if found else 3)
        want += [(r["doc_id"], r["block_id"], i, len(p)) for i, p in enumerate(packed(text, 1500, most, found[1] if found else marker) if text else [])]
    assert sorted((r["doc_id"], r["block_id"], r["chunk_id"], r["n_chars"]) for r in result(spark, "chunk_marker_packing")) == sorted(want)


def test_both_cuts(spark):
    """Windows of 300 tokens, each packed by itself."""
    rules, want = PROFILES["openvas"].chunking, []
    for r in rows("blocks", "doc_id", "block_id", "text"):
        tokens = re.findall(r"\s*(?:\w+|[^\w\s])|\s+$", r["text"] or "")
        windows = ["".join(tokens[i : i + 300]) for i in range(0, len(tokens), 300)]
        pieces = [p for w in windows for p in (packed(w, 1500, rules.max_vulnerabilities_per_chunk, rules.marker_pattern) if re.search(rules.marker_pattern, w, re.M) else packed(w, 1500, 3, "(?!)") if not any(re.search(a[1], w, re.M) for a in chunks.AUTO) else chunks.pack_sections(w, 1500, PROFILES["openvas"]))]
        want += [(r["doc_id"], r["block_id"], i, len(p)) for i, p in enumerate(pieces)]
    assert sorted((r["doc_id"], r["block_id"], r["chunk_id"], r["n_chars"]) for r in result(spark, "chunk_both_cuts")) == sorted(want)


def test_retries(spark):
    """Answers that hold stay; the others' blocks come back in pieces that hold all findings' names of the block."""
    texts = {(r["doc_id"], r["block_id"]): r["text"] for r in rows("blocks", "doc_id", "block_id", "text")}
    got: dict = {}
    for r in result(spark, "retry_two_pass"):
        got.setdefault((r["doc_id"], r["block_id"], r["chunk_id"]), []).append((r["piece_no"], r["n_items"]))
    for r in rows("responses", "doc_id", "block_id", "chunk_id", "raw"):
        key = (r["doc_id"], r["block_id"])
        if r["doc_id"] is None or key not in texts:
            continue
        items = extract.recover_json(r["raw"])
        count = lambda t: len(re.findall(r"\w+|[^\w\s]", t or ""))
        text = texts[key]
        if items and 800 + count(text) + count(r["raw"]) <= 4096 - 500 and count(text) <= 4096 * 0.6:
            assert (-1, len(items)) in got[(*key, r["chunk_id"])]
        elif text and count(text) < 2000:
            names = len(json.loads(extract.rule_based([text])[0]))
            assert sum(n for p, n in got[(*key, r["chunk_id"])] if p >= 0) >= names or "truncated" in (r["raw"] or "").lower() or len(text) > 1500
