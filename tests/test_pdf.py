import zlib

import pytest

from scoria.operators import pages
from scoria.sources import pdf, readers


def made(pages_content, packed=True, extra=b""):
    """A small PDF of given content streams; the page dictionaries are in an object stream where ``packed``."""
    n = len(pages_content)
    objects = {1: b"<< /Type /Catalog /Pages 2 0 R >>", 2: b"<< /Type /Pages /Kids [%s] /Count %d >>" % (b" ".join(b"%d 0 R" % (10 + i) for i in range(n)), n), 3: b"<< /Type /Font /Subtype /Type1 /BaseFont /Helvetica >>"}
    out = b"%PDF-1.5\n"
    inner = {10 + i: b"<< /Type /Page /Parent 2 0 R /Resources << /Font << /F1 3 0 R /F2 4 0 R >> >> /Contents [%d 0 R] >>" % (50 + i) for i in range(n)}
    if packed:
        body, head = b"", b""
        for k, v in inner.items():
            head += b"%d %d " % (k, len(body))
            body += v + b" "
        stream = zlib.compress(head + body)
        out += b"30 0 obj\n<< /Type /ObjStm /N %d /First %d /Filter /FlateDecode /Length %d >>\nstream\n" % (n, len(head), len(stream)) + stream + b"\nendstream\nendobj\n"
    else:
        objects |= inner
    for k, v in objects.items():
        out += b"%d 0 obj\n%s\nendobj\n" % (k, v)
    for i, c in enumerate(pages_content):
        stream = zlib.compress(c) if i % 2 == 0 else c
        out += b"%d 0 obj\n<< /Length %d %s>>\nstream\n" % (50 + i, len(stream), b"/Filter /FlateDecode " if i % 2 == 0 else b"") + stream + b"\nendstream\nendobj\n"
    return out + extra + b"trailer << /Root 1 0 R >>\n%%EOF"


CMAP = b"2 beginbfchar <0001> <0041> <0002> <00E9> endbfchar 1 beginbfrange <0010> <0012> <0061> endbfrange"
FONT = b"4 0 obj\n<< /Type /Font /ToUnicode 5 0 R >>\nendobj\n5 0 obj\n<< /Length %d >>\nstream\n%s\nendstream\nendobj\n" % (len(CMAP), CMAP)


@pytest.mark.parametrize("packed", [True, False])
def test_pages_in_order(packed):
    one = rb"BT /F1 12 Tf 72 700 Td (NVT: Weak \(old\) cipher) Tj 0 -14 Td [(Sum) 20 (mary) -300 (here)] TJ T* (\101\n) Tj ET"
    two = rb"BT /F1 10 Tf 1 0 0 1 200 500 Tm (right) Tj 1 0 0 1 72 500 Tm (left) Tj 14 TL (next) ' /F2 9 Tf <000100020010 0011> Tj ET % end"
    assert pdf.plain_pages(made([one, two], packed, FONT)) == [(1, "NVT: Weak (old) cipher\nSummary here A"), (2, "left right\nnext Aéab")]


def test_reading_as_pages(spark, tmp_path):
    (tmp_path / "good.pdf").write_bytes(made([b"BT (Page one) Tj ET", b""], True))
    (tmp_path / "bad.pdf").write_bytes(b"not a file of that kind")
    got = {(r.doc_id.split("/")[-1], r.page_no): r.text for r in pages.read_pages(readers.read_binary(spark, str(tmp_path)), pdf.plain_pages).collect()}
    assert got[("good.pdf", 1)] == "Page one" and got[("good.pdf", 2)] == "" and got[("bad.pdf", 1)].startswith("ERROR: no PDF")
