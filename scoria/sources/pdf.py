"""Text of plain PDF files, by the standard library: a parser for ``pages.read_pages`` where no better one is installed.

It reads page trees, compressed streams and object streams, and the text operators, with fonts' own maps to Unicode where
they have them. Encrypted files, images of text and right-to-left layout are beyond it: such pages come out empty or fail.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

_OBJECT = re.compile(rb"(?<!\d)(\d+)\s+\d+\s+obj\b")
_STREAM = re.compile(rb"stream\r?\n")
_REF = re.compile(rb"(\d+)\s+\d+\s+R\b")
_ESCAPES = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}
_TOKEN = re.compile(rb"\s+|%[^\r\n]*|<<|>>|[\[\]{}]|/[^\s/\[\]<>(){}%]*|<([0-9A-Fa-f\s]*)>|[-+]?(?:\d+\.?\d*|\.\d+)|[A-Za-z'\"*]+[0-9]?|.", re.S)


class Document:
    """The objects of a file by number: their text, and their stream, decoded."""

    def __init__(self, data: bytes) -> None:
        self.heads: dict[int, bytes] = {}
        self.streams: dict[int, bytes] = {}
        for m in _OBJECT.finditer(data):
            end = data.find(b"endobj", m.end())
            self._add(int(m[1]), data[m.end() : end if end >= 0 else len(data)])
        for n in [n for n, h in self.heads.items() if re.search(rb"/Type\s*/ObjStm", h)]:
            body, count, first = self.streams.get(n, b""), int(re.search(rb"/N\s+(\d+)", self.heads[n])[1]), int(re.search(rb"/First\s+(\d+)", self.heads[n])[1])
            numbers = list(map(int, body[:first].split()[: 2 * count]))
            places = [*numbers[1::2], len(body) - first]
            for number, a, b in zip(numbers[::2], places, places[1:]):
                self.heads.setdefault(number, body[first + a : first + b])

    def _add(self, number: int, body: bytes) -> None:
        m = _STREAM.search(body)
        self.heads[number] = body[: m.start()] if m else body
        if m:
            raw = body[m.end() : body.rfind(b"endstream")]
            if b"FlateDecode" in self.heads[number]:
                try:
                    raw = zlib.decompressobj().decompress(raw)
                except zlib.error:
                    raw = b""
            self.streams[number] = raw

    def value(self, head: bytes, name: bytes) -> bytes:
        """What follows a name in a dictionary, references followed."""
        m = re.search(rb"/" + name + rb"(?![A-Za-z])\s*", head)
        if not m:
            return b""
        rest = head[m.end() :]
        ref = _REF.match(rest)
        return self.heads.get(int(ref[1]), b"") if ref else rest

    def pages(self) -> list[int]:
        """Page objects in the order of the page tree; in that of their numbers where there is no tree."""
        root = next((h for h in self.heads.values() if re.search(rb"/Type\s*/Catalog\b", h)), b"")
        top = re.search(rb"/Pages\s+(\d+)\s+\d+\s+R", root)
        out: list[int] = []
        waiting, seen = [int(top[1])] if top else [], set()
        while waiting:
            n = waiting.pop()
            if n in seen or n not in self.heads:
                continue
            seen.add(n)
            kids = re.search(rb"/Kids\s*\[([^\]]*)\]", self.heads[n])
            if kids:
                waiting += [int(r) for r in reversed(_REF.findall(kids[1]))]
            else:
                out.append(n)
        return out or sorted(n for n, h in self.heads.items() if re.search(rb"/Type\s*/Page\b", h))

    def content(self, page: int) -> bytes:
        m = re.search(rb"/Contents\s*(\[[^\]]*\]|\d+\s+\d+\s+R)", self.heads[page])
        return b"\n".join(self.streams.get(int(r), b"") for r in _REF.findall(m[1])) if m else b""

    def fonts(self, page: int) -> dict[bytes, dict[bytes, str]]:
        """Per font name of a page its map from codes to text."""
        fonts = self.value(self.value(self.heads[page], b"Resources"), b"Font")
        out = {}
        for name, number in re.findall(rb"/([^\s/\[\]<>(){}%]+)\s+(\d+)\s+\d+\s+R", fonts.split(b">>")[0]):
            ref = re.search(rb"/ToUnicode\s+(\d+)\s+\d+\s+R", self.heads.get(int(number), b""))
            if ref:
                out[name] = _unicode_map(self.streams.get(int(ref[1]), b""))
        return out


def _unicode_map(cmap: bytes) -> dict[bytes, str]:
    def text(code: bytes) -> str:
        return bytes.fromhex(code.decode()).decode("utf-16-be", "replace")

    out = {}
    for part in re.findall(rb"beginbfchar(.*?)endbfchar", cmap, re.S):
        out.update({bytes.fromhex(a.decode()): text(b) for a, b in re.findall(rb"<([0-9A-Fa-f]+)>\s*<([0-9A-Fa-f]+)>", part)})
    for part in re.findall(rb"beginbfrange(.*?)endbfrange", cmap, re.S):
        for a, b, c in re.findall(rb"<([0-9A-Fa-f]+)>\s*<([0-9A-Fa-f]+)>\s*<([0-9A-Fa-f]+)>", part):
            first, size = int(a, 16), len(a) // 2
            for k in range(min(int(b, 16) - first + 1, 1 << 16)):
                out[(first + k).to_bytes(size, "big")] = chr(int(c, 16) + k) if len(c) <= 4 else text(c)
    return out


def _literal(data: bytes, at: int) -> tuple[bytes, int]:
    """A string in parentheses that begins at ``at``, and where it ends."""
    out, depth, i = bytearray(), 1, at + 1
    while i < len(data):
        c = data[i : i + 1]
        if c == b"\\":
            octal = re.match(rb"[0-7]{1,3}", data[i + 1 : i + 4])
            if octal:
                out.append(int(octal[0], 8) & 255)
                i += 1 + len(octal[0])
                continue
            n = data[i + 1 : i + 2]
            out += b"" if n in b"\r\n" else _ESCAPES.get(n, n)
            i += 2
            continue
        depth += (c == b"(") - (c == b")")
        if not depth:
            return bytes(out), i + 1
        out += c
        i += 1
    return bytes(out), i


def _tokens(data: bytes) -> Iterator[tuple[str, object]]:
    i = 0
    while i < len(data):
        if data[i : i + 1] == b"(":
            value, i = _literal(data, i)
            yield "text", value
            continue
        m = _TOKEN.match(data, i)
        i = m.end()
        t = m[0]
        if m[1] is not None and t[:2] != b"<<":
            digits = re.sub(rb"\s", b"", m[1])
            yield "text", bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode())
        elif re.fullmatch(rb"[-+]?(?:\d+\.?\d*|\.\d+)", t):
            yield "number", float(t)
        elif not t.isspace() and t[:1] != b"%":
            yield "word", t


def fragments(content: bytes, fonts: dict[bytes, dict[bytes, str]]) -> Iterator[tuple[float, float, str]]:
    """(x, y, text) of what a content stream shows, in its order."""
    stack: list = []
    x = y = lx = ly = leading = 0.0
    font: dict[bytes, str] = {}

    def shown(code: bytes) -> str:
        if not font:
            return code.decode("cp1252", "replace")
        size = len(next(iter(font)))
        return "".join(font.get(code[k : k + size], "") for k in range(0, len(code), size))

    for kind, t in _tokens(content):
        if kind != "word" or t in (b"[", b"]") or t[:1] == b"/":
            stack.append(t)
            continue
        numbers = [s for s in stack if isinstance(s, float)]
        if t == b"BT":
            x = y = lx = ly = 0.0
        elif t == b"Tf":
            name = next((s[1:] for s in stack if isinstance(s, bytes) and s[:1] == b"/"), b"")
            font = fonts.get(name, {})
        elif t == b"TL" and numbers:
            leading = numbers[-1]
        elif t in (b"Td", b"TD") and len(numbers) >= 2:
            lx, ly = lx + numbers[-2], ly + numbers[-1]
            x, y, leading = lx, ly, -numbers[-1] if t == b"TD" else leading
        elif t == b"Tm" and len(numbers) >= 6:
            x, y = lx, ly = numbers[-2], numbers[-1]
        elif t in (b"T*", b"'", b'"'):
            ly -= leading
            x, y = lx, ly
        if t in (b"Tj", b"'", b'"', b"TJ"):
            parts = []
            for s in stack:
                if isinstance(s, float):
                    parts.append(" " if t == b"TJ" and s < -200 else "")
                elif s not in (b"[", b"]"):
                    parts.append(shown(s))
            text = "".join(parts)
            if text:
                yield x, y, text
                x += 5.0 * len(text)  # about; only the order within a line depends on it
        stack = []


def plain_pages(data: bytes) -> list[tuple[int, str]]:
    """(page number from 1, text) of each page: a line for each height at which something is shown, from the top, left to right."""
    document = Document(data)
    if not document.heads:
        raise ValueError("no PDF objects")
    out = []
    for no, page in enumerate(document.pages(), 1):
        lines: dict[int, list[tuple[float, str]]] = {}
        for x, y, text in fragments(document.content(page), document.fonts(page)):
            lines.setdefault(round(y), []).append((x, text))
        out.append((no, "\n".join(" ".join(t for _, t in sorted(parts, key=lambda p: p[0])).rstrip() for _, parts in sorted(lines.items(), reverse=True))))
    return out
