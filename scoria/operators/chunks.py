"""Chunks of block texts: fixed token windows, marker packing, line packing, re-division, prompts and chunk quality."""

from __future__ import annotations

import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scoria.functions.text import sanitize
from scoria.profiles import NVT_LINE, Chunking, Profile
from scoria.session import ship_package

#: Sizes of the packing in characters and tokens.
TARGET, FLOOR, WINDOW, RESERVED = 8000, 1000, 4096, 1000
#: Fixed value: the header of a finding, where no profile says how it looks.
AUTO_PLUGIN_HEADER = r"^\s*VULNERABILITY\s+(CRITICAL|HIGH|MEDIUM|LOW)\s+PLUGIN\s+ID\s+\d+"
#: What a chunk is, found by its own text where the profile's pattern doesn't occur.
AUTO = (("openvas", NVT_LINE, False, 5), ("tenable_was", AUTO_PLUGIN_HEADER, True, 3))

Slicer = Callable[[str, int], list[str]]


def word_slices(text: str, n: int) -> list[str]:
    """Pieces of ``n`` tokens each, where a token is a word or a mark with the white space before it; they join to the text."""
    tokens = re.findall(r"\s*(?:\w+|[^\w\s])|\s+$", text)
    return ["".join(tokens[i : i + n]) for i in range(0, len(tokens), n)]


def word_count(text: Column) -> Column:
    """Tokens of the local counter: words and single marks; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"(?U)\w+|[^\w\s]")), F.lit(0))


def token_windows(blocks: DataFrame, max_tokens: int = WINDOW, reserve: int = RESERVED, slices: Slicer = word_slices) -> DataFrame:
    """Fixed windows of ``max_tokens - reserve`` tokens: the columns of ``blocks``, with ``chunk_id`` (from 0) and the window as ``text``."""
    return _exploded(blocks, lambda t: slices(t, max_tokens - reserve))


def _exploded(df: DataFrame, cut: Callable[[str], list[str]]) -> DataFrame:
    @F.pandas_udf(T.ArrayType(T.StringType()))
    def pieces(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: cut(t) if t else [])

    ship_package(df.sparkSession)
    rest = [c for c in df.columns if c not in ("text", "chunk_id")]
    return df.select(*rest, F.posexplode(pieces("text")).alias("chunk_id", "text"))


def marker_count(text: Column, pattern: str | None) -> Column:
    return F.lit(0) if not pattern else F.regexp_count(text, F.lit(f"(?Umd){pattern}"))


def detect_pattern(df: DataFrame, profile: Profile | None = None) -> DataFrame:
    """Adds ``scanner_type``, ``marker_pattern``, ``has_pairs``, ``max_per_chunk``, ``markers``: the profile's pattern if it occurs, else the first that does, else unknown."""
    found = F.lit(None)
    choices: list[tuple[Column, tuple]] = []
    if profile and profile.chunking.marker_pattern:
        c = profile.chunking
        choices.append((marker_count(F.col("text"), c.marker_pattern), (c.scanner_type, c.marker_pattern, c.has_pairs, c.max_vulnerabilities_per_chunk)))
    choices += [(marker_count(F.col("text"), a[1]), a) for a in AUTO]
    kind = "struct<scanner_type:string,marker_pattern:string,has_pairs:boolean,max_per_chunk:int,markers:int>"
    found = F.struct(F.lit("unknown"), F.lit(None).cast("string"), F.lit(False), F.lit(3), F.lit(0)).cast(kind)
    for n, (scanner, pattern, pairs, most) in reversed(choices):
        found = F.when(n > 0, F.struct(F.lit(scanner), F.lit(pattern), F.lit(pairs), F.lit(most), n).cast(kind)).otherwise(found)
    return df.withColumn("__p", found).select(*df.columns, "__p.*")


def pack(items: list[str], size: int) -> list[str]:
    """Joins items in order while they fit; one that is too large stands alone."""
    out: list[str] = []
    held, total = [], 0
    for item in items:
        if held and total + len(item) > size:
            out.append("".join(held))
            held, total = [], 0
        held.append(item)
        total += len(item)
    return out + (["".join(held)] if held else [])


def pack_lines(text: str, size: int, floor: int | None = None) -> list[str]:
    """Whole lines up to ``size``. With a ``floor``, targets below it cut anywhere, every ``floor`` characters."""
    if len(text) <= size:
        return [text]
    if floor and size < floor:
        return [text[i : i + floor] for i in range(0, len(text), floor)]
    return pack(text.splitlines(keepends=True), size)


def _chunking_for(text: str, profile: Profile | None) -> Chunking:
    mine = profile.chunking if profile else Chunking()
    if mine.marker_pattern and re.search(mine.marker_pattern, text, re.M):
        return mine
    for scanner, pattern, pairs, most in AUTO:
        if re.search(pattern, text, re.M):
            return Chunking(pattern, pairs, most, scanner)
    return Chunking()


def pack_sections(text: str, target: int, profile: Profile | None = None, keep_preamble: bool = False) -> list[str]:
    """Packs the sections that marker lines begin, up to the profile's number and the size.

    A text within ``target`` stays whole. A section larger than the size is packed by lines, by itself. Text before the
    first marker is dropped from larger texts unless ``keep_preamble``. Without markers lines are packed.
    """
    if len(text) <= target:
        return [text]
    size = min(target, TARGET)
    rules = _chunking_for(text, profile)
    lines = text.splitlines(keepends=True)
    heads = [i for i, x in enumerate(lines) if rules.marker_pattern and re.search(rules.marker_pattern, x)]
    if not heads:
        return pack_lines(text, size)
    most = max(2, rules.max_vulnerabilities_per_chunk // 2) if rules.has_pairs else rules.max_vulnerabilities_per_chunk
    bounds = [*heads, len(lines)]
    sections = ["".join(lines[a:b]) for a, b in zip(bounds, bounds[1:])]
    out: list[str] = []
    if keep_preamble and heads[0]:
        out += pack_lines("".join(lines[: heads[0]]), size)
    held: list[str] = []
    for section in sections:
        large = len(section) > size
        full = len(held) >= most or sum(map(len, held)) + len(section) > size
        if held and (large or full):
            out.append("".join(held))
            held = []
        if large:
            out += pack_lines(section, size, FLOOR)
        else:
            held.append(section)
    return out + (["".join(held)] if held else [])


def marker_chunks(blocks: DataFrame, target: int = TARGET, profile: Profile | None = None, keep_preamble: bool = False) -> DataFrame:
    return _exploded(blocks, lambda t: pack_sections(t, target, profile, keep_preamble))


def chunk_blocks(blocks: DataFrame, profile: Profile, max_tokens: int = WINDOW, reserve: int = RESERVED, target: int = TARGET) -> DataFrame:
    """Both cuts in the profile's order: token windows then markers for openvas, markers then token windows for others. ``chunk_id`` counts anew over both."""
    steps: list[Callable[[str], list[str]]] = [lambda t: word_slices(t, max_tokens - reserve), lambda t: pack_sections(t, target, profile)]
    if profile.reader != "openvas":
        steps.reverse()
    return _exploded(blocks, lambda t: [p for q in steps[0](t) for p in steps[1](q)])


def redivide(failed: DataFrame, max_tokens: int, profile: Profile | None = None) -> DataFrame:
    """Smaller pieces of chunks that an answer's validation sent back (``text``, ``token_valid``, ``errors``).

    The target follows characters per token, times 0.7, of ``max_tokens - 2000``; at most a third of the text after a
    token error, a quarter after unbalanced brackets, a fifth after a cut answer. Pieces still over budget are halved by lines.
    """
    budget = max_tokens - 2000

    @F.pandas_udf(T.ArrayType(T.StringType()))
    def pieces(texts: pd.Series, token_valid: pd.Series, errors: pd.Series) -> pd.Series:
        def count(t: str) -> int:
            return max(1, len(re.findall(r"\w+|[^\w\s]", t)))

        def cut(t: str, valid: bool, found: list[str]) -> list[str]:
            target = int(budget * len(t) / count(t) * 0.7)
            caps = [(not valid, 3), (any("unbalanced" in e for e in found), 4), (any("truncated" in e for e in found), 5)]
            target = max(1, min([target, *(len(t) // n for hit, n in caps if hit)]))
            out = []
            for piece in pack_sections(t, target, profile):
                out += pack_lines(piece, max(1, target // 2)) if count(piece) > budget else [piece]
            return out

        return pd.Series([cut(t, bool(v), list(e) if e is not None else []) if t else [] for t, v, e in zip(texts, token_valid, errors)])

    ship_package(failed.sparkSession)
    rest = [c for c in failed.columns if c not in ("text", "token_valid", "errors")]
    return failed.select(*rest, F.posexplode(pieces("text", "token_valid", "errors")).alias("piece_no", "text"))


def build_prompt(chunks: DataFrame, template: str) -> DataFrame:
    """Adds ``prompt``: the template with {context} replaced by the sanitised text, or the text after the template."""
    text = sanitize(F.col("text"))
    prompt = F.replace(F.lit(template), F.lit("{context}"), text) if "{context}" in template else F.concat(F.lit(template + "\n"), text)
    return chunks.withColumn("prompt", prompt)


def chunk_quality(chunks: DataFrame, pattern: str | None, budget: int = TARGET, openvas: bool = True) -> DataFrame:
    """Adds ``size_ok``, ``markers``, ``clean_start`` (a marker among the first 10, for openvas 15, lines) and ``clean_end`` (over 100 characters after the last marker of the last 10 lines, or no marker there), ``pair_kinds``."""
    lines = F.split("text", "\n")
    marker = f"(?U){pattern}" if pattern else "(?!)"
    head = F.slice(lines, 1, 15 if openvas else 10)
    tail = F.when(F.size(lines) > 10, F.slice(lines, -10, 10)).otherwise(lines)
    tail_text = F.array_join(tail, "\n")
    last = F.expr("0") if not pattern else F.coalesce(F.array_max(F.transform(tail, lambda x, i: F.when(x.rlike(marker), i))), F.lit(-1))
    after = F.length(F.array_join(F.slice(tail, F.greatest(last + 2, F.lit(1)), F.greatest(F.size(tail) - last - 1, F.lit(0))), "\n"))
    pairs = F.struct(F.regexp_count("text", F.lit(r"Instances \(\d+\)")).alias("instances"), F.regexp_count("text", F.lit(r"(?i)PLUGIN\s+ID")).alias("bases"))
    return chunks.withColumns(
        {
            "size_ok": F.length("text") <= budget,
            "markers": marker_count(F.col("text"), pattern),
            "clean_start": F.exists(head, lambda x: x.rlike(marker)) if pattern else F.lit(True),
            "clean_end": (F.when(last >= 0, after > 100).otherwise(True) if pattern else F.lit(True)) & (F.length(tail_text) >= 0),
            "pair_kinds": pairs,
        }
    )


def quality_hints(quality: DataFrame) -> DataFrame:
    """``hints``: what chunk_quality found to be wrong with each chunk, in words; an empty list for a good one."""
    hints = F.array(
        F.when(~F.col("size_ok"), "over the size: lower the chunk size"),
        F.when(F.col("markers") == 0, "no marker: check the marker pattern"),
        F.when(~F.col("clean_start"), "begins within a finding"),
        F.when(~F.col("clean_end"), "ends soon after a marker: its finding goes on in the next chunk"),
    )
    return quality.withColumn("hints", F.array_compact(hints))
