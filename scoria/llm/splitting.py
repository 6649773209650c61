"""Problem 3: texts over a size limit, or with too many marker lines, become overlapping pieces cut at natural places."""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scoria.session import shipped

SENTENCE_END = re.compile(r"[.!?][\"')\]]*\s+")
WORD_END = re.compile(r"\s+")
BLANK_LINE = re.compile(r"\n[^\S\n]*\n\s*")


@dataclass(frozen=True)
class Limits:
    """max_chars and max_markers bound a piece with its overlap; overlap is the number of characters repeated."""

    marker: str
    max_chars: int
    max_markers: int
    overlap: int


def _starts(pattern: re.Pattern[str], text: str) -> list[int]:
    return [m.end() for m in pattern.finditer(text)]


def marker_lines(text: str, marker: re.Pattern[str]) -> list[int]:
    """Where lines start in which the marker pattern is found; lines end at line feeds only."""
    out, at = [], 0
    for line in text.split("\n"):
        if marker.search(line):
            out.append(at)
        at += len(line) + 1
    return out


def cut(text: str, limits: Limits, marker: re.Pattern[str] | None = None) -> list[tuple[int, int]]:
    """The pieces as (start, end), overlaps included; a text within both limits is one piece.

    Boundaries have ranks: section (a marker line's start), paragraph, line, sentence, word, character. A piece takes as
    much as fits and ends at the last boundary there of the highest rank that there is, so units are packed greedily and a
    unit is only opened where it doesn't fit as a whole. Each piece begins with the ``overlap`` characters before its new
    text, or all that the piece before has, if that is shorter. Where the repeated characters alone hold so many markers
    that no new text would fit, fewer are repeated: the limits come first. Every piece but the first adds new text.
    """
    marker = marker or re.compile(limits.marker)
    n = len(text)
    lines = marker_lines(text, marker)
    if n <= limits.max_chars and len(lines) <= limits.max_markers:
        return [(0, n)]
    newlines = [i + 1 for i, c in enumerate(text) if c == "\n"]
    ranks = [lines, _starts(BLANK_LINE, text), newlines, _starts(SENTENCE_END, text), _starts(WORD_END, text)]
    pieces, at, before = [], 0, 0
    while at < n:
        # at: end of what is covered; the piece's text may begin up to `overlap` characters earlier
        begin = max(before, at - limits.overlap) if pieces else 0
        while True:
            end = _end(text, begin, at, lines, newlines, limits, marker)
            if end > at or begin >= at:
                break
            nxt = bisect_right(newlines, begin)  # repeat less: drop the first repeated line, or all of it
            begin = newlines[nxt] if nxt < len(newlines) and newlines[nxt] <= at else at
        if end < n:
            for places in ranks:
                k = bisect_right(places, end) - 1
                if k >= 0 and places[k] > at:
                    end = places[k]
                    break
        end = max(end, at + 1)
        pieces.append((begin, end))
        before, at = begin, end
    return pieces


def _end(text: str, begin: int, at: int, lines: list[int], newlines: list[int], limits: Limits, marker: re.Pattern[str]) -> int:
    """The farthest end of a piece from ``begin`` that keeps both limits, were it cut anywhere."""
    end = min(len(text), begin + limits.max_chars)
    k = bisect_left(newlines, begin)
    if k and newlines[k - 1] == begin or begin == 0:
        first, count = bisect_left(lines, begin), 0
    else:  # the first line is cut at its start: what is left of it may be a marker line by itself
        stop = newlines[k] - 1 if k < len(newlines) else len(text)
        count = int(bool(marker.search(text[begin:min(stop, end)])))
        first = bisect_left(lines, stop)
    over = first + limits.max_markers - count
    if over < 0:
        return begin
    if over < len(lines):
        end = min(end, max(lines[over], begin))
    return end


def needs_split(text: Column, limits: Limits) -> Column:
    """Whether a text is over either limit; decided on the JVM, so that other texts never reach Python. Null: false."""
    found = F.filter(F.split(text, "\n"), lambda line: line.rlike("(?U)" + limits.marker))
    return F.coalesce((F.length(text) > limits.max_chars) | (F.size(found) > limits.max_markers), F.lit(False))


def split_oversized(df: DataFrame, limits: Limits, keys: list[str], text: str = "text") -> DataFrame:
    """Pieces of the oversized texts: ``keys``, ``piece_no`` (from 0), ``start``, ``end``, ``piece``.

    No shuffle: each text is cut where it is read. Texts within both limits, null and empty texts have no pieces;
    repeated rows are cut each. Other columns of ``df`` are not carried along, so their names can't clash.
    """
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*keys).schema) + ", piece_no int, start int, end int, piece string"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        marker = re.compile(limits.marker)
        for pdf in batches:
            out = []
            for row in pdf.itertuples(index=False, name=None):
                body = row[-1]
                out += [(*row[:-1], k, a, b, body[a:b]) for k, (a, b) in enumerate(cut(body, limits, marker))]
            yield pd.DataFrame(out, columns=[*keys, "piece_no", "start", "end", "piece"])

    return shipped(df).filter(needs_split(F.col(text), limits)).select(*keys, F.col(text).alias("__text")).mapInPandas(run, schema)


def piece_checks(pieces: DataFrame, limits: Limits, keys: list[str]) -> DataFrame:
    """Per text: ``pieces``, ``text_md5`` of the text put together again, and whether every piece keeps the limits and repeats what it should.

    On the JVM and from the pieces alone: without what they repeat, they give the text. A piece repeats ``overlap``
    characters, or all of the piece before where that is shorter; fewer only where the limits leave no room.
    """
    before = Window.partitionBy(*keys).orderBy("piece_no")
    p = pieces.withColumn("__end", F.lag("end").over(before)).withColumn("__start", F.lag("start").over(before)).withColumn("__text", F.lag("piece").over(before))
    repeated = F.coalesce(F.col("__end") - F.col("start"), F.lit(0))
    markers = F.size(F.filter(F.split("piece", "\n"), lambda line: line.rlike("(?U)" + limits.marker)))
    full = F.least(F.lit(limits.overlap), F.col("__end") - F.col("__start"))
    same = F.substring("__text", F.length("__text") - repeated + 1, repeated) == F.substring("piece", F.lit(1), repeated)
    p = p.withColumn("__new", F.substring("piece", repeated + 1, F.length("piece")))
    p = p.withColumn("__kept", (F.length("piece") <= limits.max_chars) & (markers <= limits.max_markers) & (F.length("__new") > 0))
    p = p.withColumn("__repeats", F.col("__end").isNull() | (same & (repeated >= 0) & ((repeated == full) | (markers == limits.max_markers))))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("piece_no", "__new"))), lambda s: s["__new"]), "")
    return p.groupBy(*keys).agg(F.count(F.lit(1)).alias("pieces"), F.md5(text).alias("text_md5"), F.bool_and("__kept").alias("limits_kept"), F.bool_and("__repeats").alias("overlap_kept"))
