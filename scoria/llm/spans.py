"""Problem 8: passages of at least ``min_chars`` characters that stand verbatim in more than one document.

Tokens are the overlapping character grams of a text, each with a hash. A compact window (l, c, r) stands for all runs of
tokens that begin in [l, c], end in [c, r] and have their smallest hash at c (the leftmost, if there are more); it is the
subtree of node c in the Cartesian tree over the hashes. Only windows that hold a run as long as ``min_chars`` characters
are made, which is the tree pruned to the widest nodes: they are found level by level with running minima over doubling
widths. Equal passages have the same smallest hash at the same place, so for verbatim sharing one hash function finds
every pair: both texts have a window with that signature, and their intervals, moved onto each other, overlap by at least
one whole run. What is joined is verified on the texts, character by character.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scoria.session import cut_lineage

#: Characters of a gram; must be below min_chars. Longer grams are shared by chance less often, shorter ones give fewer windows.
GRAM = 80
#: Characters of all texts that are worked on at once.
BLOCK = 4_000_000
#: Texts that a task remembers as done.
SEEN = 500_000
#: A signature with more windows than HOT_WINDOWS, and than this part of all characters (so there are at most 1/HOT_PART of
#: them), is joined in pieces of HOT_WINDOWS rows.
HOT_WINDOWS, HOT_PART = 2_000, 1e-6
_ODD = np.uint64(0x9E3779B97F4A7C15)
#: Bits of a hash by which grams are ordered; the place takes the others. The same in all texts, whatever they are worked on with.
_LOW = np.uint64((1 << 32) - 1)


def _mix(x: np.ndarray) -> np.ndarray:
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(31)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(29)
    return x


def gram_hashes(codes: np.ndarray, size: int) -> np.ndarray:
    """A 64-bit hash of every run of ``size`` characters, by doubling."""
    level = _mix(codes.astype(np.uint64) + np.uint64(1))
    out, done, width = None, 0, 1
    while True:
        if size & width:
            if out is None:
                out = level
            else:
                m = len(level) - done
                out = out[:m] * np.uint64(pow(int(_ODD), width, 1 << 64)) + level[done : done + m] if m > 0 else out[:0]
            done += width
        if width * 2 > size:
            break
        m = len(level) - width
        if m <= 0:
            return np.zeros(0, np.uint64)
        level = level[:m] * np.uint64(pow(int(_ODD), width, 1 << 64)) + level[width:]
        width *= 2
    return _mix(out[: max(0, len(codes) - size + 1)])


def running_min(values: np.ndarray, width: int) -> np.ndarray:
    """Smallest of each ``width`` consecutive values."""
    have = 1
    while have * 2 <= width:
        values = np.minimum(values[:-have], values[have:])
        have *= 2
    left = width - have
    return np.minimum(values[: len(values) - left], values[left:]) if left else values


def compact_windows(texts: list[str], min_chars: int, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text number, signature, c, first, last) of the compact windows of many texts.

    c: the token's place; first and last: where the runs of min_chars characters begin whose smallest token is c.
    """
    sizes = np.fromiter((len(t) for t in texts), np.int64, len(texts))
    ends = np.cumsum(sizes)
    codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    width = min_chars - gram + 1
    none = np.zeros(0, np.int64)
    if len(codes) < min_chars:
        return none, none.view(np.uint64), none, none, none
    hashes = gram_hashes(codes, gram)
    # place in the low bits: the leftmost of grams with equal upper bits is the smallest, in both texts of a pair
    smallest = running_min((hashes & ~_LOW) | np.arange(len(hashes), dtype=np.uint64), width)
    at = (smallest & _LOW).astype(np.int64)
    starts = np.arange(len(at), dtype=np.int64)
    # runs of starts with the same token, within one text; runs over the border of two texts are left out
    doc = np.repeat(np.arange(len(texts), dtype=np.int64), sizes)[: len(at)]
    inside = starts + min_chars <= ends[doc]
    new = np.ones(len(at), bool)
    new[1:] = (at[1:] != at[:-1]) | (doc[1:] != doc[:-1]) | (inside[1:] != inside[:-1])
    firsts = np.flatnonzero(new)
    lasts = np.append(firsts[1:], len(at)) - 1
    keep = inside[firsts]
    firsts, lasts = firsts[keep], lasts[keep]
    number, place = doc[firsts], at[firsts]
    begin = (ends - sizes)[number]
    return number, hashes[place], place - begin, firsts - begin, lasts - begin


def chains(number: np.ndarray, sig: np.ndarray, c: np.ndarray, first: np.ndarray, last: np.ndarray, gram: int) -> tuple[np.ndarray, ...]:
    """(text number, signature, c, first, last, gap): windows of one gram that overlap at equal distances as one row each.

    A text that repeats itself, such as a ruled line, has a window at each repetition. The row has the first window's place,
    the distance in gap (0: a single window), and intervals, around that place, that hold those of all its windows around
    theirs; none is left out, as ``alignments`` stands for all their places.
    """
    if not len(c):
        return number, sig, c, first, last, c
    step = np.diff(c)
    link = (number[1:] == number[:-1]) & (sig[1:] == sig[:-1]) & (step < gram)
    new = np.ones(len(c), bool)
    new[1:] = ~link
    new[2:] |= link[:-1] & (step[1:] != step[:-1])
    heads = np.flatnonzero(new)
    gap = np.where(np.diff(np.append(heads, len(c))) > 1, np.append(step, 0)[heads], 0)
    place = c[heads]
    return number[heads], sig[heads], place, place + np.minimum.reduceat(first - c, heads), place + np.maximum.reduceat(last - c, heads), gap


def _blocks(texts: list[str]) -> Iterator[tuple[int, int]]:
    """Ranges of texts with about BLOCK characters together; one text may be longer by itself."""
    begin = total = 0
    for k, t in enumerate(texts):
        if total and total + len(t) > BLOCK:
            yield begin, k
            begin, total = k, 0
        total += len(t)
    if begin < len(texts):
        yield begin, len(texts)


def keyed_texts(docs: DataFrame, min_chars: int, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """``id``, ``key`` (128 bits of the text's digest) and ``text`` of the documents that are long enough to share a passage."""
    key = F.unhex(F.substring(F.sha2(F.col(text), 256), 1, 32))
    return docs.filter(F.length(text) >= min_chars).select(F.col(id_col).alias("id"), key.alias("key"), F.col(text).alias("text"))


def signatures(texts: DataFrame, min_chars: int, gram: int = GRAM, chained: bool = False) -> DataFrame:
    """``key``, ``sig``, ``c``, ``first``, ``last``, ``gap``: the compact windows of each distinct text; one shuffle, by signature.

    ``chained``: windows of a part that repeats itself are one row, see chains; else ``gap`` is 0 in all.

    A task makes the windows of a text once, however many copies it meets (it remembers up to SEEN keys), so copies are
    combined before the shuffle as in a partial aggregation; what still comes twice is dropped after it.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for batch in batches:
            keys, bodies = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            if len(seen) > SEEN:
                seen.clear()
            fresh = []
            for k, key in enumerate(keys):
                if key not in seen:
                    seen.add(key)
                    fresh.append(k)
            bodies = [bodies[k] for k in fresh]
            names = batch.column(0).take(pa.array(fresh, pa.int64()))
            for a, b in _blocks(bodies):
                number, sig, *places = compact_windows(bodies[a:b], min_chars, gram)
                if chained:
                    number, sig, *places = chains(number, sig, *places, gram)
                else:
                    places.append(np.zeros(len(number), np.int64))
                cols = [names.take(pa.array(number + a)), pa.array(sig.view(np.int64)), *(pa.array(p.astype(np.int32)) for p in places)]
                yield pa.RecordBatch.from_arrays(cols, names=["key", "sig", "c", "first", "last", "gap"])

    made = texts.select("key", "text").mapInArrow(run, "key binary, sig bigint, c int, first int, last int, gap int")
    # none is null; said here, no join adds it to one side only. gap follows from the rest; as a key it isn't pruned on one
    # side. So all that reads this shares one exchange
    made = made.filter(" AND ".join(f"{x} IS NOT NULL" for x in ("sig", "key", "c", "gap")))
    return made.repartition("sig").dropDuplicates(["sig", "key", "c", "gap"])


def common_run(a: str, b: str, shift: int, at: int) -> tuple[int, int]:
    """Start and end in ``a`` of the longest common run through place ``at``, with ``b`` moved by ``shift``; ends by halving steps."""
    if a[at] != b[at + shift]:
        return at, at
    lo, step, room = at, 64, min(at, at + shift)
    while room > 0:
        step = min(step, room)
        if a[lo - step : lo] == b[lo + shift - step : lo + shift]:
            lo, room, step = lo - step, room - step, step * 2
        elif step == 1:
            break
        else:
            step, room = step // 2, min(room, step - 1) if step > 1 else 0
    hi, step, room = at + 1, 64, min(len(a) - at - 1, len(b) - shift - at - 1)
    while room > 0:
        step = min(step, room)
        if a[hi : hi + step] == b[hi + shift : hi + shift + step]:
            hi, room, step = hi + step, room - step, step * 2
        elif step == 1:
            break
        else:
            step, room = step // 2, min(room, step - 1)
    return lo, hi


def alignments(a: str, b: str, at: int, shift: int, gap_a: int, gap_b: int, gram: int, extents: dict) -> Iterator[tuple[int, int]]:
    """(place in ``a``, way to ``b``) of windows or chains of one gram, so that if any of their places lie on a shared run, one given does too.

    A run through parts that repeat at one distance ends where the first of them ends, unless both begin or both end at the
    same place. So the longest is found with both true beginnings, or both true ends, on each other, or as near to it on either
    side as the distance allows. At two different distances each place of the second chain is taken as a single window.
    ``extents`` keeps where the repeating parts of this pair of texts begin and end.
    """

    def extent(side: int, text: str, c: int, gap: int) -> tuple[int, int]:
        if (side, c, gap) not in extents:
            lo, hi = common_run(text, text, gap, c)
            extents[side, c, gap] = lo, hi + gap
        return extents[side, c, gap]

    if not gap_a and not gap_b:
        yield at, shift
        return
    if gap_a and gap_b and gap_a != gap_b:
        for k in range(0, extent(1, b, at + shift, gap_b)[1] - gram - at - shift + 1, gap_b):
            yield from alignments(a, b, at, shift + k, gap_a, 0, gram, extents)
        return
    gap = gap_a or gap_b
    lo_a, hi_a = extent(0, a, at, gap)
    lo_b, hi_b = extent(1, b, at + shift, gap)
    near = {d - (d - shift) % gap for d in (lo_b - lo_a, hi_b - hi_a)}
    for d in sorted(near | {d + gap for d in near}):
        begin, end = max(lo_a, lo_b - d), min(hi_a, hi_b - d)
        if begin < end:
            yield begin, d


def candidate_pairs(sigs: DataFrame, characters: int) -> DataFrame:
    """``a``, ``b``, ``places``: pairs of different texts with windows of one signature whose intervals meet.

    Moved so that both windows' tokens lie on each other, the intervals of run starts must overlap; else the texts can't
    share a whole run there. ``places`` has the token's place in ``a``, the way to its place in ``b`` and both gaps.

    Signatures meet where the shuffle by signature put them. Those with very many windows, a short list, are joined in
    pieces: each of a's windows is in one, b's go to all pieces. ``characters``: of all texts, which no more windows have.
    """
    # the largest place is asked for so that the counts need all columns, and so the same shuffle as the joins
    counts = sigs.groupBy("sig").agg(F.count(F.lit(1)).alias("n"), F.max(F.greatest("c", "first", "last", "gap")).alias("most"))
    hot = counts.filter((F.col("n") > max(HOT_WINDOWS, characters * HOT_PART)) & (F.col("most") >= 0))
    hot = F.broadcast(hot.select("sig", F.ceil(F.col("n") / HOT_WINDOWS).cast("int").alias("pieces")))
    # an anti join would be pushed below the shuffle, and then be another one
    cold, many = sigs.join(hot, "sig", "left").filter(F.col("pieces").isNull()), sigs.join(hot, "sig")

    def side(df: DataFrame, key: str, *more: Column) -> DataFrame:
        return df.select("sig", F.col("key").alias(key), F.col("c").alias(f"c_{key}"), F.col("gap").alias(f"gap_{key}"), (F.col("first") - F.col("c")).alias(f"from_{key}"), (F.col("last") - F.col("c")).alias(f"to_{key}"), *more)

    meets = (F.col("a") < F.col("b")) & (F.col("from_a") <= F.col("to_b")) & (F.col("from_b") <= F.col("to_a"))
    place = F.struct(F.col("c_a").alias("at"), (F.col("c_b") - F.col("c_a")).alias("shift"), "gap_a", "gap_b")
    piece = F.pmod(F.xxhash64("key", "c"), F.col("pieces")).cast("int").alias("piece")
    pieces = F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)).alias("piece")
    met = [side(cold, "a").join(side(cold, "b"), "sig"), side(many, "a", piece).join(side(many, "b", pieces), ["sig", "piece"])]
    found = met[0].filter(meets).select("a", "b", place.alias("place")).unionByName(met[1].filter(meets).select("a", "b", place.alias("place")))
    return found.groupBy("a", "b").agg(F.collect_set("place").alias("places"))


def shared_runs(x: str, y: str, places: list[dict], min_chars: int, gram: int) -> Iterator[tuple[int, int, int]]:
    """Start in ``x``, start in ``y`` and length of the longest common runs through the places."""
    reached: dict[int, tuple[int, int]] = {}
    extents: dict[tuple[int, int, int], tuple[int, int]] = {}
    for p in sorted(places, key=lambda p: (p["at"], p["shift"])):
        for at, shift in alignments(x, y, p["at"], p["shift"], p["gap_a"], p["gap_b"], gram, extents):
            lo, hi = reached.get(shift, (0, 0))
            if lo <= at < hi:
                continue
            reached[shift] = lo, hi = common_run(x, y, shift, at)
            if hi - lo >= min_chars:
                yield lo, lo + shift, hi - lo


def verified_pairs(texts: DataFrame, pairs: DataFrame, min_chars: int, gram: int) -> DataFrame:
    """``a``, ``b`` of the pairs that share a run of ``min_chars`` characters, compared on the texts themselves.

    ``pairs`` and the texts in pairs, one per key, should be tables: then each join shuffles both sides as they are, and a
    text in very many pairs is spread by the engine. A pair carries no more of a text than its places can reach, as long
    as none of them is in a part that repeats itself.
    """
    at, to, chained = F.col("places.at"), F.zip_with("places.at", "places.shift", lambda x, y: x + y), F.exists("places", lambda p: (p["gap_a"] > 0) | (p["gap_b"] > 0))
    reach = min_chars - gram

    def cut(places: Column) -> tuple[Column, Column]:
        lo = F.when(chained, F.lit(0)).otherwise(F.greatest(F.array_min(places) - reach, F.lit(0)))
        return lo, F.when(chained, F.lit((1 << 31) - 1)).otherwise(F.array_max(places) + min_chars - lo)

    both = pairs
    for key, places in (("a", at), ("b", to)):
        lo, size = cut(places)
        mine = texts.select(F.col("key").alias(key), F.col("text").alias("__text"))
        both = both.withColumn(f"lo_{key}", lo).join(mine, key).withColumn(f"text_{key}", F.substring("__text", F.col(f"lo_{key}") + 1, size)).drop("__text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for places, lo_a, lo_b, x, y in zip(*(c.to_pylist() for c in batch.columns[2:])):
                moved = [p | {"at": p["at"] - lo_a, "shift": p["shift"] + lo_a - lo_b} for p in places]
                found.append(next(shared_runs(x, y, moved, min_chars, gram), None) is not None)
            yield pa.RecordBatch.from_arrays([c.filter(pa.array(found)) for c in batch.columns[:2]], names=["a", "b"])

    return both.select("a", "b", "places", "lo_a", "lo_b", "text_a", "text_b").mapInArrow(run, "a binary, b binary")


def shared_pairs(docs: DataFrame, min_chars: int, id_col: str = "doc_id", text: str = "text", gram: int | None = None) -> DataFrame:
    """``doc_id_a``, ``doc_id_b``: each pair of documents that share a run of ``min_chars`` characters, the smaller id first.

    Null texts and texts below ``min_chars`` share nothing. Copies are searched once and put in at the end. An empty table
    gives an empty result. Further columns of ``docs`` are not read.
    """
    texts = keyed_texts(docs, min_chars, id_col, text)
    gram = gram or _gram(min_chars)
    characters = texts.agg(F.sum(F.length("text"))).first()[0] or 0
    pairs = cut_lineage(candidate_pairs(signatures(texts, min_chars, gram, True), characters))
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("key")).distinct()
    bodies = cut_lineage(texts.select("key", "text").join(wanted, "key", "left_semi").dropDuplicates(["key"]))
    between = verified_pairs(bodies, pairs, min_chars, gram)
    members = texts.select("id", "key")
    x = members.select(F.col("key").alias("a"), F.col("id").alias("x"))
    y = members.select(F.col("key").alias("b"), F.col("id").alias("y"))
    apart = between.join(x, "a").join(y, "b").select("x", "y")
    copies = x.join(y.withColumnRenamed("b", "a"), "a").filter("x < y").select("x", "y")
    return apart.unionByName(copies).select(F.least("x", "y").alias("doc_id_a"), F.greatest("x", "y").alias("doc_id_b"))


def window_digests(bodies: DataFrame, windows: DataFrame, min_chars: int, each_run: bool) -> DataFrame:
    """``key``, ``sig``, ``first``, ``last``, ``offset``, ``digest`` (128 bits) of what windows (``key``, ``sig``, ``c``, ``first``, ``last``) hold.

    One row for a window, of all characters that its runs have and the token's place in them (offset 0); with ``each_run``
    one row for each run of ``min_chars`` characters, ``offset`` characters from the first.
    """
    spans = windows.groupBy("key").agg(F.collect_list(F.struct("sig", "c", "first", "last")).alias("spans"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for key, text, spans in zip(*(c.to_pylist() for c in batch.columns)):
                for s in spans:
                    first, last = s["first"], s["last"]
                    if each_run:
                        held = [text[i : i + min_chars] for i in range(first, last + 1)]
                    else:
                        held = [f"{s['c'] - first} {text[first : last + min_chars]}"]
                    rows += [(key, s["sig"], first, last, k, blake2b(h.encode("utf-8", "surrogatepass"), digest_size=16).digest()) for k, h in enumerate(held)]
            kinds = (pa.binary(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary())
            columns = list(zip(*rows)) or [()] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["key", "sig", "first", "last", "offset", "digest"])

    schema = "key binary, sig bigint, first int, last int, offset int, digest binary"
    return bodies.join(spans, "key").select("key", "text", "spans").mapInArrow(run, schema)


def shared_parts(docs: DataFrame, min_chars: int, id_col: str = "doc_id", text: str = "text", gram: int | None = None) -> DataFrame:
    """``doc_id``, ``n_chars``, ``shared_chars``, ``shared_part`` of every document with a passage that stands elsewhere too.

    A text with copies is shared as a whole. No pairs are made, so the work follows the windows, however many texts a
    passage is in. Of a signature that more than one text has, windows that hold the same are one class; a class with more
    than one text is shared as it is. Where a signature has more classes, one window of each is taken apart into its runs,
    and those that more than one text has are shared, in all windows of the class.
    """
    texts = keyed_texts(docs, min_chars, id_col, text)
    sigs = signatures(texts, min_chars, gram or _gram(min_chars))
    # the largest place is asked for so that the counts need all columns, and so the same shuffle as the join
    several = sigs.groupBy("sig").agg(F.min("key").alias("x"), F.max("key").alias("y"), F.max(F.greatest("c", "first", "last", "gap")).alias("most")).filter("x <> y AND most >= 0").select("sig")
    windows = cut_lineage(sigs.join(several, "sig", "left_semi").select("sig", "key", "c", "first", "last"))
    bodies = cut_lineage(texts.select("key", "text").join(windows.select("key").distinct(), "key", "left_semi").dropDuplicates(["key"]))
    held = cut_lineage(window_digests(bodies, windows, min_chars, False).select("sig", "key", "first", "last", F.col("digest").alias("class")))
    classes = cut_lineage(held.groupBy("sig", "class").agg(F.min("key").alias("x"), F.max("key").alias("y"), F.min(F.struct("key", "first", "last")).alias("one")))
    mixed = classes.groupBy("sig").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("sig")
    apart = classes.join(mixed, "sig", "left_semi").select("sig", "class", "x", "y", "one.*")
    runs = window_digests(bodies, apart.select("key", "sig", F.lit(0).alias("c"), "first", "last"), min_chars, True)
    # a window is its text's only one with that first place: it names its class
    runs = cut_lineage(runs.join(apart, ["sig", "key", "first", "last"]).select("sig", "class", "x", "y", "offset", "digest"))
    common = runs.groupBy("sig", "digest").agg(F.min("x").alias("x"), F.max("y").alias("y")).filter("x <> y").select("sig", "digest")
    offsets = runs.filter("x = y").join(common, ["sig", "digest"], "left_semi").select("sig", "class", "offset")
    whole = classes.filter("x <> y").select("sig", "class")
    parts = held.join(whole, ["sig", "class"], "left_semi").select("key", F.col("first").alias("lo"), (F.col("last") + min_chars).alias("hi"))
    parts = parts.unionByName(held.join(offsets, ["sig", "class"]).select("key", (F.col("first") + F.col("offset")).alias("lo"), (F.col("first") + F.col("offset") + min_chars).alias("hi")))
    members = texts.select("id", "key", F.length("text").alias("n_chars"))
    copied = members.groupBy("key").agg(F.count(F.lit(1)).alias("__n"), F.first("n_chars").alias("hi")).filter("__n > 1").select("key", F.lit(0).alias("lo"), "hi")
    each = parts.unionByName(copied).groupBy("key", "lo").agg(F.max("hi").alias("hi"))
    before = Window.partitionBy("key").orderBy("lo").rowsBetween(Window.unboundedPreceding, -1)
    new = F.greatest(F.col("hi") - F.greatest(F.col("lo"), F.coalesce(F.max("hi").over(before), F.lit(0))), F.lit(0))
    covered = each.withColumn("__new", new).groupBy("key").agg(F.sum("__new").alias("shared_chars"))
    # a key's members may be a third of all rows; the covered side is one row per key
    out = members.join(covered, "key")
    return out.select(F.col("id").alias("doc_id"), "n_chars", "shared_chars", (F.col("shared_chars") / F.col("n_chars")).alias("shared_part"))


def _gram(min_chars: int) -> int:
    """Grams well below the length of a passage, so that windows stay few, and at most GRAM."""
    return max(1, min(GRAM, min_chars * 8 // 15))
