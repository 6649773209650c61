"""Problem 6: token ids of whole texts by a public byte-level BPE vocabulary.

Words of the text (by the vocabulary's published splitting pattern) are encoded over a trie of the distinct words: the
state of a trie node is the last token of the encoding of its prefix. A prefix's encoding is that of a shorter prefix and
one more token, the only one of the tokens ending there that stays apart from the token before it; so the depth-first walk
does each shared prefix once, and a word's ids are read back from its last state.
"""

from __future__ import annotations

import base64
import os
import re
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame

from scoria.session import ship_package

#: Where the public vocabularies are; a parameter of every function that needs one.
TOKENIZER_DIR = os.environ.get("SCORIA_TOKENIZERS", "/opt/tokenizers")
#: Fixed value: the published splitting pattern of the 50k byte-level vocabularies, in the syntax of Python's re.
WORDS = re.compile(r"'(?:[sdmt]|ll|ve|re)| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+")
#: Distinct words and segments that a worker keeps the ids of; beyond, it begins afresh (results don't change).
KEPT = 400_000
#: A blank that doesn't begin a word.
BLANKS = re.compile(r" (?:\s|$)")
#: Control characters that Python takes for white space, the pattern doesn't.
NOT_SPACE = re.compile("[\x1c-\x1f]")


def _exact_words():  # noqa: ANN202
    """The pattern by Unicode categories, for texts with characters that re's classes see differently."""
    import regex

    return regex.compile(r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")


class TrieEncoder:
    """Encodes words with a rank table (token bytes to rank, ranks being ids in order of merging)."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        self.ranks = ranks
        self.longest = max(map(len, ranks))
        self.bytes_of = {v: k for k, v in ranks.items()}
        self._halves: dict[int, tuple[int, int]] = {}
        self._apart: dict[int, bool] = {}

    def halves(self, token: int) -> tuple[int, int]:
        """The two tokens that the last merge of ``token`` joins; (-1, -1) for a single byte."""
        got = self._halves.get(token)
        if got is None:
            whole = self.bytes_of[token]
            if len(whole) == 1:
                got = (-1, -1)
            else:
                parts = [whole[i : i + 1] for i in range(len(whole))]
                while len(parts) > 2:
                    best = min(range(len(parts) - 1), key=lambda i: self.ranks.get(parts[i] + parts[i + 1], 1 << 30))
                    parts[best : best + 2] = [parts[best] + parts[best + 1]]
                got = (self.ranks[parts[0]], self.ranks[parts[1]])
            self._halves[token] = got
        return got

    def apart(self, left: int, right: int) -> bool:
        """Whether the two tokens stay two tokens side by side.

        They don't if some merge joins pieces over the border before either piece goes into its own larger piece. Merging
        is traced backwards: of the two border pieces the later made one is taken apart first.
        """
        got = self._apart.get(left << 32 | right)
        if got is None:
            a, b, into_a, into_b, got = left, right, 1 << 30, 1 << 30, True
            while True:
                joined = self.ranks.get(self.bytes_of[a] + self.bytes_of[b])
                if joined is not None and joined < into_a and joined <= into_b:
                    got = False
                    break
                made_a = a if self.halves(a)[0] >= 0 else -1
                made_b = b if self.halves(b)[0] >= 0 else -1
                if made_a < 0 and made_b < 0:
                    break
                if made_b >= made_a:
                    into_b, b = b, self.halves(b)[0]
                else:
                    into_a, a = a, self.halves(a)[1]
            self._apart[left << 32 | right] = got
        return got

    def encode_words(self, words: Iterable[bytes]) -> Iterator[tuple[bytes, tuple[int, ...]]]:
        """(word, ids) of distinct words; in byte order, which walks their trie depth first."""
        get, known, apart, longest = self.ranks.get, self._apart.get, self.apart, self.longest
        last, size, before = [-1], [0], b""  # by depth: last token of the prefix, and its length
        for word in sorted(words):
            n, shared = len(word), 0
            for x, y in zip(word, before):
                if x != y:
                    break
                shared += 1
            del last[shared + 1 :], size[shared + 1 :]
            for d in range(shared + 1, n + 1):
                for at in range(d - longest if d > longest else 0, d):
                    token = get(word[at:d])
                    if token is None:
                        continue
                    if at:
                        left = last[at]
                        ok = known(left << 32 | token)
                        if ok is None:
                            ok = apart(left, token)
                        if not ok:
                            continue
                    last.append(token)
                    size.append(d - at)
                    break
                else:
                    raise ValueError(f"no token ends at {d} of {word!r}")
            ids, d = [], n
            while d:
                ids.append(last[d])
                d -= size[d]
            before = word
            yield word, tuple(reversed(ids))


class TextEncoder:
    """Encodes texts; keeps the ids of words and of segments (a word group up to the next blank) seen before."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        self.trie = TrieEncoder(ranks)
        self.words: dict[str, tuple[int, ...]] = {}
        self.segments: dict[str, tuple[int, ...]] = {}
        self.exact = _exact_words()

    def _learn(self, segments: list[str]) -> None:
        if len(self.words) > KEPT:
            self.words.clear()
        words, ranks = self.words, self.trie.ranks
        plain, exact, odd = WORDS.findall, self.exact.findall, NOT_SPACE.search
        parts = [plain(s) if s.isascii() and not odd(s) else exact(s) for s in segments]
        new: dict[bytes, str] = {}
        for w in set(chain.from_iterable(parts)).difference(words):
            coded = w.encode("utf-8", "surrogatepass")
            token = ranks.get(coded)
            if token is not None:
                words[w] = (token,)
            else:
                new[coded] = w
        for coded, ids in self.trie.encode_words(new):
            words[new[coded]] = ids
        get, known = words.__getitem__, self.segments
        for s, ws in zip(segments, parts):
            known[s] = get(ws[0]) if len(ws) == 1 else tuple(chain.from_iterable(map(get, ws)))

    def batch(self, texts: list[str | None]) -> list[list[tuple[int, ...]]]:
        """Per text the ids of its segments in order.

        A blank followed by something other than white space always begins a word, whatever stands before it; so texts
        are taken apart there. Texts with other runs of blanks are taken as one segment.
        """
        if len(self.segments) > KEPT:
            self.segments.clear()
        cut: list[list[str]] = []
        for text in texts:
            if not text:
                cut.append([])
                continue
            first, *rest = text.split(" ")
            rest = [" " + p for p in rest]
            if BLANKS.search(text):
                merged = [first]
                for p in rest:  # a blank before white space stays with what is before it; so does all up to a word
                    if p == " " or p[1].isspace() or merged[-1].endswith(" "):
                        merged[-1] += p
                    else:
                        merged.append(p)
                first, *rest = merged
            cut.append([first, *rest] if first else rest)
        known = self.segments
        missing = [s for s in set(chain.from_iterable(cut)) if s not in known]
        if missing:
            self._learn(missing)
        get = known.__getitem__
        return [list(map(get, c)) for c in cut]


def load_ranks(name: str, directory: str = TOKENIZER_DIR) -> dict[bytes, int]:
    """The rank table of a byte-level BPE vocabulary: ``<name>.tiktoken`` in ``directory``."""
    with open(os.path.join(directory, f"{name}.tiktoken"), "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


_ENCODERS: dict[tuple[str, str], TextEncoder] = {}
_SENT: set[tuple[str, str]] = set()


def send_vocabulary(df: DataFrame, name: str, directory: str) -> None:
    """Sends the vocabulary's file to all workers, once per application, where the driver has it."""
    ship_package(df.sparkSession)
    context, path = df.sparkSession.sparkContext, os.path.join(directory, f"{name}.tiktoken")
    if (context.applicationId, path) not in _SENT and os.path.isfile(path):
        context.addFile(path)
        _SENT.add((context.applicationId, path))


def _encoder(name: str, directory: str) -> TextEncoder:
    """One per worker process, from the file that the driver sent, else from the worker's own ``directory``."""
    if (name, directory) not in _ENCODERS:
        sent = SparkFiles.get(f"{name}.tiktoken")
        _ENCODERS[(name, directory)] = TextEncoder(load_ranks(name, os.path.dirname(sent) if os.path.isfile(sent) else directory))
    return _ENCODERS[(name, directory)]


def token_ids(df: DataFrame, key: str = "doc_id", text: str = "text", name: str = "byte_bpe_50k", directory: str = TOKENIZER_DIR) -> DataFrame:
    """``key`` and ``ids``: the token ids of each whole text, without special tokens, whose strings are ordinary text.

    Null and empty texts have an empty list; repeated rows come out each; no shuffle. The vocabulary is sent from the
    driver's ``directory``, or read from the workers' own.
    """
    send_vocabulary(df, name, directory)
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(name, directory)
        for batch in batches:
            coded = encoder.batch(batch.column(1).to_pylist())
            ends = np.zeros(len(coded) + 1, dtype=np.int64)
            np.cumsum([sum(map(len, c)) for c in coded], out=ends[1:])
            flat = np.fromiter(chain.from_iterable(chain.from_iterable(coded)), dtype=np.int32, count=int(ends[-1]))
            ids = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column(0), ids], names=[key, "ids"])

    return df.select(key, text).mapInArrow(run, f"`{key}` {kind}, ids array<int>")


def token_counts(df: DataFrame, keep: list[str], text: str = "text", name: str = "byte_bpe_50k", directory: str = TOKENIZER_DIR) -> DataFrame:
    """``keep`` and ``n_tokens`` of each row: like token_ids, but only the length leaves the worker."""
    send_vocabulary(df, name, directory)
    fields = df.select(*keep).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(name, directory)
        for batch in batches:
            coded = encoder.batch(batch.column(len(keep)).to_pylist())
            counts = pa.array([sum(map(len, c)) for c in coded], pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], counts], names=[*keep, "n_tokens"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields) + ", n_tokens bigint"
    return df.select(*keep, text).mapInArrow(run, schema)
