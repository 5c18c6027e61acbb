"""Byte-level BPE by corpus-level merge replay.

The words of a batch are encoded together, each distinct word once: their bytes stand in one long
list, an inverted index leads from a token pair to the positions where it occurs, and the pairs are
replayed in rank order over all words at once. A merge touches only its two neighbours.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import remembers, slices, spread

#: Words that a Python worker remembers before it starts anew; longer words than LONG bytes are not remembered.
REMEMBERED, LONG = 800_000, 64
#: Characters of text that are encoded together at least, if there are so many.
TOGETHER = 8 << 20
NONE = 1 << 30


class Tokenizer:
    """Encodes with a rank file, as the library that defined the format would, without special tokens."""

    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.words: dict[str, bytes] = {}
        self.tokens: list[bytes] = [b""] * (max(self.ranks.values()) + 1)
        for token, rank in self.ranks.items():
            self.tokens[rank] = token
        self.pairs: dict[int, int] = {}
        self.bytes = np.array([self.ranks[bytes([b])] for b in range(256)], np.int64)
        self.split = regex.compile(pattern).findall

    def forget(self) -> None:
        """The words and pairs met so far go; the ranks stay."""
        self.words, self.pairs = {}, {}

    def pair_ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each two adjacent tokens' merge, NONE where they don't merge."""
        keys, places = np.unique(left.astype(np.int64) << 20 | right, return_inverse=True)
        found = []
        if len(self.pairs) > 4 * REMEMBERED:
            self.pairs.clear()
        for key in keys.tolist():
            r = self.pairs.get(key)
            if r is None:
                r = self.pairs[key] = self.ranks.get(self.tokens[key >> 20] + self.tokens[key & 0xFFFFF], NONE)
            found.append(r)
        return np.array(found, np.int64)[places]

    def replay(self, words: list[bytes]) -> list[bytes]:
        """The token ids of each word as bytes; no word is empty."""
        if not words:
            return []
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        flat = np.frombuffer(b"".join(words), np.uint8)
        n = len(flat)
        token, word = self.bytes[flat], np.repeat(np.arange(len(words)), sizes)
        after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
        ends = np.cumsum(sizes)
        after[ends - 1] = -1
        before[ends - sizes] = -1
        rank = np.full(n, NONE)
        inner = np.flatnonzero(after >= 0)
        rank[inner] = self.pair_ranks(token[inner], token[inner + 1])
        places: dict[int, list[np.ndarray]] = {}  # inverted index; a pair has the rank of what it merges to
        queue: list[int] = []

        def enter(at: np.ndarray, ranks: np.ndarray) -> None:
            good = ranks < NONE
            at, ranks = at[good], ranks[good]
            order = np.argsort(ranks, kind="stable")
            at, ranks = at[order], ranks[order]
            cuts = np.flatnonzero(ranks[1:] != ranks[:-1]) + 1
            for r, part in zip(ranks[np.concatenate([[0], cuts])].tolist() if len(ranks) else (), np.split(at, cuts), strict=False):
                if r not in places:
                    places[r] = []
                    heapq.heappush(queue, r)
                places[r].append(part)

        enter(inner, rank[inner])
        while queue:
            r = heapq.heappop(queue)
            at = np.unique(np.concatenate(places.pop(r)))
            at = at[rank[at] == r]
            if len(at) > 1:
                # Of overlapping places of one pair, the first, third, ... are merged.
                starts = np.concatenate([[True], after[at[:-1]] != at[1:]])
                turn = np.arange(len(at)) - np.flatnonzero(starts)[np.cumsum(starts) - 1]
                at = at[turn % 2 == 0]
            if not len(at):
                continue
            second = after[at]
            left, right = before[at], after[second]
            # A pair of lower rank that a merge makes comes first in its word; there, the other places wait.
            merged = np.full(len(at), r)
            left_token = np.where(left >= 0, token[left], -1)
            if len(at) > 1:
                left_token[1:][left[1:] == second[:-1]] = r
            first_new = np.full(len(at), NONE)
            for has, a, b in ((left >= 0, left_token, merged), (right >= 0, merged, token[right])):
                if has.any():
                    first_new[has] = np.minimum(first_new[has], self.pair_ranks(a[has], b[has]))
            if len(at) > 1 and (first_new < r).any():
                own = word[at]
                early = np.isin(own, own[first_new < r])
                wait = early & np.concatenate([[False], own[1:] == own[:-1]])
                if wait.any():
                    enter(at[wait], merged[wait])
                    at, second = at[~wait], second[~wait]
                    right = after[second]
            token[at] = r
            after[at] = right
            before[right[right >= 0]] = at[right >= 0]
            token[second], rank[second] = -1, NONE
            rank[at] = NONE
            left = before[at]
            touched = np.unique(np.concatenate([at[right >= 0], left[left >= 0]]))
            if len(touched):
                rank[touched] = new = self.pair_ranks(token[touched], token[after[touched]])
                enter(touched, new)
        alive = token >= 0
        ids = token[alive].astype("<u4").tobytes()
        stops = 4 * np.cumsum(np.bincount(word[alive], minlength=len(words)))
        return [ids[a:b] for a, b in zip([0, *stops[:-1].tolist()], stops.tolist(), strict=True)]

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit numbers."""
        if len(self.words) > REMEMBERED:
            self.words.clear()
        split = [self.split(t) for t in texts]
        own: dict[str, bytes] = {}
        todo: list[str] = []
        for w in set().union(*split):
            if w in self.words:
                continue
            r = self.ranks.get(b := w.encode())
            if r is None:
                todo.append(w)
            else:
                own[w] = r.to_bytes(4, "little")
        own.update(zip(todo, self.replay([w.encode() for w in todo]), strict=True))
        known = self.words
        known.update((w, x) for w, x in own.items() if len(w) <= LONG)
        if any(len(w) > LONG for w in own):
            known = known | own
        return [b"".join(map(known.__getitem__, s)) for s in split]

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))


@cache
def tokenizer(path: str, pattern: str) -> Tokenizer:
    return Tokenizer(path, pattern)


def _together(own: Tokenizer, batches: Iterator[pa.RecordBatch], column: str) -> Iterator[tuple[pa.RecordBatch, list[str], list[bytes]]]:
    """Batches with their texts and ids; several are encoded at once."""
    held: list[tuple[pa.RecordBatch, list[str]]] = []
    size = 0

    def done() -> Iterator[tuple[pa.RecordBatch, list[str], list[bytes]]]:
        ids = iter(own.encode([t for _, texts in held for t in texts]))
        for b, texts in held:
            yield b, texts, [next(ids) for _ in texts]

    remembers("bpe", own.forget)
    for b in slices(batches, "bpe"):
        held.append((b, texts := [t or "" for t in b.column(column).to_pylist()]))
        size += sum(map(len, texts))
        if size >= TOGETHER:
            yield from done()
            held, size = [], 0
    yield from done()


def _encoded(path: str, pattern: str, names: list[str], fields: pa.Schema, column: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = tokenizer(path, pattern)
        for b, texts, ids in _together(own, batches, column):
            back = [own.decode(x) for x in ids]
            cols = [*(b.column(c) for c in names), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary()), pa.array(back, pa.binary())]
            yield pa.RecordBatch.from_arrays(cols, schema=fields)

    return run


def _digested(path: str, pattern: str, names: list[str], fields: pa.Schema, column: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sha = lambda xs: pa.array([hashlib.sha256(x).hexdigest() for x in xs], pa.string())
        for b in _encoded(path, pattern, names, _fields(fields, names, pa.binary()), column)(batches):
            ids, back = (b.column(k).to_pylist() for k in (-2, -1))
            yield pa.RecordBatch.from_arrays([*b.columns[:-2], sha(ids), sha(back)], schema=fields)

    return run


def _fields(like: pa.Schema, names: list[str], kind: pa.DataType) -> pa.Schema:
    return pa.schema([like.field(k) for k in range(len(names) + 1)] + [pa.field("ids", kind), pa.field("decoded", kind)])


def encode_texts(docs: DataFrame, path: str, pattern: str, keep: list[str], column: str = "text", digests: bool = False) -> DataFrame:
    """keep, n_tokens long, ids binary (little-endian unsigned 32-bit numbers), decoded binary of each row of docs.

    With digests, ids_sha256 and decoded_sha256 (lower-case hex) instead of the bytes, which then never leave the
    worker. A null text counts as empty and has no ids; rows that repeat are encoded alike; an empty table
    gives an empty one. keep must not hold n_tokens, ids or decoded.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    kinds = dict(docs.dtypes)
    base = [pa.field(c, to_arrow_type(docs.schema[c].dataType)) for c in keep] + [pa.field("n_tokens", pa.int64())]
    last, kind = (("ids_sha256", "decoded_sha256"), (pa.string(), "string")) if digests else (("ids", "decoded"), (pa.binary(), "binary"))
    fields = pa.schema(base + [pa.field(n, kind[0]) for n in last])
    ddl = ", ".join([f"`{c}` {kinds[c]}" for c in keep] + ["n_tokens long"] + [f"{n} {kind[1]}" for n in last])
    run = (_digested if digests else _encoded)(path, pattern, keep, fields, column)
    return spread(docs.select(*dict.fromkeys([*keep, column]))).mapInArrow(run, ddl)
