"""Byte-pair encoding by a bounded-lookahead streaming transducer.

Two stages run over the text as it streams by. The first cuts it into the pieces of the tokenizer's pattern; whether a
piece ends is settled by the next few code points. The second encodes pieces; a piece longer than a window is encoded
window by window, and the tokens that end before the merge list's sufficient lookahead are emitted, since no byte that
follows can change them. The lookahead is computed from the merge list once. Decoding is an incremental state machine
from bytes to text.
"""

from __future__ import annotations

import base64
import codecs
import heapq
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import chain

import regex

TOKENIZERS = "/opt/tokenizers"
BYTE_BPE = "byte_bpe_50k.tiktoken"

#: fixed value: the public pattern of this family of tokenizers
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: the pieces of it that have no bound
RUN = r" ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+"
#: code points after a piece that settle it: a contraction is at most three long
SETTLE = 3


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes and their ranks from a ``.tiktoken`` file."""
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


def merge_list(ranks: dict[bytes, int]) -> list[tuple[bytes, bytes]]:
    """The merges in order of priority: each longer token split as the merges before it leave it."""
    out = []
    for token, rank in sorted(ranks.items(), key=lambda x: x[1]):
        if len(token) > 1:
            parts = merge(token, ranks, rank)
            if len(parts) == 2:
                out.append((parts[0], parts[1]))
    return out


def sufficient_lookahead(ranks: dict[bytes, int]) -> int:
    """Bytes after which a token can no longer change.

    Two runs of the merges, over a text and over the same text with more behind it, agree up to a frontier. Each merge
    (u, v) can move the frontier to the left by the length of u at most once, and only if v can start at the frontier;
    then u and uv can start at the new one. Following this through the merges in order bounds how far it can get.
    """
    starts: dict[bytes, int] = {}
    furthest = longest = 0
    for u, v in merge_list(ranks):
        moved = len(u) + starts.get(v, 0)
        starts[u + v] = max(starts.get(u + v, 0), starts.get(u, 0), moved)
        starts[u] = max(starts.get(u, 0), moved)
        furthest, longest = max(furthest, moved), max(longest, len(u) + len(v))
    return furthest + longest


def merge(piece: bytes, ranks: dict[bytes, int], below: int | None = None) -> list[bytes]:
    """The tokens of a piece, by merges of rank less than ``below``."""
    n = len(piece)
    if n < 2:
        return [piece] if piece else []
    end = list(range(1, n + 1))
    prior = list(range(-1, n - 1))
    alive = [True] * n
    heap: list[tuple[int, int, int]] = []

    def offer(i: int) -> None:
        j = end[i]
        if j < n:
            rank = ranks.get(piece[i : end[j]])
            if rank is not None and (below is None or rank < below):
                heapq.heappush(heap, (rank, i, end[j]))

    for i in range(n - 1):
        offer(i)
    while heap:
        _, i, stop = heapq.heappop(heap)
        if not alive[i] or end[i] >= n or end[end[i]] != stop:
            continue
        j = end[i]
        alive[j], end[i] = False, stop
        if stop < n:
            prior[stop] = i
        offer(i)
        if prior[i] >= 0:
            offer(prior[i])
    out, i = [], 0
    while i < n:
        out.append(piece[i : end[i]])
        i = end[i]
    return out


class Transducer(dict):
    """Ids of text. As a dict it remembers the ids of short pieces, up to ``remember`` of them."""

    def __init__(self, ranks: dict[bytes, int], window: int = 4096, chunk: int = 65536, remember: int = 200_000):
        super().__init__()
        self.ranks, self.remember, self.chunk = ranks, remember, chunk
        self.lookahead = sufficient_lookahead(ranks)
        self.window = max(window, 2 * self.lookahead)
        self.pattern, self.run = regex.compile(PATTERN), regex.compile(RUN)

    def __missing__(self, piece: str) -> tuple[int, ...]:
        data = piece.encode()
        if len(data) > self.window:
            return tuple(self.stream([data]))
        ids = (self.ranks[data],) if data in self.ranks else tuple(self.ranks[t] for t in merge(data, self.ranks))
        if len(data) <= 64:
            if len(self) >= self.remember:
                self.clear()
            self[piece] = ids
        return ids

    def stream(self, parts: Iterable[bytes]) -> Iterator[int]:
        """Ids of one piece that arrives in parts; holds at most a window of it."""
        held = b""
        for part in parts:
            for at in range(0, len(part), self.window):
                held += part[at : at + self.window]
                kept = 0
                for token in merge(held, self.ranks):
                    if kept + len(token) > len(held) - self.lookahead:
                        break
                    yield self.ranks[token]
                    kept += len(token)
                held = held[kept:]
        for token in merge(held, self.ranks):
            yield self.ranks[token]

    def pieces(self, text: str) -> Iterator[list[str] | tuple[int, int]]:
        """The pieces of a text, a chunk at a time; of a piece longer than a chunk only where it begins and ends."""
        find, at, size = self.pattern.findall, 0, self.chunk
        while len(text) - at > size:
            found = find(text, at, at + size)
            settled, last = size, len(found)
            while last and settled > size - SETTLE:
                last -= 1
                settled -= len(found[last])
            if last:
                yield found[:last]
                at += settled
            else:  # one piece fills the chunk
                end = self.run.match(text, at).end()
                if end < len(text) and text[end - 1].isspace():
                    end -= 1  # the last blank goes with what follows
                yield at, end
                at = end
        yield find(text, at)

    def ids(self, text: str) -> Iterator[Iterable[int]]:
        """Ids of a text in portions; a long piece goes through :meth:`stream` window by window."""
        for found in self.pieces(text):
            if isinstance(found, tuple):
                yield self.stream(text[i : min(i + self.window, found[1])].encode() for i in range(found[0], found[1], self.window))
            else:
                yield chain.from_iterable(map(self.__getitem__, found))

    def encode(self, text: str | None) -> Iterator[int]:
        """Ids without special tokens; none for null and empty texts. Holds a chunk and a window beside the text."""
        return chain.from_iterable(self.ids(text or ""))

    def count(self, text: str | None) -> int:
        """How many ids the text has."""
        total = 0
        for found in self.pieces(text or ""):
            if isinstance(found, tuple):
                total += sum(1 for _ in self.stream(text[i : min(i + self.window, found[1])].encode() for i in range(found[0], found[1], self.window)))
            else:
                total += sum(map(len, map(self.__getitem__, found)))
        return total


@lru_cache(maxsize=4)
def transducer(path: str) -> Transducer:
    """The transducer of a vocabulary file, once per Python worker."""
    return Transducer(read_ranks(path))


@lru_cache(maxsize=4)
def token_bytes(path: str) -> dict[int, bytes]:
    return {i: t for t, i in read_ranks(path).items()}


def decode(ids: Iterable[int], tokens: dict[int, bytes]) -> Iterator[str]:
    """Text of ids as it becomes complete; bytes that are no text come out as U+FFFD."""
    machine = codecs.getincrementaldecoder("utf-8")(errors="replace")
    for i in ids:
        yield machine.decode(tokens[i])
    yield machine.decode(b"", final=True)
