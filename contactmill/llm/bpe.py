"""Byte-pair merges of one piece of text, and exact token counts at every prefix of it."""

from __future__ import annotations

import base64
import heapq
import json
from functools import lru_cache

from contactmill.llm.common import vocabulary

_SHORT = 48


@lru_cache(4)
def ranks_of(name: str) -> dict[bytes, int]:
    """Rank (here also the id) of every token of a rank file."""
    with open(vocabulary(name), "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


def _byte_letters() -> dict[str, int]:
    """The printable letters that byte-level vocabularies write for bytes: bytes that print stand for themselves, the others follow from 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


@lru_cache(4)
def merges_of(name: str) -> tuple[dict[bytes, int], tuple[str, ...]]:
    """(rank of every token a merge makes, with single bytes first; special tokens) of a tokenizer file.

    In a byte-level vocabulary each merge makes a token of its own, so ranks of made tokens decide as ranks of pairs do.
    """
    with open(vocabulary(name), encoding="utf-8") as file:
        content = json.load(file)
    letter = _byte_letters()
    ranks = {bytes([b]): b for b in range(256)}
    for k, merge in enumerate(content["model"]["merges"]):
        pair = merge.split(" ") if isinstance(merge, str) else merge
        ranks.setdefault(bytes(letter[c] for c in "".join(pair)), 256 + k)
    return ranks, tuple(t["content"] for t in content["added_tokens"])


def merged(piece: bytes, ranks: dict[bytes, int]) -> list[bytes]:
    """The tokens of a piece: of all neighbouring pairs the one of lowest rank merges first, the leftmost among equals."""
    if piece in ranks and len(piece) == 1:
        return [piece]
    if len(piece) > _SHORT:
        return _merged_long(piece, ranks)
    parts = [piece[i : i + 1] for i in range(len(piece))]
    pairs = [ranks.get(parts[i] + parts[i + 1]) for i in range(len(parts) - 1)]
    while True:
        best = min((r for r in pairs if r is not None), default=None)
        if best is None:
            return parts
        i = pairs.index(best)
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
        del pairs[i]
        if i:
            pairs[i - 1] = ranks.get(parts[i - 1] + parts[i])
        if i < len(pairs):
            pairs[i] = ranks.get(parts[i] + parts[i + 1])


def _merged_long(piece: bytes, ranks: dict[bytes, int]) -> list[bytes]:
    """The same with a heap, for pieces of any length."""
    n = len(piece)
    end, after, before = list(range(1, n + 1)), list(range(1, n + 1)), list(range(-1, n - 1))
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(piece[i : i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, stop = heapq.heappop(heap)
        j = after[i] if end[i] else n
        if not end[i] or j >= n or end[j] != stop:
            continue  # one of the two has merged meanwhile
        end[i], end[j] = stop, 0
        after[i] = after[j]
        if after[j] < n:
            before[after[j]] = i
        for a in (before[i], i):
            b = after[a] if a >= 0 else n
            if a >= 0 and b < n and (r := ranks.get(piece[a : end[b]])) is not None:
                heapq.heappush(heap, (r, a, end[b]))
    found, i = [], 0
    while i < n:
        found.append(piece[i : end[i]])
        i = after[i]
    return found


class PrefixCounts:
    """Exact token counts at every byte prefix of a piece by dynamic programming.

    The last token of a prefix is the longest token t that ends there such that t may follow the last token of what
    precedes it; two tokens may follow each other when the merges of both together give just them. Then the whole chain
    is the encoding of the prefix, and its length is one more than that of the preceding prefix.
    """

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = {t: r for t, r in ranks.items() if len(t) == 1 or merged(t, ranks) == [t]}
        self.all = ranks
        self.longest = max(map(len, self.ranks))
        self.follows: dict[tuple[bytes, bytes], bool] = {}

    def _may_follow(self, a: bytes, b: bytes) -> bool:
        if len(self.follows) >= 1 << 19:
            self.follows.clear()
        follows = self.follows[a, b] = merged(a + b, self.all) == [a, b]
        return follows

    def counts(self, piece: bytes) -> list[int]:
        """Token counts of piece[:1], piece[:2], ... to the whole piece."""
        last, count = [b""], [0]
        ranks, longest, known = self.ranks, self.longest, self.follows.get
        for end in range(1, len(piece) + 1):
            for start in range(max(0, end - longest), end):
                token = piece[start:end]
                if token in ranks:
                    if not start:
                        break
                    before = last[start]
                    follows = known((before, token))
                    if follows or (follows is None and self._may_follow(before, token)):
                        break
            last.append(token)
            count.append(count[start] + 1)
        return count[1:]


@lru_cache(4)
def prefix_counts_of(name: str) -> PrefixCounts:
    return PrefixCounts(merges_of(name)[0])
