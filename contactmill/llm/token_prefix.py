"""Exact token counts of texts and of all their prefixes.

A text falls into special strings, which count one, and pieces, whose counts at every prefix come from the dynamic
program in `bpe.PrefixCounts`. The counts at the ends of the pieces add up, so a budget is found by one search in the
running sum and a look into one piece; nothing is encoded again.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from contactmill.llm import bpe
from contactmill.llm.byte_bpe import splitter
from contactmill.llm.common import whole_text

TOKENIZER = "byte_bpe_50k.json"
LIMIT = 512
_REMEMBERED = 1 << 20
_LONG = 64


class Counter:
    """Token counts under one tokenizer file; remembers the counts of short pieces up to a bound."""

    def __init__(self, tokenizer: str = TOKENIZER):
        import regex

        self.find, self.program = splitter(), bpe.prefix_counts_of(tokenizer)
        special = sorted(bpe.merges_of(tokenizer)[1], key=len, reverse=True)
        self.special = regex.compile("|".join(map(regex.escape, special))) if special else None
        self.spans = regex.compile(self.find.__self__.pattern).finditer
        self.known: dict[str, int] = {}

    def of_piece(self, piece: str) -> int:
        count = self.known.get(piece)
        if count is None:
            count = self.program.counts(piece.encode())[-1]
            if len(piece) <= _LONG:
                if len(self.known) >= _REMEMBERED:
                    self.known.clear()
                self.known[piece] = count
        return count

    def segments(self, text: str) -> Iterator[tuple[int, int, bool]]:
        """(start, end, is special) of the special strings and what lies between them."""
        at = 0
        for match in self.special.finditer(text) if self.special else ():
            if match.start() > at:
                yield at, match.start(), False
            yield match.start(), match.end(), True
            at = match.end()
        if at < len(text):
            yield at, len(text), False

    def total(self, text: str) -> int:
        known, count = self.known.get, 0
        for start, end, special in self.segments(text):
            if special:
                count += 1
            else:
                for piece in self.find(text[start:end] if end - start < len(text) else text):
                    count += known(piece) or self.of_piece(piece)
        return count

    def pieces(self, text: str, until: float = float("inf")) -> tuple[list[int], list[int], list[bool]]:
        """Starts of the pieces and the end of the last, token counts there, and which pieces are special strings.

        It stops one piece after the count has passed `until`.
        """
        starts, counts, special_at = [0], [0], []
        for start, end, special in self.segments(text):
            for a, b in [(start, end)] if special else (m.span() for m in self.spans(text, start, end)):
                passed = counts[-1] > until
                starts.append(b)
                counts.append(counts[-1] + (1 if special else self.of_piece(text[a:b])))
                special_at.append(special)
                if passed:
                    return starts, counts, special_at
        return starts, counts, special_at

    def prefixes(self, text: str) -> np.ndarray:
        """Token counts of text[:1], text[:2], ... to the whole text, each as the tokenizer would count it alone."""
        found = self.pieces(text)
        parts = [self._inside(text, *found, k) for k in range(len(found[2]))]
        return np.fromiter((c for part in parts for c in part), np.int64, len(text))

    def _inside(self, text: str, starts: list[int], counts: list[int], special: list[bool], k: int) -> list[int]:
        """Counts of the prefixes that end inside piece k, after its first character to its end.

        Three kinds of prefixes are cut into other pieces than the text is: one that ends in a special string, one that ends
        in a contraction, and one whose last character is a white space after white space.
        """
        start, end, base = starts[k], starts[k + 1], counts[k]
        piece = text[start:end]
        if special[k]:
            first = k
            while first and not special[first - 1]:
                first -= 1
            inner = [counts[first] + self.total(text[starts[first] : c]) for c in range(start + 1, end)]
            return [*inner, base + 1]
        if piece[0] == "'" and len(piece) > 1 and piece[1].isalpha():
            return [base + sum(map(self.of_piece, self.find(piece[:c]))) for c in range(1, len(piece) + 1)]
        by_byte = self.program.counts(piece.encode())
        ends = np.cumsum([len(c.encode()) for c in piece]) - 1
        found = [base + by_byte[e] for e in ends]
        if piece[0].isspace() and k and not special[k - 1] and text[start - 1].isspace():
            found[0] = counts[k - 1] + sum(map(self.of_piece, self.find(text[starts[k - 1] : start + 1])))
        return found

    def fitting(self, text: str, budget: int) -> int:
        """Length in characters of the longest prefix of at most `budget` tokens."""
        starts, counts, special = self.pieces(text, budget)
        if counts[-1] <= budget:
            return len(text)
        # a piece that begins beyond the budget holds no such end, but for white space that joins the white space before it
        last = int(np.searchsorted(counts[:-1], budget, side="right"))
        for k in range(min(last, len(special) - 1), -1, -1):
            inside = self._inside(text, starts, counts, special, k)
            for c in range(len(inside) - 1, -1, -1):
                if inside[c] <= budget:
                    return starts[k] + c + 1
        return 0


@lru_cache(2)
def counter(tokenizer: str) -> Counter:
    return Counter(tokenizer)


_COUNTED = "doc_id bigint, n_bytes bigint, n_tokens bigint, fitting_chars bigint"


def token_counts(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str = TOKENIZER, limit: int = LIMIT
) -> DataFrame:
    """One row per row of docs: doc_id (bigint), n_bytes, n_tokens, over_limit, fitting_chars.

    n_tokens is what the tokenizer gives without begin and end tokens; special strings in a text count one. fitting_chars
    is the length in characters of the longest prefix of at most `limit` tokens. Null texts count as empty: 0 everywhere.
    Repeated rows and null identifiers keep their rows; no rows give none. Other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = counter(tokenizer)
        for batch in batches:
            n_bytes, n_tokens, fitting = [], [], []
            for text in batch.column("text"):
                text = text.as_py()
                n_bytes.append(len(text.encode()))
                n_tokens.append(own.total(text))
                fitting.append(len(text) if n_tokens[-1] <= limit else own.fitting(text, limit))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *(pa.array(x, pa.int64()) for x in (n_bytes, n_tokens, fitting))],
                ["doc_id", "n_bytes", "n_tokens", "fitting_chars"],
            )

    texts = docs.select(F.col(f"`{id_col}`").cast("bigint").alias("doc_id"), whole_text(text_col).alias("text"))
    counted = texts.mapInArrow(run, _COUNTED)
    return counted.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"), "fitting_chars")


def prefix_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str = TOKENIZER) -> DataFrame:
    """doc_id (bigint), counts: the exact token count at every prefix, one number per character; null texts count as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = counter(tokenizer)
        for batch in batches:
            counts = [own.prefixes(x.as_py()).astype(np.int32) for x in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(counts, pa.list_(pa.int32()))], ["doc_id", "counts"])

    texts = docs.select(F.col(f"`{id_col}`").cast("bigint").alias("doc_id"), whole_text(text_col).alias("text"))
    return texts.mapInArrow(run, "doc_id bigint, counts array<int>")
