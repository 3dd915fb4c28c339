"""Byte-level BPE encoding and decoding through one global shuffle of distinct words.

Documents are cut into pre-tokens in blocks: consecutive documents of one task up to a number of characters. Inside a block
every distinct word gets a number, and the positions of the words are kept as the sequence of these numbers. Then

1. the distinct words of a block go to the buckets that own them, in one sorted, packed bundle a bucket; the task of a bucket
   encodes a word when it first meets it;
2. the ids go back to the block, which puts them at the word's positions and cuts the result at the documents.

Documents are cut once: the words of a block and its head (documents and sequence) leave the same task and take both shuffles
together, so no second scan has to meet the same partitions.

A word occurs once per block at most, so no frequent word can overload a task, and a block is bounded by its characters.
Decoding looks the ids up in the token-byte table, whose size the vocabulary fixes.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from contactmill.llm import bpe
from contactmill.llm.common import short_batches, whole_text
from contactmill.session import materialize

VOCABULARY = "byte_bpe_multi_50k.tiktoken"
BLOCK_CHARS = 32_000_000
BUCKETS = 256  # of words
_KNOWN = 400_000  # words a task remembers
_END = b"\xff"  # between words: no byte of UTF-8


@lru_cache(4)
def splitter(pattern: str | None = None):
    """Finds all matches of the pattern, with \\s, \\p{L} and \\p{N} in their Unicode sense."""
    import regex

    if pattern is None:
        import public_tokenizers

        pattern = public_tokenizers.PATTERN
    return regex.compile(pattern).findall


def packed(numbers: np.ndarray) -> bytes:
    """Whole numbers below 2**32: how many, then their byte planes one after the other, compressed."""
    planes = np.ascontiguousarray(numbers.astype("<u4").view(np.uint8).reshape(-1, 4).T)
    return len(numbers).to_bytes(8, "little") + pa.Codec("zstd", compression_level=6).compress(planes.tobytes(), asbytes=True)


def unpacked(data: bytes) -> np.ndarray:
    size = int.from_bytes(data[:8], "little")
    planes = np.frombuffer(pa.Codec("zstd").decompress(data[8:], 4 * size, asbytes=True), np.uint8).reshape(4, size)
    return np.ascontiguousarray(planes.T).view("<u4").reshape(-1)


class _Numbers(dict):
    def __missing__(self, word: str) -> int:
        number = self[word] = len(self)
        return number


_HEAD = "doc_ids array<bigint>, lengths binary, sequence binary"
_HEAD_FIELDS = [("doc_ids", pa.list_(pa.int64())), ("lengths", pa.binary()), ("sequence", pa.binary())]
#: Bundles of words, and one row with the head of each block.
_CUT = f"block bigint, bucket int, words binary, numbers binary, {_HEAD}"
_CUT_ARROW = pa.schema([
    ("block", pa.int64()), ("bucket", pa.int32()), ("words", pa.binary()), ("numbers", pa.binary()), *_HEAD_FIELDS
])


class _Block:
    """The documents a task has read since its last block."""

    def __init__(self, key: int):
        self.key, self.words, self.rows, self.lengths, self.parts, self.chars = key, _Numbers(), [], [], [], 0

    def add(self, row: int | None, found: list[str], chars: int) -> None:
        self.rows.append(row)
        self.lengths.append(len(found))
        self.parts.append(np.fromiter(map(self.words.__getitem__, found), np.uint32, len(found)))
        self.chars += chars

    def _numbered(self) -> tuple[np.ndarray, np.ndarray]:
        """(sequence of words, number of each word); the most frequent words have the smallest numbers, which pack best."""
        sequence = np.concatenate(self.parts) if self.parts else np.empty(0, np.uint32)
        order = np.argsort(-np.bincount(sequence, minlength=len(self.words)), kind="stable")
        number = np.empty(len(order), np.uint32)
        number[order] = np.arange(len(order), dtype=np.uint32)
        return sequence, number

    def leave(self) -> Iterator[pa.RecordBatch]:
        """The distinct words, one bundle a bucket, then one row with the documents and the sequence of their words."""
        sequence, number = self._numbered()
        bundles: list[list[tuple[bytes, int]]] = [[] for _ in range(BUCKETS)]
        for word, n in zip(self.words, number.tolist(), strict=True):
            piece = word.encode()
            bundles[zlib.crc32(piece) % BUCKETS].append((piece, n))
        filled = [(k, sorted(bundle)) for k, bundle in enumerate(bundles) if bundle]  # sorted words pack best
        columns = {
            "block": pa.array([self.key] * len(filled), pa.int64()),
            "bucket": pa.array([k for k, _ in filled], pa.int32()),
            "words": pa.array([zlib.compress(_END.join(piece for piece, _ in found)) for _, found in filled], pa.binary()),
            "numbers": pa.array([packed(np.array([n for _, n in found])) for _, found in filled], pa.binary()),
            **{c: pa.nulls(len(filled), t) for c, t in _HEAD_FIELDS},
        }
        yield pa.RecordBatch.from_arrays(list(columns.values()), schema=_CUT_ARROW)
        yield pa.RecordBatch.from_pydict({
            "block": [self.key], "bucket": [None], "words": [None], "numbers": [None],
            "doc_ids": [self.rows], "lengths": [packed(np.array(self.lengths))], "sequence": [packed(number[sequence])],
        }, schema=_CUT_ARROW)


def _cut(pattern: str | None, block_chars: int):
    """Fills blocks with documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find, block = splitter(pattern), None
        for batch in batches:
            for key, row, text in zip(batch.column("key").to_pylist(), batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                text = text.as_py()
                if block and block.chars + len(text) > block_chars:
                    yield from block.leave()
                    block = None
                block = block or _Block(key)
                block.add(row, find(text), len(text))
        if block:
            yield from block.leave()

    return run


_SENT = ("numbers", "n_ids", "ids")
_ENCODED = f"block bigint, numbers binary, n_ids binary, ids binary, {_HEAD}"
_ENCODED_ARROW = pa.schema([("block", pa.int64()), *((c, pa.binary()) for c in _SENT), *_HEAD_FIELDS])


def _encode(vocabulary: str):
    """The words of each bundle become their ids, which take its place; heads leave as they are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks = bpe.ranks_of(vocabulary)
        known: dict[bytes, list[int]] = {}

        def ids_of(piece: bytes) -> list[int]:
            ids = known.get(piece)
            if ids is None:
                if len(known) >= _KNOWN:
                    known.clear()
                ids = known[piece] = [ranks[piece]] if piece in ranks else [ranks[t] for t in bpe.merged(piece, ranks)]
            return ids

        for batch in batches:
            n_ids, sent = [], []
            for words in batch.column("words").to_pylist():
                found = None if words is None else [ids_of(piece) for piece in zlib.decompress(words).split(_END)]
                n_ids.append(None if found is None else packed(np.fromiter(map(len, found), np.uint32, len(found))))
                sent.append(None if found is None else packed(np.fromiter((i for x in found for i in x), np.uint32)))
            columns = {name: batch.column(name) for name in ("block", "numbers", *(c for c, _ in _HEAD_FIELDS))}
            columns |= {"n_ids": pa.array(n_ids, pa.binary()), "ids": pa.array(sent, pa.binary())}
            yield pa.RecordBatch.from_arrays([columns[c] for c in _ENCODED_ARROW.names], schema=_ENCODED_ARROW)

    return run


def _ranges(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """start[0] .. start[0] + size[0] - 1, start[1] .., one after the other."""
    ends = np.cumsum(size)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(start - (ends - size), size)


def _documents(table: pa.Table) -> Iterator[tuple[int | None, np.ndarray]]:
    """(doc_id, ids) of the documents of one block: the ids of the words at their positions."""
    head = table.filter(table.column("sequence").is_valid())
    rows, sequence = head.column("doc_ids")[0].as_py(), unpacked(head.column("sequence")[0].as_py())
    bounds = np.concatenate([[0], np.cumsum(unpacked(head.column("lengths")[0].as_py()), dtype=np.int64)])
    sent = table.filter(table.column("sequence").is_null())
    parts = [[unpacked(x.as_py()) for x in sent.column(c)] for c in ("numbers", "n_ids", "ids")]
    numbers, n_ids, ids = (np.concatenate(x) if x else np.empty(0, np.uint32) for x in parts)
    size, start = np.zeros((2, len(numbers)), np.int64)
    size[numbers] = n_ids
    start[numbers] = np.cumsum(n_ids, dtype=np.int64) - n_ids
    for k, row in enumerate(rows):
        own = sequence[bounds[k] : bounds[k + 1]]
        yield row, ids[_ranges(start[own], size[own])].astype("<u4")


def _shuffled(docs: DataFrame, id_col: str, text_col: str, vocabulary: str, pattern: str | None, block_chars: int, stored: bool):
    """Rows of blocks, grouped by block: what `_documents` reads."""
    texts = short_batches(docs).select(F.col(f"`{id_col}`").cast("bigint").alias("doc_id"), whole_text(text_col).alias("text"))
    texts = (texts if stored else materialize(texts)).withColumn("key", F.monotonically_increasing_id())
    rows = texts.mapInArrow(_cut(pattern, block_chars), _CUT)
    owner = F.coalesce(F.col("bucket"), F.pmod(F.hash("block"), F.lit(BUCKETS)))  # heads are spread over all tasks
    return rows.repartition(owner).mapInArrow(_encode(vocabulary), _ENCODED).groupBy("block")


def encode(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = VOCABULARY,
    pattern: str | None = None, block_chars: int = BLOCK_CHARS, stored: bool = False,
) -> DataFrame:
    """One row per row of docs: doc_id (bigint), ids (little-endian unsigned 32-bit numbers).

    Every match of the pattern is encoded separately, without special tokens. Null and empty texts have no ids. Repeated
    rows and null identifiers keep their rows; no rows give none. Other columns are not read. The text is read once; a task
    that runs again has to meet the same rows in the same order. In a stored table it does; say so by `stored`, or it is written.
    """

    def whole(table: pa.Table) -> pa.Table:
        rows, found = zip(*((row, ids.tobytes()) for row, ids in _documents(table)), strict=True)
        return pa.table({"doc_id": pa.array(rows, pa.int64()), "ids": pa.array(found, pa.binary())})

    blocks = _shuffled(docs, id_col, text_col, vocabulary, pattern, block_chars, stored)
    return blocks.applyInArrow(whole, "doc_id bigint, ids binary")


@lru_cache(4)
def token_bytes(vocabulary: str) -> list[bytes]:
    """The token-byte table: the bytes of every id."""
    ranks = bpe.ranks_of(vocabulary)
    table = [b""] * (max(ranks.values()) + 1)
    for token, i in ranks.items():
        table[i] = token
    return table


def decode(encoded: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """The rows of (doc_id, ids) with the bytes the ids stand for, as `decoded`; null ids give null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        look_up = token_bytes(vocabulary).__getitem__
        for batch in batches:
            ids = batch.column("ids")
            texts = [None if x is None else b"".join(map(look_up, np.frombuffer(x, "<u4").tolist())) for x in ids.to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), ids, pa.array(texts, pa.binary())], ["doc_id", "ids", "decoded"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id bigint, ids binary, decoded binary")


def digests(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = VOCABULARY,
    pattern: str | None = None, block_chars: int = BLOCK_CHARS, stored: bool = False,
) -> DataFrame:
    """One row per row of docs: doc_id, n_tokens, ids_sha256, decoded_sha256; ids and decoded bytes stay in their task.

    Rows are those of `encode`, decoded as by `decode`; the digests are of the ids as little-endian unsigned 32-bit numbers
    and of the decoded bytes.
    """

    def summed(table: pa.Table) -> pa.Table:
        look_up, out = token_bytes(vocabulary).__getitem__, []
        for row, ids in _documents(table):
            decoded = b"".join(map(look_up, ids.tolist()))
            out.append((row, len(ids), sha256(ids.tobytes()).hexdigest(), sha256(decoded).hexdigest()))
        columns = [pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.string(), pa.string()), strict=True)]
        return pa.Table.from_arrays(columns, ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    blocks = _shuffled(docs, id_col, text_col, vocabulary, pattern, block_chars, stored)
    return blocks.applyInArrow(summed, "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string")
