"""Language identification by averaged hashed subword embeddings and a linear softmax.

A text is reduced to its letters in lower case, words apart by single spaces; its subwords are the sequences of one to
four characters inside a word and its borders. Each falls into one of a fixed number of buckets. The mean of the buckets'
embeddings goes through a linear softmax. Training is plain stochastic gradient descent in numpy on bags of subwords
drawn from a bounded sample; a part of the sample fixes the temperature and the score below which an answer is rejected.

For prediction the embeddings are multiplied with the softmax weights once, so a text costs one count of its buckets.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from contactmill.llm.common import whole_text

#: At most so many rows per language, and so many in all, are drawn to learn from, by the hash of doc_id.
ROWS_PER_LANGUAGE = 1500
SAMPLE_ROWS = 12_000
#: Subwords drawn from each row of the sample, spread over the whole text.
BAG = 384
BUCKETS = 1 << 15
UNKNOWN = "und"


@lru_cache(1)
def _letter_table() -> np.ndarray:
    """True for code points that are letters."""
    return np.fromiter((unicodedata.category(chr(c))[0] == "L" for c in range(0x110000)), bool, 0x110000)


def subwords(text: str) -> np.ndarray:
    """Bucket of every subword of a text; none if it has no letter."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    letters = _letter_table()[points] if len(points) else np.empty(0, bool)
    if not letters.any():
        return np.empty(0, np.uint32)
    points = np.concatenate([[np.uint32(32)], np.where(letters, points, np.uint32(32)), [np.uint32(32)]])
    gap = points == 32
    points = points[~(gap & np.concatenate([[False], gap[:-1]]))]
    gap, found = points == 32, []
    mixed = np.zeros(len(points), np.uint32)
    for n in range(1, 5):
        if len(points) < n:
            break
        mixed = (mixed[: len(points) - n + 1] ^ points[n - 1 :]) * np.uint32(0x01000193) + np.uint32(0x9E3779B9)
        inside = ~gap.copy() if n == 1 else np.ones(len(mixed), bool)
        for k in range(1, n - 1):  # a space may stand at either end only
            inside &= ~gap[k : k + len(mixed)]
        if n == 2:
            inside &= ~(gap[: len(mixed)] & gap[1 : 1 + len(mixed)])
        hashed = mixed[inside]
        hashed = (hashed ^ (hashed >> np.uint32(15))) * np.uint32(0x85EBCA6B)
        found.append((hashed ^ (hashed >> np.uint32(13))) % np.uint32(BUCKETS))
    return np.concatenate(found)


@dataclass
class Model:
    """Languages, bucket weights (buckets x languages), bias, temperature, and the score from which an answer is accepted."""

    languages: list[str]
    weights: np.ndarray
    bias: np.ndarray
    temperature: float = 1.0
    accept: float = 0.0

    def logits(self, buckets: np.ndarray) -> np.ndarray:
        counts = np.bincount(buckets, minlength=BUCKETS).astype(np.float32)
        return counts @ self.weights / len(buckets) + self.bias

    def answer(self, text: str) -> tuple[str, float]:
        """(language, score); `und` with score 0 for a text without letters or when nothing was learned."""
        buckets = subwords(text)
        if not len(buckets) or not self.languages:
            return UNKNOWN, 0.0
        shares = _softmax(self.logits(buckets)[None] / self.temperature)[0]
        best = int(shares.argmax())
        return self.languages[best], float(shares[best])


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def train(
    bags: np.ndarray, sizes: np.ndarray, labels: np.ndarray, languages: list[str], width: int = 16, epochs: int = 12,
    rate: float = 0.6, batch: int = 64, seed: int = 3, errors: float = 0.005,
) -> Model:
    """Learn from bags of buckets (rows x BAG, the first `sizes` of each row are set), labels as numbers of languages.

    Every step uses bags of another size, so that short texts are learned too. One row in five is set aside: it fixes the
    temperature (by likelihood) and the lowest score at which at most `errors` of the accepted answers are wrong.
    """
    draws = np.random.default_rng(seed)
    table = draws.normal(0, 0.1, (BUCKETS, width)).astype(np.float32)
    out, bias = np.zeros((width, len(languages)), np.float32), np.zeros(len(languages), np.float32)
    aside = draws.random(len(labels)) < 0.2
    learn, check = np.flatnonzero(~aside), np.flatnonzero(aside)
    steps, total = 0, max(1, epochs * -(-len(learn) // batch))
    for _ in range(epochs):
        draws.shuffle(learn)
        for at in range(0, len(learn), batch):
            rows = learn[at : at + batch]
            drawn = _draw(bags, sizes, rows, int(draws.choice([4, 16, 64, 256])), draws)
            mean = table[drawn].mean(axis=1)
            error = _softmax(mean @ out + bias)
            error[np.arange(len(rows)), labels[rows]] -= 1
            error *= rate * (1 - steps / total) / len(rows)
            back = (error @ out.T) * (len(rows) / drawn.shape[1])
            out -= mean.T @ error * 8
            bias -= error.sum(axis=0)
            np.subtract.at(table, drawn.ravel(), np.repeat(back, drawn.shape[1], axis=0))
            steps += 1
    model = Model(languages, table @ out, bias)
    if len(check):
        _calibrate(model, bags, sizes, labels, check, draws, errors)
    return model


def _draw(bags: np.ndarray, sizes: np.ndarray, rows: np.ndarray, size: int, draws: np.random.Generator) -> np.ndarray:
    return bags[rows[:, None], (draws.random((len(rows), size)) * sizes[rows][:, None]).astype(np.int64)]


def _calibrate(model, bags, sizes, labels, rows, draws, errors) -> None:
    logits = [np.stack([model.logits(x) for x in _draw(bags, sizes, rows, n, draws)]) for n in (8, 32, 256)]
    logits, truth = np.concatenate(logits), np.tile(labels[rows], 3)
    at = np.arange(len(truth))
    choices = np.geomspace(0.1, 10, 60)
    model.temperature = float(choices[np.argmin([-np.log(_softmax(logits / t)[at, truth] + 1e-12).mean() for t in choices])])
    shares = _softmax(logits / model.temperature)
    best = shares.max(axis=1)
    order = np.argsort(-best, kind="stable")
    wrong = np.cumsum(shares.argmax(axis=1)[order] != truth[order]) / (at + 1)
    fine = np.flatnonzero(wrong <= errors)
    model.accept = float(best[order][fine[-1]]) if len(fine) else 1.0


def held_out(doc_id: Column) -> Column:
    """Rows that never teach: crc32 of the identifier as text is divisible by 5. A null identifier teaches nothing either."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string")), F.lit(5)) == 0, F.lit(True))


def fit(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
    rows_per_language: int = ROWS_PER_LANGUAGE, sample_rows: int = SAMPLE_ROWS,
) -> Model:
    """Learn from a bounded sample of the rows that are not held out and have a language and a text with letters.

    An identifier on several rows counts once, with the smallest of its languages and subword bags, however often it repeats.
    """
    doc_id = F.col(f"`{id_col}`")
    usable = docs.where(F.col(f"`{lang_col}`").isNotNull() & F.col(f"`{text_col}`").isNotNull() & ~held_out(doc_id))
    ids = usable.select(doc_id.alias("_id"), F.col(f"`{lang_col}`").cast("string").alias("_lang"))
    # by the hash, about twice the rows wanted of each language are left to be ranked, however many it has; the sample
    # has no room for more languages than rows, which bounds the table that is broadcast
    sizes = ids.groupBy("_lang").agg(F.count(F.lit(1)).alias("_n")).orderBy(F.desc("_n"), "_lang").limit(sample_rows)
    place = F.pmod(F.xxhash64("_id"), F.lit(1 << 30)) / float(1 << 30)
    ids = ids.join(F.broadcast(sizes), "_lang").where(place * F.col("_n") < 2.0 * rows_per_language).distinct()
    turn = F.row_number().over(Window.partitionBy("_lang").orderBy(F.xxhash64("_id"), "_id"))
    drawn = ids.withColumn("_turn", turn).where(F.col("_turn") <= rows_per_language)
    drawn = drawn.orderBy("_turn", "_lang").limit(sample_rows).select("_id").distinct()

    def bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for key, text in zip(batch.column("_id"), batch.column("_text"), strict=True):
                all_of = subwords(text.as_py())
                draws = np.random.default_rng(hash(key.as_py()) & 0xFFFFFFFF)
                found.append(all_of if len(all_of) <= BAG else draws.choice(all_of, BAG, replace=False))
            yield pa.RecordBatch.from_arrays(
                [batch.column("_id"), batch.column("_lang"), pa.array([x.astype("<u4").tobytes() for x in found], pa.binary())],
                ["_id", "_lang", "_bag"],
            )

    texts = usable.select(
        doc_id.cast("bigint").alias("_id"), F.col(f"`{lang_col}`").cast("string").alias("_lang"), whole_text(text_col).alias("_text")
    )
    sample = texts.join(F.broadcast(drawn), "_id", "left_semi").mapInArrow(bags, "_id bigint, _lang string, _bag binary")
    taught = sample.where("octet_length(_bag) > 0").groupBy("_id").agg(F.min(F.struct("_lang", "_bag")).alias("_one"))
    rows = sorted(taught.select("_id", "_one.*").collect(), key=lambda r: r["_id"])
    languages = sorted({r["_lang"] for r in rows})
    if not rows:
        return Model([], np.zeros((BUCKETS, 0), np.float32), np.zeros(0, np.float32))
    matrix, sizes = np.zeros((len(rows), BAG), np.uint32), np.zeros(len(rows), np.int64)
    for k, r in enumerate(rows):
        bag = np.frombuffer(r["_bag"], "<u4")
        matrix[k, : len(bag)], sizes[k] = bag, len(bag)
    return train(matrix, sizes, np.array([languages.index(r["_lang"]) for r in rows]), languages)


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id (bigint), held_out, lang_pred, score (0 to 1), accepted (score high enough).

    Null texts and texts without a letter give `und` with score 0, not accepted. Every subword of the whole text counts.
    Repeated rows get equal answers; no rows give none. Only the identifier and the text are read, the identifier for
    `held_out` alone.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            answers = [own.answer(text.as_py()) for text in batch.column("text")]
            yield pa.RecordBatch.from_arrays([
                batch.column("doc_id"), batch.column("held_out"), pa.array([a for a, _ in answers], pa.string()),
                pa.array([s for _, s in answers], pa.float64()), pa.array([a != UNKNOWN and s >= own.accept for a, s in answers], pa.bool_()),
            ], ["doc_id", "held_out", "lang_pred", "score", "accepted"])

    doc_id = F.col(f"`{id_col}`")
    texts = docs.select(doc_id.cast("bigint").alias("doc_id"), held_out(doc_id).alias("held_out"), whole_text(text_col).alias("text"))
    return texts.mapInArrow(run, "doc_id bigint, held_out boolean, lang_pred string, score double, accepted boolean")
