"""Near-duplicate documents by SetSketch registers.

A sketch holds m registers; register j of a set is 1 - log_b of the smallest of its elements' exponential values under
hash j, cut to whole numbers between 0 and q + 1. Only minima enter, so sketches of parts merge by the largest register.
Registers of two sets agree with a probability close to their Jaccard similarity, so bands of registers find candidates;
from the number of registers above, below and equal, together with the known set sizes, the likelihood of each
similarity follows, and candidates whose best similarity is far more likely than the threshold itself are dropped.
Everything else is verified on the full shingle sets.

Members of one bucket are never paired with each other: all meet the bucket's first member, its centre, and verified links
are contracted. In most buckets one component is left then. Members of the others are few, and among these all pairs of
different components that may be linked are found by their rarest shingles, with a bound on what they can share (prefix
and position filters), which is exact and leaves apart the far variants of one text that every register-based test lets
through. These pairs are verified on the full sets, too.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from contactmill.llm.common import short_batches, whole_text
from contactmill.session import materialize

BASE = 1.2
RATE = 20.0
LIMIT = 254  # q; registers fit a byte
BANDS = 50
ROWS = 5
REGISTERS = BANDS * ROWS
#: A candidate is dropped when the threshold is this many standard errors away from the likeliest similarity.
ERRORS = 6.0
_MIX = np.uint64(0x9E3779B97F4A7C15)
_CHUNK = 256


class _WordHashes(dict):
    """64-bit hashes of words, remembered up to a bound."""

    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) >= 1 << 17:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value


_HASHES = _WordHashes()


def _scrambled(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


def words_of(text: str | None) -> list[bytes]:
    """Words of a text: A-Z in lower case, split at ASCII white space."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def shingle_hashes(text: str | None, size: int = 5) -> np.ndarray:
    """Sorted distinct hashes of a text's shingles; fewer words than `size` make one shingle, none make none."""
    words = words_of(text)
    if not words:
        return np.empty(0, np.uint64)
    one = np.fromiter(map(_HASHES.__getitem__, words), np.uint64, len(words))
    size = min(size, len(words))
    total = np.full(len(words) - size + 1, size, np.uint64) * _MIX
    for k in range(size):
        total = _scrambled(total * _MIX + one[k : len(words) - size + 1 + k])
    return np.unique(total)


@lru_cache(1)
def _multipliers() -> tuple[np.ndarray, np.ndarray]:
    draws = np.random.default_rng(20210).integers(0, 2**63, (2, REGISTERS), dtype=np.uint64)
    return draws[0] * np.uint64(2) + np.uint64(1), draws[1] * np.uint64(2)


def sketch(hashes: np.ndarray) -> np.ndarray:
    """The registers of a set of 64-bit hashes, one byte each; an empty set has zeros."""
    if not len(hashes):
        return np.zeros(REGISTERS, np.uint8)
    factor, shift = _multipliers()
    low = np.full(REGISTERS, np.iinfo(np.uint64).max)
    for at in range(0, len(hashes), _CHUNK):
        np.minimum(low, (hashes[at : at + _CHUNK, None] * factor + shift).min(axis=0), out=low)
    values = -np.log1p(-(low.astype(np.float64) + 0.5) / 2.0**64) / RATE
    return np.clip(np.floor(1.0 - np.log(values) / np.log(BASE)), 0, LIMIT + 1).astype(np.uint8)


def merged(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The sketch of the union of two sketched sets."""
    return np.maximum(a, b)


def likely_similarity(
    above: np.ndarray, below: np.ndarray, n_a: np.ndarray, n_b: np.ndarray, threshold: float
) -> tuple[np.ndarray, np.ndarray]:
    """(likeliest similarity, twice the log-likelihood ratio to the threshold) of pairs of sets.

    above, below: registers of a that are larger and smaller than those of b; n_a, n_b: sizes of the sets.
    """
    above, below = np.asarray(above, float)[:, None], np.asarray(below, float)[:, None]
    u = (n_a / (n_a + n_b)).astype(float)[:, None]
    v = 1.0 - u
    top = np.minimum(u / v, v / u)

    def log_likelihood(j):
        def exceeds(x):
            return -np.log1p(-np.clip(x, 0, 1) * (BASE - 1) / BASE) / np.log(BASE)

        more, less = exceeds(u - v * j), exceeds(v - u * j)
        tiny = 1e-12
        return (
            above * np.log(np.maximum(more, tiny)) + below * np.log(np.maximum(less, tiny))
            + (REGISTERS - above - below) * np.log(np.maximum(1 - more - less, tiny))
        )

    grid = np.linspace(0, 1, 101)[None, :] * top
    best = log_likelihood(grid)
    spot = best.argmax(axis=1)
    at = np.minimum(threshold, top)
    ratio = 2 * (best.max(axis=1) - log_likelihood(at)[:, 0])
    return grid[np.arange(len(spot)), spot], ratio


def _batches(function, schema: pa.Schema):
    """mapInArrow over a function from one record batch to a dict of columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_pydict(function(batch), schema=schema)

    return run


_SKETCHED = pa.schema(
    [("doc_id", pa.int64()), ("text_key", pa.int64()), ("n_shingles", pa.int64()), ("set_key", pa.binary()), ("registers", pa.binary())]
)


def _sketch_batch(batch: pa.RecordBatch) -> dict:
    import xxhash

    sizes, keys, registers = [], [], []
    for text in batch.column("text"):
        hashes = shingle_hashes(text.as_py())
        sizes.append(len(hashes))
        keys.append(xxhash.xxh3_128_digest(hashes.tobytes()))
        registers.append(sketch(hashes).tobytes())
    own = {c: batch.column(c) for c in ("doc_id", "text_key")}
    return own | {"n_shingles": sizes, "set_key": keys, "registers": registers}


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id, text_key, text: the first two name a text even where a doc_id repeats with another text."""
    text = whole_text(text_col)
    return short_batches(docs).select(F.col(f"`{id_col}`").cast("bigint").alias("doc_id"), F.xxhash64(text).alias("text_key"), text.alias("text"))


def sketches(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text_key, n_shingles, set_key (equal for equal sets), registers (one byte each) per row of docs."""
    return _texts(docs, id_col, text_col).mapInArrow(
        _batches(_sketch_batch, _SKETCHED), "doc_id bigint, text_key bigint, n_shingles bigint, set_key binary, registers binary"
    )


_BANDED = pa.schema([("node", pa.int64()), ("n_shingles", pa.int64()), ("band", pa.int64())])


def _band_batch(batch: pa.RecordBatch) -> dict:
    registers = np.frombuffer(b"".join(batch.column("registers").to_pylist()), np.uint8).reshape(-1, BANDS, ROWS).astype(np.uint64)
    keys = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64) * _MIX, registers.shape[:2])
    for k in range(ROWS):
        keys = _scrambled(keys * _MIX + registers[:, :, k])
    each = lambda name: np.repeat(np.asarray(batch.column(name)), BANDS)
    return {"node": each("node"), "n_shingles": each("n_shingles"), "band": keys.reshape(-1).view(np.int64)}


def _near_batch(threshold: float):
    def near(batch: pa.RecordBatch) -> dict:
        a, b = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(-1, REGISTERS) for c in ("reg_a", "reg_b"))
        n_a, n_b = (np.asarray(batch.column(c)).astype(float) for c in ("n_a", "n_b"))
        best, ratio = likely_similarity((a > b).sum(axis=1), (a < b).sum(axis=1), n_a, n_b, threshold)
        keep = (best >= threshold) | (ratio <= ERRORS**2)
        return {c: batch.column(c).filter(pa.array(keep)) for c in ("a", "b")}

    return near


def _verify_batch(percent: int):
    def verify(batch: pa.RecordBatch) -> dict:
        last: dict[int, tuple[str, np.ndarray]] = {}

        def hashes(side: int, text: str) -> np.ndarray:
            if side not in last or last[side][0] != text:
                last[side] = (text, shingle_hashes(text))
            return last[side][1]

        linked = []
        for x, y in zip(batch.column("text_a"), batch.column("text_b"), strict=True):
            p, q = hashes(0, x.as_py()), hashes(1, y.as_py())
            both = len(np.intersect1d(p, q, assume_unique=True))
            linked.append(100 * both >= percent * (len(p) + len(q) - both))
        return {c: batch.column(c).filter(pa.array(linked)) for c in ("a", "b")}

    return verify


_PAIR = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def components(links: DataFrame) -> DataFrame:
    """(node, component) for every node of the links (a, b): the smallest node it is connected to.

    Each round every node moves to its smallest neighbour and the links are rewritten between the new nodes, so paths
    shrink by more than half; nothing leaves Spark but the number of links left.
    """
    links = materialize(links.where("a <> b").distinct())
    moved = links.select(F.col("a").alias("node"), F.col("a").alias("component")).union(links.select("b", "b")).distinct()
    while not links.isEmpty():
        both = links.select("a", "b").union(links.select("b", "a"))
        to = materialize(both.groupBy(F.col("a").alias("_from")).agg(F.least(F.min("b"), F.col("a")).alias("_to")))
        step = moved.join(to, moved["component"] == to["_from"], "left")
        moved = materialize(step.select("node", F.coalesce("_to", "component").alias("component")))
        left = links.join(to, links["a"] == to["_from"]).select(F.col("_to").alias("a"), "b")
        links = left.join(to, left["b"] == to["_from"]).select("a", F.col("_to").alias("b")).where("a <> b")
        links = materialize(links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    return moved


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 75
) -> DataFrame:
    """One row per row of docs: doc_id, n_shingles, component_id, kept.

    The set of a document is its distinct five-word shingles, A-Z in lower case, words split at ASCII white space; with
    fewer words it is the whole sequence, without words (or null) it is empty and linked with nothing. Documents with
    100 * intersection >= percent * union are linked; component_id is the smallest doc_id reachable; kept is doc_id =
    component_id. Documents with equal sets count as one; repeated rows get equal results. No rows give no rows. Rows
    without doc_id stand alone with component_id null and are kept. Other columns are not read.
    """
    whole = materialize(sketches(docs, id_col, text_col))
    known = whole.where("doc_id IS NOT NULL AND n_shingles > 0")
    heads = known.groupBy("set_key").agg(F.min(F.struct("doc_id", "text_key", "n_shingles", "registers")).alias("_head"))
    heads = materialize(heads.select("set_key", "_head.*", F.monotonically_increasing_id().alias("node")))
    links = _links(docs, heads, id_col, text_col, percent)
    member = known.select("doc_id", "set_key").join(heads.select("set_key", "node"), "set_key").select("doc_id", "node").distinct()
    # a doc_id that repeats with another text joins the classes of its texts
    repeats = member.groupBy("doc_id").agg(F.min("node").alias("a"), F.max("node").alias("b")).where("a <> b")
    repeats = member.join(repeats.select("doc_id", "a"), "doc_id").select("a", F.col("node").alias("b"))
    joined = components(links.union(repeats))
    placed = member.join(joined, "node", "left").select("doc_id", F.coalesce("component", "node").alias("_class"))
    smallest = placed.groupBy("_class").agg(F.min("doc_id").alias("component_id"))
    answer = placed.join(smallest, "_class").select(F.col("doc_id").alias("_id"), "component_id").distinct()
    out = whole.join(answer, whole["doc_id"] == answer["_id"], "left")
    found = F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", "n_shingles", found.alias("component_id"), found.eqNullSafe(F.col("doc_id")).alias("kept"))


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 75) -> DataFrame:
    """The rows of docs that are kept, with all their columns."""
    kept = near_duplicates(docs, id_col, text_col, percent).where("kept").select(F.col("doc_id").alias("_kept_id")).distinct()
    rows = docs.select(F.struct("*").alias("doc"), F.col(f"`{id_col}`").cast("bigint").alias("_id"))
    return rows.join(kept, F.col("_id").eqNullSafe(F.col("_kept_id")), "left_semi").select("doc.*")


def _links(docs: DataFrame, heads: DataFrame, id_col: str, text_col: str, percent: int) -> DataFrame:
    """Verified links (a, b) between nodes, one node for each set; enough of them to connect every component."""
    banded = heads.mapInArrow(_batches(_band_batch, _BANDED), "node bigint, n_shingles bigint, band bigint")
    shared = banded.groupBy("band").agg(F.count(F.lit(1)).alias("_n"), F.min(F.struct("node", "n_shingles")).alias("centre")).where("_n > 1")
    live = materialize(banded.join(shared.select("band", "centre"), "band").select(
        "band", "node", "n_shingles", F.col("centre.node").alias("centre"), F.col("centre.n_shingles").alias("n_centre")
    ))
    wanted = materialize(heads.join(live.select("node").distinct(), "node", "left_semi").select("node", "doc_id", "text_key", "registers"))
    texts = _texts(docs, id_col, text_col).join(wanted.select("node", "doc_id", "text_key"), ["doc_id", "text_key"])
    texts = materialize(texts.dropDuplicates(["doc_id", "text_key"]).select("node", "text"))
    fits = 100 * F.least("n_shingles", "n_centre") >= percent * F.greatest("n_shingles", "n_centre")
    rest = live.where(F.col("node") != F.col("centre"))
    pairs = rest.where(fits).select(F.col("centre").alias("a"), F.col("node").alias("b"), F.col("n_centre").alias("n_a"), F.col("n_shingles").alias("n_b")).distinct()
    links = materialize(_checked(_likely(pairs, wanted, percent), texts, percent))
    placed = rest.join(components(links), "node", "left").select("band", "node", "n_shingles", F.coalesce("component", "node").alias("component"))
    mixed = placed.groupBy("band").agg(F.min("component").alias("_p"), F.max("component").alias("_q")).where("_p <> _q")
    left = materialize(placed.join(mixed, "band", "left_semi").select("node", "n_shingles", "component").distinct())
    return links.union(materialize(_checked(_prefix_pairs(left, texts, percent), texts, percent)))


def _prefix_pairs(left: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """All pairs (a, b) of nodes of different components that may be linked, by their rarest shingles.

    Shingles are ordered by the number of nodes that hold them. Linked sets share one of the first n - percent n + 1 of
    either, and of the shorter one even of the first n - least + 1, where `least` is what a link to a set of equal size
    shares. If the first one they share stands at places i and j, they share 1 + min(n_a - i, n_b - j) at most (places from
    1), so variants of one text with many shingles of their own do not meet. Pairs within the largest component of a
    shingle's nodes are not formed.
    """
    held = materialize(texts.join(left.select("node"), "node", "left_semi").mapInArrow(_exploded, "node bigint, shingle bigint"))
    common = held.groupBy("shingle").agg(F.count(F.lit(1)).alias("_in")).where("_in > 1")
    shared = held.join(common, "shingle").join(left, "node")
    place = Window.partitionBy("node").orderBy("_in", "shingle")
    ranked = shared.withColumn("_k", F.row_number().over(place)).withColumn("_shared", F.count(F.lit(1)).over(Window.partitionBy("node")))
    ranked = ranked.withColumn("place", F.col("_k") + F.col("n_shingles") - F.col("_shared"))
    size, least = F.col("n_shingles"), F.ceil(2 * percent * F.col("n_shingles") / (100 + percent))
    first = ranked.where(F.col("place") <= size - F.ceil(size * percent / 100) + 1)
    first = materialize(first.select("shingle", "node", "n_shingles", "component", "place", (F.col("place") <= size - least + 1).alias("early")))
    largest = first.groupBy("shingle", "component").agg(F.count(F.lit(1)).alias("_n"))
    largest = largest.groupBy("shingle").agg(F.max_by("component", F.struct("_n", "component")).alias("_largest"))
    x = first.join(largest, "shingle").where(F.col("component") != F.col("_largest")).drop("_largest").alias("x")
    y = first.alias("y")
    shorter = F.struct("x.n_shingles", "x.node") < F.struct("y.n_shingles", "y.node")
    most = 1 + F.least(F.col("x.n_shingles") - F.col("x.place"), F.col("y.n_shingles") - F.col("y.place"))
    meets = (
        (F.col("x.shingle") == F.col("y.shingle")) & (F.col("x.component") != F.col("y.component"))
        & F.when(shorter, F.col("x.early")).otherwise(F.col("y.early"))
        & ((100 + percent) * most >= percent * (F.col("x.n_shingles") + F.col("y.n_shingles")))
    )
    return x.join(y, meets).select(F.least("x.node", "y.node").alias("a"), F.greatest("x.node", "y.node").alias("b")).distinct()


def _exploded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for every shingle of every text."""
    for batch in batches:
        for node, text in zip(batch.column("node").to_pylist(), batch.column("text"), strict=True):
            hashes = shingle_hashes(text.as_py()).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(hashes), node)), pa.array(hashes)], ["node", "shingle"])


def _likely(pairs: DataFrame, registers: DataFrame, percent: int) -> DataFrame:
    """The pairs whose sketches do not rule a link out."""
    for side in ("a", "b"):
        pairs = pairs.join(registers.select(F.col("node").alias(side), F.col("registers").alias(f"reg_{side}")), side)
    return pairs.mapInArrow(_batches(_near_batch(percent / 100), _PAIR), "a bigint, b bigint")


def _checked(pairs: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """The pairs that are linked, by their full sets."""
    for side in ("a", "b"):
        pairs = pairs.join(texts.select(F.col("node").alias(side), F.col("text").alias(f"text_{side}")), side)
    return pairs.mapInArrow(_batches(_verify_batch(percent), _PAIR), "a bigint, b bigint")
