"""Sparse matrices in tiles, their products with thin matrices, and truncated decompositions built on these products.

A matrix (one per `part`) is cut by hashes of its row and column ids into tiles of about ROWS x COLUMNS. A thin matrix (few
values per row or per column) is a table of blocks: part, block, ids, x (row after row, flat). A product meets tile and
block once and multiplies them in the task; what is shuffled is one partial block per tile, not one array per stored entry.
Parts have thin matrices of their own widths. Only Gram matrices (width x width) reach the driver.

Centring is a rank-one correction of the thin side: (A - 1 m') X = A X - 1 (m' X), and the mean of the rows of A X is m' X.
So nothing is ever filled in, and the number of columns is not limited.

Parts with few columns need neither tiles nor iterations: rows are shuffled once, and the Gram matrices of all columns
(`SMALL_GRAMS` bytes at most) give the right singular vectors exactly.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from contactmill.functions.vectors import array_sum
from contactmill.operators import cellmaps
from contactmill.session import materialize

ROWS, COLUMNS = 4096, 2048
MAX_GRAM_BYTES = 2 << 30
SMALL_GRAMS = 64 << 20  # bytes of the Gram matrices of all columns, up to which a task may hold them
DIRECTIONS = 256  # of a principal component analysis, at least
_DENSE = 30  # tiles with more than one entry in so many are multiplied as dense ones
THIN = "part LONG, block LONG, ids ARRAY<LONG>, x ARRAY<DOUBLE>"


def check_gram_size(groups: int, width: int) -> None:
    """Refuse component counts whose Gram matrices the driver cannot hold."""
    if groups * width * width * 8 > MAX_GRAM_BYTES:
        raise ValueError(f"{groups} Gram matrices of width {width} exceed {MAX_GRAM_BYTES} bytes; use fewer components")


@dataclass
class Tiled:
    """tiles: part, rb, cb, r, c (places inside the blocks), v. row_blocks, column_blocks: part, block, ids (sorted).

    n_rows, n_columns: per part.
    """

    tiles: DataFrame
    row_blocks: DataFrame
    column_blocks: DataFrame
    n_rows: dict[int, int]
    n_columns: dict[int, int]


def _counts(table: DataFrame) -> dict[int, int]:
    return {r["part"]: r["n"] for r in table.groupBy("part").agg(F.count(F.lit(1)).alias("n")).collect()}  # one row a part


def _block(id_column: str, counts: dict[int, int], size: int) -> Column:
    """The block of an id: a hash over as many blocks as the part needs."""
    if not counts:
        return F.lit(0).cast("long")
    pairs = [F.lit(x) for part, n in counts.items() for x in (part, -(-n // size))]
    return F.pmod(F.xxhash64(id_column), F.element_at(F.create_map(*pairs), F.col("part"))).cast("long")


def _rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    """Row by row, arrays as NumPy arrays without copies."""
    for batch in batches:
        columns = dict(zip(batch.schema.names, batch.columns, strict=True))
        for i in range(batch.num_rows):
            yield {
                n: c[i].values.to_numpy(zero_copy_only=False) if pa.types.is_list(c.type) else c[i].as_py()
                for n, c in columns.items()
            }


def _record(values: dict) -> pa.RecordBatch:
    kinds = {np.dtype("int64"): pa.int64(), np.dtype("int32"): pa.int32(), np.dtype("float64"): pa.float64()}
    arrays = [
        pa.array([v], pa.list_(kinds[v.dtype])) if isinstance(v, np.ndarray) else pa.array([v], pa.int64()) for v in values.values()
    ]
    return pa.RecordBatch.from_arrays(arrays, names=list(values))


def tiled(entries: DataFrame, rows: DataFrame, columns: DataFrame | None = None) -> Tiled:
    """entries: part, row, col, value (equal places add up); rows: part, row, for every row there is; columns: the distinct part, col."""
    if columns is None:
        columns = materialize(entries.select("part", "col").distinct())
    n_rows, n_columns = _counts(rows), _counts(columns)

    def blocks(table: DataFrame, name: str, counts: dict[int, int], size: int) -> DataFrame:
        ids = F.array_sort(F.collect_list(name)).alias("ids")  # about `size`
        return materialize(table.groupBy("part", _block(name, counts, size).alias("block")).agg(ids))

    row_blocks = blocks(rows, "row", n_rows, ROWS)
    column_blocks = blocks(columns, "col", n_columns, COLUMNS)
    placed = entries.where(F.col("part").isin(list(n_rows))).select(
        "part", _block("row", n_rows, ROWS).alias("rb"), _block("col", n_columns, COLUMNS).alias("cb"), "row", "col", "value"
    )
    gathered = placed.groupBy("part", "rb", "cb").agg(F.collect_list(F.struct("row", "col", "value")).alias("e")).select(
        "part", "rb", "cb", F.col("e.row").alias("row"), F.col("e.col").alias("col"), F.col("e.value").alias("v")
    )
    known = gathered.join(row_blocks.toDF("part", "rb", "row_ids"), ["part", "rb"]).join(
        column_blocks.toDF("part", "cb", "col_ids"), ["part", "cb"]
    )

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _rows_of(batches):
            at_row, at_col = np.searchsorted(t["row_ids"], t["row"]), np.searchsorted(t["col_ids"], t["col"])
            held = np.minimum(at_row, len(t["row_ids"]) - 1)
            listed = t["row_ids"][held] == t["row"]  # entries of rows that are not asked for
            yield _record({
                "part": t["part"], "rb": t["rb"], "cb": t["cb"], "r": at_row[listed].astype(np.int32),
                "c": at_col[listed].astype(np.int32), "v": t["v"][listed],
            })

    shape = "part LONG, rb LONG, cb LONG, r ARRAY<INT>, c ARRAY<INT>, v ARRAY<DOUBLE>"
    return Tiled(materialize(known.mapInArrow(local, shape)), row_blocks, column_blocks, n_rows, n_columns)


def _product(r: np.ndarray, c: np.ndarray, v: np.ndarray, height: int, x: np.ndarray) -> np.ndarray:
    """The tile with entries v at (r, c) times x."""
    if len(r) * _DENSE > height * len(x):
        dense = np.bincount(r.astype(np.int64) * len(x) + c, weights=v, minlength=height * len(x))
        return dense.reshape(height, len(x)) @ x
    out = np.zeros((height, x.shape[1]))
    for a in range(0, len(r), 8192):
        part = slice(a, a + 8192)
        np.add.at(out, r[part], v[part, None] * x[c[part]])
    return out


def _times(matrix: Tiled, thin: DataFrame, transposed: bool) -> DataFrame:
    """A X for blocks X of the columns, or A^T X for blocks of the rows, as blocks of the other side."""
    near, far, own, other = ("rb", "cb", "r", "c") if transposed else ("cb", "rb", "c", "r")
    blocks = matrix.column_blocks if transposed else matrix.row_blocks
    joined = matrix.tiles.join(thin.select("part", F.col("block").alias(near), "x", F.size("ids").alias("height")), ["part", near])
    sizes = blocks.select("part", F.col("block").alias(far), F.size("ids").alias("out"))
    joined = joined.join(sizes, ["part", far]).select("part", far, own, other, "v", "x", "height", "out")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _rows_of(batches):
            y = _product(t[other], t[own], t["v"], t["out"], t["x"].reshape(t["height"], -1))
            yield _record({"part": t["part"], "block": t[far], "x": y.reshape(-1)})

    parts = joined.mapInArrow(run, "part LONG, block LONG, x ARRAY<DOUBLE>")
    sums = parts.groupBy("part", "block").agg(array_sum(F.col("x")).alias("x"))
    return blocks.join(sums, ["part", "block"], "left")  # a block without entries has no x


def _changed(thin: DataFrame, change: Callable[[int, np.ndarray, np.ndarray], np.ndarray], widths: dict[int, int]) -> DataFrame:
    """Each block's matrix x replaced by change(part, ids, x); x is zero where the block has none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                part, block = batch.column(0)[i].as_py(), batch.column(1)[i].as_py()
                ids, x = batch.column(2)[i].values.to_numpy(), batch.column(3)[i]
                matrix = x.values.to_numpy().reshape(len(ids), -1) if x.is_valid else np.zeros((len(ids), widths[part]))
                yield _record({"part": part, "block": block, "ids": ids, "x": change(part, ids, matrix).reshape(-1)})

    return thin.select("part", "block", "ids", "x").mapInArrow(run, THIN)


def _sums(thin: DataFrame, of: Callable[[np.ndarray], np.ndarray]) -> dict[int, np.ndarray]:
    """Per part the sum of of(block) over all blocks; one partial per task and part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, np.ndarray] = {}
        for t in _rows_of(batches):
            value = of(t["x"].reshape(len(t["ids"]), -1))
            found[t["part"]] = found.get(t["part"], 0.0) + value
        for part, value in found.items():
            yield from (_record({"part": part, "row": i, "x": row}) for i, row in enumerate(np.atleast_2d(value)))

    return _collected(thin.mapInArrow(run, _PARTIAL))


_PARTIAL = "part LONG, row LONG, x ARRAY<DOUBLE>"


def _collected(partials: DataFrame) -> dict[int, np.ndarray]:
    """Per part the sum of matrices given row by row."""
    found: dict[int, dict[int, list[float]]] = {}
    for r in partials.groupBy("part", "row").agg(array_sum(F.col("x")).alias("x")).collect():  # `width` rows a part
        found.setdefault(r["part"], {})[r["row"]] = r["x"]
    return {p: np.array([m[i] for i in sorted(m)]) for p, m in found.items()}


def _gram(x: np.ndarray) -> np.ndarray:
    return x.T @ x


def _orthonormalizer(g: np.ndarray) -> np.ndarray:
    """W with (Y W)^T (Y W) = I on the range of Y, given Y^T Y; zero columns where Y has no direction left."""
    values, vectors = np.linalg.eigh((g + g.T) / 2)
    good = values > max(values.max(), 0.0) * 1e-13
    inv = np.where(good, 1.0 / np.sqrt(np.where(good, values, 1.0)), 0.0)
    return vectors * inv


_CHUNK = "part LONG, ids ARRAY<LONG>, fit ARRAY<INT>, r ARRAY<INT>, c ARRAY<INT>, v ARRAY<DOUBLE>"


def _chunks(entries: DataFrame, rows: DataFrame, fit_rows: DataFrame | None, columns: dict[int, np.ndarray]) -> DataFrame:
    """Some whole rows of a part each: their ids, whether the fit sees them, and their entries at (r, c).

    A listed row travels along as an entry without a value, so rows without entries stay and others go, without a join.
    """
    listed = rows.withColumn("mark", F.lit(1))
    if fit_rows is not None:
        listed = rows.join(fit_rows.withColumn("mark", F.lit(1)), ["part", "row"], "left").fillna(0, ["mark"])
    marks = listed.select("part", "row", F.lit(0).cast("long").alias("col"), F.lit(0.0).alias("value"), "mark")
    both = entries.withColumn("mark", F.lit(-1)).unionByName(marks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, row, col, value, mark in cellmaps.complete(batches):
            starts = np.flatnonzero(np.r_[True, (part[1:] != part[:-1]) | (row[1:] != row[:-1])])
            number = np.repeat(np.arange(len(starts)), np.diff(np.r_[starts, len(part)]))
            fit, owner = np.maximum.reduceat(mark, starts), part[starts]
            for p in np.unique(owner):
                own = np.flatnonzero((owner == p) & (fit >= 0))
                if not len(own):
                    continue
                place = np.full(len(starts), -1)
                place[own] = np.arange(len(own))
                held = (mark < 0) & (place[number] >= 0)
                yield _record({
                    "part": int(p), "ids": row[starts][own], "fit": fit[own].astype(np.int32),
                    "r": place[number][held].astype(np.int32),
                    "c": np.searchsorted(columns.get(int(p), np.empty(0, np.int64)), col[held]).astype(np.int32), "v": value[held],
                })

    return both.repartition("part", "row").sortWithinPartitions("part", "row").mapInArrow(run, _CHUNK)


def _small_svd(
    entries: DataFrame, rows: DataFrame, ranks: dict[int, int], columns: dict[int, np.ndarray],
    fit_rows: DataFrame | None, center: bool, spectrum: dict[int, np.ndarray] | None,
) -> DataFrame:
    """Scores by the eigenvectors of the whole Gram matrix of each part: one shuffle of the entries, two passes over the rows."""
    chunks = materialize(_chunks(entries, rows, fit_rows, columns))
    widths = {p: len(columns.get(p, ())) for p in ranks}

    def dense(t: dict) -> np.ndarray:
        height, width = len(t["ids"]), widths[t["part"]]
        place = t["r"].astype(np.int64) * width + t["c"]
        return np.bincount(place, weights=t["v"], minlength=height * width).reshape(height, width)

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Gram matrices of rows with a one behind; the last row has the sums over all rows, fitted on or not."""
        found: dict[int, np.ndarray] = {}
        for t in _rows_of(batches):
            x = np.pad(dense(t), ((0, 0), (0, 1)), constant_values=1.0)
            fitted = x[t["fit"] > 0]
            found[t["part"]] = found.get(t["part"], 0.0) + np.vstack([fitted.T @ fitted, x.sum(axis=0)])
        for part, value in found.items():
            yield from (_record({"part": part, "row": i, "x": row}) for i, row in enumerate(value))

    turn, means = {}, {}
    for p, sums in _collected(chunks.mapInArrow(partial, _PARTIAL)).items():
        if not widths[p]:
            continue
        g, fit_sums, n_fit = sums[:-2, :-1], sums[-2, :-1], sums[-2, -1]
        if center:
            g = g - np.outer(fit_sums, fit_sums) / max(1.0, n_fit)
        values, vectors = np.linalg.eigh((g + g.T) / 2)
        order = np.argsort(values)[::-1][: ranks[p]]
        turn[p] = np.where(values[order] > max(values.max(), 0.0) * 1e-13, vectors[:, order], 0.0)
        means[p] = sums[-1, :-1] @ turn[p] / sums[-1, -1] if center else 0.0
        if spectrum is not None:
            spectrum[p] = np.sqrt(np.maximum(values[order], 0.0))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _rows_of(batches):
            p, n = t["part"], len(t["ids"])
            y = dense(t) @ turn[p] - means[p] if p in turn else np.zeros((n, ranks[p]))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * y.shape[1]), pa.array(y.reshape(-1)))
            yield pa.RecordBatch.from_arrays([pa.array(np.full(n, p)), pa.array(t["ids"]), lists], names=["part", "row", "scores"])

    return chunks.mapInArrow(score, "part LONG, row LONG, scores ARRAY<DOUBLE>")


def randomized_svd(
    entries: DataFrame,
    rows: DataFrame,
    rank: int | dict[int, int],
    fit_rows: DataFrame | None = None,
    center: bool = False,
    oversample: int = 10,
    n_iter: int = 2,
    spectrum: dict[int, np.ndarray] | None = None,
    stored: bool = False,
) -> DataFrame:
    """Scores A V of truncated singular value decompositions, one per `part`, computed together.

    While the Gram matrices of all columns are small, V comes from these and is exact; oversample and n_iter do not count
    then. entries: part, row, col, value (sparse). rows: part, row for every row to report. rank: wanted components, the same for
    all parts or one number a part; a part has at most as many as it has rows or columns. fit_rows: the rows V is fitted on
    (all when absent). center: subtract column means, as a principal component analysis does. Result: part, row, scores (by
    falling singular value). A dict given as `spectrum` receives the singular values per part. Entries are read several times:
    they are written once, unless they are a table already (`stored`).
    """
    rows = rows.select(F.col("part").cast("long").alias("part"), F.col("row").cast("long").alias("row"))
    entries = entries.select(
        F.col("part").cast("long").alias("part"), F.col("row").cast("long").alias("row"),
        F.col("col").cast("long").alias("col"), F.col("value").cast("double").alias("value"),
    )
    entries = entries if stored else materialize(entries)
    columns = materialize(entries.select("part", "col").distinct())
    n_rows, n_columns = _counts(rows), _counts(columns)
    ranks = {p: max(1, min(rank[p] if isinstance(rank, dict) else rank, n, n_columns.get(p, 0) or n)) for p, n in n_rows.items()}
    if sum(8 * (n + 2) ** 2 for n in n_columns.values()) <= SMALL_GRAMS:
        ids: dict[int, list[int]] = {}
        for r in columns.where(F.col("part").isin(list(n_rows))).collect():  # few: their Gram matrices are small
            ids.setdefault(r["part"], []).append(r["col"])
        fit = None if fit_rows is None else fit_rows.select(F.col("part").cast("long").alias("part"), "row").distinct()
        return _small_svd(entries, rows, ranks, {p: np.sort(np.array(c)) for p, c in ids.items()}, fit, center, spectrum)
    matrix = tiled(entries, rows, columns)
    widths = {p: min(ranks[p] + oversample, max(ranks[p], min(matrix.n_rows[p], matrix.n_columns.get(p, 0)))) for p in ranks}
    check_gram_size(len(widths), max(widths.values(), default=1))
    fitted = None
    if fit_rows is not None:
        listed = fit_rows.select(F.col("part").cast("long").alias("part"), "row").distinct()
        marked = listed.withColumn("block", _block("row", matrix.n_rows, ROWS)).groupBy("part", "block")
        fitted = materialize(marked.agg(F.array_sort(F.collect_list("row")).alias("fit")))
    n_fit = matrix.n_rows if fit_rows is None else _counts(listed)

    def prepared(y: DataFrame) -> DataFrame:
        """Row blocks centred, without the rows that are not fitted on."""
        filled = _changed(y, lambda part, ids, x: x, widths) if fitted is None else _only(y)
        if not center:
            return filled
        filled = materialize(filled)
        means = {p: s[0] / max(1, n_fit.get(p, 0)) for p, s in _sums(filled, lambda x: x.sum(axis=0)).items()}
        centred = _changed(filled, lambda part, ids, x: x - means[part], widths)
        return centred if fitted is None else _only(centred)

    def _only(y: DataFrame) -> DataFrame:
        """Rows that are not fitted on become zero."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for i in range(batch.num_rows):
                    part, block = batch.column(0)[i].as_py(), batch.column(1)[i].as_py()
                    ids, x, fit = batch.column(2)[i].values.to_numpy(), batch.column(3)[i], batch.column(4)[i]
                    rows_ = np.isin(ids, fit.values.to_numpy()) if fit.is_valid else np.zeros(len(ids), bool)
                    y_ = x.values.to_numpy().reshape(len(ids), -1) if x.is_valid else np.zeros((len(ids), widths[part]))
                    yield _record({"part": part, "block": block, "ids": ids, "x": np.where(rows_[:, None], y_, 0.0).reshape(-1)})

        return y.join(fitted, ["part", "block"], "left").select("part", "block", "ids", "x", "fit").mapInArrow(run, THIN)

    def orthonormal(y: DataFrame) -> DataFrame:
        y = materialize(prepared(y))
        turn = {p: _orthonormalizer(g) for p, g in _sums(y, _gram).items()}
        return _changed(y, lambda part, ids, x: x @ turn[part], widths)

    def drawn(part: int, ids: np.ndarray, x: np.ndarray) -> np.ndarray:
        """Gaussian rows that follow from part and first id, so every attempt draws the same."""
        draws = np.random.Generator(np.random.Philox(key=[part & (2**63 - 1), int(ids[0]) & (2**63 - 1)]))
        return draws.normal(size=(len(ids), widths[part]))

    def columns_of(q: DataFrame) -> DataFrame:
        """A^T Q, zeros for columns without entries."""
        return _changed(_times(matrix, q, True), lambda part, ids, x: x, widths)

    empty = matrix.column_blocks.withColumn("x", F.lit(None).cast("array<double>"))
    q = orthonormal(_times(matrix, _changed(empty, drawn, widths), False))
    for _ in range(n_iter):
        q = orthonormal(_times(matrix, columns_of(q), False))
    b = materialize(columns_of(q))
    turn = {}
    for p, g in _sums(b, _gram).items():
        values, vectors = np.linalg.eigh((g + g.T) / 2)
        order = np.argsort(values)[::-1][: ranks[p]]
        safe = np.where(values[order] > max(values.max(), 0.0) * 1e-13, values[order], np.inf)
        turn[p] = vectors[:, order] / np.sqrt(safe)
        if spectrum is not None:
            spectrum[p] = np.sqrt(np.maximum(values[order], 0.0))
    v = _changed(b, lambda part, ids, x: x @ turn[part], widths)
    out_widths = dict(ranks)
    scores = _times(matrix, v, False)
    scores = _changed(scores, lambda part, ids, x: x, out_widths)
    if center:
        scores = materialize(scores)
        means = {p: s[0] / matrix.n_rows[p] for p, s in _sums(scores, lambda x: x.sum(axis=0)).items()}
        scores = _changed(scores, lambda part, ids, x: x - means[part], out_widths)
    at = F.posexplode("ids").alias("_at", "row")
    step = (F.size("x") / F.size("ids")).cast("int")
    return scores.select("part", "x", step.alias("_w"), at).select(
        "part", "row", F.slice("x", F.col("_at") * F.col("_w") + 1, F.col("_w")).alias("scores")
    )


def components(entries: DataFrame, rows: DataFrame, keep: int | float) -> DataFrame:
    """Principal component scores (part, row, scores) of sparse matrices with one part: a number of components, or as many
    as exceed a share of the variance. Missing entries are zeros. At least DIRECTIONS directions are followed, so the result
    is exact where rows or columns are no more than these; flat spectra of larger matrices are approximated. The number found
    by share grows by doubling."""
    if isinstance(keep, int):
        return randomized_svd(entries, rows, keep, center=True, oversample=max(10, DIRECTIONS - keep), n_iter=6)
    n = rows.count()
    moments = entries.groupBy("col").agg(F.sum("value").alias("s"), F.sum(F.col("value") * F.col("value")).alias("q"))
    total = moments.agg(F.sum(F.col("q") - F.col("s") * F.col("s") / n)).first()[0] or 0.0
    rank = 32
    while True:
        found: dict[int, np.ndarray] = {}
        scores = randomized_svd(entries, rows, rank, center=True, oversample=max(10, DIRECTIONS - rank), n_iter=6, spectrum=found)
        (values,) = found.values()
        share = np.cumsum(values**2) / total if total > 0 else np.ones(1)
        if share[-1] > keep or len(values) < rank:
            take = min(int(np.searchsorted(share, keep, side="right")) + 1, len(values))
            return scores.withColumn("scores", F.slice("scores", 1, take))
        rank *= 2
