"""Whole maps (one cell, one chromosome) inside tasks, without a task or a call for each of them.

Pixels are shuffled once, by map, and sorted; tasks read them in batches and work on all complete maps of a batch at once. What
a stencil spreads over neighbouring bins is summed there and never shuffled. Packed maps are one row per map: cell_id,
chrom_ord and the arrays bin1, bin2, value. The genome and the resolution bound a map.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAP = ["cell_id", "chrom_ord"]
PACKED = "cell_id LONG, chrom_ord INT, bin1 ARRAY<LONG>, bin2 ARRAY<LONG>, value ARRAY<DOUBLE>"
PIXELS = "cell_id LONG, chrom_ord INT, bin1 LONG, bin2 LONG, value DOUBLE"
STACK = 1 << 19  # numbers of dense maps that are worked on at once
_DENSE = 16  # maps with more than one target in so many bin pairs are summed in full


def complete(batches: Iterator[pa.RecordBatch]) -> Iterator[list[np.ndarray]]:
    """Columns of complete maps (rows alike in the first two columns) from batches sorted by map; a map that a batch cuts waits
    for its rest."""
    held: list[list[np.ndarray]] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
        same = (columns[0] == columns[0][-1]) & (columns[1] == columns[1][-1])
        cut = batch.num_rows - int(same.sum())
        if cut:
            yield [np.concatenate(parts) for parts in zip(*held, [c[:cut] for c in columns], strict=True)]
            held = []
        held.append([c[cut:] for c in columns])
    if held:
        yield [np.concatenate(parts) for parts in zip(*held, strict=True)]


def by_map(pixels: DataFrame, run: Callable[..., Iterator[pa.RecordBatch]], schema: str, extra: Sequence[Column] = ()) -> DataFrame:
    """run(starts, cell_id, chrom_ord, bin1, bin2, value, *extra) for the complete maps of every batch; `starts` are the
    places where maps begin. Pixels without a cell or a value do not count."""
    placed = pixels.where(F.col("cell_id").isNotNull() & F.col("value").isNotNull()).select(
        F.col("cell_id").cast("long").alias("cell_id"), F.col("chrom_ord").cast("int").alias("chrom_ord"),
        F.col("bin1").cast("long").alias("bin1"), F.col("bin2").cast("long").alias("bin2"),
        F.col("value").cast("double").alias("value"), *extra,
    )

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for columns in complete(batches):
            cell, chrom = columns[0], columns[1]
            starts = np.flatnonzero(np.r_[True, (cell[1:] != cell[:-1]) | (chrom[1:] != chrom[:-1])])
            yield from run(starts, *columns)

    return placed.repartition(*MAP).sortWithinPartitions(*MAP).mapInArrow(stream, schema)


def pixel_batch(*columns: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=[*MAP, "bin1", "bin2", "value"])


def stacks(
    starts: np.ndarray, sizes: np.ndarray, bin1: np.ndarray, bin2: np.ndarray, value: np.ndarray
) -> Iterator[tuple[np.ndarray, int, np.ndarray]]:
    """(map numbers, n, dense maps) for maps of the same size n at a time; equal places add up."""
    number = _numbers(starts, len(value))
    for n in np.unique(sizes).tolist():
        same, step = np.flatnonzero(sizes == n), max(1, STACK // (n * n))
        for part in (same[a : a + step] for a in range(0, len(same), step)):
            place = np.full(len(starts), -1)
            place[part] = np.arange(len(part))
            held = place[number] >= 0
            code = (place[number][held] * n + bin1[held]) * n + bin2[held]
            yield part, n, np.bincount(code, value[held], len(part) * n * n).reshape(len(part), n, n)


def _spread(
    number: np.ndarray, bin1: np.ndarray, bin2: np.ndarray, value: np.ndarray, n: np.ndarray,
    center: float, side: float, mirrored: bool, upper: bool,
) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(map number, bin1, bin2, value) under a 3x3 separable filter, in this order; places that no pixel reaches are absent.

    number: the map of each pixel, ascending from 0. Weight beyond the ends is mirrored back or lost. upper: bin1 <= bin2 only.
    """
    width = int(n.max())

    def taps(bins: np.ndarray, step: int) -> np.ndarray:
        if step:
            return np.full(len(bins), side)
        return center + (side * ((bins == 0).astype(float) + (bins == n - 1)) if mirrored else 0.0)

    codes, weights = [], []
    for i in (-1, 0, 1):
        row, at_row = bin1 + i, taps(bin1, i)
        for j in (-1, 0, 1):
            col = bin2 + j
            inside = (row >= 0) & (row < n) & (col >= 0) & (col < n)
            if upper:
                inside &= row <= col
            codes.append(((number * width + row) * width + col)[inside])
            weights.append((value * at_row * taps(bin2, j))[inside])
    code, weight = np.concatenate(codes), np.concatenate(weights)
    room = (int(number[-1]) + 1) * width * width
    if room <= _DENSE * len(code):
        sums, found = np.bincount(code, weight, room), np.flatnonzero(np.bincount(code, minlength=room))
        sums = sums[found]
    else:
        found, place = np.unique(code, return_inverse=True)
        sums = np.bincount(place, weight, len(found))
    return found // (width * width), found // width % width, found % width, sums


def _numbers(starts: np.ndarray, length: int) -> np.ndarray:
    return np.repeat(np.arange(len(starts)), np.diff(np.r_[starts, length]))


def smoothed(pixels: DataFrame, sizes: Sequence[int], center: float, side: float, tiny: float) -> DataFrame:
    """Packed upper triangles of M + M^T under a mirrored 3x3 filter, divided by their total; pixels are upper-triangle."""
    bins = np.array(sizes)

    def run(starts, cell, chrom, bin1, bin2, value):  # noqa: ANN001, ANN202
        number = _numbers(starts, len(cell))
        n = np.tile(bins[chrom], 2)
        order = np.argsort(np.tile(number, 2), kind="stable")
        both = [np.tile(number, 2)[order], np.r_[bin1, bin2][order], np.r_[bin2, bin1][order], np.tile(value, 2)[order], n[order]]
        owner, row, col, sums = _spread(*both, center, side, True, True)
        sums = sums / (2.0 * np.bincount(number, value) + tiny)[owner]
        offsets = pa.array(np.searchsorted(owner, np.arange(len(starts) + 1)).astype(np.int32))
        lists = [pa.ListArray.from_arrays(offsets, pa.array(x)) for x in (row, col, sums)]
        names = ["cell_id", "chrom_ord", "bin1", "bin2", "value"]
        yield pa.RecordBatch.from_arrays([pa.array(cell[starts]), pa.array(chrom[starts]), *lists], names=names)

    return by_map(pixels, run, PACKED)


def box_sums(maps: DataFrame, n: Column) -> DataFrame:
    """3x3 sums with zeros outside the map of pixels given one by one; `maps` holds both triangles."""

    def run(starts, cell, chrom, bin1, bin2, value, size):  # noqa: ANN001, ANN202
        number = _numbers(starts, len(cell))
        owner, row, col, sums = _spread(number, bin1, bin2, value, size, 1.0, 1.0, False, False)
        yield pixel_batch(cell[starts][owner], chrom[starts][owner], row, col, sums)

    return by_map(maps, run, PIXELS, [n.cast("long").alias("_n")])


def entries_of(packed: DataFrame) -> DataFrame:
    """Packed maps as pixels."""
    return packed.select(*MAP, F.inline(F.arrays_zip("bin1", "bin2", "value")))
