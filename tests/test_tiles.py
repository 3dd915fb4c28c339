"""Decompositions in tiles against dense NumPy arithmetic."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from contactmill.operators import linalg, tiles


def table(spark, parts):
    rows = [(p, int(i), int(j) * 7, float(m[i, j])) for p, m in enumerate(parts) for i, j in zip(*np.nonzero(m))]
    entries = spark.createDataFrame(rows, "part LONG, row LONG, col LONG, value DOUBLE").repartition(3)
    listed = spark.createDataFrame([(p, i) for p, m in enumerate(parts) for i in range(len(m))], "part LONG, row LONG")
    return entries, listed


def gathered(scores, part):
    rows = sorted((r["row"], r["scores"]) for r in scores.where(F.col("part") == part).collect())
    return np.array([s for _, s in rows])


def same_up_to_sign(got, want):
    sign = np.sign((got * want).sum(axis=0))
    assert got.shape == want.shape
    assert np.allclose(got * sign, want, atol=1e-8 * np.abs(want).max())


def dense_scores(m, rank, center, fit=None):
    used = m if fit is None else m[fit]
    if center:
        used = used - used.mean(axis=0)
    v = np.linalg.svd(used, full_matrices=False)[2][:rank].T
    out = m @ v
    return out - out.mean(axis=0) if center else out


@pytest.mark.parametrize("center", [False, True])
def test_parts_of_own_ranks(spark, monkeypatch, center):
    """Small tiles, a part per rank, an empty row, rows that are not fitted on."""
    monkeypatch.setattr(tiles, "ROWS", 7)
    monkeypatch.setattr(tiles, "COLUMNS", 5)
    rng = np.random.default_rng(1)
    parts = [rng.normal(size=shape) * (rng.random(shape) < 0.4) for shape in ((24, 12), (24, 9))]
    parts[0][3] = 0.0
    entries, rows = table(spark, parts)
    scores = linalg.randomized_svd(entries, rows, {0: 4, 1: 2}, center=center)
    for p, rank in ((0, 4), (1, 2)):
        same_up_to_sign(gathered(scores, p), dense_scores(parts[p], rank, center))
    if not center:
        fit = np.arange(24) % 4 != 0
        fitted = linalg.randomized_svd(entries, rows, 3, rows.where("row % 4 != 0"))
        same_up_to_sign(gathered(fitted, 0), dense_scores(parts[0], 3, False, fit))


def test_wide_rows_need_no_covariance(spark):
    """62,000 columns: a number of components, and a share of the variance."""
    rng = np.random.default_rng(2)
    m = np.zeros((30, 62_000))
    spots = rng.choice(62_000, 4000, replace=False)
    m[:, spots] = rng.normal(size=(30, 4000)) * (rng.random((30, 4000)) < 0.2)
    entries, rows = table(spark, [m])
    same_up_to_sign(gathered(tiles.components(entries, rows, 6), 0), dense_scores(m, 6, True))
    values = np.linalg.svd(m - m.mean(axis=0), compute_uv=False) ** 2
    wanted = int(np.searchsorted(np.cumsum(values) / values.sum(), 0.5, side="right")) + 1
    same_up_to_sign(gathered(tiles.components(entries, rows, 0.5), 0), dense_scores(m, wanted, True))


@pytest.mark.parametrize("center", [False, True])
def test_few_columns_need_no_rounds(spark, monkeypatch, center):
    """exact components without tiles, from rows that batches cut, rows without entries, unlisted rows, added places."""
    monkeypatch.setattr(tiles, "tiled", None)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "5")
    try:
        rng = np.random.default_rng(4)
        parts = [rng.normal(size=(40, 30)) * (rng.random((40, 30)) < 0.5), rng.normal(size=(40, 6)), np.zeros((40, 3))]
        parts[0][3] = parts[1][7] = 0.0
        entries, rows = table(spark, parts)
        halves = entries.withColumn("value", F.col("value") / 2)
        other = spark.createDataFrame([(0, 99, 7, 5.0), (5, 0, 0, 1.0)], entries.schema)
        fit = np.arange(40) % 4 != 0
        scores = linalg.randomized_svd(halves.union(halves).union(other), rows, {0: 8, 1: 9, 2: 2}, center=center)
        for p, rank in ((0, 8), (1, 6)):
            same_up_to_sign(gathered(scores, p), dense_scores(parts[p], rank, center))
        assert gathered(scores, 2).tolist() == [[0.0, 0.0]] * 40
        fitted = linalg.randomized_svd(entries, rows, 3, rows.where("row % 4 != 0"), center=center)
        same_up_to_sign(gathered(fitted, 0), dense_scores(parts[0], 3, center, fit))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_tiles_where_columns_are_many(spark, monkeypatch):
    monkeypatch.setattr(tiles, "SMALL_GRAMS", 0)
    test_parts_of_own_ranks(spark, monkeypatch, True)
