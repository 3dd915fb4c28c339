"""Whole maps inside tasks: results against dense arithmetic, and what is left to shuffle."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from contactmill.genome import Genome
from contactmill import scale
from contactmill.operators import features, maps
from contactmill.operators.binning import symmetrize
from contactmill.operators.pipeline import variable_bin_embedding
from contactmill.session import materialize

GENOME = Genome((("chr1", 700), ("chr2", 400)))


@pytest.fixture(scope="module")
def pixels(spark):
    rng = np.random.default_rng(3)
    seen = {}
    for _ in range(400):
        chrom = int(rng.integers(0, 2))
        a, b = sorted(int(x) for x in rng.integers(0, (7, 4)[chrom], 2))
        seen[(int(rng.integers(0, 9)), chrom, a, b)] = float(rng.integers(1, 5))
    rows = [(*k, v) for k, v in seen.items()]
    return spark.createDataFrame(rows, "cell_id LONG, chrom_ord INT, bin1 LONG, bin2 LONG, value DOUBLE").repartition(3)


def dense(rows, key):
    n = (7, 4)[key[1]]
    m = np.zeros((n, n))
    for r in rows:
        if (r["cell_id"], r["chrom_ord"]) == key:
            m[r["bin1"], r["bin2"]] += r["value"]
    return m


def shuffles_above_tasks(df):
    """Exchanges after the step that works on whole maps (all of them where there is no such step)."""
    return df._jdf.queryExecution().executedPlan().toString().split("MapInArrow")[0].count("Exchange")


def small_batches(spark):
    """Batches that cut maps."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "5")


def test_smoothed_maps(spark, pixels):
    """neighbours' shares are summed where the map is, not shuffled."""
    small_batches(spark)
    try:
        out = features.smoothed_cell_maps(pixels, GENOME, 100)
        got = out.collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    raw, tap = pixels.collect(), np.exp(-0.5) / (1 + 2 * np.exp(-0.5))
    for key in {(r["cell_id"], r["chrom_ord"]) for r in raw}:
        upper = dense(raw, key)
        full = np.pad(upper + upper.T, 1, mode="symmetric")
        n = len(upper)
        rows = sum(w * full[i : i + n] for i, w in enumerate((tap, 1 - 2 * tap, tap)))
        want = sum(w * rows[:, i : i + n] for i, w in enumerate((tap, 1 - 2 * tap, tap)))
        assert np.allclose(dense(got, key), want / want.sum())
    assert len(got) == len({(r["cell_id"], r["chrom_ord"], r["bin1"], r["bin2"]) for r in got})
    assert shuffles_above_tasks(out) == 0


def test_batch_correction_joins_maps_not_pixels(spark, pixels):
    """every map's total is 1 again, and its pixels are made after the joins."""
    cells = spark.range(9).select(F.col("id").alias("cell_id"), (F.col("id") % 2).alias("batch"))
    packed = features.packed_cell_maps(pixels, GENOME, 100)
    coverage = features.batch_coverage(features.smoothed_cell_maps(pixels, GENOME, 100), cells, GENOME, 100)
    out = features.batch_corrected(packed, cells, coverage, features.batch_agreement(coverage), below=1.1)
    sums = {r["s"] for r in out.groupBy("cell_id", "chrom_ord").agg(F.round(F.sum("value"), 9).alias("s")).collect()}
    assert sums == {1.0}
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan[: plan.index("Generate")]


def test_common_features_are_not_shuffled_by_feature(spark, pixels):
    """entries stay where they are while the features are few."""
    entries = features.feature_entries(features.smoothed_cell_maps(pixels, GENOME, 100))
    out = features.common_features(entries, F.lit(9))
    seen = {}
    for r in entries.collect():
        seen.setdefault((r["chrom_ord"], r["bin1"], r["bin2"]), []).append(r["cell_id"])
    assert out.count() == sum(len(c) for c in seen.values() if len(c) > 5)
    assert "SortMergeJoin" not in out._jdf.queryExecution().executedPlan().toString()


def test_random_walk_solves_maps_in_stacks(spark, pixels):
    """one call for many maps; maps of two sizes, cut by batches, as each map alone gives."""
    small_batches(spark)
    try:
        out = features.random_walk_maps(pixels, GENOME, 100, 4)
        got = out.collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    raw = pixels.collect()
    keys = {(r["cell_id"], r["chrom_ord"]) for r in raw}
    for key in keys:
        upper = dense(raw, key)
        n = len(upper)
        full = np.pad(upper + upper.T, 1)
        links = sum(full[i : i + n, j : j + n] for i in range(3) for j in range(3)) / 9.0
        np.fill_diagonal(links, 0.0)
        np.fill_diagonal(links, links.sum(axis=0) == 0)
        walk, chances = np.eye(n), links / links.sum(axis=0)
        for _ in range(200):
            walk = 0.5 * np.eye(n) + 0.5 * walk @ chances
        b1, b2 = np.triu_indices(n, 1)
        near = b2 - b1 < 4
        want = np.zeros((n, n))
        want[b1[near], b2[near]] = walk[b1[near], b2[near]]
        assert np.allclose(dense(got, key), want)
    assert "FlatMapGroupsInPandas" not in out._jdf.queryExecution().executedPlan().toString()


def test_box_smoothing_does_not_shuffle_what_it_spreads(spark, pixels):
    """nine rows a pixel stay in the task of their map."""
    full = symmetrize(pixels)
    out = features.box_smoothed(full, GENOME.n_bins(F.col("chrom_ord"), 100))
    raw, got = pixels.collect(), out.collect()
    for key in {(r["cell_id"], r["chrom_ord"]) for r in raw}:
        upper = dense(raw, key)
        padded, n = np.pad(upper + upper.T, 1), len(upper)
        assert np.allclose(dense(got, key), sum(padded[i : i + n, j : j + n] for i in range(3) for j in range(3)) / 9.0)
    assert shuffles_above_tasks(out) == 0


def test_quantile_sorts_distinct_values(spark, monkeypatch):
    """a value that most rows share is one row of the sort."""
    written = []
    monkeypatch.setattr(scale, "materialize", lambda df: written.append(materialize(df)) or written[-1])
    df = spark.range(5000).select((F.col("id") % 50 == 0).cast("double").alias("v"))
    assert scale.quantile_within(df, [], "v", 0.99).first()["quantile"] == 1.0
    assert scale.quantile_within(df, [], "v", 0.5).first()["quantile"] == 0.0
    assert max(t.count() for t in written) == 2


def test_low_coverage_needs_no_dense_maps(spark, pixels):
    """F32: the same bins as from dense maps, from pixels alone."""
    owners = spark.range(12).select(F.col("id").alias("cell_id"), F.explode(F.array(F.lit(0), F.lit(1))).alias("chrom_ord"))
    keys = ["cell_id", "chrom_ord"]
    got = set()
    for chrom, n in ((0, 7), (1, 4)):
        part = owners.where(F.col("chrom_ord") == chrom)
        held = pixels.where((F.col("chrom_ord") == chrom) & (F.col("cell_id") != 4))
        out = maps.low_coverage_bins_of_pixels(held, part, keys, GENOME.n_bins(F.col("chrom_ord"), 100), 0.6)
        dense_maps = maps.dense_region(part, symmetrize(held, double_diagonal=False), 0, n)
        rows = {tuple(r) for r in out.collect()}
        assert rows == {tuple(r) for r in maps.low_coverage_bins(dense_maps, keys, 0.6).collect()}
        assert "Join LeftOuter" not in out._jdf.queryExecution().optimizedPlan().toString()
        got |= rows
    assert got


def test_variable_bins_read_scores_once(spark, monkeypatch):
    """the scores are made once, whatever number of passes reads them."""
    rng = np.random.default_rng(5)
    rows = [(c, 0, b, float(rng.normal(0, 1 + b))) for c in range(30) for b in range(8)]
    made = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            made.add(batch.num_rows)
            yield batch

    scores = spark.createDataFrame(rows, "cell_id LONG, chrom_ord INT, bin LONG, score DOUBLE")
    scores = scores.mapInArrow(counted, scores.schema)
    out = variable_bin_embedding(scores, spark.range(30).toDF("cell_id"), top_bins=5, components=2)
    assert out.count() == 30
    assert made.value == len(rows)


def test_top_percent_sorts_maps_in_their_task(spark, pixels):
    """the percentile of every dense map, from one shuffle of its pixels."""
    small_batches(spark)
    try:
        full = symmetrize(pixels)
        out = features.top_percent_entries(full, GENOME.n_bins(F.col("chrom_ord"), 100), 35)
        rows, got = full.collect(), {}
        for r in out.collect():
            got.setdefault((r["cell_id"], r["chrom_ord"]), {})[r["bin1"], r["bin2"]] = r["value"]
        for key in {(r["cell_id"], r["chrom_ord"]) for r in rows}:
            m = dense(rows, key)
            want = {(int(i), int(j)): m[i, j] for i, j in zip(*np.nonzero(m > np.percentile(m, 65)), strict=True)}
            assert got.get(key, {}) == want
        assert shuffles_above_tasks(out) == 0
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
