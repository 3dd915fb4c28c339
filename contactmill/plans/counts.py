"""Counts, depths, statistics of pixels and cells."""

from __future__ import annotations

from pyspark.sql import functions as F

from contactmill.functions.draws import hash_key_sql
from contactmill.operators import binning, features, stats
from contactmill.plans import fixtures as fx
from contactmill.plans.catalog import big, query, r6, rounded

GENOME, MB = fx.GENOME, fx.MB


def _long_chrom(df):
    return df.withColumn("chrom_ord", F.col("chrom_ord").cast("long"))


@query("A1_depth", f"SELECT cell_id, {big('depth', 'depth')} FROM depths")
def depth(spark, sf):
    return fx.depths(spark, sf)


@query("A2_pixels", f"SELECT cell_id, {big('chrom_ord', 'chrom_ord')}, bin1, bin2, value FROM pix")
def pixels(spark, sf):
    return _long_chrom(fx.pixels(spark, sf))


@query(
    "A3_reads_per_chrom",
    "SELECT cell_id, "
    + ", ".join(f"coalesce(sum(value) FILTER (WHERE chrom_ord = {i}), 0) AS reads_chr{i + 1}" for i in range(6))
    + " FROM pix GROUP BY 1",
)
def reads_per_chrom(spark, sf):
    return stats.reads_per_chrom(fx.pixels(spark, sf), GENOME)


BULK_SQL = """bulk0 AS (SELECT chrom_ord, bin1, bin2, sum(value) AS value FROM sym GROUP BY 1, 2, 3),
bulk1 AS (SELECT a.chrom_ord, a.bin AS bin1, b.bin AS bin2,
    coalesce(m.value, 0) + CASE WHEN a.bin = b.bin AND r.s IS NULL THEN 1 ELSE 0 END AS value
  FROM grid a JOIN grid b ON a.chrom_ord = b.chrom_ord
  LEFT JOIN bulk0 m ON m.chrom_ord = a.chrom_ord AND m.bin1 = a.bin AND m.bin2 = b.bin
  LEFT JOIN (SELECT chrom_ord, bin1, sum(value) AS s FROM (SELECT chrom_ord, bin1, value FROM pix) GROUP BY 1, 2) r
    ON r.chrom_ord = a.chrom_ord AND r.bin1 = a.bin),
bulk2 AS (SELECT chrom_ord, bin1, bin2, least(value, avg(value) OVER (PARTITION BY chrom_ord)
    + 10 * stddev_pop(value) OVER (PARTITION BY chrom_ord)) AS value FROM bulk1),
bulk AS (SELECT chrom_ord, bin1, bin2, value / sum(value) OVER (PARTITION BY chrom_ord, bin1) AS value FROM bulk2)"""


@query(
    "A4_quality_flags",
    f"""SELECT c.cell_id, {big('s.chrom_ord', 'chrom_ord')}, {big('coalesce(f.n, 0)', 'n_off_diagonal')}, {r6('u.needed', 'needed')},
  coalesce(f.n, 0) >= u.needed AS passes
FROM cells c CROSS JOIN chrom_sizes s
JOIN (SELECT chrom_ord, greatest(0.25 * count(*) FILTER (WHERE filled > 2) - 5, 0) AS needed FROM
  (SELECT chrom_ord, bin1, count(*) FILTER (WHERE value > 0) AS filled FROM bulk GROUP BY 1, 2) GROUP BY 1) u ON u.chrom_ord = s.chrom_ord
LEFT JOIN (SELECT cell_id, chrom_ord, count(*) AS n FROM pix WHERE bin1 <> bin2 GROUP BY 1, 2) f
  ON f.cell_id = c.cell_id AND f.chrom_ord = s.chrom_ord""",
    BULK_SQL,
)
def quality_flags(spark, sf):
    pix = fx.pixels(spark, sf)
    bulk = features.pseudo_bulk(pix, GENOME, MB)
    flags = stats.quality_flags(pix, fx.cells(spark, sf), bulk, GENOME, MB)
    return _long_chrom(flags).withColumn("needed", rounded("needed"))


@query(
    "A5_sparsity",
    f"""SELECT cell_id, {big('count(*)', 'filled')}, {r6('count(*) / CAST(6 * 200 AS DOUBLE)', 'sparsity')}
FROM (SELECT DISTINCT cell_id, chrom_ord, bin1 // 2 AS b1, bin2 // 2 AS b2 FROM pix500) GROUP BY 1""",
)
def sparsity(spark, sf):
    out = stats.sparsity(fx.pixels(spark, sf, 500_000), GENOME, 500_000)
    return out.withColumn("sparsity", rounded("sparsity"))


@query(
    "A5_median_sparsity",
    f"""SELECT {r6('quantile_cont(s, 0.5)', 'median_sparsity')} FROM (SELECT count(*) / CAST(6 * 200 AS DOUBLE) AS s
FROM (SELECT DISTINCT cell_id, chrom_ord, bin1 // 2 AS b1, bin2 // 2 AS b2 FROM pix500) GROUP BY cell_id)""",
)
def median_sparsity(spark, sf):
    per_cell = stats.sparsity(fx.pixels(spark, sf, 500_000), GENOME, 500_000)
    # the share takes at most as many values as there are pixels, so value counts stay small
    return per_cell.agg(rounded(F.percentile("sparsity", F.lit(0.5)), "median_sparsity"))


@query(
    "A6_mean_reads",
    f"""SELECT {big('chrom_ord', 'chrom_ord')}, {r6('sum(value) / (SELECT count(*) FROM cells)', 'reads_per_cell')} FROM pix GROUP BY 1""",
)
def mean_reads(spark, sf):
    out = stats.mean_reads_per_chrom(fx.pixels(spark, sf), fx.cells(spark, sf))
    return _long_chrom(out).withColumn("reads_per_cell", rounded("reads_per_cell"))


@query("A7_pseudo_bulk", f"SELECT {big('chrom_ord', 'chrom_ord')}, {big('bin1', 'bin1')}, {big('bin2', 'bin2')}, {r6('value', 'value')} FROM bulk WHERE value > 0", BULK_SQL)
def pseudo_bulk(spark, sf):
    bulk = features.pseudo_bulk(fx.pixels(spark, sf), GENOME, MB)
    return _long_chrom(bulk).withColumn("value", rounded("value"))


@query("A8_decay", f"SELECT bin2 - bin1 AS distance, {r6('avg(value)', 'weight')} FROM pix WHERE bin1 <> bin2 GROUP BY 1")
def decay(spark, sf):
    return stats.decay_by_distance(fx.pixels(spark, sf)).withColumn("weight", rounded("weight"))


@query("A9_mean_value", f"SELECT cell_id, {r6('avg(value)', 'weight')} FROM pix WHERE bin1 <> bin2 GROUP BY 1")
def mean_value(spark, sf):
    return stats.mean_value_by_cell(fx.pixels(spark, sf)).withColumn("weight", rounded("weight"))


_CELL_DEPTH = "celld AS (SELECT c.*, d.depth FROM cells c JOIN depths d USING (cell_id))"


def cells_with_depth(spark, sf):
    return fx.cells(spark, sf).join(fx.depths(spark, sf), "cell_id")


@query(
    "A10_metacell_depths",
    f"SELECT metacell, {big('sum(depth)', 'total_depth')}, {big('count(*)', 'cell_count')}, {r6('avg(depth)', 'mean_depth')} FROM celld GROUP BY 1",
    _CELL_DEPTH,
)
def metacell_depths(spark, sf):
    return stats.metacell_depths(cells_with_depth(spark, sf)).withColumn("mean_depth", rounded("mean_depth"))


@query(
    "A11_dominant_labels",
    """SELECT metacell, label AS dominant_label FROM (SELECT metacell, label, row_number() OVER (PARTITION BY metacell
  ORDER BY count(*) DESC, label) AS rn FROM cells GROUP BY 1, 2) WHERE rn = 1""",
)
def dominant_labels(spark, sf):
    return stats.dominant_labels(fx.cells(spark, sf))


@query(
    "A24_recommend_global",
    f"""SELECT {big('least(lo, hi)', 'min_k')}, {big('hi', 'max_k')} FROM (
  SELECT greatest(1, least(round_even(sum(depth) / CAST(9000 AS DOUBLE), 0), count(*) // 10)) AS lo,
    greatest(1, least(round_even(sum(depth) / CAST(2500 AS DOUBLE), 0), count(*) // 10)) AS hi FROM depths)""",
)
def recommend_global(spark, sf):
    return stats.recommend_global(fx.depths(spark, sf), 2500, 9000, 10)


_CLUSTER_SQL = """per AS (SELECT label AS cluster, count(*) AS cells, sum(depth) AS total_depth,
    greatest(1, round_even(sum(depth) / CAST(900 AS DOUBLE), 0)) AS hi, greatest(1, round_even(sum(depth) / CAST(1700 AS DOUBLE), 0)) AS lo
  FROM celld GROUP BY 1)"""


@query(
    "A25_recommend_per_cluster",
    f"""SELECT cluster, {big('cells', 'cells')}, {big('total_depth', 'total_depth')}, {big('least(lo, hi)', 'min_k')}, {big('hi', 'max_k')} FROM per""",
    _CELL_DEPTH + ",\n" + _CLUSTER_SQL,
)
def recommend_per_cluster(spark, sf):
    clustered = cells_with_depth(spark, sf).withColumnRenamed("label", "cluster")
    return stats.recommend_per_cluster(clustered, 900, 1700)


@query(
    "A25_recommend_total",
    f"SELECT {big('sum(least(lo, hi))', 'min_k')}, {big('least(sum(hi), count(*) * 5)', 'max_k')} FROM per",
    _CELL_DEPTH + ",\n" + _CLUSTER_SQL,
)
def recommend_total(spark, sf):
    return stats.recommend_total(recommend_per_cluster(spark, sf))


@query(
    "T1_clusters_by_size",
    f"""SELECT cluster, {big('cells', 'cells')}, {big('row_number() OVER (ORDER BY cells DESC, cluster)', 'place')} FROM per""",
    _CELL_DEPTH + ",\n" + _CLUSTER_SQL,
)
def clusters_by_size(spark, sf):
    from contactmill.scale import rank_within

    per = recommend_per_cluster(spark, sf).select("cluster", "cells")
    return rank_within(per, [], [F.desc("cells"), "cluster"], "place")


_SIM_SQL = f"""simr AS (SELECT depth, row_number() OVER (ORDER BY {hash_key_sql('cell_id', seed=42)}, cell_id) - 1 AS r,
    count(*) OVER () AS n FROM depths),
sim AS (SELECT CASE WHEN r < (n % 12) * (n // 12 + 1) THEN r // (n // 12 + 1)
    ELSE n % 12 + (r - (n % 12) * (n // 12 + 1)) // (n // 12) END AS part, sum(depth) AS depth FROM simr GROUP BY 1)"""


@query("A26_simulated_depths", f"SELECT {big('part', 'part')}, {big('depth', 'depth')} FROM sim", _SIM_SQL)
def simulated_depths(spark, sf):
    return stats.simulated_depths(fx.depths(spark, sf), 12, seed=42)


@query(
    "A26_simulated_interval",
    f"SELECT {r6('quantile_cont(depth, 0.05)', 'p05')}, {r6('quantile_cont(depth, 0.95)', 'p95')} FROM (SELECT CAST(depth AS DOUBLE) AS depth FROM sim)",
    _SIM_SQL,
)
def simulated_interval(spark, sf):
    out = stats.simulated_interval(simulated_depths(spark, sf))
    return out.select(rounded("p05"), rounded("p95"))


@query(
    "A30_depth_histogram",
    f"""SELECT {big('slot', 'slot')}, {big('count(*)', 'n')}, {r6('any_value(lo + slot * (hi - lo) / 30)', 'low')},
  {r6('any_value(lo + (slot + 1) * (hi - lo) / 30)', 'high')}, {r6('any_value(mean)', 'mean')} FROM (
  SELECT least(floor((depth - lo) / ((hi - lo) / 30)), 29) AS slot, lo, hi, mean FROM depths,
    (SELECT CAST(min(depth) AS DOUBLE) AS lo, CAST(max(depth) AS DOUBLE) AS hi, avg(depth) AS mean FROM depths)) GROUP BY 1""",
)
def depth_histogram(spark, sf):
    out = stats.value_histogram(fx.depths(spark, sf), "depth", 30)
    return out.select("slot", "n", rounded("low"), rounded("high"), rounded("mean"))


@query(
    "A30_size_histogram",
    f"""SELECT {big('slot', 'slot')}, {big('count(*)', 'n')}, {r6('any_value(lo + slot * (hi - lo) / 20)', 'low')},
  {r6('any_value(lo + (slot + 1) * (hi - lo) / 20)', 'high')}, {r6('any_value(mean)', 'mean')} FROM (
  SELECT least(floor((n - lo) / ((hi - lo) / 20)), 19) AS slot, lo, hi, mean FROM sizes,
    (SELECT CAST(min(n) AS DOUBLE) AS lo, CAST(max(n) AS DOUBLE) AS hi, avg(n) AS mean FROM sizes)) GROUP BY 1""",
    "sizes AS (SELECT metacell, count(*) AS n FROM cells GROUP BY 1)",
)
def size_histogram(spark, sf):
    sizes = fx.cells(spark, sf).groupBy("metacell").agg(F.count(F.lit(1)).alias("size"))
    out = stats.value_histogram(sizes, "size", 20)
    return out.select("slot", "n", rounded("low"), rounded("high"), rounded("mean"))


@query(
    "A22_layout_centroids",
    f"""SELECT metacell, {r6('x', 'x')}, {r6('y', 'y')}, {big('n', 'cell_count')},
  {r6('50 + (n - min(n) OVER ()) / CAST(max(n) OVER () - min(n) OVER () AS DOUBLE) * 450', 'marker_size')}
FROM (SELECT metacell, avg(features[1]) AS x, avg(features[2]) AS y, count(*) AS n
  FROM views JOIN cells USING (cell_id) WHERE view_id = 0 GROUP BY 1)""",
)
def layout_centroids(spark, sf):
    out = stats.layout_centroids(fx.cells(spark, sf), layout(spark, sf, 0))
    return out.select("metacell", rounded("x"), rounded("y"), "cell_count", rounded("marker_size"))


def layout(spark, sf, view):
    """The first two features of a view stand for a 2-D layout."""
    table = fx.views(spark, sf).where(F.col("view_id") == view)
    return table.select("cell_id", F.element_at("features", 1).alias("x"), F.element_at("features", 2).alias("y"))


@query(
    "A27_batch_coverage",
    f"""SELECT {big('chrom_ord', 'chrom_ord')}, {big('batch', 'batch')}, {r6('corr(rx, ry)', 'spearman')} FROM (
  SELECT chrom_ord, batch, rank() OVER (PARTITION BY chrom_ord, batch ORDER BY b) + (count(*) OVER (PARTITION BY chrom_ord, batch, b) - 1) / CAST(2 AS DOUBLE) AS rx,
    rank() OVER (PARTITION BY chrom_ord, batch ORDER BY u) + (count(*) OVER (PARTITION BY chrom_ord, batch, u) - 1) / CAST(2 AS DOUBLE) AS ry
  FROM cover WHERE u > 0) GROUP BY 1, 2""",
    """rows0 AS (SELECT chrom_ord, bin1 AS bin, cell_id, sum(value) AS s FROM sym GROUP BY 1, 2, 3),
cover AS (SELECT g.chrom_ord, b.batch, g.bin, coalesce(x.s / b.n / 20, 0) AS b, coalesce(y.s / t.n / 20, 0) AS u
  FROM grid g CROSS JOIN (SELECT batch, count(*) AS n FROM cells GROUP BY 1) b CROSS JOIN (SELECT count(*) AS n FROM cells) t
  LEFT JOIN (SELECT chrom_ord, bin, batch, sum(s) AS s FROM rows0 JOIN cells USING (cell_id) GROUP BY 1, 2, 3) x
    ON x.chrom_ord = g.chrom_ord AND x.bin = g.bin AND x.batch = b.batch
  LEFT JOIN (SELECT chrom_ord, bin, sum(s) AS s FROM rows0 GROUP BY 1, 2) y ON y.chrom_ord = g.chrom_ord AND y.bin = g.bin)""",
)
def batch_coverage(spark, sf):
    pix = binning.symmetrize(fx.pixels(spark, sf))
    cover = features.batch_coverage(pix, fx.cells(spark, sf), GENOME, MB)
    return _long_chrom(features.batch_agreement(cover)).withColumn("spearman", rounded("spearman"))


@query(
    "A32_link_scores",
    f"""SELECT {r6('(SELECT (sum(r) FILTER (WHERE truth = 1) - count(*) FILTER (WHERE truth = 1) * (count(*) FILTER (WHERE truth = 1) + 1) / 2.0) / (count(*) FILTER (WHERE truth = 1) * CAST(count(*) FILTER (WHERE truth = 0) AS DOUBLE)) FROM ranked)', 'auc')},
  {r6('(SELECT sum(pos * cp / CAST(ca AS DOUBLE)) / sum(pos) FROM (SELECT pos, sum(pos) OVER (ORDER BY score DESC) AS cp, sum(n) OVER (ORDER BY score DESC) AS ca FROM (SELECT score, sum(truth) AS pos, count(*) AS n FROM links GROUP BY 1)))', 'aupr')},
  {r6('(SELECT avg(CASE WHEN (score >= 0.5) = (truth >= 0.5) THEN 1.0 ELSE 0.0 END) FROM links)', 'accuracy')},
  {r6('(SELECT corr(score, truth) FROM links)', 'pearson')}, {r6('(SELECT corr(r, t) FROM ranked)', 'spearman')}""",
    """links AS (SELECT 1 / CAST(1 + bin2 - bin1 AS DOUBLE) AS score, CASE WHEN value > 1 THEN 1 ELSE 0 END AS truth FROM pix),
ranked AS (SELECT truth, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / CAST(2 AS DOUBLE) AS r,
  rank() OVER (ORDER BY truth) + (count(*) OVER (PARTITION BY truth) - 1) / CAST(2 AS DOUBLE) AS t FROM links)""",
)
def link_scores(spark, sf):
    links = fx.pixels(spark, sf).select(
        (1 / (1 + F.col("bin2") - F.col("bin1")).cast("double")).alias("score"),
        F.when(F.col("value") > 1, 1).otherwise(0).alias("truth"),
    )
    out = stats.link_scores(links)
    return out.select(*[rounded(c) for c in ("auc", "aupr", "accuracy", "pearson", "spearman")])
