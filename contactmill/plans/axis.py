"""Operators along the genomic axis."""

from __future__ import annotations

from pyspark.sql import functions as F

from contactmill.operators import binning, insulation, stats
from contactmill.plans import fixtures as fx
from contactmill.plans.catalog import big, query, r6, rounded

GENOME = fx.GENOME
FINE = 100_000


def _long(df):
    return df.withColumn("chrom_ord", F.col("chrom_ord").cast("long"))


IS_SQL = """squares AS (SELECT p.cell_id, p.chrom_ord, i.bin, sum(p.value) AS s FROM pix100 p JOIN grid100 i
    ON i.chrom_ord = p.chrom_ord AND i.bin >= 6 AND i.bin < 194 AND p.bin1 >= i.bin - 6 AND p.bin1 < i.bin
      AND p.bin2 >= i.bin AND p.bin2 < i.bin + 6
  WHERE p.bin2 > p.bin1 AND p.bin2 - p.bin1 < 12 GROUP BY 1, 2, 3),
ismean AS (SELECT cell_id, chrom_ord, sum(s) / 188 AS m FROM squares GROUP BY 1, 2),
isc AS (SELECT c.cell_id, g.chrom_ord, g.bin, CASE WHEN coalesce(m.m, 0) > 0 THEN
    CASE WHEN g.bin >= 6 AND g.bin < 194 THEN log2(coalesce(q.s, 0) / m.m + 0.00001) END ELSE 0 END AS score
  FROM cells c CROSS JOIN grid100 g LEFT JOIN squares q ON q.cell_id = c.cell_id AND q.chrom_ord = g.chrom_ord AND q.bin = g.bin
  LEFT JOIN ismean m ON m.cell_id = c.cell_id AND m.chrom_ord = g.chrom_ord)"""


def cell_scores(spark, sf, cells=None):
    owners = (fx.cells(spark, sf) if cells is None else cells).select("cell_id")
    return insulation.insulation_scores(fx.pixels(spark, sf, FINE), owners, GENOME, FINE, window=6)


@query("W1_insulation", f"SELECT cell_id, {big('chrom_ord', 'chrom_ord')}, {big('bin', 'bin')}, {r6('score', 'score')} FROM isc", IS_SQL)
def insulation_scores(spark, sf):
    return _long(cell_scores(spark, sf)).withColumn("score", rounded("score"))


@query(
    "W1_insulation_raw",
    f"""SELECT c.metacell, {big('g.chrom_ord', 'chrom_ord')}, {big('g.bin', 'bin')}, {r6('CASE WHEN g.bin >= 6 AND g.bin < 194 THEN coalesce(sum(q.s), 0) END', 'score')}
FROM cells c CROSS JOIN grid100 g LEFT JOIN squares q ON q.cell_id = c.cell_id AND q.chrom_ord = g.chrom_ord AND q.bin = g.bin GROUP BY 1, 2, 3, g.bin""",
    IS_SQL,
)
def insulation_raw(spark, sf):
    from contactmill.operators.maps import metacell_pixels

    cells = fx.cells(spark, sf)
    mc = metacell_pixels(fx.pixels(spark, sf, FINE), cells)
    out = insulation.insulation_scores(
        mc, cells.select("metacell").distinct(), GENOME, FINE, window=6, normalize=False, owner="metacell"
    )
    return _long(out).withColumn("score", rounded("score"))


@query("W2_tad_boundaries")
def tad_boundaries(spark, sf):
    from contactmill.operators.maps import metacell_pixels

    cells = fx.cells(spark, sf)
    mc = metacell_pixels(fx.pixels(spark, sf, FINE), cells)
    scores = insulation.insulation_scores(mc, cells.select("metacell").distinct(), GENOME, FINE, owner="metacell")
    out = insulation.tad_boundaries(scores, window=5, min_prominence=0.1)
    return _long(out).withColumn("score", rounded("score"))


@query("A23_bin_variance", f"SELECT {big('chrom_ord', 'chrom_ord')}, {big('bin', 'bin')}, {r6('var_pop(score)', 'variance')} FROM isc GROUP BY 1, 2", IS_SQL)
def bin_variance(spark, sf):
    return _long(stats.bin_variance(cell_scores(spark, sf))).withColumn("variance", rounded("variance"))


@query(
    "P13_complete_bins",
    f"""SELECT {big('chrom_ord', 'chrom_ord')}, {big('bin', 'bin')} FROM isc GROUP BY 1, 2 HAVING count(score) = (SELECT count(*) FROM cells)""",
    IS_SQL,
)
def complete_bins(spark, sf):
    n_cells = fx.cells(spark, sf).select(F.count(F.lit(1))).scalar()
    return _long(insulation.complete_bins(cell_scores(spark, sf), n_cells))


@query(
    "W7_top_variable_bins",
    f"""SELECT {big('chrom_ord', 'chrom_ord')}, {big('bin', 'bin')}, {r6('v', 'variance')} FROM (SELECT chrom_ord, bin, var_pop(score) AS v FROM isc
  GROUP BY 1, 2 HAVING count(score) = (SELECT count(*) FROM cells)) ORDER BY round(v, 9) DESC, 1, 2 LIMIT 100""",
    IS_SQL,
)
def top_variable_bins(spark, sf):
    scores = cell_scores(spark, sf)
    n_cells = fx.cells(spark, sf).select(F.count(F.lit(1))).scalar()
    kept = insulation.complete_bins(scores, n_cells)
    variances = stats.bin_variance(scores.join(kept, ["chrom_ord", "bin"], "left_semi"))
    # nine digits settle ties between sums taken in different orders
    top = stats.top_variable_bins(variances.withColumn("variance", F.round("variance", 9)), 100)
    return _long(top).withColumn("variance", rounded("variance"))


@query("M41_variable_bin_embedding")
def variable_bin_embedding(spark, sf):
    from contactmill.operators.pipeline import variable_bin_embedding as embed

    cells = fx.cells(spark, sf).where(F.col("label").isin("type_0", "type_1", "type_2", "type_3"))
    out = embed(cell_scores(spark, sf, cells), cells, top_bins=100, components=15)
    return out.select("cell_id", F.posexplode("features").alias("pos", "value")).withColumn("value", rounded("value"))


@query(
    "W4_moving_average",
    f"""SELECT cell_id, {big('chrom_ord', 'chrom_ord')}, {big('i', 'bin1')}, {big('bin2', 'bin2')}, {r6('v', 'value')} FROM (
  SELECT s.cell_id, s.chrom_ord, t.i, s.bin2, sum(s.value * t.w) AS v FROM sym s JOIN (
    SELECT i, greatest(0, least(19, i + o)) AS src, sum(exp(-0.5 * (o / CAST(2 AS DOUBLE)) * (o / CAST(2 AS DOUBLE))) / sqrt(2 * pi())) AS w
    FROM (SELECT unnest(range(0, 20)) AS i) CROSS JOIN (SELECT unnest(range(-4, 5)) AS o) GROUP BY 1, 2) t ON t.src = s.bin1
  GROUP BY 1, 2, 3, 4)""",
)
def moving_average(spark, sf):
    full = binning.symmetrize(fx.pixels(spark, sf))
    out = insulation.moving_average(full, ["cell_id", "chrom_ord"], GENOME.n_bins(F.col("chrom_ord"), fx.MB), 2)
    return _long(out).withColumn("value", rounded("value"))


@query(
    "W8_rank_match",
    f"""SELECT {big('a.chrom_ord', 'chrom_ord')}, {big('a.bin1', 'bin1')}, {big('a.bin2', 'bin2')}, {r6('b.value', 'value')} FROM (
  SELECT *, row_number() OVER (PARTITION BY chrom_ord ORDER BY value, bin1, bin2) AS r FROM dense WHERE batch = 0) a
JOIN (SELECT *, row_number() OVER (PARTITION BY chrom_ord ORDER BY value, bin1, bin2) AS r FROM dense WHERE batch = 1) b
  ON a.chrom_ord = b.chrom_ord AND a.r = b.r""",
    """dense AS (SELECT b.batch, x.chrom_ord, x.bin AS bin1, y.bin AS bin2, coalesce(v.value, 0) AS value
  FROM grid x JOIN grid y ON x.chrom_ord = y.chrom_ord CROSS JOIN (SELECT unnest([0, 1]) AS batch) b
  LEFT JOIN (SELECT batch, chrom_ord, bin1, bin2, sum(value) AS value FROM sym JOIN cells USING (cell_id) GROUP BY 1, 2, 3, 4) v
    ON v.batch = b.batch AND v.chrom_ord = x.chrom_ord AND v.bin1 = x.bin AND v.bin2 = y.bin)""",
)
def rank_match(spark, sf):
    from contactmill.genome import bin_table

    sums = (
        binning.symmetrize(fx.pixels(spark, sf))
        .join(fx.cells(spark, sf).select("cell_id", "batch"), "cell_id")
        .groupBy("batch", "chrom_ord", "bin1", "bin2")
        .agg(F.sum("value").alias("value"))
    )
    axis = F.sequence(F.lit(0).cast("long"), GENOME.n_bins(F.col("chrom_ord"), fx.MB) - 1)
    grid = bin_table(spark, GENOME, fx.MB).select("chrom_ord", F.col("bin").alias("bin1")).select("*", F.explode(axis).alias("bin2"))

    def dense(batch):
        one = sums.where(F.col("batch") == batch).drop("batch")
        return grid.join(one, ["chrom_ord", "bin1", "bin2"], "left").fillna(0.0, ["value"])

    out = insulation.rank_match(dense(0), dense(1), ["chrom_ord"])
    return _long(out).withColumn("value", rounded("value"))
