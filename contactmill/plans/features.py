"""Preprocessing statistics, feature blocks and linear algebra."""

from __future__ import annotations

from pyspark.sql import functions as F

from contactmill.functions import vectors
from contactmill.operators import binning, cellmaps, features, linalg, stats
from contactmill.plans import fixtures as fx
from contactmill.plans.catalog import big, query, r6, rounded
from contactmill.plans.counts import BULK_SQL
from contactmill.session import materialize

GENOME, MB = fx.GENOME, fx.MB


def _long(df):
    return df.withColumn("chrom_ord", F.col("chrom_ord").cast("long"))


def _map_out(df, digits=6):
    return _long(df).withColumn("value", rounded("value", digits=digits))


_MAP_COLS = f"cell_id, {big('chrom_ord', 'chrom_ord')}, {big('bin1', 'bin1')}, {big('bin2', 'bin2')}"


@query("M1_symmetrize", f"SELECT {_MAP_COLS}, {r6('value', 'value')} FROM sym")
def symmetrize(spark, sf):
    return _map_out(binning.symmetrize(fx.pixels(spark, sf)))


@query(
    "M2_depth_scaled_adjacency",
    f"""SELECT {_MAP_COLS}, {r6('ln(1 + value)', 'log_value')} FROM (
  SELECT x.cell_id, x.chrom_ord, x.bin1, x.bin2, x.value * (t.target / (coalesce(s.s, 0) + 1e-15)) AS value FROM (
    SELECT cell_id, chrom_ord, bin1, bin2, value FROM offd
    UNION ALL SELECT c.cell_id, g.chrom_ord, g.bin, g.bin, 1 FROM cells c CROSS JOIN grid g
      WHERE NOT EXISTS (SELECT 1 FROM offd o WHERE o.cell_id = c.cell_id AND o.chrom_ord = g.chrom_ord AND o.bin1 = g.bin)) x
  JOIN (SELECT chrom_ord, sum(value) / (SELECT count(*) FROM cells) AS target FROM pix GROUP BY 1) t USING (chrom_ord)
  LEFT JOIN (SELECT cell_id, chrom_ord, sum(value) AS s FROM pix WHERE bin1 < bin2 GROUP BY 1, 2) s ON s.cell_id = x.cell_id AND s.chrom_ord = x.chrom_ord)""",
    "offd AS (SELECT * FROM sym WHERE bin1 <> bin2)",
)
def depth_scaled_adjacency(spark, sf):
    out = features.depth_scaled_adjacency(fx.pixels(spark, sf), fx.cells(spark, sf), GENOME, MB)
    return _long(out).select("cell_id", "chrom_ord", "bin1", "bin2", rounded(F.log1p("value"), "log_value"))


# taps of the mirrored 3-tap filter, per source bin and target bin
SMOOTH_SQL = """g1 AS (SELECT exp(-0.5::DOUBLE) / (1 + 2 * exp(-0.5::DOUBLE)) AS side, 1 / (1 + 2 * exp(-0.5::DOUBLE)) AS mid),
taps AS (SELECT src, dst, sum(w) AS w FROM (
    SELECT least(19, greatest(0, d.b + o.o)) AS src, d.b AS dst, CASE WHEN o.o = 0 THEN mid ELSE side END AS w
    FROM (SELECT unnest(range(0, 20)) AS b) d CROSS JOIN (SELECT unnest([-1, 0, 1]) AS o) o CROSS JOIN g1) GROUP BY 1, 2),
smap0 AS (SELECT cell_id, chrom_ord, a.dst AS bin1, b.dst AS bin2, sum(value * a.w * b.w) AS value
  FROM sym JOIN taps a ON a.src = bin1 JOIN taps b ON b.src = bin2 GROUP BY 1, 2, 3, 4),
smap AS (SELECT cell_id, chrom_ord, bin1, bin2, value / (sum(value) OVER (PARTITION BY cell_id, chrom_ord) + 1e-15) AS value FROM smap0)"""


def smoothed(spark, sf):
    return features.smoothed_cell_maps(fx.pixels(spark, sf), GENOME, MB)


def packed(spark, sf, pix=None):
    return features.packed_cell_maps(fx.pixels(spark, sf) if pix is None else pix, GENOME, MB)


def both_triangles(maps):
    return binning.symmetrize(cellmaps.entries_of(maps), double_diagonal=False)


@query("M3_smoothed_cell_maps", f"SELECT {_MAP_COLS}, {r6('value', 'value')} FROM smap", SMOOTH_SQL)
def smoothed_cell_maps(spark, sf):
    return _map_out(smoothed(spark, sf))


@query(
    "M4_pooled_columns",
    f"""SELECT {big('chrom_ord', 'chrom_ord')}, {big('bin1', 'bin1')}, {big('bin2 // 7', 'slot')}, {r6('sum(value) / 7', 'value')}
FROM bulk WHERE bin2 // 7 < 20 // 7 AND value > 0 GROUP BY 1, 2, 3, bin2 // 7""",
    BULK_SQL,
)
def pooled_columns(spark, sf):
    bulk = features.pseudo_bulk(fx.pixels(spark, sf), GENOME, MB)
    return _map_out(features.pooled_columns(bulk, GENOME, MB, wide=3))


CORRECT_SQL = SMOOTH_SQL + """,
srow AS (SELECT cell_id, chrom_ord, bin1 AS bin, sum(value) AS s FROM smap GROUP BY 1, 2, 3),
brow AS (SELECT chrom_ord, bin, batch, sum(s) / any_value(n) / 20 AS b FROM srow JOIN cells USING (cell_id)
  JOIN (SELECT batch, count(*) AS n FROM cells GROUP BY 1) USING (batch) GROUP BY 1, 2, 3),
arow AS (SELECT chrom_ord, bin, sum(s) / (SELECT count(*) FROM cells) / 20 AS a FROM srow GROUP BY 1, 2),
fixedm AS (SELECT m.cell_id, m.chrom_ord, m.bin1, m.bin2, m.value * a.a / (b.b + 1e-15) AS value FROM smap m JOIN cells c USING (cell_id)
  JOIN brow b ON b.chrom_ord = m.chrom_ord AND b.bin = m.bin1 AND b.batch = c.batch JOIN arow a ON a.chrom_ord = m.chrom_ord AND a.bin = m.bin1),
cover AS (SELECT g.chrom_ord, t.batch, g.bin, coalesce(b.b, 0) AS b, coalesce(a.a, 0) AS a FROM grid g
  CROSS JOIN (SELECT DISTINCT batch FROM cells) t LEFT JOIN brow b ON b.chrom_ord = g.chrom_ord AND b.bin = g.bin AND b.batch = t.batch
  LEFT JOIN arow a ON a.chrom_ord = g.chrom_ord AND a.bin = g.bin),
poor AS (SELECT chrom_ord, batch FROM (
    SELECT chrom_ord, batch, rank() OVER (PARTITION BY chrom_ord, batch ORDER BY b) AS rb, rank() OVER (PARTITION BY chrom_ord, batch ORDER BY a) AS ra
    FROM cover WHERE a > 0) GROUP BY 1, 2 HAVING corr(rb, ra) < 0.8)"""


@query(
    "M5_batch_corrected",
    f"""SELECT {_MAP_COLS}, {r6('value', 'value')} FROM (
  SELECT f.cell_id, f.chrom_ord, bin1, bin2, f.value / sum(f.value) OVER (PARTITION BY f.cell_id, f.chrom_ord) AS value
  FROM fixedm f JOIN cells c USING (cell_id) JOIN poor p ON p.chrom_ord = f.chrom_ord AND p.batch = c.batch
  UNION ALL SELECT m.cell_id, m.chrom_ord, bin1, bin2, m.value FROM smap m JOIN cells c USING (cell_id)
  WHERE (m.chrom_ord, c.batch) NOT IN (SELECT (chrom_ord, batch) FROM poor))""",
    CORRECT_SQL,
)
def batch_corrected(spark, sf):
    """Batches that agree less than the default with the bulk are corrected, the others left."""
    maps, cells = packed(spark, sf), fx.cells(spark, sf)
    coverage = features.batch_coverage(both_triangles(maps), cells, GENOME, MB)
    agreement = features.batch_agreement(coverage)
    return _map_out(features.batch_corrected(maps, cells, coverage, agreement))


@query(
    "M5_every_batch_corrected",
    f"""SELECT {_MAP_COLS}, {r6('value / sum(value) OVER (PARTITION BY cell_id, chrom_ord)', 'value')} FROM fixedm""",
    CORRECT_SQL,
)
def every_batch_corrected(spark, sf):
    """With the threshold above 1 every batch counts as poor, so all maps are corrected."""
    maps, cells = packed(spark, sf), fx.cells(spark, sf)
    coverage = features.batch_coverage(both_triangles(maps), cells, GENOME, MB)
    return _map_out(features.batch_corrected(maps, cells, coverage, features.batch_agreement(coverage), below=1.1))


def entries(spark, sf, write=False, pix=None):
    """Where several passes read the smoothed maps, they are written once, as the full pipeline does."""
    maps = packed(spark, sf, pix)
    return features.feature_entries(cellmaps.entries_of(materialize(maps) if write else maps))


def _entry_sql(source="smap"):
    return SMOOTH_SQL + f""",
ent AS (SELECT cell_id, chrom_ord, bin1, bin2, bin1 = bin2 AS diagonal, value FROM {source} WHERE bin1 <= bin2),
common AS (SELECT e.* FROM ent e JOIN (SELECT chrom_ord, bin1, bin2 FROM ent WHERE value > 0 GROUP BY 1, 2, 3
    HAVING count(*) > least(5, (SELECT count(*) FROM cells) - 2)) USING (chrom_ord, bin1, bin2)),
clip AS (SELECT cell_id, chrom_ord, bin1, bin2, diagonal, least(value, lim) AS value FROM common JOIN (
    SELECT chrom_ord, diagonal, avg(value) + 10 * stddev_pop(value) AS lim FROM common GROUP BY 1, 2) USING (chrom_ord, diagonal)),
scaled AS (SELECT cell_id, chrom_ord, bin1, bin2, diagonal, value / sum(value) OVER (PARTITION BY cell_id, chrom_ord) * 13 AS value FROM clip)"""


@query("M6_feature_blocks", f"SELECT {_MAP_COLS}, diagonal, {r6('value', 'value')} FROM ent", _entry_sql())
def feature_blocks(spark, sf):
    return _map_out(entries(spark, sf))


def common(spark, sf, pix=None):
    n_cells = fx.cells(spark, sf).select(F.count(F.lit(1))).scalar()
    return features.common_features(entries(spark, sf, write=True, pix=pix), n_cells)


@query("M7_common_features", f"SELECT {_MAP_COLS}, diagonal, {r6('value', 'value')} FROM common", _entry_sql())
def common_features(spark, sf):
    return _map_out(common(spark, sf))


@query("M8_clipped_features", f"SELECT {_MAP_COLS}, diagonal, {r6('value', 'value')} FROM clip", _entry_sql())
def clipped_features(spark, sf):
    return _map_out(features.clipped_features(common(spark, sf)))


def scaled(spark, sf, pix=None):
    return features.scaled_features(features.clipped_features(common(spark, sf, pix)), GENOME, MB)


@query("M9_scaled_features", f"SELECT {_MAP_COLS}, diagonal, {r6('value', 'value')} FROM scaled", _entry_sql())
def scaled_features(spark, sf):
    return _map_out(scaled(spark, sf))


@query("M10_chromosome_svd")
def chromosome_svd(spark, sf):
    """Ranks by the rule, components fitted on the cells that pass on each chromosome."""
    from contactmill.operators.pipeline import chromosome_embedding
    from contactmill.operators.stats import quality_flags

    pix, cells = materialize(fx.pixels(spark, sf)), fx.cells(spark, sf)  # read for maps, bulk and flags
    flags = quality_flags(pix, cells, features.pseudo_bulk(pix, GENOME, MB), GENOME, MB)
    out = chromosome_embedding(scaled(spark, sf, pix), cells.select("cell_id"), GENOME, MB, flags=flags)
    return out.select("cell_id", F.posexplode("features").alias("pos", "value")).withColumn("value", rounded("value"))


_VIEW0 = "v0 AS (SELECT cell_id, unnest(range(0, 24)) AS pos, unnest(features) AS x FROM views WHERE view_id = 0)"


def view0(spark, sf):
    return fx.views(spark, sf).where(F.col("view_id") == 0).select("cell_id", "features")


def _dims(df, *keys):
    out = df.select("cell_id", *keys, F.posexplode("features").alias("pos", "value"))
    return out.withColumns({"pos": F.col("pos").cast("long"), "value": rounded("value")})


@query("M12_standardize", f"SELECT cell_id, {big('pos', 'pos')}, {r6('(x - avg(x) OVER (PARTITION BY pos)) / stddev_pop(x) OVER (PARTITION BY pos)', 'value')} FROM v0", _VIEW0)
def standardize(spark, sf):
    return _dims(linalg.standardize(view0(spark, sf)))


@query("M12_standardize_all", f"SELECT cell_id, {big('pos', 'pos')}, {r6('(x - (SELECT avg(x) FROM v0)) / (SELECT stddev_pop(x) FROM v0)', 'value')} FROM v0", _VIEW0)
def standardize_all(spark, sf):
    return _dims(linalg.standardize_all(view0(spark, sf)))


@query("M13_principal_components")
def principal_components(spark, sf):
    return _dims(linalg.principal_components(view0(spark, sf), 0.75))


@query("M14_shift_non_negative", f"SELECT cell_id, {big('pos', 'pos')}, {r6('x - least((SELECT min(x) FROM v0), 0)', 'value')} FROM v0", _VIEW0)
def shift_non_negative(spark, sf):
    return _dims(linalg.shift_non_negative(view0(spark, sf)))


@query(
    "M14_pseudo_counts",
    f"SELECT cell_id, {big('pos', 'pos')}, {r6('(x - (SELECT min(x) FROM v0)) / (SELECT max(x) - min(x) FROM v0) * 1000', 'value')} FROM v0",
    _VIEW0,
)
def pseudo_counts(spark, sf):
    return _dims(linalg.pseudo_counts(view0(spark, sf)))


@query(
    "M14_target_count",
    f"SELECT {r6('sum(c)', 'total', 3)}, {big('floor(sum(c) / 25)', 'target')} FROM (SELECT (x - (SELECT min(x) FROM v0)) / (SELECT max(x) - min(x) FROM v0) * 1000 AS c FROM v0)",
    _VIEW0,
)
def target_count(spark, sf):
    out = linalg.target_count(linalg.pseudo_counts(view0(spark, sf)), 25)
    return out.select(rounded("total", digits=3), F.col("target").cast("long").alias("target"))


@query(
    "M15_regress_out",
    f"""SELECT v.cell_id, {big('v.pos', 'pos')}, {r6('v.x - f.my - f.b * (w.weight - f.mx)', 'value')} FROM v0 v
JOIN w1 w USING (cell_id) JOIN (SELECT pos, avg(x) AS my, avg(weight) AS mx, covar_pop(weight, x) / var_pop(weight) AS b
  FROM v0 JOIN w1 USING (cell_id) GROUP BY 1) f ON f.pos = v.pos""",
    _VIEW0 + """,
w1 AS (SELECT c.cell_id, coalesce(x.w, 0) AS weight FROM cells c LEFT JOIN (SELECT cell_id, avg(value) AS w FROM pix WHERE bin1 <> bin2 GROUP BY 1) x USING (cell_id))""",
)
def regress_out(spark, sf):
    weight = stats.mean_value_by_cell(fx.pixels(spark, sf))
    joined = view0(spark, sf).join(weight, "cell_id", "left").fillna(0.0, ["weight"])
    return _dims(linalg.regress_out(joined, "weight"))


@query("M16_l2_normalize", f"SELECT cell_id, {big('pos', 'pos')}, {r6('x / sqrt(sum(x * x) OVER (PARTITION BY cell_id))', 'value')} FROM v0", _VIEW0)
def l2_normalize(spark, sf):
    return _dims(view0(spark, sf).withColumn("features", vectors.l2_normalize(F.col("features"))))


@query(
    "M16_l1_normalize",
    f"SELECT {_MAP_COLS}, {r6('value / sum(value) OVER (PARTITION BY cell_id, chrom_ord, bin1)', 'value')} FROM sym",
)
def l1_normalize(spark, sf):
    from contactmill.scale import with_totals

    rows = with_totals(binning.symmetrize(fx.pixels(spark, sf)), ["cell_id", "chrom_ord", "bin1"], _s=F.sum("value"))
    return _map_out(rows.withColumn("value", F.col("value") / F.col("_s")).select("cell_id", "chrom_ord", "bin1", "bin2", "value"))


@query(
    "M17_box_smoothing",
    f"""SELECT {_MAP_COLS}, {r6('value', 'value')} FROM (SELECT cell_id, chrom_ord, bin1 + a.o AS bin1, bin2 + b.o AS bin2, sum(value) / 9 AS value
  FROM sym CROSS JOIN (SELECT unnest([-1, 0, 1]) AS o) a CROSS JOIN (SELECT unnest([-1, 0, 1]) AS o) b
  WHERE bin1 + a.o BETWEEN 0 AND 19 AND bin2 + b.o BETWEEN 0 AND 19 GROUP BY 1, 2, 3, 4)""",
)
def box_smoothing(spark, sf):
    full = binning.symmetrize(fx.pixels(spark, sf))
    return _map_out(features.box_smoothed(full, GENOME.n_bins(F.col("chrom_ord"), MB)))


@query("M18_random_walk")
def random_walk(spark, sf):
    return _map_out(features.random_walk_maps(fx.pixels(spark, sf), GENOME, MB, max_bin=20))


@query(
    "M19_top_percent",
    f"""SELECT {_MAP_COLS}, {r6('value', 'value')} FROM sym JOIN (SELECT cell_id, chrom_ord, quantile_cont(v, 0.8) AS cut FROM (
    SELECT o.cell_id, o.chrom_ord, coalesce(s.value, 0) AS v FROM (SELECT DISTINCT cell_id, chrom_ord FROM sym) o
    JOIN grid a ON a.chrom_ord = o.chrom_ord JOIN grid b ON b.chrom_ord = o.chrom_ord
    LEFT JOIN sym s ON s.cell_id = o.cell_id AND s.chrom_ord = o.chrom_ord AND s.bin1 = a.bin AND s.bin2 = b.bin) GROUP BY 1, 2)
USING (cell_id, chrom_ord) WHERE value > cut""",
)
def top_percent(spark, sf):
    full = binning.symmetrize(fx.pixels(spark, sf))
    return _map_out(features.top_percent_entries(full, GENOME.n_bins(F.col("chrom_ord"), MB), 20))


@query("M19_top_percent_embedding")
def top_percent_embedding(spark, sf):
    from contactmill.operators.pipeline import top_percent_embedding as embed

    cells = fx.cells(spark, sf).select("cell_id")
    out = embed(fx.pixels(spark, sf), cells, GENOME, MB, dim=5)
    return _dims(out)


def signals(spark, sf):
    """Two tracks per bin from the contacts that start there: how many, and how far they reach."""
    located = binning.bin_contacts(fx.contacts(spark, sf), GENOME, 4 * MB)
    both = located.groupBy("cell_id", F.col("chrom_ord1").alias("chrom_ord"), F.col("bin1").alias("bin")).agg(
        F.count(F.lit(1)).cast("double").alias("n"), F.avg(F.abs(F.col("bin2") - F.col("bin1"))).alias("reach")
    )
    return both.select("cell_id", "chrom_ord", "bin", F.expr("stack(2, 'n', n, 'reach', reach) AS (signal, value)"))


@query(
    "S8_signal_tracks",
    f"""SELECT signal, cell_id, {big('chrom_ord', 'chrom_ord')}, {big('bin', 'bin')}, {r6('value', 'value')} FROM (
  SELECT 'n' AS signal, cell_id, c1 AS chrom_ord, pos1 // 4000000 AS bin, CAST(count(*) AS DOUBLE) AS value FROM located GROUP BY 2, 3, 4
  UNION ALL SELECT 'reach', cell_id, c1, pos1 // 4000000, avg(abs(pos2 // 4000000 - pos1 // 4000000)) FROM located GROUP BY 2, 3, 4)""",
)
def signal_tracks(spark, sf):
    return _map_out(signals(spark, sf)).select("signal", "cell_id", "chrom_ord", "bin", "value")


@query("M40_signal_features")
def signal_features(spark, sf):
    from contactmill.operators.pipeline import signal_embedding

    out = signal_embedding(signals(spark, sf), fx.cells(spark, sf).select("cell_id"), GENOME, 4 * MB)
    return _dims(out)


@query(
    "J12_joined_views",
    f"""SELECT cell_id, {big('view_id * 24 + pos', 'pos')}, {r6('x', 'value')} FROM (SELECT view_id, cell_id, unnest(range(0, 24)) AS pos, unnest(features) AS x FROM views)""",
)
def joined_views(spark, sf):
    return _dims(linalg.concat_blocks(fx.views(spark, sf), "cell_id", ["view_id"], "features"))


@query(
    "A33_update_rate",
    f"""SELECT {r6('min(rate)', 'lowest')}, {r6('max(rate)', 'highest')} FROM (SELECT a.cell_id, sum((a.x - b.x) * (a.x - b.x)) / sum(a.x * a.x) AS rate
  FROM v0 a JOIN v1 b USING (cell_id, pos) GROUP BY 1)""",
    _VIEW0 + ", v1 AS (SELECT cell_id, unnest(range(0, 24)) AS pos, unnest(features) AS x FROM views WHERE view_id = 1)",
)
def update_rate(spark, sf):
    from contactmill.operators.pipeline import update_rates

    new = fx.views(spark, sf).where(F.col("view_id") == 1)
    rates = update_rates(view0(spark, sf), new)
    return rates.agg(rounded(F.min("rate"), "lowest"), rounded(F.max("rate"), "highest"))
