"""Metacell maps, stores, regions, observed/expected and balancing."""

from __future__ import annotations

from pyspark.sql import functions as F

from contactmill.operators import balance, binning, evaluate, features, maps
from contactmill.plans import fixtures as fx
from contactmill.plans.catalog import big, query, r6, rounded
from contactmill.plans.contacts import scratch_path
from contactmill.plans.counts import BULK_SQL
from contactmill.plans.scores import SCORES_SQL
from contactmill.sources import stores

GENOME, MB = fx.GENOME, fx.MB


def _long(df):
    return df.withColumn("chrom_ord", F.col("chrom_ord").cast("long"))


def metacell_maps(spark, sf, resolution=MB):
    return maps.metacell_pixels(fx.pixels(spark, sf, resolution), fx.cells(spark, sf))


@query("J2_contacts_by_metacell", f"SELECT metacell, {big('count(*)', 'n')}, {big('min(pos1)', 'first_pos')}, {big('max(pos2)', 'last_pos')} FROM raw_contacts JOIN cells USING (cell_id) GROUP BY 1")
def contacts_by_metacell(spark, sf):
    merged = stores.merged_pairs(fx.contacts(spark, sf), fx.cells(spark, sf))
    return merged.groupBy("metacell").agg(F.count(F.lit(1)).alias("n"), F.min("pos1").alias("first_pos"), F.max("pos2").alias("last_pos"))


# a second grouping: one type moves, one is lost, and the twelfth metacell is dissolved
AFTER_SQL = """regrouped AS (SELECT cell_id, label, CASE WHEN metacell = 12 THEN 1 WHEN label = 'type_3' AND metacell = 4 THEN 5 ELSE metacell END AS metacell
  FROM cells WHERE label <> 'type_9')"""


def regrouped(cells):
    moved = F.when(F.col("metacell") == 12, 1).when((F.col("label") == "type_3") & (F.col("metacell") == 4), 5)
    return cells.where(F.col("label") != "type_9").withColumn("metacell", moved.otherwise(F.col("metacell")).cast("long"))


@query(
    "S12_merged_pairs",
    f"SELECT metacell, cell_id, chrom1, {big('pos1', 'pos1')}, chrom2, {big('pos2', 'pos2')} FROM raw_contacts JOIN regrouped USING (cell_id)",
    AFTER_SQL,
)
def merged_pairs(spark, sf):
    """Written for one grouping, then for another, and read back."""
    path, contacts = scratch_path(spark, "pairs"), fx.contacts(spark, sf)
    for cells in (fx.cells(spark, sf), regrouped(fx.cells(spark, sf))):
        stores.write_merged_pairs(stores.merged_pairs(contacts, cells), path)
    return stores.read_merged_pairs(spark, path)


# all contacts between listed chromosomes, as (c1, b1) <= (c2, b2) at one resolution
def _paired_sql(res: int, bins: int, cells: str, name: str) -> str:
    return f"""{name} AS (SELECT metacell, least(g1, g2) // {bins} AS chrom_ord, greatest(g1, g2) // {bins} AS chrom_ord2,
  least(g1, g2) % {bins} AS bin1, greatest(g1, g2) % {bins} AS bin2, CAST(count(*) AS DOUBLE) AS value
  FROM (SELECT r.cell_id, pos1 // {res} + {bins} * a.chrom_ord AS g1, pos2 // {res} + {bins} * b.chrom_ord AS g2
    FROM raw_contacts r JOIN chrom_sizes a ON a.chrom = r.chrom1 JOIN chrom_sizes b ON b.chrom = r.chrom2)
  JOIN {cells} USING (cell_id) GROUP BY 1, 2, 3, 4, 5)"""


_PAIRED_OUT = f"metacell, {big('chrom_ord', 'chrom_ord')}, {big('chrom_ord2', 'chrom_ord2')}, {big('bin1', 'bin1')}, {big('bin2', 'bin2')}, value"


def _paired_long(df):
    return df.withColumns({c: F.col(c).cast("long") for c in ("chrom_ord", "chrom_ord2")})


@query(
    "S13_metacell_pixel_store",
    f"SELECT {big('500000', 'resolution')}, {_PAIRED_OUT} FROM half UNION ALL SELECT {big('1000000', 'resolution')}, {_PAIRED_OUT} FROM whole",
    ",\n".join([AFTER_SQL, _paired_sql(500_000, 40, "regrouped", "half"), _paired_sql(1_000_000, 20, "regrouped", "whole")]),
)
def metacell_pixel_store(spark, sf):
    """Built for one grouping, brought up to date for another, and read back at both stored levels."""
    path, contacts = scratch_path(spark, "pixels"), fx.contacts(spark, sf)
    for cells in (fx.cells(spark, sf), regrouped(fx.cells(spark, sf))):
        stores.refresh_metacell_pixels(contacts, cells, GENOME, 500_000, path, levels=[MB])
    back = [
        stores.read_metacell_pixels(spark, f"{path}/pixels", "pair", r).select(F.lit(r).cast("long").alias("resolution"), "*")
        for r in (500_000, MB)
    ]
    return _paired_long(back[0].unionByName(back[1]))


@query("S14_cell_pixel_store", f"SELECT cell_id, {big('bin1 + 20 * chrom_ord', 'gbin1')}, {big('bin2 + 20 * chrom_ord', 'gbin2')}, value FROM pix")
def cell_pixel_store(spark, sf):
    path = scratch_path(spark, "cells")
    stores.write_cell_pixels(fx.pixels(spark, sf), GENOME, MB, path)
    return spark.read.parquet(path).where(F.col("resolution") == MB).drop("resolution")


@query(
    "S15_changed_metacells",
    """SELECT DISTINCT metacell FROM (SELECT unnest([a.metacell, b.metacell]) AS metacell FROM cells a FULL OUTER JOIN regrouped b
  USING (cell_id) WHERE a.metacell IS DISTINCT FROM b.metacell) WHERE metacell IS NOT NULL""",
    AFTER_SQL,
)
def changed_metacells(spark, sf):
    """What a manifest saved for one grouping finds stale under another."""
    cells = fx.cells(spark, sf)
    manifest = stores.Manifest(spark, scratch_path(spark, "manifest"))
    manifest.save(cells, {"resolution": MB})
    return manifest.stale(regrouped(cells), {"resolution": MB})


@query("A16_metacell_pixels", f"SELECT {_PAIRED_OUT} FROM whole", _paired_sql(1_000_000, 20, "cells", "whole"))
def metacell_pixels(spark, sf):
    return _paired_long(paired_maps(spark, sf, MB))


def paired_maps(spark, sf, resolution):
    return maps.metacell_pixels(binning.paired_pixels(fx.contacts(spark, sf), GENOME, resolution), fx.cells(spark, sf), binning.PAIRED)


def genome_wide_maps(spark, sf):
    """Filtered contacts in genome-wide bins, as the balancing check takes them."""
    return maps.metacell_pixels(binning.all_pixels(fx.contacts(spark, sf), GENOME, MB), fx.cells(spark, sf), ["gbin1", "gbin2"])


FLOOR_SQL = """floors AS (SELECT cell_id, chrom_ord, quantile_cont(value, 0.2) AS f FROM sym GROUP BY 1, 2),
matmap AS (SELECT c.metacell, s.chrom_ord, s.bin1, s.bin2, sum(s.value) AS value FROM sym s JOIN cells c USING (cell_id)
  JOIN floors f ON f.cell_id = s.cell_id AND f.chrom_ord = s.chrom_ord
  JOIN (SELECT metacell, min(cell_id) AS first FROM cells GROUP BY 1) k ON k.metacell = c.metacell
  WHERE s.value >= f.f OR s.cell_id = k.first GROUP BY 1, 2, 3, 4)"""


@query("A17_filtered_maps", f"SELECT metacell, {big('chrom_ord', 'chrom_ord')}, bin1, bin2, {r6('value', 'value')} FROM matmap", FLOOR_SQL)
def filtered_maps(spark, sf):
    out = maps.filtered_metacell_maps(fx.pixels(spark, sf), fx.cells(spark, sf))
    return _long(out).withColumn("value", rounded("value"))


@query(
    "A18_consensus_maps",
    f"""SELECT metacell, {big('chrom_ord', 'chrom_ord')}, bin1, bin2, {r6('sum(ln(1 + value) / s * 100000)', 'value', 4)} FROM
  (SELECT *, sum(ln(1 + value)) OVER (PARTITION BY cell_id, chrom_ord) AS s FROM sym) JOIN cells USING (cell_id) GROUP BY 1, 2, 3, 4""",
)
def consensus_maps(spark, sf):
    out = maps.consensus_maps(fx.pixels(spark, sf), fx.cells(spark, sf))
    return _long(out).withColumn("value", rounded("value", digits=4))


@query(
    "A19_coarsened_maps",
    f"SELECT {big('1000000', 'resolution')}, {_PAIRED_OUT} FROM whole UNION ALL SELECT {big('5000000', 'resolution')}, {_PAIRED_OUT} FROM coarse",
    _paired_sql(1_000_000, 20, "cells", "whole") + ",\n" + _paired_sql(5_000_000, 4, "cells", "coarse"),
)
def coarsened_maps(spark, sf):
    levels = maps.coarsened_maps(paired_maps(spark, sf, 500_000), 500_000, [MB, 5 * MB])
    tagged = [levels[r].select(F.lit(r).cast("long").alias("resolution"), "*") for r in (MB, 5 * MB)]
    return _paired_long(tagged[0].unionByName(tagged[1]))


@query(
    "P9_region",
    f"SELECT metacell, bin1, bin2, value FROM mcpix500 WHERE chrom_ord = 1 AND bin1 BETWEEN 4 AND 17 AND bin2 BETWEEN 4 AND 17",
)
def region(spark, sf):
    order, first, stop = maps.region_bounds(GENOME, "chr2", 2_300_000, 8_600_000, 500_000)
    return maps.in_region(metacell_maps(spark, sf, 500_000), order, first, stop).select("metacell", "bin1", "bin2", "value")


def coverage_weights(mc):
    """Stand-in weights for region queries: inverse root of a bin's coverage, absent on thin bins."""
    cover = binning.symmetrize(mc).groupBy("metacell", "chrom_ord", F.col("bin1").alias("bin")).agg(F.sum("value").alias("s"))
    return cover.where(F.col("s") >= 3).select("metacell", "chrom_ord", "bin", (1 / F.sqrt("s")).alias("weight"))


WEIGHT_SQL = """wts AS (SELECT metacell, chrom_ord, bin, 1 / sqrt(s) AS weight FROM (SELECT metacell, chrom_ord, bin1 AS bin, sum(value) AS s FROM (
    SELECT metacell, chrom_ord, bin1, value * CASE WHEN bin1 = bin2 THEN 2 ELSE 1 END AS value FROM mcpix500
    UNION ALL SELECT metacell, chrom_ord, bin2, value FROM mcpix500 WHERE bin1 <> bin2) GROUP BY 1, 2, 3) WHERE s >= 3),
bal AS (SELECT p.metacell, p.chrom_ord, p.bin1, p.bin2, p.value * a.weight * b.weight AS value FROM mcpix500 p
  LEFT JOIN wts a ON a.metacell = p.metacell AND a.chrom_ord = p.chrom_ord AND a.bin = p.bin1
  LEFT JOIN wts b ON b.metacell = p.metacell AND b.chrom_ord = p.chrom_ord AND b.bin = p.bin2)"""


@query("J4_balanced_values", f"SELECT metacell, {big('chrom_ord', 'chrom_ord')}, bin1, bin2, {r6('value', 'value')} FROM bal", WEIGHT_SQL)
def balanced_values(spark, sf):
    mc = metacell_maps(spark, sf, 500_000)
    return _long(maps.balanced(mc, coverage_weights(mc))).select("metacell", "chrom_ord", "bin1", "bin2", rounded("value"))


@query(
    "P14_display_values",
    f"""SELECT metacell, {big('chrom_ord', 'chrom_ord')}, bin1, bin2, {r6('CASE WHEN bin1 = bin2 THEN 0 ELSE ln(1 + coalesce(value, 0)) END', 'value')} FROM bal""",
    WEIGHT_SQL,
)
def display_values(spark, sf):
    mc = metacell_maps(spark, sf, 500_000)
    shown = maps.balanced(mc, coverage_weights(mc)).withColumn("value", maps.displayed(F.col("value")))
    return _long(shown).select("metacell", "chrom_ord", "bin1", "bin2", rounded("value"))


def _region_sql(keys: str, source: str, key: str, bins: str) -> str:
    lo, hi = bins.split(":")
    return f"""reg AS (SELECT k.{key}, a.b AS bin1, b.b AS bin2, CASE WHEN a.b = b.b THEN 0 ELSE ln(1 + coalesce(m.value, 0)) END AS value
  FROM ({keys}) k CROSS JOIN (SELECT unnest(range({lo}, {hi})) AS b) a CROSS JOIN (SELECT unnest(range({lo}, {hi})) AS b) b
  LEFT JOIN ({source}) m ON m.{key} = k.{key} AND m.bin1 = least(a.b, b.b) AND m.bin2 = greatest(a.b, b.b))"""


@query(
    "R1_metacell_region",
    f"SELECT metacell, {big('bin1', 'bin1')}, {big('bin2', 'bin2')}, {r6('value', 'value')} FROM reg",
    _region_sql("SELECT 3 AS metacell", "SELECT * FROM mcpix500 WHERE chrom_ord = 0", "metacell", "0:20"),
)
def metacell_region(spark, sf):
    mc = metacell_maps(spark, sf, 500_000)
    keys = spark.range(3, 4).toDF("metacell")
    out = maps.region_map(mc, keys, GENOME, "chr1", 0, 10_000_000, 500_000)
    return out.withColumn("value", rounded("value"))


@query(
    "R1_metacell_region_balanced",
    f"SELECT metacell, {big('bin1', 'bin1')}, {big('bin2', 'bin2')}, {r6('value', 'value')} FROM reg",
    WEIGHT_SQL + ",\n" + _region_sql("SELECT 3 AS metacell", "SELECT * FROM bal WHERE chrom_ord = 0", "metacell", "0:20"),
)
def metacell_region_balanced(spark, sf):
    mc = metacell_maps(spark, sf, 500_000)
    keys = spark.range(3, 4).toDF("metacell")
    out = maps.region_map(mc, keys, GENOME, "chr1", 0, 10_000_000, 500_000, weights=coverage_weights(mc))
    return out.withColumn("value", rounded("value"))


@query(
    "R1_metacell_region_filtered",
    f"SELECT metacell, {big('bin1', 'bin1')}, {big('bin2', 'bin2')}, {r6('value', 'value')} FROM reg",
    FLOOR_SQL + ",\n" + _region_sql("SELECT 3 AS metacell", "SELECT * FROM matmap WHERE chrom_ord = 0", "metacell", "0:10"),
)
def metacell_region_filtered(spark, sf):
    mc = maps.filtered_metacell_maps(fx.pixels(spark, sf), fx.cells(spark, sf))
    keys = spark.range(3, 4).toDF("metacell")
    out = maps.region_map(mc, keys, GENOME, "chr1", 0, 10_000_000, MB, symmetric=True)
    return out.withColumn("value", rounded("value"))


_FIRST_CELL = "SELECT min(cell_id) AS cell_id FROM cells WHERE metacell = 3"


@query(
    "R2_cell_region",
    f"SELECT cell_id, {big('bin1', 'bin1')}, {big('bin2', 'bin2')}, {r6('value', 'value')} FROM reg",
    _region_sql(_FIRST_CELL, "SELECT * FROM sym WHERE chrom_ord = 0 AND bin1 <= bin2", "cell_id", "0:10"),
)
def cell_region(spark, sf):
    first = fx.cells(spark, sf).where(F.col("metacell") == 3).agg(F.min("cell_id").alias("cell_id"))
    out = maps.region_map(fx.pixels(spark, sf), first, GENOME, "chr1", 0, 10_000_000, MB, double_diagonal=True)
    return out.withColumn("value", rounded("value"))


@query(
    "R3_cell_type_regions",
    f"SELECT metacell, {big('bin1', 'bin1')}, {big('bin2', 'bin2')}, {r6('value', 'value')} FROM reg",
    SCORES_SQL + ",\n" + _region_sql("SELECT metacell FROM mc WHERE cell_type = 'type_1'", "SELECT * FROM mcpix500 WHERE chrom_ord = 2", "metacell", "5:25"),
)
def cell_type_regions(spark, sf):
    cells = fx.cells(spark, sf)
    chosen = evaluate.metacell_scores(cells).where(F.col("cell_type") == "type_1").select("metacell")
    out = maps.region_map(metacell_maps(spark, sf, 500_000), chosen, GENOME, "chr3", 2_500_000, 12_500_000, 500_000)
    return out.withColumn("value", rounded("value"))


@query(
    "R4_all_metacell_regions",
    f"SELECT r.metacell, m.cell_type, {big('bin1', 'bin1')}, {big('bin2', 'bin2')}, {r6('value', 'value')} FROM reg r JOIN mc m USING (metacell)",
    SCORES_SQL + ",\n" + _region_sql("SELECT DISTINCT metacell FROM cells", "SELECT * FROM mcpix500 WHERE chrom_ord = 2", "metacell", "5:25"),
)
def all_metacell_regions(spark, sf):
    cells = fx.cells(spark, sf)
    scores = evaluate.metacell_scores(cells).select("metacell", "cell_type")
    out = maps.region_map(
        metacell_maps(spark, sf, 500_000), scores.select("metacell"), GENOME, "chr3", 2_500_000, 12_500_000, 500_000
    )
    return out.join(scores, "metacell").withColumn("value", rounded("value"))


def _taps_sql(sigma: int = 3, radius: int = 12) -> str:
    return f"""(SELECT o, exp(-0.5 * (o / CAST({sigma} AS DOUBLE)) * (o / CAST({sigma} AS DOUBLE))) / sum(exp(-0.5 * (o / CAST({sigma} AS DOUBLE)) * (o / CAST({sigma} AS DOUBLE)))) OVER () AS t
    FROM (SELECT unnest(range(-{radius}, {radius + 1})) AS o))"""


def oe_sql(keys: str, source: str, key: str, n: int) -> str:
    """CTEs dn (dense), cov, curve, smooth, oe for dense n x n maps of `source` (upper triangle, local bins 0..n-1)."""
    return f"""dn AS (SELECT k.{key}, a.b AS bin1, b.b AS bin2, coalesce(m.value, 0) AS value
  FROM ({keys}) k CROSS JOIN (SELECT unnest(range(0, {n})) AS b) a CROSS JOIN (SELECT unnest(range(0, {n})) AS b) b
  LEFT JOIN ({source}) m ON m.{key} = k.{key} AND m.bin1 = least(a.b, b.b) AND m.bin2 = greatest(a.b, b.b)),
cov AS (SELECT {key}, bin1 AS bin, 2 * sum(value) AS c FROM dn GROUP BY 1, 2),
bad AS (SELECT {key}, bin FROM (SELECT *, avg(c) OVER (PARTITION BY {key}) AS a FROM cov) WHERE c < 0.05 * a),
curve AS (SELECT {key}, bin2 - bin1 AS d, coalesce(avg(value) FILTER (WHERE value > 0), 0) AS e FROM dn WHERE bin2 >= bin1 GROUP BY 1, 2),
smooth AS (SELECT p.{key}, p.d, sum(t.t * q.e) AS e FROM curve p CROSS JOIN {_taps_sql()} t
  JOIN curve q ON q.{key} = p.{key} AND q.d = least((p.d + t.o + {4 * n}) % {2 * n}, {2 * n - 1} - (p.d + t.o + {4 * n}) % {2 * n}) GROUP BY 1, 2),
oe AS (SELECT dn.{key}, bin1, bin2, CASE WHEN x.bin IS NOT NULL OR y.bin IS NOT NULL THEN 0
    ELSE log2((value + 1) / (greatest(e, 0) + 1)) END AS value
  FROM dn JOIN smooth s ON s.{key} = dn.{key} AND s.d = abs(bin2 - bin1)
  LEFT JOIN bad x ON x.{key} = dn.{key} AND x.bin = bin1 LEFT JOIN bad y ON y.{key} = dn.{key} AND y.bin = bin2)"""


# a unit is a metacell or cell and a chromosome
_MC_MAPS = "SELECT metacell * 6 + chrom_ord AS unit, bin1, bin2, value FROM mcpix500"
_MC_UNITS = "SELECT DISTINCT c.metacell * 6 + x.chrom_ord AS unit FROM cells c, chrom_sizes x"
_OF_UNIT = f"{big('unit // 6', 'metacell')}, {big('unit % 6', 'chrom_ord')}"
_CHR3_CUT = "SELECT metacell, bin1 - 5 AS bin1, bin2 - 5 AS bin2, value FROM mcpix500 WHERE chrom_ord = 2 AND bin1 >= 5 AND bin2 < 25"


def whole_maps(spark, sf, pixels, keys, bins):
    """Raw dense maps of every chromosome of every key row; all six chromosomes have the same number of bins."""
    units = keys.select("*", F.explode(F.array(*[F.lit(i) for i in range(6)])).alias("chrom_ord"))
    return maps.dense_region(units, binning.symmetrize(pixels, double_diagonal=False), 0, bins)


def metacell_whole_maps(spark, sf):
    return whole_maps(spark, sf, metacell_maps(spark, sf, 500_000), metacells(spark, sf), 40)


def dense_maps(spark, sf, keys, first=0, stop=40):
    """Raw dense chr3 maps with bins counted from the region start."""
    mc = maps.in_region(metacell_maps(spark, sf, 500_000), 2, first, stop)
    dense = maps.dense_region(keys, binning.symmetrize(mc, double_diagonal=False), first, stop)
    return dense.withColumns({"bin1": F.col("bin1") - first, "bin2": F.col("bin2") - first})


def metacells(spark, sf):
    return fx.cells(spark, sf).select("metacell").distinct()


@query("A20_decay_curve", f"SELECT {_OF_UNIT}, {big('d', 'distance')}, {r6('e', 'expected')} FROM curve", oe_sql(_MC_UNITS, _MC_MAPS, "unit", 40))
def decay_curve(spark, sf):
    return _long(maps.decay_curve(metacell_whole_maps(spark, sf), maps.MAP)).withColumn("expected", rounded("expected"))


@query(
    "A21_low_coverage_bins",
    f"SELECT {big('unit // 6', 'cell_id')}, {big('unit % 6', 'chrom_ord')}, {big('bin', 'bin')} FROM bad",
    oe_sql("SELECT c.cell_id * 6 + x.chrom_ord AS unit FROM cells c, chrom_sizes x", "SELECT cell_id * 6 + chrom_ord AS unit, bin1, bin2, value FROM pix", "unit", 20),
)
def low_coverage_bins(spark, sf):
    chroms = F.explode(F.array(*[F.lit(i) for i in range(6)])).alias("chrom_ord")
    owners = fx.cells(spark, sf).select("cell_id", chroms)
    n = GENOME.n_bins(F.col("chrom_ord"), MB)
    return _long(maps.low_coverage_bins_of_pixels(fx.pixels(spark, sf), owners, ["cell_id", "chrom_ord"], n))


def dense_cells(spark, sf, keys):
    cut = maps.in_region(fx.pixels(spark, sf), 2, 0, 20)
    return maps.dense_region(keys, binning.symmetrize(cut, double_diagonal=False), 0, 20)


@query("W3_smoothed_curve", f"SELECT {_OF_UNIT}, {big('d', 'distance')}, {r6('e', 'expected')} FROM smooth", oe_sql(_MC_UNITS, _MC_MAPS, "unit", 40))
def smoothed_curve(spark, sf):
    from contactmill.operators.insulation import gaussian_smooth

    curve = maps.decay_curve(metacell_whole_maps(spark, sf), maps.MAP)
    return _long(gaussian_smooth(curve, maps.MAP, "distance", "expected", 40)).withColumn("expected", rounded("expected"))


_OE_OUT = "SELECT {key}, " + big("bin1", "bin1") + ", " + big("bin2", "bin2") + ", " + r6("value", "value") + " FROM oe"


@query("M21_observed_expected", _OE_OUT.format(key=_OF_UNIT), oe_sql(_MC_UNITS, _MC_MAPS, "unit", 40))
def observed_expected(spark, sf):
    out = maps.observed_over_expected(metacell_whole_maps(spark, sf), maps.MAP, 40)
    return _long(out).withColumn("value", rounded("value"))


@query(
    "J5_expected_join",
    f"SELECT {_OF_UNIT}, {big('bin1', 'bin1')}, {big('bin2', 'bin2')}, {r6('dn.value', 'observed')}, {r6('c.e', 'expected')} FROM dn JOIN curve c USING (unit) WHERE c.d = abs(bin2 - bin1)",
    oe_sql(_MC_UNITS, _MC_MAPS, "unit", 40),
)
def expected_join(spark, sf):
    dense = metacell_whole_maps(spark, sf)
    paired = dense.withColumn("distance", F.abs(F.col("bin2") - F.col("bin1"))).join(maps.decay_curve(dense, maps.MAP), [*maps.MAP, "distance"])
    return _long(paired.select(*maps.MAP, "bin1", "bin2", rounded("value", "observed"), rounded("expected")))


@query("R5_metacell_region_oe", _OE_OUT.format(key="metacell"), oe_sql("SELECT 3 AS metacell", _CHR3_CUT, "metacell", 20))
def metacell_region_oe(spark, sf):
    dense = dense_maps(spark, sf, spark.range(3, 4).toDF("metacell"), 5, 25)
    return maps.observed_over_expected(dense, ["metacell"], 20).withColumn("value", rounded("value"))


@query(
    "R5_cell_region_oe",
    _OE_OUT.format(key="cell_id"),
    oe_sql(_FIRST_CELL, "SELECT cell_id, bin1, bin2, value FROM pix WHERE chrom_ord = 2", "cell_id", 20),
)
def cell_region_oe(spark, sf):
    first = fx.cells(spark, sf).where(F.col("metacell") == 3).agg(F.min("cell_id").alias("cell_id"))
    return maps.observed_over_expected(dense_cells(spark, sf, first), ["cell_id"], 20).withColumn("value", rounded("value"))


@query(
    "R5_cell_type_regions_oe",
    _OE_OUT.format(key="metacell"),
    SCORES_SQL + ",\n" + oe_sql("SELECT metacell FROM mc WHERE cell_type = 'type_1'", _CHR3_CUT, "metacell", 20),
)
def cell_type_regions_oe(spark, sf):
    chosen = evaluate.metacell_scores(fx.cells(spark, sf)).where(F.col("cell_type") == "type_1").select("metacell")
    return maps.observed_over_expected(dense_maps(spark, sf, chosen, 5, 25), ["metacell"], 20).withColumn("value", rounded("value"))


def _plain_steps_sql(steps: int) -> str:
    """Filters of the balancing operator and a fixed number of plain steps, unrolled."""
    parts = [
        """gpix AS (SELECT metacell, least(pos1 // 1000000 + 20 * c1, pos2 // 1000000 + 20 * c2) AS b1,
    greatest(pos1 // 1000000 + 20 * c1, pos2 // 1000000 + 20 * c2) AS b2, CAST(count(*) AS DOUBLE) AS v
  FROM located JOIN cells USING (cell_id) GROUP BY 1, 2, 3),
side AS (SELECT metacell, b1, b2, v FROM gpix WHERE b1 // 20 <> b2 // 20 OR b2 - b1 >= 2 UNION ALL
  SELECT metacell, b2, b1, v FROM gpix WHERE b1 // 20 <> b2 // 20 OR b2 - b1 >= 2),
raw AS (SELECT o.metacell, g.b, coalesce(s.nnz, 0) AS nnz, coalesce(s.c, 0) AS c
  FROM (SELECT DISTINCT metacell FROM gpix) o CROSS JOIN (SELECT unnest(range(0, 120)) AS b) g
  LEFT JOIN (SELECT metacell, b1, count(*) AS nnz, sum(v) AS c FROM side GROUP BY 1, 2) s ON s.metacell = o.metacell AND s.b1 = g.b),
mid AS (SELECT metacell, b // 20 AS chrom, median(c) AS m FROM raw WHERE c > 0 GROUP BY 1, 2),
rel AS (SELECT r.*, coalesce(r.c / m.m, 0) AS rel FROM raw r LEFT JOIN mid m ON m.metacell = r.metacell AND m.chrom = r.b // 20),
centre AS (SELECT metacell, median(ln(rel)) AS ce FROM rel WHERE rel > 0 GROUP BY 1),
spread AS (SELECT r.metacell, median(abs(ln(rel) - ce)) AS mad, any_value(ce) AS ce FROM rel r JOIN centre USING (metacell)
  WHERE rel > 0 GROUP BY 1),
w0 AS (SELECT r.metacell, r.b, CASE WHEN nnz >= 10 AND rel >= exp(ce - 5 * mad) THEN 1.0::DOUBLE ELSE 0 END AS w
  FROM rel r LEFT JOIN spread USING (metacell))"""
    ]
    for i in range(steps):
        parts.append(f"""m{i} AS (SELECT w.metacell, w.b, w.w, w.w * coalesce(s.r, 0) AS marg FROM w{i} w LEFT JOIN
  (SELECT x.metacell, x.b1, sum(x.v * y.w) AS r FROM side x JOIN w{i} y ON y.metacell = x.metacell AND y.b = x.b2 GROUP BY 1, 2) s
  ON s.metacell = w.metacell AND s.b1 = w.b),
w{i + 1} AS (SELECT metacell, b, marg, CASE WHEN marg = 0 THEN w ELSE w / (marg / avg(marg) FILTER (WHERE marg <> 0) OVER (PARTITION BY metacell)) END AS w FROM m{i})""")
    return ",\n".join(parts)


@query(
    "M20_balance_steps",
    f"""SELECT metacell, {big('b // 20', 'chrom_ord')}, {big('b % 20', 'bin')}, {r6('CASE WHEN w <> 0 THEN w / sqrt(mean) END', 'weight')}
FROM (SELECT *, avg(marg) FILTER (WHERE marg <> 0) OVER (PARTITION BY metacell) AS mean FROM w3)""",
    _plain_steps_sql(3),
)
def balance_steps(spark, sf):
    """Three plain steps, for the exact check."""
    weights = balance.balance(genome_wide_maps(spark, sf), GENOME, MB, max_iters=3)
    return _long(weights).select("metacell", "chrom_ord", "bin", rounded("weight"))


#: All plain steps of the default settings; a map that has converged stays as it is.
_ALL_STEPS_SQL = _plain_steps_sql(0) + """,
step AS (SELECT 0 AS i, metacell, b, w, false AS done, NULL::DOUBLE AS scale FROM w0 UNION ALL
  SELECT i + 1, metacell, b, CASE WHEN done OR marg = 0 THEN w ELSE w / (marg / mean) END,
    done OR mean IS NULL OR spread < 1e-5, CASE WHEN done THEN scale ELSE mean END
  FROM (SELECT *, avg(marg) FILTER (WHERE marg <> 0) OVER (PARTITION BY metacell) AS mean,
      var_pop(marg) FILTER (WHERE marg <> 0) OVER (PARTITION BY metacell) AS spread
    FROM (SELECT t.*, t.w * coalesce(s.r, 0) AS marg FROM step t LEFT JOIN
      (SELECT x.metacell, x.b1, sum(x.v * y.w) AS r FROM side x JOIN step y ON y.metacell = x.metacell AND y.b = x.b2 GROUP BY 1, 2) s
      ON s.metacell = t.metacell AND s.b1 = t.b)) WHERE i < 100)"""


@query(
    "M20_balance_weights",
    f"""SELECT metacell, {big('b // 20', 'chrom_ord')}, {big('b % 20', 'bin')}, {r6('CASE WHEN w <> 0 THEN w / sqrt(scale) END', 'weight')},
  done AS converged FROM step WHERE i = (SELECT max(i) FROM step)""",
    _ALL_STEPS_SQL,
    recursive=True,
)
def balance_weights(spark, sf):
    """The default settings; thin maps may stay unconverged, as the flag says."""
    weights = balance.balance(genome_wide_maps(spark, sf), GENOME, MB)
    return _long(weights).withColumn("weight", rounded("weight"))


@query("S5_bulk_choice", f"""SELECT {big('chrom_ord', 'chrom_ord')}, {big('bin1', 'bin1')}, {big('bin2', 'bin2')}, {r6('value', 'value')} FROM (
  SELECT chrom_ord, bin1, bin2, value * 20 / sum(value) OVER (PARTITION BY chrom_ord) AS value FROM bulk0 WHERE chrom_ord < 3
  UNION ALL SELECT chrom_ord, bin1, bin2, value FROM bulk WHERE chrom_ord >= 3 AND value > 0)""", BULK_SQL)
def bulk_choice(spark, sf):
    from contactmill.sources.tables import choose_bulk

    pix = fx.pixels(spark, sf)
    # the given map fits the first three chromosomes only
    given = (
        binning.symmetrize(pix)
        .groupBy("chrom_ord", "bin1", "bin2")
        .agg(F.sum("value").alias("value"))
        .withColumn("n_bins", F.when(F.col("chrom_ord") < 3, 20).otherwise(21))
    )
    out = choose_bulk(given, features.pseudo_bulk(pix, GENOME, MB), GENOME, MB)
    return _long(out).withColumn("value", rounded("value"))
