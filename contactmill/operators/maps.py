"""Metacell maps: sums over member cells, coarsening, regions, balanced and observed/expected values."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from contactmill.genome import Genome
from contactmill.operators.binning import coarsen, symmetrize
from contactmill.scale import with_totals

MAP = ["metacell", "chrom_ord"]


def metacell_pixels(pixels: DataFrame, cells: DataFrame, keys: Sequence[str] = ("chrom_ord", "bin1", "bin2")) -> DataFrame:
    """Sum of the members' pixels. Cells are summed to pixels before this join, so a hot cell is small here."""
    joined = pixels.join(cells.select("cell_id", "metacell"), "cell_id")
    return joined.groupBy("metacell", *keys).agg(F.sum("value").alias("value"))


def filtered_metacell_maps(pixels: DataFrame, cells: DataFrame, pct: float = 20.0, keep_first: bool = True) -> DataFrame:
    """Sum of symmetric per-cell maps after dropping, in each cell and chromosome, values below a percentile.

    The first member (lowest cell_id) is added whole when keep_first is set. Counts repeat heavily inside a map,
    so the percentile works on value counts of one cell and chromosome.
    """
    full = symmetrize(pixels).join(cells.select("cell_id", "metacell"), "cell_id")
    floors = full.groupBy("cell_id", "chrom_ord").agg(F.percentile("value", F.lit(pct / 100.0)).alias("_floor"))
    kept = F.col("value") >= F.col("_floor")
    if keep_first:
        firsts = cells.groupBy("metacell").agg(F.min("cell_id").alias("_first"))
        full = full.join(firsts, "metacell")
        kept = kept | (F.col("cell_id") == F.col("_first"))
    return (
        full.join(floors, ["cell_id", "chrom_ord"])
        .where(kept)
        .groupBy(*MAP, "bin1", "bin2")
        .agg(F.sum("value").alias("value"))
    )


def consensus_maps(pixels: DataFrame, cells: DataFrame, target_sum: float = 1e5) -> DataFrame:
    """Sum of log1p maps, each cell and chromosome scaled to the same total."""
    logs = symmetrize(pixels).withColumn("value", F.log1p("value"))
    shared = with_totals(logs, ["cell_id", "chrom_ord"], _total=F.sum("value"))
    scaled = shared.withColumn("value", F.col("value") / F.col("_total") * F.lit(float(target_sum))).drop("_total")
    return metacell_pixels(scaled, cells)


def cis_maps(maps: DataFrame) -> DataFrame:
    """The maps inside chromosomes of maps that hold both ends' chromosomes."""
    return maps.where(F.col("chrom_ord") == F.col("chrom_ord2")).drop("chrom_ord2")


def coarsened_maps(maps: DataFrame, base: int, resolutions: Sequence[int]) -> dict[int, DataFrame]:
    """Coarser maps, each from the largest finer resolution that divides it; trans pixels too where maps hold them."""
    keys = [*MAP, "chrom_ord2"] if "chrom_ord2" in maps.columns else MAP
    out = {base: maps}
    for resolution in sorted(set(resolutions) - {base}):
        finer = [r for r in out if resolution % r == 0]
        if not finer:
            raise ValueError(f"{resolution} is not a multiple of {base}")
        source = max(finer)
        out[resolution] = coarsen(out[source], resolution // source, keys)
    return out


def region_bounds(genome: Genome, chrom: str, start: int, end: int, resolution: int) -> tuple[int, int, int]:
    """(chromosome ordinal, first bin, bin after the last), clamped to the chromosome."""
    if chrom not in genome.names:
        raise ValueError(f"unknown chromosome {chrom}")
    order = genome.names.index(chrom)
    return order, max(0, start // resolution), min(genome.bins(resolution)[order], -(-end // resolution))


def in_region(maps: DataFrame, chrom_ord: int, first: int, stop: int) -> DataFrame:
    """Rows with both bins inside the region; on a stored table the filter reaches the scan."""
    return maps.where(
        (F.col("chrom_ord") == chrom_ord) & F.col("bin1").between(first, stop - 1) & F.col("bin2").between(first, stop - 1)
    )


def balanced(maps: DataFrame, weights: DataFrame) -> DataFrame:
    """value * weight(bin1) * weight(bin2); bins without a weight give NULL."""
    for side in ("bin1", "bin2"):
        w = weights.select(*MAP, F.col("bin").alias(side), F.col("weight").alias(f"_w_{side}"))
        maps = maps.join(w, [*MAP, side], "left")
    scaled = F.col("value") * F.col("_w_bin1") * F.col("_w_bin2")
    return maps.withColumn("value", scaled).drop("_w_bin1", "_w_bin2")


def displayed(value: Column, log1p: bool = True, zero_diagonal: bool = True) -> Column:
    """Missing to 0, then log1p, then an empty diagonal."""
    out = F.coalesce(value, F.lit(0.0))
    if log1p:
        out = F.log1p(out)
    return F.when(F.col("bin1") == F.col("bin2"), F.lit(0.0)).otherwise(out) if zero_diagonal else out


def dense_region(keys: DataFrame, pixels: DataFrame, first: int, stop: int) -> DataFrame:
    """Every (bin1, bin2) of a square region for each key row; absent pixels are 0, present NULLs stay NULL."""
    axis = F.sequence(F.lit(first).cast("long"), F.lit(stop - 1).cast("long"))
    cells = keys.select("*", F.explode(axis).alias("bin1")).select("*", F.explode(axis).alias("bin2"))
    found = pixels.select(*keys.columns, "bin1", "bin2", "value", F.lit(True).alias("_seen"))
    return cells.join(found, [*keys.columns, "bin1", "bin2"], "left").select(
        *keys.columns, "bin1", "bin2", F.when(F.col("_seen"), F.col("value")).otherwise(F.lit(0.0)).alias("value")
    )


def region_map(
    maps: DataFrame,
    keys: DataFrame,
    genome: Genome,
    chrom: str,
    start: int,
    end: int,
    resolution: int,
    *,
    symmetric: bool = False,
    double_diagonal: bool = False,
    weights: DataFrame | None = None,
    log1p: bool = True,
    zero_diagonal: bool = True,
) -> DataFrame:
    """Displayed square region of the maps named by the key rows (metacell or cell_id).

    `symmetric` says the maps already hold both triangles; upper-triangle maps are mirrored after the cut, so that the
    region reaches the scan. Their diagonal is taken once, as a fetch from a pixel store does, or twice, as M + M^T has it.
    Weights apply before mirroring.
    """
    order, first, stop = region_bounds(genome, chrom, start, end, resolution)
    cut = in_region(maps, order, first, stop)
    cut = cut.join(keys, keys.columns, "left_semi")
    if weights is not None:
        cut = balanced(cut, weights)
    if not symmetric:
        cut = symmetrize(cut, double_diagonal=double_diagonal)
    grid = dense_region(keys, cut, first, stop)
    return grid.withColumn("value", displayed(F.col("value"), log1p, zero_diagonal))


def low_coverage_bins(dense: DataFrame, keys: Sequence[str], threshold: float = 0.05) -> DataFrame:
    """Bins of a dense map whose row plus column sum stays below a share of the mean over all bins."""
    sides = dense.select(*keys, F.explode(F.array("bin1", "bin2")).alias("bin"), "value")
    cover = sides.groupBy(*keys, "bin").agg(F.sum("value").alias("coverage"))
    mean = cover.groupBy(*keys).agg((F.avg("coverage") * threshold).alias("_limit"))
    return cover.join(mean, list(keys)).where(F.col("coverage") < F.col("_limit")).select(*keys, "bin")


def low_coverage_bins_of_pixels(
    pixels: DataFrame, owners: DataFrame, keys: Sequence[str], n: Column, threshold: float = 0.05
) -> DataFrame:
    """`low_coverage_bins` of the dense maps behind upper-triangle pixels, without their zeros: bins 0..n-1 of the owners'
    maps (one row of `owners` with `keys` per map). A map without pixels has no bin below its mean."""
    ends = F.array("bin1", "bin2")  # either end meets a pixel and its mirror once; on the diagonal both are one entry
    placed = pixels.select(*keys, F.explode(ends).alias("bin"), (F.col("value") * F.when(F.col("bin1") == F.col("bin2"), 1.0).otherwise(2.0)).alias("value"))
    cover = placed.groupBy(*keys, "bin").agg(F.sum("value").alias("c"))
    curves = cover.groupBy(*keys).agg((F.sum("c") / F.max(n) * threshold).alias("_limit"), F.collect_list(F.struct("bin", "c")).alias("_c"))
    enough = F.transform(F.filter("_c", lambda x: x["c"] >= F.col("_limit")), lambda x: x["bin"])
    absent = F.when(F.col("_limit") > 0, F.array_except(F.sequence(F.lit(0).cast("long"), n - 1), enough)).otherwise(
        F.transform(F.filter("_c", lambda x: x["c"] < F.col("_limit")), lambda x: x["bin"])
    )
    return curves.join(owners.select(*keys).distinct(), list(keys), "left_semi").select(*keys, F.explode(absent).alias("bin"))


def decay_curve(dense: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Mean of the positive entries on every diagonal of a dense map, 0 where none is positive."""
    upper = dense.where(F.col("bin2") >= F.col("bin1"))
    positive = F.when(F.col("value") > 0, F.col("value"))
    return upper.groupBy(*keys, (F.col("bin2") - F.col("bin1")).alias("distance")).agg(
        F.coalesce(F.avg(positive), F.lit(0.0)).alias("expected")
    )


def observed_over_expected(
    dense: DataFrame,
    keys: Sequence[str],
    n: int,
    pseudocount: float = 1.0,
    threshold: float = 0.05,
    log2: bool = True,
) -> DataFrame:
    """(O + p) / (E + p) of a dense n x n map, E the smoothed decay curve; low-coverage bins read 1."""
    from contactmill.operators.insulation import gaussian_smooth

    keys = list(keys)
    curve = gaussian_smooth(decay_curve(dense, keys), keys, "distance", "expected", n, sigma=3.0)
    bad = low_coverage_bins(dense, keys, threshold)
    out = dense.withColumn("distance", F.abs(F.col("bin2") - F.col("bin1"))).join(curve, [*keys, "distance"])
    for side in ("bin1", "bin2"):
        flagged = bad.select(*keys, F.col("bin").alias(side), F.lit(True).alias(f"_bad_{side}"))
        out = out.join(flagged, [*keys, side], "left")
    ratio = (F.col("value") + pseudocount) / (F.greatest("expected", F.lit(0.0)) + pseudocount)
    ratio = F.when(F.col("_bad_bin1") | F.col("_bad_bin2"), F.lit(1.0)).otherwise(ratio)
    return out.select(*keys, "bin1", "bin2", (F.log2(ratio) if log2 else ratio).alias("value"))
