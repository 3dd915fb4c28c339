"""From pixels to per-cell features: bulk maps, smoothing, batch correction, feature blocks."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from contactmill.genome import Genome, bin_table
from contactmill.operators import cellmaps
from contactmill.operators.binning import symmetrize
from contactmill.operators.insulation import gaussian_taps
from contactmill.operators.stats import spearman
from contactmill.scale import with_totals
from contactmill.session import materialize

CELL_MAP = ["cell_id", "chrom_ord"]
TINY = 1e-15  # fixed value added to denominators


def pseudo_bulk(pixels: DataFrame, genome: Genome, resolution: int, clip_sd: float = 10.0) -> DataFrame:
    """Row-normalised sum of all cells: symmetric, unit diagonal for rows that are empty in the upper triangle,
    clipped at mean + clip_sd * sd over all n^2 entries (taken from sums, no dense map)."""
    upper = pixels.groupBy("chrom_ord", "bin1", "bin2").agg(F.sum("value").alias("value"))
    bins = bin_table(pixels.sparkSession, genome, resolution).select("chrom_ord", F.col("bin").alias("bin1"))
    empty = bins.join(upper.select("chrom_ord", "bin1").distinct(), ["chrom_ord", "bin1"], "left_anti")
    full = symmetrize(upper).unionByName(
        empty.select("chrom_ord", "bin1", F.col("bin1").alias("bin2"), F.lit(1.0).alias("value"))
    )
    n = genome.n_bins(F.col("chrom_ord"), resolution)
    sums = full.groupBy("chrom_ord").agg(F.sum("value").alias("s"), F.sum(F.col("value") * F.col("value")).alias("ss"))
    mean = F.col("s") / (n * n)
    sd = F.sqrt(F.greatest(F.col("ss") / (n * n) - mean * mean, F.lit(0.0)))
    limits = F.broadcast(sums.select("chrom_ord", (mean + sd * clip_sd).alias("_limit")))  # one row per chromosome
    clipped = full.join(limits, "chrom_ord").withColumn("value", F.least("value", "_limit")).drop("_limit")
    normed = with_totals(clipped, ["chrom_ord", "bin1"], _row=F.sum("value"))
    return normed.select("chrom_ord", "bin1", "bin2", (F.col("value") / F.col("_row")).alias("value"))


def pooled_columns(bulk: DataFrame, genome: Genome, resolution: int, wide: int = 3000) -> DataFrame:
    """Average of neighbouring columns of bulk rows on chromosomes with at least `wide` bins; a ragged tail goes."""
    sizes = genome.bins(resolution)
    steps = [int(round(n / wide)) if n >= wide else 1 for n in sizes]
    step = F.element_at(F.array(*[F.lit(s).cast("long") for s in steps]), F.col("chrom_ord") + 1)
    n = genome.n_bins(F.col("chrom_ord"), resolution)
    slot = F.floor(F.col("bin2") / step).cast("long")
    return (
        bulk.where(slot < F.floor(n / step))
        .groupBy("chrom_ord", "bin1", slot.alias("slot"))
        .agg((F.sum("value") / F.max(step)).alias("value"))
    )


def depth_scaled_adjacency(pixels: DataFrame, cells: DataFrame, genome: Genome, resolution: int) -> DataFrame:
    """Symmetric maps without their diagonal, scaled to the mean reads per cell; empty rows get a unit diagonal."""
    off = pixels.where(F.col("bin1") < F.col("bin2"))
    n_cells = cells.select(F.count(F.lit(1))).scalar()
    reads = pixels.groupBy("chrom_ord").agg((F.sum("value") / n_cells).alias("_target"))
    target = F.broadcast(reads)  # one row per chromosome
    chroms = F.sequence(F.lit(0), F.lit(len(genome.chroms) - 1))
    owners = cells.select("cell_id", F.explode(chroms).alias("chrom_ord"))
    sums = off.groupBy(*CELL_MAP).agg(F.sum("value").alias("_sum"))
    factor = (
        owners.join(sums, CELL_MAP, "left")
        .join(target, "chrom_ord", "left")
        .select(*CELL_MAP, (F.coalesce("_target", F.lit(0.0)) / (F.coalesce("_sum", F.lit(0.0)) + TINY)).alias("_factor"))
    )
    full = symmetrize(off)
    n = genome.n_bins(F.col("chrom_ord"), resolution)
    rows = owners.select(*CELL_MAP, F.explode(F.sequence(F.lit(0).cast("long"), n - 1)).alias("bin1"))
    empty = rows.join(full.select(*CELL_MAP, "bin1").distinct(), [*CELL_MAP, "bin1"], "left_anti")
    diagonal = empty.select(*CELL_MAP, "bin1", F.col("bin1").alias("bin2"), F.lit(1.0).alias("value"))
    return (
        full.unionByName(diagonal)
        .join(factor, CELL_MAP)
        .select(*CELL_MAP, "bin1", "bin2", (F.col("value") * F.col("_factor")).alias("value"))
    )


def packed_cell_maps(pixels: DataFrame, genome: Genome, resolution: int) -> DataFrame:
    """Upper triangles of the smoothed maps, one row with the arrays bin1, bin2 and value per cell and chromosome."""
    side, center, _ = gaussian_taps(1.0, 1)
    return cellmaps.smoothed(pixels, genome.bins(resolution), center, side, TINY)


def smoothed_cell_maps(pixels: DataFrame, genome: Genome, resolution: int) -> DataFrame:
    """Symmetric per-cell maps under a 3x3 separable Gaussian (sigma 1, mirrored edges), divided by their total.

    Pixels meet by map, and what they send to at most nine neighbours is summed in the task, for the upper triangle only: the
    maps are symmetric, and the lower one is mirrored after the sum. Mirrored edges keep the mass, so the total is that of
    the pixels.
    """
    return symmetrize(cellmaps.entries_of(packed_cell_maps(pixels, genome, resolution)), double_diagonal=False)


def box_smoothed(maps: DataFrame, n: Column) -> DataFrame:
    """3x3 mean of per-cell maps with zeros outside the map; `maps` holds both triangles."""
    return cellmaps.box_sums(maps, n).withColumn("value", F.col("value") / 9.0)


def batch_coverage(maps: DataFrame, cells: DataFrame, genome: Genome, resolution: int) -> DataFrame:
    """Mean row coverage of each batch and of all cells; `maps` are symmetric per-cell maps.

    The result (bins x batches) is written once, because ranking reads it several times.
    """
    rows = maps.groupBy("cell_id", "chrom_ord", F.col("bin1").alias("bin")).agg(F.sum("value").alias("s"))
    n = genome.n_bins(F.col("chrom_ord"), resolution)
    by_batch = rows.join(cells.select("cell_id", "batch"), "cell_id").groupBy("batch", "chrom_ord", "bin").agg(
        F.sum("s").alias("batch_sum")
    )
    overall = by_batch.groupBy("chrom_ord", "bin").agg(F.sum("batch_sum").alias("all_sum"))
    sizes = cells.groupBy("batch").agg(F.count(F.lit(1)).alias("batch_cells"))
    n_cells = cells.select(F.count(F.lit(1))).scalar()
    chroms = F.sequence(F.lit(0), F.lit(len(genome.chroms) - 1))
    grid = sizes.select("*", F.explode(chroms).alias("chrom_ord")).select(
        "*", F.explode(F.sequence(F.lit(0).cast("long"), n - 1)).alias("bin")
    )
    filled = grid.join(by_batch, ["batch", "chrom_ord", "bin"], "left").join(overall, ["chrom_ord", "bin"], "left")
    return materialize(filled.select(
        "chrom_ord", "batch", "bin",
        F.coalesce(F.col("batch_sum") / F.col("batch_cells") / n, F.lit(0.0)).alias("batch_row"),
        F.coalesce(F.col("all_sum") / n_cells / n, F.lit(0.0)).alias("bulk_row"),
    ))


def batch_agreement(coverage: DataFrame) -> DataFrame:
    """Rank correlation of batch and bulk coverage over bins the bulk covers."""
    return spearman(coverage.where(F.col("bulk_row") > 0), ["chrom_ord", "batch"], "batch_row", "bulk_row")


def batch_corrected(
    packed: DataFrame, cells: DataFrame, coverage: DataFrame, agreement: DataFrame, below: float = 0.8
) -> DataFrame:
    """Rows of poorly agreeing batches rescaled from batch to bulk coverage, each map back to total 1.

    `packed` are the packed maps behind those of `coverage`: joins meet one row per map, and a map's total stays in its row.
    The result holds both triangles, pixel by pixel.
    """
    poor = agreement.where(F.col("spearman") < below).select("chrom_ord", "batch")
    by_bin = F.array_sort(F.collect_list(F.struct("bin", (F.col("bulk_row") / (F.col("batch_row") + TINY)).alias("r"))))
    ratios = materialize(  # one array as long as the chromosome per poor batch; the planner sees its size
        coverage.join(poor, ["chrom_ord", "batch"], "left_semi").groupBy("chrom_ord", "batch").agg(by_bin["r"].alias("_ratio"))
    )
    joined = packed.join(cells.select("cell_id", "batch"), "cell_id").join(ratios, ["chrom_ord", "batch"], "left")

    def at(bin_: Column) -> Column:
        return F.element_at("_ratio", (bin_ + 1).cast("int"))

    def mass(entry: Column) -> Column:
        other = F.when(entry["bin1"] == entry["bin2"], F.lit(0.0)).otherwise(entry["value"] * at(entry["bin2"]))
        return entry["value"] * at(entry["bin1"]) + other

    entries = F.arrays_zip("bin1", "bin2", "value")
    total = F.when(F.col("_ratio").isNotNull(), F.aggregate(entries, F.lit(0.0), lambda s, e: s + mass(e)))
    summed = joined.withColumn("_sum", total)  # before pixels are made, once a map
    pixels = summed.select(*CELL_MAP, "_ratio", "_sum", F.inline(entries))
    both = symmetrize(pixels, double_diagonal=False)
    value = F.when(F.col("_ratio").isNull(), F.col("value")).otherwise(F.try_divide(F.col("value") * at(F.col("bin1")), F.col("_sum")))
    return both.select(*CELL_MAP, "bin1", "bin2", value.alias("value"))


def feature_entries(maps: DataFrame) -> DataFrame:
    """Upper triangle as feature rows; the diagonal forms a block of its own."""
    return maps.where(F.col("bin1") <= F.col("bin2")).withColumn("diagonal", F.col("bin1") == F.col("bin2"))


FEATURE = ["chrom_ord", "bin1", "bin2"]


def common_features(entries: DataFrame, n_cells: Column) -> DataFrame:
    """Entries of features that are positive in more than min(5, n - 2) cells.

    The features are written once: many entries share one, and the planner need not shuffle entries by features where it sees
    that these are few.
    """
    limit = F.least(F.lit(5).cast("long"), n_cells - 2)
    seen = entries.where(F.col("value") > 0).groupBy(*FEATURE).agg(F.count(F.lit(1)).alias("_n"))
    return entries.join(materialize(seen.where(F.col("_n") > limit).drop("_n")), FEATURE, "left_semi")


def clipped_features(entries: DataFrame, sd: float = 10.0) -> DataFrame:
    """Values capped at mean + sd deviations of the stored entries of their block."""
    block = ["chrom_ord", "diagonal"]
    limits = entries.groupBy(*block).agg((F.avg("value") + F.stddev_pop("value") * sd).alias("_limit"))
    return entries.join(F.broadcast(limits), block).withColumn(  # two rows per chromosome
        "value", F.least("value", "_limit")
    ).drop("_limit")


def scaled_features(entries: DataFrame, genome: Genome, resolution: int) -> DataFrame:
    """Both blocks of a cell and chromosome together scaled to the chromosome's length proxy.

    A chromosome with a single block keeps its values.
    """
    lengths = [length_proxy(n, resolution) for n in genome.bins(resolution)]
    length = F.element_at(F.array(*[F.lit(float(x)) for x in lengths]), F.col("chrom_ord") + 1)
    blocks = entries.groupBy("chrom_ord").agg(
        (F.max("diagonal") & ~F.min("diagonal")).alias("_both")  # one row per chromosome
    )
    whole = Window.partitionBy(*CELL_MAP)  # the genome bounds a map; totals joined back would shuffle and sort twice
    shared = entries.withColumn("_sum", F.sum("value").over(whole)).join(F.broadcast(blocks), "chrom_ord")
    scaled = F.try_divide("value", "_sum") * length
    return shared.withColumn("value", F.when(F.col("_both"), scaled).otherwise(F.col("value"))).drop("_sum", "_both")


def length_proxy(n_bins: int, resolution: int) -> int:
    """int(sqrt(pairs) * resolution in Mb)."""
    return int((n_bins * (n_bins - 1) // 2) ** 0.5 / 1_000_000 * resolution)


def embedding_ranks(n_cells: int, genome: Genome, resolution: int) -> list[int]:
    """Components per chromosome: a total from cells and genome length, shared out by length, plus one."""
    lengths = [length_proxy(n, resolution) for n in genome.bins(resolution)]
    total = float(sum(int((n * (n - 1) // 2) ** 0.5 * resolution / 1_000_000) for n in genome.bins(resolution)))
    if len(lengths) > 1:
        size = min(max(int(n_cells * 0.5), int(total * 0.5)), int(n_cells * 0.65))
    else:
        n = genome.bins(resolution)[0]
        size = int(min(n_cells, n * (n - 1) // 2) * 0.8)
    size = min(size, 2400)
    return [int(size / max(total, 1.0) * x) + 1 for x in lengths]


def bin_attributes(spark: SparkSession, genome: Genome, resolution: int) -> DataFrame:
    """One-hot chromosome and coordinate of every bin, scaled by the first chromosome's bin count."""
    count = len(genome.chroms)
    hot = F.transform(F.sequence(F.lit(0), F.lit(count - 1)), lambda i: F.when(i == F.col("chrom_ord"), 1.0).otherwise(0.0))
    return bin_table(spark, genome, resolution).select(
        "chrom_ord", "bin", "gbin", hot.alias("one_hot"),
        (F.col("bin") / F.lit(float(genome.bins(resolution)[0]))).alias("coordinate"),
    )


def cell_covariates(pixels: DataFrame, cells: DataFrame) -> DataFrame:
    """log1p of total reads and one-hot batch (batches in sorted order)."""
    reads = pixels.groupBy("cell_id").agg(F.sum("value").alias("reads"))
    batches = cells.select("batch").distinct().agg(F.array_sort(F.collect_list("batch"))).scalar()
    hot = F.transform(F.col("_all"), lambda b: F.when(b == F.col("batch"), 1.0).otherwise(0.0))
    return (
        cells.join(reads, "cell_id", "left")
        .withColumn("_all", batches)
        .select("cell_id", F.log1p(F.coalesce("reads", F.lit(0.0))).alias("log_reads"), hot.alias("one_hot"))
    )


def _visits(smooth: np.ndarray, restart: float) -> np.ndarray:
    """Where a walk is found in the long run when it starts in each bin (rows), without the starting bins themselves.

    A walk goes on with probability `restart` and begins anew otherwise. Its limit Q obeys Q = (1 - r) I + r Q P, one linear
    system a map; bins without partners keep to themselves. Takes a stack of maps.
    """
    n = smooth.shape[-1]
    eye = np.eye(n)
    links = np.where(eye > 0, 0.0, smooth)
    reach = links.sum(axis=1)
    diagonal = np.arange(n)
    links[:, diagonal, diagonal] = reach == 0
    chances = links / np.where(reach == 0, 1.0, reach)[:, None, :]
    system = (eye - restart * chances).transpose(0, 2, 1)
    limit = np.linalg.solve(system, np.broadcast_to((1 - restart) * eye, system.shape)).transpose(0, 2, 1).copy()
    limit[:, diagonal, diagonal] = 0.0
    return limit


def random_walk_maps(
    pixels: DataFrame,
    genome: Genome,
    resolution: int,
    max_bin: int,
    restart: float = 0.5,
    min_bin: int = 1,
) -> DataFrame:
    """Box-smoothed maps after a random walk with restart, at pairs with min_bin <= bin2 - bin1 < max_bin.

    Dense maps of one size are solved as a stack, as many as fit in cellmaps.STACK numbers and one at least; the size of one
    is set by the genome and the resolution.
    """
    sizes = np.array(genome.bins(resolution))

    def run(starts, cell, chrom, bin1, bin2, value):  # noqa: ANN001, ANN202
        for maps, n, upper in cellmaps.stacks(starts, sizes[chrom[starts]], bin1, bin2, value):
            full = np.pad(upper + upper.transpose(0, 2, 1), ((0, 0), (1, 1), (1, 1)))
            smooth = sum(full[:, i : i + n, j : j + n] for i in range(3) for j in range(3)) / 9.0
            walked = _visits(smooth, restart)
            b1, b2 = np.triu_indices(n, min_bin)
            near = b2 - b1 < max_bin
            b1, b2 = b1[near], b2[near]
            first = starts[maps]
            yield cellmaps.pixel_batch(
                np.repeat(cell[first], len(b1)), np.repeat(chrom[first], len(b1)), np.tile(b1, len(maps)), np.tile(b2, len(maps)),
                walked[:, b1, b2].reshape(-1),
            )

    return cellmaps.by_map(pixels, run, cellmaps.PIXELS)


def top_percent_entries(maps: DataFrame, n: Column, top_percent: float) -> DataFrame:
    """Entries above each dense map's (100 - top_percent) percentile, zeros counted but never stored.

    `maps` holds both triangles of non-negative maps. Pixels are shuffled once; a map is sorted in its task.
    """
    share = (100.0 - top_percent) / 100.0

    def run(starts, cell, chrom, bin1, bin2, value, size):  # noqa: ANN001, ANN202
        number = np.repeat(np.arange(len(starts)), np.diff(np.r_[starts, len(cell)]))
        positive = value > 0
        levels = value[positive][np.lexsort((value[positive], number[positive]))]
        nnz = np.bincount(number[positive], minlength=len(starts))
        first, total = np.cumsum(nnz) - nnz, size[starts].astype(np.int64) ** 2

        def at(rank: np.ndarray) -> np.ndarray:
            """Values at 0-based ranks of the dense sorted maps."""
            beyond = rank - (total - nnz)
            out = np.zeros(len(rank))
            out[beyond >= 0] = levels[(first + beyond)[beyond >= 0]]
            return out

        spot = (total - 1) * share
        low = np.floor(spot).astype(np.int64)
        below = at(low)
        cut = below + (at(np.minimum(low + 1, total - 1)) - below) * (spot - low)
        kept = positive & (value > cut[number])
        yield cellmaps.pixel_batch(cell[kept], chrom[kept], bin1[kept], bin2[kept], value[kept])

    return cellmaps.by_map(maps.where(n.isNotNull()), run, cellmaps.PIXELS, [n.cast("long").alias("_n")])
