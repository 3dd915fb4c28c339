"""Matrix balancing by iterative correction, for all metacells in one job per iteration."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from contactmill.genome import Genome, bin_table
from contactmill.operators.binning import symmetrize
from contactmill.session import RoundTables, materialize, materialize_layout, round_tables

BIN = ["metacell", "gbin"]


def _genome_wide(maps: DataFrame, genome: Genome, resolution: int) -> DataFrame:
    """Upper-triangle pixels as (metacell, chrom1, chrom2, bin1, bin2, value) with genome-wide bins."""
    if "gbin1" in maps.columns:
        bins = bin_table(maps.sparkSession, genome, resolution)
        one = F.broadcast(bins.select(F.col("gbin").alias("gbin1"), F.col("chrom_ord").alias("chrom1")))
        two = F.broadcast(bins.select(F.col("gbin").alias("gbin2"), F.col("chrom_ord").alias("chrom2")))
        located = maps.join(one, "gbin1").join(two, "gbin2")
        return located.select(
            "metacell", "chrom1", "chrom2", F.col("gbin1").alias("bin1"), F.col("gbin2").alias("bin2"), "value"
        )
    second = "chrom_ord2" if "chrom_ord2" in maps.columns else "chrom_ord"
    return maps.select(
        "metacell",
        F.col("chrom_ord").alias("chrom1"),
        F.col(second).alias("chrom2"),
        (F.col("bin1") + genome.offset(F.col("chrom_ord"), resolution)).alias("bin1"),
        (F.col("bin2") + genome.offset(F.col(second), resolution)).alias("bin2"),
        "value",
    )


def balance(
    maps: DataFrame,
    genome: Genome,
    resolution: int,
    *,
    cis_only: bool = False,
    trans_only: bool = False,
    ignore_diags: int = 2,
    mad_max: float = 5,
    min_nnz: int = 10,
    min_count: float = 0,
    blacklist: DataFrame | None = None,
    rescale_marginals: bool = True,
    tol: float = 1e-5,
    max_iters: int = 100,
    existing: DataFrame | None = None,
    damped: bool = False,
) -> DataFrame:
    """Weights per (metacell, chromosome, bin) that make all kept rows of value * w1 * w2 sum alike.

    `maps` hold one triangle, as genome-wide bins (gbin1, gbin2), as bins of two chromosomes (chrom_ord2 for the second
    one), or as bins inside chromosomes; a map of the last kind has no trans pixels, so nothing links its chromosomes.
    Bins dropped by a filter get NULL. Metacells in `existing` are taken as they are. Every iteration joins the pixels,
    laid out once by their second bin, with the current weights; a map that has converged takes no further part.
    The plain step divides each weight by its relative row sum. It hardly moves the scales of loosely linked
    chromosomes towards each other; with damped=True every second step takes the square root of that ratio, which has
    the same fixed point and settles the slow directions.
    Columns: metacell, chrom_ord, bin, weight, converged.
    """
    if cis_only and trans_only:
        raise ValueError("cis_only and trans_only exclude each other")
    todo = maps if existing is None else maps.join(existing.select("metacell").distinct(), "metacell", "left_anti")
    pixels = _genome_wide(todo, genome, resolution)
    same = F.col("chrom1") == F.col("chrom2")
    if cis_only:
        pixels = pixels.where(same)
    if trans_only:
        pixels = pixels.where(~same)
    pixels = pixels.where(~same | (F.col("bin2") - F.col("bin1") >= ignore_diags))
    sides = symmetrize(pixels.select("metacell", "bin1", "bin2", "value"))
    sides = materialize_layout(sides.repartition("metacell", "bin2"))

    bins = bin_table(maps.sparkSession, genome, resolution).select("gbin", "chrom_ord", "bin")
    owners = todo.select("metacell").distinct()
    every = F.sequence(F.lit(0).cast("long"), F.lit(sum(genome.bins(resolution)) - 1).cast("long"))
    grid = owners.select("metacell", F.explode(every).alias("gbin")).join(F.broadcast(bins), "gbin")
    raw = sides.groupBy("metacell", F.col("bin1").alias("gbin")).agg(
        F.sum(F.when(F.col("bin1") == F.col("bin2"), 2).otherwise(1)).alias("nnz"), F.sum("value").alias("count")
    )
    filled = grid.join(raw, BIN, "left").fillna(0, ["nnz", "count"])
    keep = (F.col("nnz") >= min_nnz) & (F.col("count") >= min_count)
    if mad_max > 0:
        # medians run over the bins of one map, a number set by the genome
        chrom_mid = filled.where(F.col("count") > 0).groupBy("metacell", "chrom_ord").agg(F.median("count").alias("_mid"))
        filled = filled.join(chrom_mid, ["metacell", "chrom_ord"], "left").withColumn(
            "_rel", F.coalesce(F.col("count") / F.col("_mid"), F.lit(0.0))
        )
        logs = filled.where(F.col("_rel") > 0).select("metacell", F.log("_rel").alias("_log"))
        centre = logs.groupBy("metacell").agg(F.median("_log").alias("_centre"))
        spread = (
            logs.join(centre, "metacell")
            .groupBy("metacell")
            .agg(F.median(F.abs(F.col("_log") - F.col("_centre"))).alias("_mad"), F.first("_centre").alias("_centre"))
        )
        filled = filled.join(spread, "metacell", "left")
        keep = keep & (F.col("_rel") >= F.exp(F.col("_centre") - F.lit(float(mad_max)) * F.col("_mad")))
    weights = filled.select("metacell", "chrom_ord", "bin", "gbin", F.when(keep, 1.0).otherwise(0.0).alias("w"))
    if blacklist is not None:
        barred = blacklist.select("chrom_ord", "bin", F.lit(True).alias("_bar"))
        weights = weights.join(barred, ["chrom_ord", "bin"], "left").withColumn(
            "w", F.when(F.col("_bar"), 0.0).otherwise(F.col("w"))
        ).drop("_bar")

    group = ["metacell", "chrom_ord"] if cis_only else ["metacell"]
    state = materialize(weights.withColumns({"done": F.lit(False), "scale": F.lit(None).cast("double")}))
    with round_tables(maps.sparkSession) as rounds:
        state = _iterated(state, sides, group, max_iters, tol, damped, rounds)
    final = F.when((F.col("w") != 0) & F.col("scale").isNotNull(), F.col("w"))
    if rescale_marginals:
        final = final / F.sqrt("scale")
    out = state.select("metacell", "chrom_ord", "bin", final.alias("weight"), F.col("done").alias("converged"))
    if existing is not None:
        out = existing.select("metacell", "chrom_ord", "bin", "weight", F.lit(True).alias("converged")).unionByName(out)
    return out


def _iterated(
    state: DataFrame, sides: DataFrame, group: list[str], max_iters: int, tol: float, damped: bool, rounds: RoundTables
) -> DataFrame:
    """The weights after the iterations; the tables of past ones go as they are replaced."""
    for i in range(max_iters):
        active = state.where(~F.col("done"))
        other = active.select("metacell", F.col("gbin").alias("bin2"), F.col("w").alias("_w2"))
        reach = sides.join(other, ["metacell", "bin2"]).groupBy("metacell", F.col("bin1").alias("gbin")).agg(
            F.sum(F.col("value") * F.col("_w2")).alias("_reach")
        )
        marg = state.join(reach, BIN, "left").withColumn("_marg", F.col("w") * F.coalesce("_reach", F.lit(0.0)))
        nonzero = F.when(F.col("_marg") != 0, F.col("_marg"))
        # a window sees the bins of one map: their number is set by the genome
        whole = Window.partitionBy(*group)
        marg = marg.withColumns({"_mean": F.avg(nonzero).over(whole), "_var": F.var_pop(nonzero).over(whole)})
        step = F.when(F.col("_marg") == 0, F.lit(1.0)).otherwise(F.col("_marg") / F.col("_mean"))
        if damped and i % 2 == 1:
            step = F.sqrt(step)
        # a map without any usable bin ends here, without weights
        state = materialize(marg.select(
            "metacell", "chrom_ord", "bin", "gbin",
            F.when(F.col("done"), F.col("w")).otherwise(F.try_divide("w", F.coalesce(step, F.lit(1.0)))).alias("w"),
            (F.col("done") | F.col("_mean").isNull() | (F.col("_var") < tol)).alias("done"),
            F.when(F.col("done"), F.col("scale")).otherwise(F.col("_mean")).alias("scale"),
        ))
        rounds.turn()
        if state.where(~F.col("done")).isEmpty():
            break
    return state
