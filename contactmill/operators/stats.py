"""Counts and summaries of cells, pixels and metacells."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from contactmill.functions.draws import hash_key
from contactmill.genome import Genome
from contactmill.operators.binning import coarsen
from contactmill.scale import mean_ranks, rank_within


def cell_depth(contacts: DataFrame, cells: DataFrame | None = None) -> DataFrame:
    """Data rows per cell; with a cell table, cells without contacts get 0."""
    counted = contacts.groupBy("cell_id").agg(F.count(F.lit(1)).alias("depth"))
    if cells is None:
        return counted
    return cells.select("cell_id").join(counted, "cell_id", "left").fillna(0, ["depth"])


def reads_per_chrom(pixels: DataFrame, genome: Genome) -> DataFrame:
    """One row per cell, one column per chromosome."""
    pivoted = pixels.groupBy("cell_id").pivot("chrom_ord", list(range(len(genome.chroms)))).agg(F.sum("value"))
    renamed = [F.coalesce(F.col(str(i)), F.lit(0.0)).alias(f"reads_{n}") for i, n in enumerate(genome.names)]
    return pivoted.select("cell_id", *renamed)


def quality_flags(pixels: DataFrame, cells: DataFrame, bulk: DataFrame, genome: Genome, resolution: int) -> DataFrame:
    """Off-diagonal pixel rows per cell and chromosome against what the bulk map lets expect.

    A bulk row counts as usable when over a tenth of its entries are positive.
    """
    n = genome.n_bins(F.col("chrom_ord"), resolution)
    usable = (
        bulk.where(F.col("value") > 0)
        .groupBy("chrom_ord", "bin1")
        .agg(F.count(F.lit(1)).alias("filled"))
        .where(F.col("filled") > n * 0.1)
        .groupBy("chrom_ord")
        .agg(F.count(F.lit(1)).alias("usable"))
    )
    chroms = F.broadcast(genome.table(pixels.sparkSession).select("chrom_ord"))
    needed = chroms.join(usable, "chrom_ord", "left").select(
        "chrom_ord",
        F.greatest(F.coalesce("usable", F.lit(0)) * 0.25 - 5, F.lit(0.0)).alias("needed"),
    )
    found = (
        pixels.where(F.col("bin1") != F.col("bin2"))
        .groupBy("cell_id", "chrom_ord")
        .agg(F.count(F.lit(1)).alias("n_off_diagonal"))
    )
    every = cells.select("cell_id", F.explode(F.sequence(F.lit(0), F.lit(len(genome.chroms) - 1))).alias("chrom_ord"))
    return (
        every.join(found, ["cell_id", "chrom_ord"], "left")
        .fillna(0, ["n_off_diagonal"])
        .join(needed, "chrom_ord")
        .withColumn("passes", F.col("n_off_diagonal") >= F.col("needed"))
    )


def sparsity(pixels: DataFrame, genome: Genome, resolution: int, metric_bp: int = 1_000_000) -> DataFrame:
    """Share of the 1 Mb triangle a cell fills: distinct coarse pixels over sum of int(n^2 / 2)."""
    factor = max(metric_bp // resolution, 1)
    possible = float(sum((-(-n * resolution // metric_bp)) ** 2 // 2 for n in genome.bins(resolution)))
    filled = coarsen(pixels, factor).groupBy("cell_id").agg(F.count(F.lit(1)).alias("filled"))
    return filled.select("cell_id", "filled", (F.col("filled") / F.lit(possible)).alias("sparsity"))


def mean_reads_per_chrom(pixels: DataFrame, cells: DataFrame) -> DataFrame:
    """Reads of a chromosome divided by the number of cells, empty cells included."""
    n_cells = cells.select(F.count(F.lit(1))).scalar()
    return pixels.groupBy("chrom_ord").agg((F.sum("value") / n_cells).alias("reads_per_cell"))


def decay_by_distance(pixels: DataFrame) -> DataFrame:
    """Mean pixel value at each off-diagonal bin distance."""
    return (
        pixels.where(F.col("bin1") != F.col("bin2"))
        .groupBy((F.col("bin2") - F.col("bin1")).alias("distance"))
        .agg(F.avg("value").alias("weight"))
    )


def mean_value_by_cell(pixels: DataFrame) -> DataFrame:
    """Mean off-diagonal pixel value of each cell."""
    return (
        pixels.where(F.col("bin1") != F.col("bin2")).groupBy("cell_id").agg(F.avg("value").alias("weight"))
    )


def metacell_depths(cells: DataFrame) -> DataFrame:
    """Total, count and mean depth per metacell."""
    return cells.groupBy("metacell").agg(
        F.sum("depth").alias("total_depth"),
        F.count(F.lit(1)).alias("cell_count"),
        F.avg("depth").alias("mean_depth"),
    )


def dominant_labels(cells: DataFrame) -> DataFrame:
    """Most frequent label per metacell, the smallest one on ties."""
    counted = cells.groupBy("metacell", "label").agg(F.count(F.lit(1)).alias("n"))
    top = F.min_by("label", F.struct(-F.col("n"), F.col("label")))
    return counted.groupBy("metacell").agg(top.alias("dominant_label"))


def layout_centroids(
    cells: DataFrame, layout: DataFrame, min_size: float = 50.0, max_size: float = 500.0
) -> DataFrame:
    """Centre and member count of each metacell on a 2-D layout, with a marker size scaled to the counts."""
    placed = cells.join(layout, "cell_id").groupBy("metacell").agg(
        F.avg("x").alias("x"), F.avg("y").alias("y"), F.count(F.lit(1)).alias("cell_count")
    )
    low = placed.select(F.min("cell_count")).scalar()
    high = placed.select(F.max("cell_count")).scalar()
    share = (F.col("cell_count") - low) / F.nullif(high - low, F.lit(0).cast("long"))
    return placed.withColumn(
        "marker_size",
        F.coalesce(F.lit(min_size) + share * (max_size - min_size), F.lit((min_size + max_size) / 2)),
    )


def value_histogram(df: DataFrame, value: str, bins: int) -> DataFrame:
    """Equal-width bins between the smallest and largest value, the last bin closed, with the overall mean."""
    low = df.select(F.min(value)).scalar().cast("double")
    high = df.select(F.max(value)).scalar().cast("double")
    mean = df.select(F.avg(value)).scalar()
    width = (high - low) / bins
    slot = F.when(high == low, F.lit(0)).otherwise(
        F.least(F.floor((F.col(value) - low) / F.nullif(width, F.lit(0.0))), F.lit(bins - 1))
    )
    return (
        df.withColumn("slot", slot.cast("long"))
        .groupBy("slot")
        .agg(F.count(F.lit(1)).alias("n"))
        .withColumns({"low": low + F.col("slot") * width, "high": low + (F.col("slot") + 1) * width, "mean": mean})
    )


def score_by_type(scores: DataFrame, value: str) -> DataFrame:
    """Mean of a metacell score per dominant cell type."""
    return scores.groupBy("cell_type").agg(F.avg(value).alias(value), F.count(F.lit(1)).alias("metacells"))


def recommend_global(
    depths: DataFrame, target_min: float, target_max: float, min_cells: int = 10
) -> DataFrame:
    """Range of K that puts the mean metacell depth between two targets."""
    totals = depths.agg(F.sum("depth").alias("total"), F.count(F.lit(1)).alias("n"))
    limit = F.floor(F.col("n") / min_cells)

    def bounded(target: float):
        raw = F.bround(F.col("total") / F.lit(float(target))).cast("long")
        return F.greatest(F.lit(1).cast("long"), F.least(raw, limit))

    return totals.select(
        F.least(bounded(target_max), bounded(target_min)).alias("min_k"), bounded(target_min).alias("max_k")
    )


def recommend_per_cluster(
    clustered: DataFrame, target_min: float, target_max: float, min_per_cluster: int = 1
) -> DataFrame:
    """Cells, depth and K range of each cluster (columns cluster and depth), largest cluster first."""
    floor = F.lit(min_per_cluster).cast("long")
    stats = clustered.groupBy("cluster").agg(F.count(F.lit(1)).alias("cells"), F.sum("depth").alias("total_depth"))
    high = F.greatest(floor, F.bround(F.col("total_depth") / F.lit(float(target_min))).cast("long"))
    low = F.greatest(floor, F.bround(F.col("total_depth") / F.lit(float(target_max))).cast("long"))
    return stats.withColumns({"min_k": F.least(low, high), "max_k": high}).orderBy(F.desc("cells"), "cluster")


def recommend_total(per_cluster: DataFrame) -> DataFrame:
    """Summed range; the upper end is capped at five metacells per cluster, the lower end is not."""
    return per_cluster.agg(
        F.sum("min_k").alias("min_k"),
        F.least(F.sum("max_k"), F.count(F.lit(1)) * 5).alias("max_k"),
    )


def simulated_depths(depths: DataFrame, k: int, seed: int = 0) -> DataFrame:
    """Depth of each of k random, equally sized groups of cells."""
    drawn = depths.withColumn("_draw", hash_key(F.col("cell_id"), seed=seed))
    ranked = rank_within(drawn, [], ["_draw", "cell_id"], "_rank")
    n = depths.select(F.count(F.lit(1))).scalar()
    # the first n % k groups hold one cell more, as an even split does
    small, extra = F.floor(n / k), n % k
    rank0 = F.col("_rank") - 1
    group = F.when(rank0 < extra * (small + 1), F.floor(rank0 / (small + 1))).otherwise(
        extra + F.floor((rank0 - extra * (small + 1)) / F.greatest(small, F.lit(1).cast("long")))
    )
    return ranked.groupBy(group.cast("long").alias("part")).agg(F.sum("depth").alias("depth"))


def simulated_interval(simulated: DataFrame) -> DataFrame:
    """5th and 95th percentile of the simulated depths (k rows)."""
    return simulated.agg(
        F.percentile("depth", F.lit(0.05)).alias("p05"), F.percentile("depth", F.lit(0.95)).alias("p95")
    )


def compare_methods(sweep: DataFrame, metrics: Sequence[str]) -> DataFrame:
    """Mean of each metric per method, min-max scaled over the methods, averaged, best first."""
    means = sweep.groupBy("method").agg(*[F.avg(m).alias(m) for m in metrics])
    everyone = Window.partitionBy(F.lit(1))  # one row per method
    scaled = means
    for m in metrics:
        low, high = F.min(m).over(everyone), F.max(m).over(everyone)
        span = F.when(high == low, F.lit(1.0)).otherwise(high - low)
        scaled = scaled.withColumn(f"{m}_scaled", (F.col(m) - low) / span)
    total = sum((F.col(f"{m}_scaled") for m in metrics[1:]), F.col(f"{metrics[0]}_scaled"))
    return scaled.withColumn("overall_score", total / len(metrics)).orderBy(F.desc("overall_score"), "method")


def sweep_curves(sweep: DataFrame, metrics: Sequence[str]) -> DataFrame:
    """One row per (k, metric)."""
    ids = [c for c in sweep.columns if c not in metrics]
    return sweep.unpivot(ids, list(metrics), "metric", "value")


def spearman(df: DataFrame, groups: Sequence[str], x: str, y: str, name: str = "spearman") -> DataFrame:
    """Rank correlation per group with average ranks on ties."""
    rx = mean_ranks(df, groups, x, "_rx").drop("n")
    ry = mean_ranks(df, groups, y, "_ry").drop("n")
    ranked = df.join(rx, [*groups, x]).join(ry, [*groups, y])
    flat = F.when((F.stddev_pop("_rx") == 0) | (F.stddev_pop("_ry") == 0), F.lit(None).cast("double"))
    return ranked.groupBy(*groups).agg(flat.otherwise(F.corr("_rx", "_ry")).alias(name))


def bin_variance(scores: DataFrame) -> DataFrame:
    """Population variance of a per-cell score at each bin."""
    return scores.groupBy("chrom_ord", "bin").agg(F.var_pop("score").alias("variance"))


def top_variable_bins(variances: DataFrame, k: int) -> DataFrame:
    """The k bins of largest variance, lower bin first on ties."""
    return variances.orderBy(F.desc("variance"), "chrom_ord", "bin").limit(k)


def link_scores(pairs: DataFrame) -> DataFrame:
    """AUC, average precision, accuracy at 0.5, Pearson and Spearman of `score` against `truth` (0 or 1).

    AUC comes from average ranks; precision is accumulated over distinct scores, so ties count as one step.
    """
    from contactmill.scale import running_sum

    levels = pairs.groupBy("score").agg(F.sum("truth").alias("pos"), F.count(F.lit(1)).alias("all"))
    down = running_sum(levels, [], [F.desc("score")], "pos", "cum_pos")
    down = running_sum(down, [], [F.desc("score")], "all", "cum_all")
    sums = down.agg(
        F.sum("pos").alias("n_pos"),
        F.sum("all").alias("n"),
        # area by counting negatives ranked below each positive, half for equal scores
        F.sum((F.col("all") - F.col("pos")) * (F.col("cum_pos") - F.col("pos") + F.col("pos") / 2.0)).alias("wins"),
        F.sum(F.col("pos") * F.col("cum_pos") / F.col("cum_all")).alias("precision_sum"),
    )
    direct = pairs.agg(
        F.avg(F.when((F.col("score") >= 0.5) == (F.col("truth") >= 0.5), 1.0).otherwise(0.0)).alias("accuracy"),
        F.corr("score", F.col("truth").cast("double")).alias("pearson"),
    )
    rank_corr = spearman(pairs, [], "score", "truth")
    one = F.lit(1).alias("_one")
    out = sums.select("*", one).join(direct.select("*", one), "_one").join(rank_corr.select("*", one), "_one")
    negatives = F.col("n") - F.col("n_pos")
    return out.select(
        (F.try_divide("wins", F.col("n_pos") * negatives)).alias("auc"),
        F.try_divide("precision_sum", "n_pos").alias("aupr"),
        "accuracy",
        "pearson",
        "spearman",
    )
