"""Multi-step recipes that turn pixels, scores or signals into embeddings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from contactmill.functions.vectors import dot, squared_distance
from contactmill.genome import Genome
from contactmill.operators import cellmaps, features, linalg, stats
from contactmill.operators.binning import symmetrize
from contactmill.session import materialize


def chromosome_embedding(
    entries: DataFrame,
    cells: DataFrame,
    genome: Genome,
    resolution: int,
    rank: int | None = None,
    flags: DataFrame | None = None,
) -> DataFrame:
    """Truncated SVD of both feature blocks of every chromosome, joined into one array per cell.

    With more than ten failing cells on a chromosome (`flags`: cell_id, chrom_ord, passes) the components are fitted on
    the passing cells only. Three cells or fewer get unit vectors. All chromosomes are decomposed together.
    """
    n_cells = cells.count()
    n_chrom = len(genome.chroms)
    if n_cells <= 3:
        ids = cells.agg(F.array_sort(F.collect_list("cell_id"))).scalar()  # at most three rows
        unit = F.transform(ids, lambda i: F.when(i == F.col("cell_id"), 1.0).otherwise(0.0))
        return cells.select("cell_id", F.flatten(F.array_repeat(unit, n_chrom)).alias("features"))
    given = [rank] * n_chrom if rank else features.embedding_ranks(n_cells, genome, resolution)
    part = (F.col("chrom_ord") * 2 + F.col("diagonal").cast("int")).cast("long")
    keyed = materialize(entries.select(  # read for the widths and by the decomposition
        part.alias("part"), F.col("cell_id").alias("row"),
        (F.col("bin1") * (1 << 31) + F.col("bin2")).alias("col"), "value",
    ))
    widths = {r["part"]: r["n"] for r in keyed.groupBy("part").agg(F.count_distinct("col").alias("n")).toLocalIterator()}
    ranks, rank_so_far = [], 0
    for chrom in range(n_chrom):
        rank_so_far = given[chrom]
        for block in (0, 1):
            width = widths.get(chrom * 2 + block)
            if width is not None:
                rank_so_far = max(1, min(rank_so_far, width - 2))
        ranks += [rank_so_far, rank_so_far]
    present = F.array(*[F.lit(p).cast("long") for p in sorted(widths)])
    rows = cells.select(F.explode(present).alias("part"), F.col("cell_id").alias("row"))
    fit_rows = None
    if flags is not None:
        bad = flags.groupBy("chrom_ord").agg(F.sum(F.when(F.col("passes"), 0).otherwise(1)).alias("bad"))
        noisy = F.broadcast(bad.where(F.col("bad") > 10).select("chrom_ord"))  # one row per chromosome
        failing = flags.where(~F.col("passes")).join(noisy, "chrom_ord", "left_semi")
        skip = failing.select(
            F.explode(F.array((F.col("chrom_ord") * 2).cast("long"), (F.col("chrom_ord") * 2 + 1).cast("long"))).alias("part"),
            F.col("cell_id").alias("row"),
        )
        fit_rows = rows.join(skip, ["part", "row"], "left_anti")
    scores = linalg.randomized_svd(keyed, rows, dict(enumerate(ranks)), fit_rows, stored=True)
    return linalg.concat_blocks(scores.withColumnRenamed("row", "cell_id"), "cell_id", ["part"], "scores")


def cell_features(
    pixels: DataFrame,
    cells: DataFrame,
    genome: Genome,
    resolution: int,
    bulk: DataFrame | None = None,
    rank: int | None = None,
) -> DataFrame:
    """Feature array per cell from its pixels: smoothing, batch correction, feature blocks, decomposition."""
    packed = materialize(features.packed_cell_maps(pixels, genome, resolution))
    maps = cellmaps.entries_of(packed)
    if "batch" in cells.columns:
        coverage = features.batch_coverage(symmetrize(maps, double_diagonal=False), cells, genome, resolution)
        maps = materialize(features.batch_corrected(packed, cells, coverage, features.batch_agreement(coverage)))
    n_cells = cells.select(F.count(F.lit(1))).scalar()
    entries = materialize(features.common_features(features.feature_entries(maps), n_cells))
    scaled = features.scaled_features(features.clipped_features(entries), genome, resolution)
    own = features.pseudo_bulk(pixels, genome, resolution) if bulk is None else bulk
    flags = stats.quality_flags(pixels, cells, own, genome, resolution)
    return chromosome_embedding(scaled, cells.select("cell_id"), genome, resolution, rank, flags)


def view_of(features_table: DataFrame, scale: bool = True, keep: int | float = 0.75) -> tuple[DataFrame, DataFrame]:
    """(principal components, non-negative embedding) of a feature table."""
    moved = linalg.standardize(features_table) if scale else features_table
    return linalg.principal_components(moved, keep), linalg.shift_non_negative(moved)


def top_percent_embedding(
    pixels: DataFrame,
    cells: DataFrame,
    genome: Genome,
    resolution: int,
    dim: int,
    top_percent: float = 20,
    chrom_rank: int | None = None,
) -> DataFrame:
    """Binarised top entries of every map, components per chromosome, joined, components again."""
    n_cells = cells.count()
    n = genome.n_bins(F.col("chrom_ord"), resolution)
    top = features.top_percent_entries(symmetrize(pixels), n, top_percent)
    keyed = top.select(
        F.col("chrom_ord").cast("long").alias("part"), F.col("cell_id").alias("row"),
        (F.col("bin1") * (1 << 31) + F.col("bin2")).alias("col"), F.lit(1.0).alias("value"),
    )
    ranks = [max(1, chrom_rank or int(min(n_cells, b * b) * 0.2) - 1) for b in genome.bins(resolution)]
    parts = F.sequence(F.lit(0).cast("long"), F.lit(len(ranks) - 1).cast("long"))
    rows = cells.select(F.explode(parts).alias("part"), F.col("cell_id").alias("row"))
    scores = linalg.randomized_svd(keyed, rows, dict(enumerate(ranks)), center=True)
    joined = linalg.concat_blocks(scores.withColumnRenamed("row", "cell_id"), "cell_id", ["part"], "scores")
    return linalg.principal_components(materialize(joined), dim)  # several passes read it


def signal_embedding(signals: DataFrame, cells: DataFrame, genome: Genome, resolution: int) -> DataFrame:
    """Co-assay tracks, each standardised over all its entries with gaps at 0, joined and reduced to 0.8 of the
    smaller side. `signals`: signal, cell_id, chrom_ord, bin, value. Gaps stay absent, whatever the number of bins."""
    moments = signals.groupBy("signal").agg(F.avg("value").alias("_m"), F.stddev_pop("value").alias("_s"))
    scaled = signals.join(moments, "signal").where((F.col("_s") > 0) & F.col("value").isNotNull())
    tracks = signals.agg(F.array_sort(F.collect_set("signal"))).first()[0]  # the names of the assay's tracks
    place = F.col("chrom_ord") * len(tracks) + F.array_position(F.array(*[F.lit(t) for t in tracks]), F.col("signal"))
    one = F.lit(0).cast("long").alias("part")
    entries = scaled.select(
        one, F.col("cell_id").alias("row"), (place * F.lit(1 << 32) + F.col("bin")).cast("long").alias("col"),
        ((F.col("value") - F.col("_m")) / F.col("_s")).alias("value"),
    )
    width = sum(genome.bins(resolution)) * len(tracks)
    keep = max(1, int(min(cells.count(), width) * 0.8))
    found = linalg.components(entries, cells.select(one, F.col("cell_id").alias("row")), keep)
    missing = F.array_repeat(F.lit(0.0), F.lit(keep) - F.size("scores"))  # columns without any entry
    return found.select(F.col("row").alias("cell_id"), F.concat("scores", missing).alias("features"))


def variable_bin_embedding(
    scores: DataFrame, cells: DataFrame, top_bins: int = 1000, components: int = 15
) -> DataFrame:
    """Embedding of a subset of cells on the bins whose score varies most among them.

    The scores are written once, for two passes read them; the few bins chosen are written too, so that the planner sees their
    size and leaves the scores where they are.
    """
    chosen = materialize(scores.join(cells.select("cell_id"), "cell_id", "left_semi").select("cell_id", "chrom_ord", "bin", "score"))
    n_cells = cells.select(F.count(F.lit(1))).scalar()
    spread = chosen.groupBy("chrom_ord", "bin").agg(F.count("score").alias("_n"), F.var_pop("score").alias("variance"))
    variances = spread.where(F.col("_n") == n_cells).drop("_n")
    top = materialize(stats.top_variable_bins(variances, top_bins).select("chrom_ord", "bin"))
    packed = (
        chosen.join(top, ["chrom_ord", "bin"], "left_semi")
        .groupBy("cell_id")
        .agg(F.array_sort(F.collect_list(F.struct("chrom_ord", "bin", "score"))).alias("_s"))  # top_bins entries
    )
    arrays = packed.select("cell_id", F.transform("_s", lambda s: s["score"]).alias("features"))
    return linalg.principal_components(linalg.standardize(arrays), components)


def update_rates(old: DataFrame, new: DataFrame) -> DataFrame:
    """Squared change of each cell's embedding relative to its old squared length."""
    a, b = F.col("_old"), F.col("_new")
    joined = old.select("cell_id", F.col("features").alias("_old")).join(
        new.select("cell_id", F.col("features").alias("_new")), "cell_id"
    )
    return joined.select("cell_id", F.try_divide(squared_distance(a, b), dot(a, a)).alias("rate"))
