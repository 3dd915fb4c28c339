"""From contacts to pixels: filtering, binning, ordering, counting."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from contactmill.functions.draws import hash_key
from contactmill.genome import Genome, bin_table
from contactmill.scale import rank_within

SHORT_RANGE_BP = 2500  # fixed value: shorter cis contacts are dropped unless both ends coincide
PIXEL = ["cell_id", "chrom_ord", "bin1", "bin2"]
PAIRED = ["chrom_ord", "chrom_ord2", "bin1", "bin2"]


def drop_short_range(contacts: DataFrame, min_bp: int = SHORT_RANGE_BP) -> DataFrame:
    """Keep trans contacts, and cis contacts that span at least min_bp or nothing at all."""
    span = F.abs(F.col("pos2") - F.col("pos1"))
    return contacts.where((F.col("chrom1") != F.col("chrom2")) | (span >= min_bp) | (span == 0))


def locate(contacts: DataFrame, genome: Genome) -> DataFrame:
    """Replace chromosome names by ordinals; contacts with an end on an unlisted chromosome go."""
    chroms = genome.table(contacts.sparkSession)
    first = F.broadcast(chroms.select(F.col("chrom").alias("chrom1"), F.col("chrom_ord").alias("chrom_ord1")))
    second = F.broadcast(chroms.select(F.col("chrom").alias("chrom2"), F.col("chrom_ord").alias("chrom_ord2")))
    return contacts.join(first, "chrom1").join(second, "chrom2").drop("chrom1", "chrom2")


def to_bin(position: Column, resolution: int, one_based: bool = False) -> Column:
    shifted = position - 1 if one_based else position
    return F.floor(shifted / resolution).cast("long")


def bin_contacts(contacts: DataFrame, genome: Genome, resolution: int, one_based: bool = False) -> DataFrame:
    """Filtered, located and binned contacts, one row per contact; bins count within their chromosome."""
    located = locate(drop_short_range(contacts), genome)
    weight = F.coalesce(F.col("count"), F.lit(1.0)) if "count" in contacts.columns else F.lit(1.0)
    return located.select(
        "cell_id",
        "chrom_ord1",
        "chrom_ord2",
        to_bin(F.col("pos1"), resolution, one_based).alias("bin1"),
        to_bin(F.col("pos2"), resolution, one_based).alias("bin2"),
        weight.alias("value"),
    )


def genome_wide(binned: DataFrame, genome: Genome, resolution: int) -> DataFrame:
    """Add genome-wide bin ids next to the bins within chromosomes."""
    return binned.withColumn(
        "gbin1", F.col("bin1") + genome.offset(F.col("chrom_ord1"), resolution)
    ).withColumn("gbin2", F.col("bin2") + genome.offset(F.col("chrom_ord2"), resolution))


def split_cis_trans(binned: DataFrame) -> tuple[DataFrame, DataFrame]:
    cis = binned.where(F.col("chrom_ord1") == F.col("chrom_ord2"))
    trans = binned.where(F.col("chrom_ord1") != F.col("chrom_ord2"))
    return cis, trans


def order_bins(cis: DataFrame) -> DataFrame:
    """bin1 <= bin2 on every row."""
    return cis.withColumns({"bin1": F.least("bin1", "bin2"), "bin2": F.greatest("bin1", "bin2")})


def cis_pixels(contacts: DataFrame, genome: Genome, resolution: int, one_based: bool = False) -> DataFrame:
    """Upper-triangle counts per cell and chromosome; the sum combines on the map side first."""
    cis, _ = split_cis_trans(bin_contacts(contacts, genome, resolution, one_based))
    return (
        order_bins(cis)
        .withColumnRenamed("chrom_ord1", "chrom_ord")
        .groupBy(*PIXEL)
        .agg(F.sum("value").alias("value"))
    )


def all_pixels(contacts: DataFrame, genome: Genome, resolution: int, one_based: bool = False) -> DataFrame:
    """Counts of cis and trans pixels per cell in genome-wide bin ids, gbin1 <= gbin2."""
    binned = genome_wide(bin_contacts(contacts, genome, resolution, one_based), genome, resolution)
    return (
        binned.withColumns({"gbin1": F.least("gbin1", "gbin2"), "gbin2": F.greatest("gbin1", "gbin2")})
        .groupBy("cell_id", "gbin1", "gbin2")
        .agg(F.sum("value").alias("value"))
    )


def paired_pixels(contacts: DataFrame, genome: Genome, resolution: int, one_based: bool = False) -> DataFrame:
    """Counts of all contacts between listed chromosomes per cell: short ones and trans ones included.

    The end that comes first in the genome is (chrom_ord, bin1), the other one (chrom_ord2, bin2).
    """
    weight = F.coalesce(F.col("count"), F.lit(1.0)) if "count" in contacts.columns else F.lit(1.0)
    ends = [
        F.struct(F.col(f"chrom_ord{i}").alias("chrom"), to_bin(F.col(f"pos{i}"), resolution, one_based).alias("bin")) for i in (1, 2)
    ]
    placed = locate(contacts, genome).select("cell_id", F.least(*ends).alias("_a"), F.greatest(*ends).alias("_b"), weight.alias("value"))
    ordered = placed.select(
        "cell_id", F.col("_a.chrom").alias("chrom_ord"), F.col("_b.chrom").alias("chrom_ord2"),
        F.col("_a.bin").alias("bin1"), F.col("_b.bin").alias("bin2"), "value",
    )
    return ordered.groupBy("cell_id", *PAIRED).agg(F.sum("value").alias("value"))


def coarsen(pixels: DataFrame, factor: int, keys: list[str] | None = None) -> DataFrame:
    """Pixels at `factor` times the bin width."""
    if factor < 1:
        raise ValueError("factor must be at least 1")
    keys = keys or ["cell_id", "chrom_ord"]
    narrowed = pixels.select(
        *keys,
        F.floor(F.col("bin1") / factor).cast("long").alias("bin1"),
        F.floor(F.col("bin2") / factor).cast("long").alias("bin2"),
        "value",
    )
    return narrowed.groupBy(*keys, "bin1", "bin2").agg(F.sum("value").alias("value"))


def downsample(contacts: DataFrame, fraction: float, seed: int = 0) -> DataFrame:
    """Exactly int(fraction * n) contacts of each cell, chosen by a reproducible hash order."""
    if not 0 <= fraction <= 1:
        raise ValueError("fraction must lie between 0 and 1")
    if fraction == 1:
        return contacts
    number = [F.regexp_replace(c, "[^0-9]", "") for c in ("chrom1", "chrom2")]
    chrom_key = F.coalesce(F.try_to_number(F.concat(*number), F.lit("999999")).cast("long"), F.lit(0).cast("long"))
    drawn = contacts.withColumn("_draw", hash_key(F.col("cell_id"), F.col("pos1"), F.col("pos2"), chrom_key, seed=seed))
    ranked = rank_within(drawn, ["cell_id"], ["_draw", "chrom1", "pos1", "chrom2", "pos2"], "_rank")
    sizes = contacts.groupBy("cell_id").agg(F.floor(F.count(F.lit(1)) * F.lit(float(fraction))).alias("_keep"))
    return ranked.join(sizes, "cell_id").where(F.col("_rank") <= F.col("_keep")).select(*contacts.columns)


def distance_band(pixels: DataFrame, min_bin: int = 0, max_bin: int = -1) -> DataFrame:
    """Pixels strictly between two bin distances; max_bin < 0 means no upper limit. The diagonal always goes."""
    span = F.col("bin2") - F.col("bin1")
    kept = pixels.where((span > min_bin) & (span > 0))
    return kept.where(span < max_bin) if max_bin >= 0 else kept


def symmetrize(pixels: DataFrame, double_diagonal: bool = True) -> DataFrame:
    """Both triangles as rows; like M + M^T, the diagonal counts twice unless told otherwise."""
    diagonal = F.lit(2.0 if double_diagonal else 1.0)
    both = F.when(
        F.col("bin1") == F.col("bin2"),
        F.array(F.struct(F.col("bin1"), F.col("bin2"), (F.col("value") * diagonal).alias("value"))),
    ).otherwise(
        F.array(
            F.struct(F.col("bin1"), F.col("bin2"), F.col("value")),
            F.struct(F.col("bin2").alias("bin1"), F.col("bin1").alias("bin2"), F.col("value")),
        )
    )
    rest = [c for c in pixels.columns if c not in ("bin1", "bin2", "value")]
    return pixels.select(*rest, F.explode(both).alias("_p")).select(*rest, "_p.bin1", "_p.bin2", "_p.value")


def bin_pairs(
    bins: DataFrame, n_bins: Column, min_bin: int, max_bin: int, masked: DataFrame | None = None
) -> DataFrame:
    """All pairs (bin1, bin2) of a chromosome with min_bin <= bin2 - bin1 < max_bin, minus masked bins.

    `bins` has chrom_ord and bin; `masked` has the same two columns. Ids in the result count from 1.
    """
    last = F.least(F.col("bin") + max_bin, n_bins) - 1
    first = F.col("bin") + min_bin
    pairs = bins.where(first <= last).select(
        "chrom_ord", F.col("bin").alias("bin1"), F.explode(F.sequence(first, last)).alias("bin2")
    )
    if masked is not None:
        for side in ("bin1", "bin2"):
            pairs = pairs.join(masked.select("chrom_ord", F.col("bin").alias(side)), ["chrom_ord", side], "left_anti")
    return pairs.select("chrom_ord", (F.col("bin1") + 1).alias("bin1"), (F.col("bin2") + 1).alias("bin2"))


def masked_bins(gaps: DataFrame, genome: Genome, resolution: int, pad_bp: int = 100_000) -> DataFrame:
    """Bins that a centromere interval (type 'acen', widened by pad_bp) covers."""
    spans = gaps.where(F.col("type") == "acen").select(
        "chrom",
        F.floor((F.col("start") - pad_bp) / resolution).cast("long").alias("first"),
        F.ceil((F.col("end") + pad_bp) / resolution).cast("long").alias("stop"),
    )
    chroms = F.broadcast(genome.table(gaps.sparkSession))
    located = spans.join(chroms, "chrom")
    last = F.least(F.col("stop"), genome.n_bins(F.col("chrom_ord"), resolution)) - 1
    first = F.greatest(F.col("first"), F.lit(0).cast("long"))
    return (
        located.where(first <= last)
        .select("chrom_ord", F.explode(F.sequence(first, last)).alias("bin"))
        .distinct()
    )


def node_ids(pixels: DataFrame, genome: Genome, resolution: int, n_cells: Column) -> DataFrame:
    """Put cells and bins into one id space: cells first, then the bins of each chromosome."""
    base = n_cells + genome.offset(F.col("chrom_ord"), resolution)
    return pixels.select(
        F.col("cell_id").alias("node0"),
        (F.col("bin1") + base).alias("node1"),
        (F.col("bin2") + base).alias("node2"),
        "chrom_ord",
        "value",
    )


def node_table(cells: DataFrame, genome: Genome, resolution: int) -> DataFrame:
    """Every node id with the [first, stop) range of its kind; cells have no chromosome (-1)."""
    spark = cells.sparkSession
    n_cells = cells.select((F.max("cell_id") + 1).alias("n")).scalar()
    offset = genome.offset(F.col("chrom_ord"), resolution)
    cell_nodes = cells.select(
        F.col("cell_id").alias("node"), F.lit(0).cast("long").alias("first"), n_cells.alias("stop"),
        F.lit(-1).alias("chrom_ord"),
    )
    bin_nodes = bin_table(spark, genome, resolution).select(
        (n_cells + F.col("gbin")).alias("node"),
        (n_cells + offset).alias("first"),
        (n_cells + offset + genome.n_bins(F.col("chrom_ord"), resolution)).alias("stop"),
        "chrom_ord",
    )
    return cell_nodes.unionByName(bin_nodes)
