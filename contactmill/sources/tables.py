"""Side tables: bulk maps, cytobands, batches, co-assay signals, external groupings, metric sweeps."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from contactmill.genome import Genome
from contactmill.schema import CYTOBANDS, SIGNALS, SWEEP


def recode(cells: DataFrame, column: str, groups: Mapping[str, Sequence[str]]) -> DataFrame:
    """Give the listed old values of a column their group's name; other values stay."""
    out = F.col(column)
    for new, old in groups.items():
        out = F.when(F.col(column).isin(list(old)), F.lit(new)).otherwise(out)
    return cells.withColumn(column, out)


def read_cytobands(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(CYTOBANDS).option("sep", "\t").csv(path)


def read_signals(spark: SparkSession, path: str) -> DataFrame:
    """Co-assay tracks as a long table (signal, cell_id, chrom, bin, value)."""
    return spark.read.schema(SIGNALS).parquet(path)


def attach_batches(cells: DataFrame, batches: DataFrame, default: str = "0") -> DataFrame:
    """Batch of each cell; cells not listed get the default batch."""
    return cells.join(batches.select("cell_id", "batch"), "cell_id", "left").fillna(default, ["batch"])


def read_sweep(spark: SparkSession, path: str, method: str) -> DataFrame:
    """A metric sweep CSV whose unnamed first column is K."""
    return spark.read.schema(SWEEP).option("header", True).csv(path).select(F.lit(method).alias("method"), "*")


def choose_bulk(given: DataFrame | None, own: DataFrame, genome: Genome, resolution: int) -> DataFrame:
    """A given bulk map per chromosome, scaled to sum to its number of bins; the data's own map where the given one
    is absent or has another number of bins.

    `given` has chrom_ord, n_bins, bin1, bin2, value (both triangles); `own` has chrom_ord, bin1, bin2, value.
    """
    if given is None:
        return own
    fits = given.where(F.col("n_bins") == genome.n_bins(F.col("chrom_ord"), resolution))
    sums = fits.groupBy("chrom_ord").agg(F.sum(F.coalesce("value", F.lit(0.0))).alias("_sum"))
    scaled = fits.join(F.broadcast(sums), "chrom_ord").select(  # one row per chromosome
        "chrom_ord", "bin1", "bin2",
        F.try_divide(F.coalesce("value", F.lit(0.0)) * F.col("n_bins"), "_sum").alias("value"),
    )
    rest = own.join(F.broadcast(sums.select("chrom_ord")), "chrom_ord", "left_anti")
    return scaled.unionByName(rest.select("chrom_ord", "bin1", "bin2", "value"))


def check_grouping(cells: DataFrame | None, views: Mapping[int, DataFrame] | None) -> None:
    """Refuse an external grouping that lacks cells, needed columns or views."""
    if cells is None or not {"cell_id", "metacell"} <= set(cells.columns):
        raise ValueError("cells must have the columns cell_id and metacell")
    if cells.isEmpty():
        raise ValueError("cells must not be empty")
    if not views:
        raise ValueError("at least one view is needed")
    for resolution, view in views.items():
        if not {"cell_id", "features"} <= set(view.columns):
            raise ValueError(f"view {resolution} must have the columns cell_id and features")
