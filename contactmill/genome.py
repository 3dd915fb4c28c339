"""The chromosome dictionary: ordered names and sizes. Its length is fixed by the genome, not by the data."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from contactmill.schema import CHROMS

# a genome assembly with all its scaffolds stays far below this; more entries are refused, not broadcast
MAX_CHROMOSOMES = 100_000


@dataclass(frozen=True)
class Genome:
    """Chromosomes in list order, as (name, size in bp)."""

    chroms: tuple[tuple[str, int], ...]

    def __post_init__(self) -> None:
        if not self.chroms:
            raise ValueError("chrom_list must not be empty")
        if len(self.chroms) > MAX_CHROMOSOMES:
            raise ValueError(f"more than {MAX_CHROMOSOMES} chromosomes")

    @property
    def names(self) -> list[str]:
        return [name for name, _ in self.chroms]

    def bins(self, resolution: int) -> list[int]:
        """Bins per chromosome: the size divided by the resolution, rounded up."""
        return [-(-size // resolution) for _, size in self.chroms]

    def table(self, spark: SparkSession) -> DataFrame:
        rows = [(i, name, size) for i, (name, size) in enumerate(self.chroms)]
        return spark.createDataFrame(rows, CHROMS)

    def n_bins(self, chrom_ord: Column, resolution: int) -> Column:
        """Number of bins of the chromosome in a row, as a lookup expression (no join)."""
        return F.element_at(F.array(*[F.lit(n).cast("long") for n in self.bins(resolution)]), chrom_ord + 1)

    def offset(self, chrom_ord: Column, resolution: int) -> Column:
        """Genome-wide id of the first bin of a row's chromosome."""
        starts, total = [], 0
        for n in self.bins(resolution):
            starts.append(total)
            total += n
        return F.element_at(F.array(*[F.lit(s).cast("long") for s in starts]), chrom_ord + 1)

    def select(self, names: Sequence[str]) -> Genome:
        sizes = dict(self.chroms)
        missing = [n for n in names if n not in sizes]
        if missing:
            raise ValueError(f"chromosomes not in the size table: {missing}")
        return Genome(tuple((n, sizes[n]) for n in names))


def bin_table(spark: SparkSession, genome: Genome, resolution: int) -> DataFrame:
    """One row per bin: chromosome, bin within it, genome-wide bin, start and end in bp."""
    chroms = F.broadcast(genome.table(spark))
    n = genome.n_bins(F.col("chrom_ord"), resolution)
    return (
        chroms.select("chrom_ord", "chrom", "size_bp", F.explode(F.sequence(F.lit(0).cast("long"), n - 1)).alias("bin"))
        .select(
            F.lit(resolution).alias("resolution"),
            "chrom_ord",
            "chrom",
            "bin",
            (F.col("bin") + genome.offset(F.col("chrom_ord"), resolution)).alias("gbin"),
            (F.col("bin") * resolution).alias("start"),
            F.least((F.col("bin") + 1) * resolution, F.col("size_bp")).alias("end"),
        )
    )
