"""Per-cell contact lists: one tab-separated `.pairs` or `.pairs.gz` file per cell."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from contactmill.genome import Genome
from contactmill.scale import rank_within


def read_pairs(spark: SparkSession, directory: str) -> DataFrame:
    """Contacts of every file with the file name as cell_name.

    Columns 1..4 (counted from 0) are chrom1, pos1, chrom2, pos2 whatever they are called. Comment lines, the header
    line and rows without two chromosomes and two integer positions are left out: they carry no contact.
    """
    lines = (
        spark.read.option("pathGlobFilter", "*.{pairs,pairs.gz}")
        .text(directory)
        .select("value", F.col("_metadata.file_name").alias("cell_name"))
    )
    field = F.split("value", "\t")
    rows = lines.where(~F.col("value").startswith("#")).select(
        "cell_name",
        F.try_element_at(field, F.lit(2)).alias("chrom1"),
        F.try_element_at(field, F.lit(3)).try_cast("long").alias("pos1"),
        F.try_element_at(field, F.lit(4)).alias("chrom2"),
        F.try_element_at(field, F.lit(5)).try_cast("long").alias("pos2"),
    )
    return rows.dropna()


def cell_dimension(names: DataFrame) -> DataFrame:
    """cell_id (rank of the sorted name, from 0), cell_name, and the label between the first underscores."""
    ranked = rank_within(names.select("cell_name").distinct(), [], ["cell_name"], "_rank")
    stem = F.split_part("cell_name", F.lit(".pairs"), F.lit(1))
    return ranked.select(
        (F.col("_rank") - 1).alias("cell_id"), "cell_name", F.split_part(stem, F.lit("_"), F.lit(2)).alias("label")
    )


def load_cells(spark: SparkSession, directory: str) -> tuple[DataFrame, DataFrame]:
    """(contacts keyed by cell_id, cell dimension) of a directory; files without any contact count as cells too."""
    rows = read_pairs(spark, directory)
    files = (
        spark.read.format("binaryFile")
        .option("pathGlobFilter", "*.{pairs,pairs.gz}")
        .load(directory)
        .select(F.element_at(F.split("path", "/"), -1).alias("cell_name"))
    )
    cells = cell_dimension(files)
    contacts = rows.join(cells.select("cell_name", "cell_id"), "cell_name").drop("cell_name")
    return contacts, cells


def read_chrom_sizes(spark: SparkSession, path: str, chrom_list: list[str]) -> Genome:
    """Sizes of the listed chromosomes, in list order."""
    table = spark.read.schema("chrom STRING, size_bp LONG").option("sep", "\t").csv(path)
    listed = table.where(F.col("chrom").isin(chrom_list)).dropDuplicates(["chrom"])
    sizes = {r.chrom: r.size_bp for r in listed.toLocalIterator()}  # at most one row per listed chromosome
    missing = [c for c in chrom_list if c not in sizes]
    if missing:
        raise ValueError(f"chromosomes not in {path}: {missing}")
    return Genome(tuple((c, sizes[c]) for c in chrom_list))
