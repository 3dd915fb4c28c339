"""Parquet stores for metacell contacts and pixels, and the manifest that keeps re-runs small.

Stores are versioned: what a run writes goes to a folder of its own, and the run counts once its commit stands. Readers
follow the last commit, so a run that dies before it leaves the old content in place, whole. Folders that neither the last
commit nor the one before it names are deleted after a commit. A store has one writer at a time; of two, the later fails.

Writers ask for rebalanced partitions: the adaptive planner then splits a hot metacell over several files and merges
small ones, so that neither one task nor one file holds a whole hot group.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from contactmill.genome import Genome, bin_table
from contactmill.operators import binning

METACELL_PIXELS = "chrom_ord INT, chrom_ord2 INT, bin1 LONG, bin2 LONG, value DOUBLE, metacell LONG"


def merged_pairs(contacts: DataFrame, cells: DataFrame) -> DataFrame:
    """All contacts with the metacell of their cell."""
    return contacts.join(cells.select("cell_id", "metacell"), "cell_id").select(
        "metacell", "cell_id", "chrom1", "pos1", "chrom2", "pos2"
    )


def _path(spark: SparkSession, path: str):
    """(file system, path object) of the JVM."""
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    return jpath.getFileSystem(spark._jsc.hadoopConfiguration()), jpath


def _names(spark: SparkSession, folder: str) -> list[str]:
    fs, jpath = _path(spark, folder)
    return [s.getPath().getName() for s in fs.listStatus(jpath)] if fs.exists(jpath) else []


def _delete(spark: SparkSession, path: str) -> None:
    fs, jpath = _path(spark, path)
    fs.delete(jpath, True)


class CommitLog:
    """Tables of which the last committed one counts: commit-N holds table N, the file done-N makes it count."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path

    def numbers(self) -> list[int]:
        return sorted(int(n.removeprefix("done-")) for n in _names(self.spark, self.path) if n.startswith("done-"))

    def read(self, back: int = 0) -> DataFrame | None:
        """The last table, or the one `back` commits before it."""
        numbers = self.numbers()
        if len(numbers) <= back:
            return None
        return self.spark.read.parquet(f"{self.path}/commit-{numbers[-1 - back]}")

    def commit(self, table: DataFrame) -> None:
        """The file is made in one step and must not exist: a reader sees the old table or the new one, nothing else."""
        numbers = self.numbers()
        number = numbers[-1] + 1 if numbers else 1
        table.write.mode("overwrite").parquet(f"{self.path}/commit-{number}")
        fs, marker = _path(self.spark, f"{self.path}/done-{number}")
        fs.create(marker, False).close()
        for old in numbers[:-1]:
            _delete(self.spark, f"{self.path}/done-{old}")
            _delete(self.spark, f"{self.path}/commit-{old}")


def write_merged_pairs(pairs: DataFrame, path: str) -> None:
    """Tab-separated contacts, one folder per metacell under a new version, a header at the start of each file."""
    spark, version, log = pairs.sparkSession, f"v{uuid.uuid4().hex}", CommitLog(pairs.sparkSession, f"{path}/_log")
    (
        pairs.hint("rebalance", "metacell")
        .write.option("header", True)
        .option("sep", "\t")
        .partitionBy("metacell")
        .csv(f"{path}/version={version}")
    )
    log.commit(spark.createDataFrame([(version,)], "version STRING"))
    kept = {t.first()["version"] for back in (0, 1) if (t := log.read(back)) is not None}
    for name in _names(spark, path):
        if name.startswith("version=") and name.removeprefix("version=") not in kept:
            _delete(spark, f"{path}/{name}")


def read_merged_pairs(spark: SparkSession, path: str) -> DataFrame:
    layout = "cell_id LONG, chrom1 STRING, pos1 LONG, chrom2 STRING, pos2 LONG, metacell LONG"
    version = CommitLog(spark, f"{path}/_log").read().first()["version"]
    return spark.read.schema(layout).option("header", True).option("sep", "\t").csv(f"{path}/version={version}")


def _pixel_folder(path: str, source: str, resolution: int) -> str:
    return f"{path}/source={source}/resolution={resolution}"


def write_metacell_pixels(pixels: DataFrame, path: str, source: str, resolution: int, version: str) -> None:
    """Pixels under source=/resolution=/version=/metacell= folders, sorted so that region reads skip row groups.

    They count from the commit that names the version for their metacells.
    """
    (
        pixels.hint("rebalance", "metacell")
        .sortWithinPartitions("metacell", "chrom_ord", "bin1", "bin2")
        .write.partitionBy("metacell")
        .parquet(f"{_pixel_folder(path, source, resolution)}/version={version}")
    )


def write_bins(spark: SparkSession, genome: Genome, resolution: int, path: str) -> None:
    bin_table(spark, genome, resolution).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(
        "resolution"
    ).parquet(path)


def read_metacell_pixels(spark: SparkSession, path: str, source: str, resolution: int) -> DataFrame:
    """metacell, chrom_ord, chrom_ord2, bin1, bin2, value of all contacts, of each metacell the version of the last commit.

    `maps.cis_maps` takes those inside chromosomes.
    """
    live = Manifest(spark, f"{path}/source={source}/_log").live()
    named = F.broadcast(live.where(F.col("resolution") == resolution).select("version", "metacell"))  # one row a metacell
    every = spark.read.schema(METACELL_PIXELS + ", version STRING").parquet(_pixel_folder(path, source, resolution))
    return every.join(named, ["version", "metacell"], "left_semi").select("chrom_ord", "chrom_ord2", "bin1", "bin2", "value", "metacell")


def cell_pixels_genome_wide(pixels: DataFrame, genome: Genome, resolution: int) -> DataFrame:
    """Upper-triangle pixels of each cell in genome-wide bin ids."""
    first = genome.offset(F.col("chrom_ord"), resolution)
    return pixels.select(
        "cell_id", (F.col("bin1") + first).alias("gbin1"), (F.col("bin2") + first).alias("gbin2"), "value"
    ).where(F.col("gbin2") >= F.col("gbin1"))


def write_cell_pixels(pixels: DataFrame, genome: Genome, resolution: int, path: str) -> None:
    """One store for all cells; rows sorted by cell so that a cell's rows are found by row-group statistics."""
    (
        cell_pixels_genome_wide(pixels, genome, resolution)
        .withColumn("resolution", F.lit(resolution))
        .repartitionByRange("cell_id", "gbin1")
        .sortWithinPartitions("cell_id", "gbin1", "gbin2")
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("resolution")
        .parquet(path)
    )


def write_views(view: DataFrame, resolution: int, path: str) -> None:
    view.withColumn("resolution", F.lit(resolution)).write.mode("overwrite").option(
        "partitionOverwriteMode", "dynamic"
    ).partitionBy("resolution").parquet(path)


def read_views(spark: SparkSession, path: str) -> DataFrame | None:
    """Stored views, or nothing when none were stored."""
    return _read_if_present(spark, path)


def _read_if_present(spark: SparkSession, path: str) -> DataFrame | None:
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not jpath.getFileSystem(spark._jsc.hadoopConfiguration()).exists(jpath):
        return None
    return spark.read.parquet(path)


def changed_metacells(before: DataFrame, after: DataFrame) -> DataFrame:
    """Metacells that gained or lost a cell between two allocations (cell_id, metacell)."""
    old = before.select("cell_id", F.col("metacell").alias("old"))
    new = after.select("cell_id", F.col("metacell").alias("new"))
    moved = old.join(new, "cell_id", "full_outer").where(~F.col("old").eqNullSafe(F.col("new")))
    return (
        moved.select(F.explode(F.array("old", "new")).alias("metacell")).where(F.col("metacell").isNotNull()).distinct()
    )


_ENTRY = "kind STRING, base LONG, cell_id LONG, metacell LONG, resolution LONG, version STRING, parameters STRING"


class Manifest:
    """What runs have written, in one commit: per base resolution the allocation table and the parameters, and for every
    metacell and stored resolution the version that counts."""

    def __init__(self, spark: SparkSession, path: str, base: int = 0) -> None:
        self.spark, self.log, self.base = spark, CommitLog(spark, path), base

    def _rows(self, kind: str, back: int = 0) -> DataFrame | None:
        table = self.log.read(back)
        return None if table is None else table.where(F.col("kind") == kind)

    def allocation(self) -> DataFrame | None:
        saved, rows = self.parameters(), self._rows("cell")
        return None if saved is None else rows.where(F.col("base") == self.base).select("cell_id", "metacell")

    def parameters(self) -> dict | None:
        rows = self._rows("parameters")
        found = None if rows is None else rows.where(F.col("base") == self.base).first()
        return None if found is None else json.loads(found.parameters)

    def live(self, back: int = 0) -> DataFrame:
        """resolution, metacell, version."""
        rows = self._rows("live", back)
        if rows is None:
            rows = self.spark.createDataFrame([], _ENTRY)
        return rows.select("resolution", "metacell", "version")

    def save(self, cells: DataFrame, parameters: dict, live: DataFrame | None = None) -> None:
        """One commit: allocation and parameters of this base resolution, versions; other bases stay as they are."""
        names = [c.split()[0] for c in _ENTRY.split(", ")]

        def entries(table: DataFrame, kind: str) -> DataFrame:
            held = table.withColumns({"kind": F.lit(kind), "base": F.lit(self.base).cast("long")})
            missing = {n: F.lit(None).cast(t) for n, t in (c.split() for c in _ENTRY.split(", ")) if n not in held.columns}
            return held.withColumns(missing).select(*names) if missing else held.select(*names)

        text = self.spark.createDataFrame([(json.dumps(parameters, sort_keys=True),)], "parameters STRING")
        table = entries(cells.select("cell_id", "metacell"), "cell").unionByName(entries(text, "parameters"))
        table = table.unionByName(entries(self.live() if live is None else live, "live"))
        last = self.log.read()
        if last is not None:
            table = table.unionByName(last.where((F.col("kind") != "live") & (F.col("base") != self.base)).select(*names))
        self.log.commit(table)

    def stale(self, cells: DataFrame, parameters: dict, force: bool = False) -> DataFrame | None:
        """Metacells to rebuild: None means all of them, an empty table means none."""
        saved = self.allocation()
        if force or saved is None or self.parameters() != parameters:
            return None
        return changed_metacells(saved, cells)


def _vacuum(spark: SparkSession, path: str, source: str, manifest: Manifest) -> None:
    """Delete folders that neither of the last two commits names."""
    kept = {(r["resolution"], r["version"], r["metacell"]) for back in (0, 1) for r in manifest.live(back).toLocalIterator()}
    for level in _names(spark, f"{path}/source={source}"):
        if not level.startswith("resolution="):
            continue
        resolution, folder = int(level.removeprefix("resolution=")), f"{path}/source={source}/{level}"
        for name in _names(spark, folder):
            version = name.removeprefix("version=")
            metacells = {m for r, v, m in kept if (r, v) == (resolution, version)}
            if not metacells:
                _delete(spark, f"{folder}/{name}")
                continue
            for part in _names(spark, f"{folder}/{name}"):
                if part.startswith("metacell=") and int(part.removeprefix("metacell=")) not in metacells:
                    _delete(spark, f"{folder}/{name}/{part}")


def refresh_metacell_pixels(
    contacts: DataFrame, cells: DataFrame, genome: Genome, resolution: int, path: str, force: bool = False,
    levels: Sequence[int] = (), one_based: bool = False,
) -> str:
    """Bring the pixel store up to date, rebuilding only metacells whose members changed. Returns what was done.

    A metacell's pixels sum all its contacts between listed chromosomes, trans and short ones included. Coarser `levels`
    are stored beside the base resolution and belong to the manifest like everything else that decides the content.
    """
    from contactmill.operators.maps import coarsened_maps, metacell_pixels

    spark, pixels = contacts.sparkSession, f"{path}/pixels"
    manifest = Manifest(spark, f"{pixels}/source=pair/_log", resolution)
    parameters = {
        "resolution": resolution, "chroms": [list(c) for c in genome.chroms], "levels": sorted(set(levels)), "one_based": one_based,
    }
    stale = manifest.stale(cells, parameters, force)
    if stale is not None and stale.isEmpty():
        return "skipped"
    members, version = cells if stale is None else cells.join(stale, "metacell", "left_semi"), f"v{uuid.uuid4().hex}"
    base = metacell_pixels(binning.paired_pixels(contacts, genome, resolution, one_based), members, binning.PAIRED)
    write_metacell_pixels(base, pixels, "pair", resolution, version)
    stored = spark.read.schema(METACELL_PIXELS).parquet(f"{_pixel_folder(pixels, 'pair', resolution)}/version={version}")
    for level, table in coarsened_maps(stored, resolution, levels).items():
        if level != resolution:
            write_metacell_pixels(table, pixels, "pair", level, version)
    written = sorted({resolution, *levels})
    own = F.array(*[F.lit(r).cast("long") for r in written])
    fresh = members.select("metacell").distinct().select(F.explode(own).alias("resolution"), "metacell", F.lit(version).alias("version"))
    before = manifest.live()
    kept = before.where(~F.col("resolution").isin(written))  # levels of other base resolutions
    if stale is not None:
        same = before.where(F.col("resolution").isin(written)).join(stale, "metacell", "left_anti")
        kept = kept.unionByName(same.select(*before.columns))
    manifest.save(cells, parameters, kept.unionByName(fresh))
    _vacuum(spark, pixels, "pair", manifest)
    return "rebuilt" if stale is None else "updated"
