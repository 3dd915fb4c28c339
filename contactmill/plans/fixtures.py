"""Stand-in inputs built from the given tables, as DataFrames and as the SQL text the oracle uses.

Cells are the rows of `embeddings`; contacts come from `lineitem` and are spread over all of those cells, so both
the number of cells and the number of contacts grow with the tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from contactmill.genome import Genome
from contactmill.operators import binning

# fixed values: six chromosomes of 20 Mb; contacts on a seventh exercise the "not selected" filter
GENOME = Genome(tuple((f"chr{i}", 20_000_000) for i in range(1, 7)))
MB = 1_000_000


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def contacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    n_cells = _read(spark, sf_dir, "embeddings").select(F.count(F.lit(1))).scalar()
    c = F.col
    line = _read(spark, sf_dir, "lineitem")
    spot = (c("l_partkey") * 7919 + c("l_suppkey") * 104729) % 20_000_000
    hop = F.when(c("l_discount") == 0, F.lit(0).cast("long")).otherwise(
        F.floor(c("l_extendedprice") * c("l_extendedprice") / 1000).cast("long")
    )
    other = F.when(c("l_quantity") > 45, c("l_linenumber") % 7 + 1).otherwise(c("l_linenumber"))
    return line.select(
        (c("l_orderkey") % n_cells).alias("cell_id"),
        F.concat(F.lit("chr"), c("l_linenumber").cast("string")).alias("chrom1"),
        spot.alias("pos1"),
        F.concat(F.lit("chr"), other.cast("string")).alias("chrom2"),
        ((spot + hop) % 20_000_000).alias("pos2"),
    )


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    return _read(spark, sf_dir, "embeddings").select(
        c("vec_id").alias("cell_id"),
        F.concat(F.lit("type_"), c("label").cast("string")).alias("label"),
        F.when(c("vec_id") % 7 == 0, c("vec_id") % 12 + 1).otherwise(c("label") + 1).cast("long").alias("metacell"),
        (c("vec_id") % 3).alias("batch"),
    )


def views(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three overlapping slices of each embedding stand for three resolutions."""
    parts = F.array(*[
        F.struct(F.lit(v).alias("view_id"), F.slice("embedding", start, 24).cast("array<double>").alias("features"))
        for v, start in enumerate((1, 21, 41))
    ])
    table = _read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("cell_id"), F.explode(parts).alias("p"))
    return table.select("p.view_id", "cell_id", "p.features")


def pixels(spark: SparkSession, sf_dir: str, resolution: int = MB) -> DataFrame:
    return binning.cis_pixels(contacts(spark, sf_dir), GENOME, resolution)


def depths(spark: SparkSession, sf_dir: str) -> DataFrame:
    from contactmill.operators import stats

    return stats.cell_depth(contacts(spark, sf_dir), cells(spark, sf_dir))


_PIXEL_CTE = """pix{tag} AS (SELECT cell_id, c1 AS chrom_ord, least(pos1 // {res}, pos2 // {res}) AS bin1,
    greatest(pos1 // {res}, pos2 // {res}) AS bin2, CAST(count(*) AS DOUBLE) AS value
  FROM located WHERE c1 = c2 GROUP BY 1, 2, 3, 4)"""

PRELUDE = (
    """WITH raw_contacts AS (
  SELECT l_orderkey % (SELECT count(*) FROM embeddings) AS cell_id,
    concat('chr', CAST(l_linenumber AS VARCHAR(8))) AS chrom1,
    (l_partkey * 7919 + l_suppkey * 104729) % 20000000 AS pos1,
    concat('chr', CAST(CASE WHEN l_quantity > 45 THEN (l_linenumber % 7) + 1
      ELSE l_linenumber END AS VARCHAR(8))) AS chrom2,
    ((l_partkey * 7919 + l_suppkey * 104729) % 20000000 + CASE WHEN l_discount = 0 THEN 0
      ELSE CAST(floor(l_extendedprice * l_extendedprice / 1000) AS BIGINT) END) % 20000000 AS pos2
  FROM lineitem),
chrom_sizes AS (SELECT * FROM (VALUES (0,'chr1',20000000),(1,'chr2',20000000),(2,'chr3',20000000),
  (3,'chr4',20000000),(4,'chr5',20000000),(5,'chr6',20000000)) AS t(chrom_ord, chrom, size_bp)),
cells AS (SELECT vec_id AS cell_id, concat('type_', CAST(label AS VARCHAR(8))) AS label,
    CAST(CASE WHEN vec_id % 7 = 0 THEN vec_id % 12 + 1 ELSE label + 1 END AS BIGINT) AS metacell,
    vec_id % 3 AS batch
  FROM embeddings),
views AS (SELECT 0 AS view_id, vec_id AS cell_id, CAST(embedding[1:24] AS DOUBLE[]) AS features FROM embeddings
  UNION ALL SELECT 1, vec_id, CAST(embedding[21:44] AS DOUBLE[]) FROM embeddings
  UNION ALL SELECT 2, vec_id, CAST(embedding[41:64] AS DOUBLE[]) FROM embeddings),
kept AS (SELECT * FROM raw_contacts WHERE chrom1 <> chrom2 OR abs(pos2 - pos1) >= 2500 OR pos1 = pos2),
located AS (SELECT k.cell_id, a.chrom_ord AS c1, k.pos1, b.chrom_ord AS c2, k.pos2
  FROM kept k JOIN chrom_sizes a ON a.chrom = k.chrom1 JOIN chrom_sizes b ON b.chrom = k.chrom2),
"""
    + ",\n".join(
        _PIXEL_CTE.format(tag=tag, res=res) for tag, res in (("", 1_000_000), ("500", 500_000), ("100", 100_000))
    )
    + """,
sym AS (SELECT cell_id, chrom_ord, bin1, bin2, value * CASE WHEN bin1 = bin2 THEN 2 ELSE 1 END AS value FROM pix
  UNION ALL SELECT cell_id, chrom_ord, bin2, bin1, value FROM pix WHERE bin1 <> bin2),
grid AS (SELECT chrom_ord, unnest(range(0, 20)) AS bin FROM chrom_sizes),
grid100 AS (SELECT chrom_ord, unnest(range(0, 200)) AS bin FROM chrom_sizes),
depths AS (SELECT c.cell_id, count(r.cell_id) AS depth FROM cells c LEFT JOIN raw_contacts r USING (cell_id) GROUP BY 1),
mcpix AS (SELECT metacell, chrom_ord, bin1, bin2, sum(value) AS value FROM pix JOIN cells USING (cell_id)
  GROUP BY 1, 2, 3, 4),
mcpix500 AS (SELECT metacell, chrom_ord, bin1, bin2, sum(value) AS value FROM pix500 JOIN cells USING (cell_id)
  GROUP BY 1, 2, 3, 4)"""
)
