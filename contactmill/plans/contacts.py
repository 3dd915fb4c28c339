"""Sources, projections and filters on contacts, bins and cells."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from contactmill.functions.draws import hash_key_sql
from contactmill.genome import bin_table
from contactmill.operators import binning
from contactmill.plans import fixtures as fx
from contactmill.plans.catalog import big, query, r6, rounded
from contactmill.plans.scores import METRICS, SWEEP_SQL, sweep_table
from contactmill.session import ensure_checkpoint_dir, materialize
from contactmill.sources import stores
from contactmill.sources.tables import read_sweep

GENOME, MB = fx.GENOME, fx.MB
def count_rows():
    return F.count(F.lit(1))


@query(
    "S2_cell_dimension",
    f"""SELECT {big('dense_rank() OVER (ORDER BY name) - 1', 'cell_id')}, name AS cell_name,
  split_part(split_part(name, '.pairs', 1), '_', 2) AS label
FROM (SELECT DISTINCT concat('cell', CAST(r.cell_id AS VARCHAR), '_type', CAST(c.label AS VARCHAR), '.pairs.gz') AS name
  FROM raw_contacts r JOIN embeddings c ON c.vec_id = r.cell_id)""",
)
def cell_dimension(spark, sf):
    from contactmill.sources.pairs import cell_dimension as dimension

    named = (
        fx.contacts(spark, sf)
        .select("cell_id")
        .distinct()
        .join(fx.cells(spark, sf), "cell_id")
        .select(
            F.concat(
                F.lit("cell"), F.col("cell_id").cast("string"), F.lit("_"), F.replace("label", F.lit("_"), F.lit("")),
                F.lit(".pairs.gz"),
            ).alias("cell_name")
        )
    )
    return dimension(named)


@query(
    "S3_chrom_sizes",
    f"""SELECT {big('s.chrom_ord', 'chrom_ord')}, s.chrom, s.size_bp, {big('count(r.pos1)', 'n_contacts')},
  {big('max(r.pos1)', 'last_pos')}
FROM chrom_sizes s LEFT JOIN raw_contacts r ON r.chrom1 = s.chrom GROUP BY 1, 2, 3""",
)
def chrom_sizes(spark, sf):
    seen = fx.contacts(spark, sf).groupBy(F.col("chrom1").alias("chrom")).agg(
        count_rows().alias("n_contacts"), F.max("pos1").alias("last_pos")
    )
    chroms = GENOME.table(spark).withColumn("chrom_ord", F.col("chrom_ord").cast("long"))
    return chroms.join(seen, "chrom", "left").fillna(0, ["n_contacts"]).select(
        "chrom_ord", "chrom", "size_bp", "n_contacts", "last_pos"
    )


_BINS_SQL = """bins AS (SELECT s.chrom_ord, s.chrom, s.size_bp, unnest(range(0, CAST(ceil(s.size_bp / 300000) AS BIGINT))) AS bin
  FROM chrom_sizes s),
offsets AS (SELECT chrom_ord, coalesce(sum(ceil(size_bp / 300000)) OVER (ORDER BY chrom_ord
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS first FROM chrom_sizes),
hits AS (SELECT c1 AS chrom_ord, pos1 // 300000 AS bin, count(*) AS n FROM located GROUP BY 1, 2)"""


@query(
    "S4_bin_table",
    f"""SELECT {big('b.chrom_ord', 'chrom_ord')}, b.chrom, {big('b.bin', 'bin')}, {big('b.bin + o.first', 'gbin')},
  {big('b.bin * 300000', 'start')}, {big('least((b.bin + 1) * 300000, b.size_bp)', 'end')},
  {big('coalesce(h.n, 0)', 'n_contacts')}
FROM bins b JOIN offsets o USING (chrom_ord) LEFT JOIN hits h ON h.chrom_ord = b.chrom_ord AND h.bin = b.bin""",
    _BINS_SQL,
)
def bins_with_hits(spark, sf):
    hits = (
        binning.bin_contacts(fx.contacts(spark, sf), GENOME, 300_000)
        .groupBy(F.col("chrom_ord1").alias("chrom_ord"), F.col("bin1").alias("bin"))
        .agg(count_rows().alias("n_contacts"))
    )
    return (
        bin_table(spark, GENOME, 300_000)
        .join(hits, ["chrom_ord", "bin"], "left")
        .fillna(0, ["n_contacts"])
        .select(F.col("chrom_ord").cast("long").alias("chrom_ord"), "chrom", "bin", "gbin", "start", "end", "n_contacts")
    )


@query(
    "W5_genome_offset",
    f"""SELECT {big('b.chrom_ord', 'chrom_ord')}, {big('min(b.bin + o.first)', 'first_gbin')}, {big('max(b.bin + o.first)', 'last_gbin')},
  {big('sum(coalesce(h.n, 0))', 'n_contacts')}
FROM bins b JOIN offsets o USING (chrom_ord) LEFT JOIN hits h ON h.chrom_ord = b.chrom_ord AND h.bin = b.bin GROUP BY 1""",
    _BINS_SQL,
)
def genome_offsets(spark, sf):
    binned = binning.genome_wide(binning.bin_contacts(fx.contacts(spark, sf), GENOME, 300_000), GENOME, 300_000)
    hits = binned.groupBy(F.col("gbin1").alias("gbin")).agg(count_rows().alias("n"))
    return (
        bin_table(spark, GENOME, 300_000)
        .join(hits, "gbin", "left")
        .groupBy(F.col("chrom_ord").cast("long").alias("chrom_ord"))
        .agg(
            F.min("gbin").alias("first_gbin"),
            F.max("gbin").alias("last_gbin"),
            F.coalesce(F.sum("n"), F.lit(0)).alias("n_contacts"),
        )
    )


@query("P1_short_range_filter", f"SELECT cell_id, chrom1, {big('pos1', 'pos1')}, chrom2, {big('pos2', 'pos2')} FROM kept")
def short_range_filter(spark, sf):
    return binning.drop_short_range(fx.contacts(spark, sf))


@query(
    "P2_position_to_bin",
    f"SELECT cell_id, chrom1, chrom2, {big('pos1 // 500000', 'bin1')}, {big('floor((pos2 - 1) / CAST(500000 AS DOUBLE))', 'bin2')} FROM kept",
)
def position_to_bin(spark, sf):
    kept = binning.drop_short_range(fx.contacts(spark, sf))
    return kept.select(
        "cell_id", "chrom1", "chrom2",
        binning.to_bin(F.col("pos1"), 500_000).alias("bin1"),
        binning.to_bin(F.col("pos2"), 500_000, one_based=True).alias("bin2"),
    )


@query(
    "P3_listed_chromosomes",
    f"SELECT cell_id, {big('c1', 'chrom_ord1')}, {big('pos1', 'pos1')}, {big('c2', 'chrom_ord2')}, {big('pos2', 'pos2')} FROM located",
)
def listed_chromosomes(spark, sf):
    located = binning.locate(binning.drop_short_range(fx.contacts(spark, sf)), GENOME)
    return located.select(
        "cell_id", F.col("chrom_ord1").cast("long").alias("chrom_ord1"), "pos1",
        F.col("chrom_ord2").cast("long").alias("chrom_ord2"), "pos2",
    )


@query(
    "P4_genome_wide_bins",
    f"""SELECT cell_id, {big('c1', 'chrom_ord1')}, {big('c2', 'chrom_ord2')}, {big('pos1 // 1000000 + 20 * c1', 'gbin1')},
  {big('pos2 // 1000000 + 20 * c2', 'gbin2')} FROM located""",
)
def genome_wide_bins(spark, sf):
    binned = binning.genome_wide(binning.bin_contacts(fx.contacts(spark, sf), GENOME, MB), GENOME, MB)
    return binned.select(
        "cell_id", F.col("chrom_ord1").cast("long").alias("chrom_ord1"),
        F.col("chrom_ord2").cast("long").alias("chrom_ord2"), "gbin1", "gbin2",
    )


@query(
    "J1_chromosome_lookup",
    f"""SELECT {big('c1', 'chrom_ord1')}, {big('c2', 'chrom_ord2')}, {big('min(pos1 // 1000000 + 20 * c1)', 'first_gbin')},
  {big('count(*)', 'n')} FROM located GROUP BY 1, 2""",
)
def chromosome_lookup(spark, sf):
    binned = binning.genome_wide(binning.bin_contacts(fx.contacts(spark, sf), GENOME, MB), GENOME, MB)
    return binned.groupBy(
        F.col("chrom_ord1").cast("long").alias("chrom_ord1"), F.col("chrom_ord2").cast("long").alias("chrom_ord2")
    ).agg(F.min("gbin1").alias("first_gbin"), count_rows().alias("n"))


@query(
    "P5_split_cis_trans",
    f"""SELECT cell_id, {big('count(*) FILTER (WHERE c1 = c2)', 'cis')}, {big('count(*) FILTER (WHERE c1 <> c2)', 'trans')}
FROM located GROUP BY 1""",
)
def split_cis_trans(spark, sf):
    cis, trans = binning.split_cis_trans(binning.bin_contacts(fx.contacts(spark, sf), GENOME, MB))
    tagged = cis.select("cell_id", F.lit(1).alias("c"), F.lit(0).alias("t")).unionByName(
        trans.select("cell_id", F.lit(0).alias("c"), F.lit(1).alias("t"))
    )
    return tagged.groupBy("cell_id").agg(F.sum("c").alias("cis"), F.sum("t").alias("trans"))


@query(
    "P6_canonical_order",
    f"""SELECT cell_id, {big('c1', 'chrom_ord')}, {big('least(pos1 // 1000000, pos2 // 1000000)', 'bin1')},
  {big('greatest(pos1 // 1000000, pos2 // 1000000)', 'bin2')} FROM located WHERE c1 = c2""",
)
def canonical_order(spark, sf):
    cis, _ = binning.split_cis_trans(binning.bin_contacts(fx.contacts(spark, sf), GENOME, MB))
    return binning.order_bins(cis).select(
        "cell_id", F.col("chrom_ord1").cast("long").alias("chrom_ord"), "bin1", "bin2"
    )


_NUMBER = "CAST(concat(chrom1[4:], chrom2[4:]) AS BIGINT)"


@query(
    "P7_downsample",
    f"""SELECT cell_id, chrom1, {big('pos1', 'pos1')}, chrom2, {big('pos2', 'pos2')} FROM (
  SELECT *, row_number() OVER (PARTITION BY cell_id ORDER BY {hash_key_sql('cell_id', 'pos1', 'pos2', _NUMBER, seed=7)},
    chrom1, pos1, chrom2, pos2) AS rn, count(*) OVER (PARTITION BY cell_id) AS n FROM raw_contacts)
WHERE rn <= floor(n * CAST(0.3 AS DOUBLE))""",
)
def downsample(spark, sf):
    return binning.downsample(fx.contacts(spark, sf), 0.3, seed=7)


@query(
    "P8_distance_band",
    f"SELECT cell_id, {big('chrom_ord', 'chrom_ord')}, bin1, bin2, value FROM pix WHERE bin2 - bin1 > 1 AND bin2 - bin1 < 9",
)
def distance_band(spark, sf):
    banded = binning.distance_band(fx.pixels(spark, sf), 1, 9)
    return banded.withColumn("chrom_ord", F.col("chrom_ord").cast("long"))


@query(
    "P10_recode_labels",
    f"""SELECT CASE WHEN label IN ('type_1', 'type_2', 'type_3') THEN 'merged' ELSE label END AS label,
  {big('count(*)', 'n')} FROM cells GROUP BY 1""",
)
def recode_labels(spark, sf):
    from contactmill.sources.tables import recode

    merged = recode(fx.cells(spark, sf), "label", {"merged": ["type_1", "type_2", "type_3"]})
    return merged.groupBy("label").agg(count_rows().alias("n"))


@query("P11_cells_by_label", "SELECT cell_id, label, metacell FROM cells WHERE label IN ('type_0', 'type_4')")
def cells_by_label(spark, sf):
    return fx.cells(spark, sf).where(F.col("label").isin("type_0", "type_4")).select("cell_id", "label", "metacell")


@query(
    "P15_bin_pairs",
    f"""SELECT {big('a.chrom_ord', 'chrom_ord')}, {big('a.bin + 1', 'bin1')}, {big('b.bin + 1', 'bin2')}, {big('coalesce(p.n, 0)', 'n_contacts')}
FROM grid a JOIN grid b ON a.chrom_ord = b.chrom_ord AND b.bin - a.bin >= 1 AND b.bin - a.bin < 6
LEFT JOIN (SELECT chrom_ord, bin1, bin2, sum(value) AS n FROM pix GROUP BY 1, 2, 3) p
  ON p.chrom_ord = a.chrom_ord AND p.bin1 = a.bin AND p.bin2 = b.bin
WHERE (a.chrom_ord, a.bin) NOT IN (SELECT (chrom_ord, bin) FROM dense) AND (b.chrom_ord, b.bin) NOT IN (SELECT (chrom_ord, bin) FROM dense)""",
    """dense AS (SELECT chrom_ord, bin FROM (SELECT chrom_ord, bin1 AS bin, sum(value) AS s FROM sym GROUP BY 1, 2)
  WHERE s > 1.02 * (SELECT avg(s) FROM (SELECT sum(value) AS s FROM sym GROUP BY chrom_ord, bin1)))""",
)
def bin_pairs(spark, sf):
    pixels = fx.pixels(spark, sf)
    coverage = binning.symmetrize(pixels).groupBy("chrom_ord", F.col("bin1").alias("bin")).agg(F.sum("value").alias("s"))
    masked = coverage.where(F.col("s") > coverage.select(F.avg("s") * 1.02).scalar()).select("chrom_ord", "bin")
    pairs = binning.bin_pairs(
        bin_table(spark, GENOME, MB).select("chrom_ord", "bin"), GENOME.n_bins(F.col("chrom_ord"), MB), 1, 6, masked
    )
    seen = pixels.groupBy("chrom_ord", (F.col("bin1") + 1).alias("bin1"), (F.col("bin2") + 1).alias("bin2")).agg(
        F.sum("value").cast("long").alias("n_contacts")
    )
    return (
        pairs.join(seen, ["chrom_ord", "bin1", "bin2"], "left")
        .fillna(0, ["n_contacts"])
        .withColumn("chrom_ord", F.col("chrom_ord").cast("long"))
    )


@query(
    "J6_mask_centromeres",
    f"""SELECT cell_id, {big('chrom_ord', 'chrom_ord')}, bin1, bin2, value FROM pix500 p WHERE NOT EXISTS (SELECT 1 FROM gaps g
  WHERE g.chrom_ord = p.chrom_ord AND p.bin1 >= floor((g.s - 100000) / 500000) AND p.bin1 < ceil((g.e + 100000) / 500000))
  AND NOT EXISTS (SELECT 1 FROM gaps g
  WHERE g.chrom_ord = p.chrom_ord AND p.bin2 >= floor((g.s - 100000) / 500000) AND p.bin2 < ceil((g.e + 100000) / 500000))""",
    """gaps AS (SELECT chrom_ord, 7000000 + 1000000 * chrom_ord AS s, 8200000 + 1000000 * chrom_ord AS e FROM chrom_sizes)""",
)
def mask_centromeres(spark, sf):
    bands = GENOME.table(spark).select(
        "chrom",
        (7_000_000 + F.col("chrom_ord") * MB).cast("long").alias("start"),
        (8_200_000 + F.col("chrom_ord") * MB).cast("long").alias("end"),
        F.lit("p11").alias("name"),
        F.lit("acen").alias("type"),
    )
    masked = F.broadcast(binning.masked_bins(bands, GENOME, 500_000))  # bins of a genome at one resolution
    pixels = fx.pixels(spark, sf, 500_000)
    for side in ("bin1", "bin2"):
        pixels = pixels.join(masked.withColumnRenamed("bin", side), ["chrom_ord", side], "left_anti")
    return pixels.select("cell_id", F.col("chrom_ord").cast("long").alias("chrom_ord"), "bin1", "bin2", "value")


_NODE_SQL = "(SELECT max(cell_id) + 1 FROM cells)"


@query(
    "P17_node_ids",
    f"""SELECT {big('p.cell_id', 'node0')}, {big(f'p.bin1 + 20 * p.chrom_ord + {_NODE_SQL}', 'node1')},
  {big(f'p.bin2 + 20 * p.chrom_ord + {_NODE_SQL}', 'node2')}, {big(f'{_NODE_SQL} + 20 * p.chrom_ord', 'first')},
  {big(f'{_NODE_SQL} + 20 * p.chrom_ord + 20', 'stop')}, p.value FROM pix p""",
)
def node_ids(spark, sf):
    cells = fx.cells(spark, sf)
    n_cells = cells.select(F.max("cell_id") + 1).scalar()
    nodes = binning.node_ids(fx.pixels(spark, sf), GENOME, MB, n_cells)
    table = binning.node_table(cells, GENOME, MB).where(F.col("chrom_ord") >= 0).drop("chrom_ord")
    return nodes.join(table, nodes.node1 == table.node).select("node0", "node1", "node2", "first", "stop", "value")


@query(
    "P18_bin_attributes",
    f"""SELECT {big('g.chrom_ord', 'chrom_ord')}, {big('g.bin', 'bin')}, {r6('g.bin / CAST(20 AS DOUBLE)', 'coordinate')},
  {big('x.pos', 'pos')}, {big('CASE WHEN x.pos = g.chrom_ord THEN 1 ELSE 0 END', 'flag')}, {big('coalesce(h.n, 0)', 'n_contacts')}
FROM grid g CROSS JOIN (SELECT unnest(range(0, 6)) AS pos) x
LEFT JOIN (SELECT chrom_ord, bin1, count(*) AS n FROM pix GROUP BY 1, 2) h ON h.chrom_ord = g.chrom_ord AND h.bin1 = g.bin""",
)
def bin_attributes(spark, sf):
    from contactmill.operators.features import bin_attributes as attributes

    hits = fx.pixels(spark, sf).groupBy("chrom_ord", F.col("bin1").alias("bin")).agg(count_rows().alias("n_contacts"))
    table = attributes(spark, GENOME, MB).join(hits, ["chrom_ord", "bin"], "left").fillna(0, ["n_contacts"])
    return table.select(
        F.col("chrom_ord").cast("long").alias("chrom_ord"), "bin", rounded("coordinate"),
        F.posexplode("one_hot").alias("pos", "flag"), "n_contacts",
    ).withColumns({"pos": F.col("pos").cast("long"), "flag": F.col("flag").cast("long")})


@query(
    "P19_cell_covariates",
    f"""SELECT c.cell_id, {r6('ln(1 + coalesce(r.reads, 0))', 'log_reads')}, {big('b.pos', 'pos')},
  {big('CASE WHEN b.pos = c.batch THEN 1 ELSE 0 END', 'flag')}
FROM cells c LEFT JOIN (SELECT cell_id, sum(value) AS reads FROM pix GROUP BY 1) r USING (cell_id)
CROSS JOIN (SELECT unnest(range(0, 3)) AS pos) b""",
)
def cell_covariates(spark, sf):
    from contactmill.operators.features import cell_covariates as covariates

    table = covariates(fx.pixels(spark, sf), fx.cells(spark, sf))
    return table.select("cell_id", rounded("log_reads"), F.posexplode("one_hot").alias("pos", "flag")).withColumns(
        {"pos": F.col("pos").cast("long"), "flag": F.col("flag").cast("long")}
    )


@query(
    "S7_cell_batches",
    f"""SELECT CAST(coalesce(s.s_suppkey % 3, 0) AS VARCHAR) AS batch, {big('count(*)', 'n_cells')}, {big('sum(d.depth)', 'depth')}
FROM cells c LEFT JOIN supplier s ON s.s_suppkey = c.cell_id JOIN depths d ON d.cell_id = c.cell_id GROUP BY 1""",
)
def cell_batches(spark, sf):
    from contactmill.sources.tables import attach_batches

    given = spark.read.parquet(f"{sf}/supplier.parquet").select(
        F.col("s_suppkey").alias("cell_id"), (F.col("s_suppkey") % 3).cast("string").alias("batch")
    )
    cells = attach_batches(fx.depths(spark, sf), given, default="0")
    return cells.groupBy("batch").agg(count_rows().alias("n_cells"), F.sum("depth").alias("depth"))


@query(
    "S6_masked_bins",
    f"""SELECT DISTINCT {big('chrom_ord', 'chrom_ord')}, {big('b', 'bin')} FROM (SELECT chrom_ord,
  unnest(range(CAST(greatest(floor((lo - 100000) / CAST(500000 AS DOUBLE)), 0) AS BIGINT), CAST(least(ceil((hi + 100000) / CAST(500000 AS DOUBLE)), 40) AS BIGINT))) AS b
  FROM thin)""",
    """perbin AS (SELECT c1 AS chrom_ord, pos1 // 1000000 AS b, count(*) AS n FROM located GROUP BY 1, 2),
thin AS (SELECT chrom_ord, b * 1000000 AS lo, (b + 1) * 1000000 AS hi FROM perbin WHERE n < (SELECT avg(n) FROM perbin) * 0.97)""",
)
def masked_bins(spark, sf):
    """Thinly covered megabases stand for centromere bands."""
    located = binning.bin_contacts(fx.contacts(spark, sf), GENOME, MB)
    per_bin = located.groupBy(F.col("chrom_ord1").alias("chrom_ord"), F.col("bin1").alias("b")).agg(count_rows().alias("n"))
    limit = per_bin.select(F.avg("n") * 0.97).scalar()
    bands = per_bin.join(F.broadcast(GENOME.table(spark)), "chrom_ord").select(
        "chrom", (F.col("b") * MB).alias("start"), ((F.col("b") + 1) * MB).alias("end"), F.lit("band").alias("name"),
        F.when(F.col("n") < limit, "acen").otherwise("gneg").alias("type"),
    )
    return binning.masked_bins(bands, GENOME, 500_000).withColumn("chrom_ord", F.col("chrom_ord").cast("long"))


def scratch_path(spark, name):
    """A new folder below the shared checkpoint folder."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"


@query(
    "S10_stored_views",
    f"""SELECT {big('CASE view_id WHEN 0 THEN 500000 WHEN 1 THEN 1000000 ELSE 50000 END', 'resolution')}, cell_id, {big('pos', 'pos')}, {r6('x', 'value')}
FROM (SELECT view_id, cell_id, unnest(range(0, 24)) AS pos, unnest(features) AS x FROM views)""",
)
def stored_views(spark, sf):
    """Views written by resolution and read back."""
    path = scratch_path(spark, "views")
    views = fx.views(spark, sf)
    for view_id, resolution in ((0, 500_000), (1, MB), (2, 50_000)):
        stores.write_views(views.where(F.col("view_id") == view_id).drop("view_id"), resolution, path)
    back = stores.read_views(spark, path)
    return back.select(
        F.col("resolution").cast("long").alias("resolution"), "cell_id", F.posexplode("features").alias("pos", "value")
    ).withColumns({"pos": F.col("pos").cast("long"), "value": rounded("value")})


@query(
    "S11_sweep_files",
    f"SELECT method, {big('k', 'k')}, " + ", ".join(r6(m, m) for m in METRICS) + " FROM sweep",
    SWEEP_SQL,
)
def sweep_files(spark, sf):
    """One CSV per method, first column unnamed, read back and stacked."""
    table = materialize(sweep_table(spark, sf))
    read = []
    for i in range(3):
        path = scratch_path(spark, "sweep")
        one = table.where(F.col("method") == f"method_{i}").select(F.col("k").alias(" "), *METRICS)
        one.write.option("header", True).csv(path)
        read.append(read_sweep(spark, path, f"method_{i}"))
    stacked = read[0].unionByName(read[1]).unionByName(read[2])
    return stacked.select("method", F.col("k").cast("long").alias("k"), *[rounded(m) for m in METRICS])
