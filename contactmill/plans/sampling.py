"""Hyperedges, negatives, splits and batches."""

from __future__ import annotations

from pyspark.sql import functions as F

from contactmill.functions.draws import MODULUS, hash_key_sql
from contactmill.operators import binning, sampling
from contactmill.plans import fixtures as fx
from contactmill.plans.catalog import big, query, r6, rounded
from contactmill.session import materialize

GENOME, MB = fx.GENOME, fx.MB
def count_rows():
    return F.count(F.lit(1))


def edges(spark, sf):
    """Pixels as padded triples of cell and genome-wide bins in one id space."""
    n_cells = fx.cells(spark, sf).select(F.max("cell_id") + 1).scalar()
    nodes = binning.node_ids(fx.pixels(spark, sf), GENOME, MB, n_cells)
    return sampling.padded_edges(nodes, ["node0", "node1", "node2"])


EDGE_SQL = """ed AS (SELECT cell_id + 1 AS a, bin1 + 20 * chrom_ord + (SELECT max(cell_id) + 1 FROM cells) + 1 AS b,
    bin2 + 20 * chrom_ord + (SELECT max(cell_id) + 1 FROM cells) + 1 AS c FROM pix)"""


def _abc(df, column="edge", names=("a", "b", "c")):
    return df.select(*[F.col(column)[i].cast("long").alias(n) for i, n in enumerate(names)])


@query("P16_padded_edges", f"SELECT {big('a', 'a')}, {big('b', 'b')}, {big('c', 'c')} FROM ed", EDGE_SQL)
def padded_edges(spark, sf):
    return _abc(edges(spark, sf))


@query("U4_distinct_edges", f"SELECT DISTINCT {big('a', 'a')}, {big('b', 'b')}, {big('c', 'c')} FROM ed", EDGE_SQL)
def distinct_edges(spark, sf):
    return _abc(sampling.distinct_edges(edges(spark, sf)))


@query(
    "U4_node_pairs",
    f"""SELECT DISTINCT {big('x', 'x')}, {big('y', 'y')} FROM (SELECT a AS x, b AS y FROM ed UNION ALL SELECT b, a FROM ed UNION ALL SELECT a, c FROM ed
  UNION ALL SELECT c, a FROM ed UNION ALL SELECT b, c FROM ed UNION ALL SELECT c, b FROM ed) WHERE x <> y""",
    EDGE_SQL,
)
def node_pairs(spark, sf):
    return sampling.node_pairs(edges(spark, sf)).select(F.col("x").cast("long").alias("x"), F.col("y").cast("long").alias("y"))


@query(
    "U4_leave_one_out",
    f"""SELECT DISTINCT {big('x', 'a')}, {big('y', 'b')}, {big('z', 'c')} FROM (SELECT 0 AS x, b AS y, c AS z FROM ed
  UNION ALL SELECT a, 0, c FROM ed UNION ALL SELECT a, b, 0 FROM ed)""",
    EDGE_SQL,
)
def leave_one_out(spark, sf):
    return _abc(sampling.leave_one_out(edges(spark, sf)))


@query(
    "M42_stencil_edges",
    f"""SELECT {big('e.a', 'a')}, {big('e.b', 'b')}, {big('e.c', 'c')}, {big('list_sort([e.a, e.b + m.i, e.c + m.j])[1]', 'na')},
  {big('list_sort([e.a, e.b + m.i, e.c + m.j])[2]', 'nb')}, {big('list_sort([e.a, e.b + m.i, e.c + m.j])[3]', 'nc')}
FROM ed e CROSS JOIN (SELECT * FROM (VALUES (-1,0),(0,-1),(0,0),(0,1),(1,0)) t(i, j)) m""",
    EDGE_SQL,
)
def stencil_edges(spark, sf):
    out = sampling.stencil_edges(edges(spark, sf))
    return out.select(
        *[F.col("edge")[i].cast("long").alias(n) for i, n in enumerate("abc")],
        *[F.col("neighbor")[i].cast("long").alias(f"n{n}") for i, n in enumerate("abc")],
    )


_PROBE = """cand AS (SELECT DISTINCT (cell_id + 1) % (SELECT count(*) FROM cells) AS cell_id, chrom_ord, bin1, bin2 FROM pix)"""


def candidates(spark, sf):
    """Every pixel asked of the next cell."""
    n = fx.cells(spark, sf).select(count_rows()).scalar()
    return fx.pixels(spark, sf).select(((F.col("cell_id") + 1) % n).alias("cell_id"), "chrom_ord", "bin1", "bin2").distinct()


@query(
    "J13_contact_probe",
    f"""SELECT DISTINCT c.cell_id, {big('c.chrom_ord', 'chrom_ord')}, c.bin1, c.bin2 FROM cand c JOIN sym s ON s.cell_id = c.cell_id
  AND s.chrom_ord = c.chrom_ord AND abs(s.bin1 - c.bin1) <= 1 AND abs(s.bin2 - c.bin2) <= 1 AND s.bin1 < 19 AND s.bin2 < 19""",
    _PROBE,
)
def contact_probe(spark, sf):
    hit = sampling.near_contacts(candidates(spark, sf), fx.pixels(spark, sf), GENOME.n_bins(F.col("chrom_ord"), MB))
    return hit.withColumn("chrom_ord", F.col("chrom_ord").cast("long"))


@query(
    "M34_adjacency_rows",
    f"""SELECT cell_id, {big('chrom_ord', 'chrom_ord')}, bin1, bin2, {r6('ln(1 + value)', 'value')} FROM (
  SELECT *, count(*) OVER (PARTITION BY cell_id, chrom_ord, bin1) AS n FROM sym)
WHERE NOT (bin2 = bin1 + 1 AND {hash_key_sql('cell_id', 'chrom_ord', 'bin1', seed=3)} / CAST({MODULUS} AS DOUBLE) >= 0.6 AND n > 1)""",
)
def adjacency_rows(spark, sf):
    full = binning.symmetrize(fx.pixels(spark, sf))
    out = sampling.adjacency_rows(full, ["cell_id", "chrom_ord", "bin1"], "bin2", F.col("bin1") + 1, seed=3)
    return out.withColumns({"chrom_ord": F.col("chrom_ord").cast("long"), "value": rounded("value")})


def negative_table(spark, sf):
    pix = materialize(fx.pixels(spark, sf))  # read as positives and as contacts
    positives = pix.where(F.col("bin2") - F.col("bin1") >= 2)
    n_cells = fx.cells(spark, sf).count()
    return sampling.negatives(positives, pix, GENOME, MB, n_cells, per_positive=2, max_bin=12, seed=9)


def _pick_sql(salt: int, low: str, high: str) -> str:
    draw = hash_key_sql("cell_id", "chrom_ord", "bin1", "bin2", "slot", "attempt", str(salt), seed=9)
    return f"({low} + CAST(floor({draw} / CAST({MODULUS} AS DOUBLE) * ({high} - {low})) AS BIGINT))"


def _base_sql(salt: int) -> str:
    return hash_key_sql("cell_id", "chrom_ord", "bin1", "bin2", "slot", str(salt), seed=9)


_NEAR = ("greatest(0, bin2 - 12)", "least(20, bin2 + 12)")
NEGATIVE_SQL = f"""slots AS (SELECT cell_id, chrom_ord, bin1, bin2, slot, {_base_sql(1)} % 3 AS change,
    {_base_sql(2)} / CAST({MODULUS} AS DOUBLE) <= 0.5 AS easy
  FROM (SELECT cell_id, chrom_ord, bin1, bin2, unnest([0, 1]) AS slot FROM pix WHERE bin2 - bin1 >= 2)),
attempts AS (SELECT *, {_pick_sql(3, "0", "(SELECT count(*) FROM cells)")} AS anycell, {_pick_sql(4, *_NEAR)} AS n1, {_pick_sql(5, *_NEAR)} AS n2,
    {_pick_sql(6, "0", "20")} AS a1 FROM (SELECT *, unnest(range(1, 51)) AS attempt FROM slots)),
corrupted AS (SELECT *, {_pick_sql(7, "greatest(0, a1 - 12)", "least(20, a1 + 12)")} AS a2 FROM attempts),
triples AS (SELECT *, CASE WHEN easy AND change <> 0 THEN cell_id ELSE anycell END AS nc,
    CASE WHEN NOT easy THEN a1 WHEN change = 1 THEN n1 ELSE bin1 END AS x1, CASE WHEN NOT easy THEN a2 WHEN change = 2 THEN n2 ELSE bin2 END AS x2
  FROM corrupted),
banded AS (SELECT cell_id AS of_cell_id, chrom_ord, bin1 AS of_bin1, bin2 AS of_bin2, slot, attempt, nc AS cell_id, least(x1, x2) AS b1,
    greatest(x1, x2) AS b2 FROM triples WHERE abs(x1 - x2) > 1 AND abs(x1 - x2) < 12),
wide AS (SELECT DISTINCT cell_id, chrom_ord, bin1 + i AS b1, bin2 + j AS b2 FROM sym CROSS JOIN (SELECT unnest([-1, 0, 1]) AS i)
  CROSS JOIN (SELECT unnest([-1, 0, 1]) AS j) WHERE bin1 <= 18 AND bin2 <= 18),
free AS (SELECT * FROM banded ANTI JOIN wide USING (cell_id, chrom_ord, b1, b2))"""


@query(
    "M35_negatives",
    f"""SELECT of_cell_id, of_bin1, of_bin2, {big('chrom_ord', 'chrom_ord')}, slot, arg_min(cell_id, attempt) AS cell_id,
  arg_min(b1, attempt) AS bin1, arg_min(b2, attempt) AS bin2 FROM free GROUP BY of_cell_id, of_bin1, of_bin2, chrom_ord, slot""",
    NEGATIVE_SQL,
)
def negatives(spark, sf):
    return negative_table(spark, sf).withColumn("chrom_ord", F.col("chrom_ord").cast("long"))


@query(
    "M36_negative_ratio",
    f"""SELECT {big('CASE WHEN d > 0.3 THEN 1 WHEN d > 0.2 THEN 2 WHEN d > 0.15 THEN 3 WHEN d > 0.1 THEN 4 ELSE 5 END', 'ratio')}, {r6('d', 'density')}
FROM (SELECT count(*) / CAST((SELECT count(*) FROM cells) * 6 * 210 AS DOUBLE) AS d FROM pix WHERE bin2 - bin1 >= 2)""",
)
def negative_ratio(spark, sf):
    n_cells = fx.cells(spark, sf).select(count_rows()).scalar()
    n = fx.pixels(spark, sf).where(F.col("bin2") - F.col("bin1") >= 2).agg(count_rows().alias("n"))
    ratio = sampling.negatives_per_positive(F.col("n"), n_cells, GENOME, MB)
    return n.select(ratio.cast("long").alias("ratio"), rounded(F.col("n") / (n_cells * F.lit(1260.0)), "density"))


@query(
    "M37_class_weights",
    f"""SELECT cell_id, {big('chrom_ord', 'chrom_ord')}, bin1, bin2,
  {r6('least(log2(value + 1), (SELECT quantile_cont(log2(value + 1), 0.99) FROM pix)) / CAST(1.5 AS DOUBLE) * 5', 'weight')} FROM pix""",
)
def class_weights(spark, sf):
    out = sampling.class_weights(fx.pixels(spark, sf), 1.5, 5.0)
    return out.select("cell_id", F.col("chrom_ord").cast("long").alias("chrom_ord"), "bin1", "bin2", rounded("weight"))


_HASH = hash_key_sql("cell_id", "chrom_ord", "bin1", "bin2", seed=11)


@query(
    "M38_train_test_split",
    f"""SELECT cell_id, {big('chrom_ord', 'chrom_ord')}, bin1, bin2, value, r <= floor(n * CAST(0.85 AS DOUBLE)) AS train FROM (
  SELECT *, row_number() OVER (PARTITION BY chrom_ord ORDER BY {_HASH}, cell_id, bin1, bin2) AS r,
    count(*) OVER (PARTITION BY chrom_ord) AS n FROM pix WHERE bin2 - bin1 >= 2)""",
)
def train_test_split(spark, sf):
    out = sampling.train_test_split(fx.pixels(spark, sf), seed=11)
    return out.withColumn("chrom_ord", F.col("chrom_ord").cast("long"))


@query(
    "M39_epoch_batches",
    f"""SELECT {big('chrom_ord', 'chrom_ord')}, {big('(r - 1) // 5000', 'batch')}, {big('count(*)', 'n')}, {big('sum(cell_id)', 'cells')}, {big('max(copy)', 'last_copy')} FROM (
  SELECT *, row_number() OVER (PARTITION BY chrom_ord ORDER BY {hash_key_sql('cell_id', 'chrom_ord', 'bin1', 'bin2', 'copy', seed=1)}, cell_id, bin1, bin2, copy) AS r
  FROM (SELECT p.*, unnest(range(0, CASE WHEN n > 5000 THEN 1 ELSE CAST(pow(2, floor(log2(5000 / CAST(n AS DOUBLE))) + 1) AS BIGINT) END)) AS copy
    FROM pix p JOIN (SELECT chrom_ord, count(*) AS n FROM pix GROUP BY 1) USING (chrom_ord))) GROUP BY 1, 2""",
)
def epoch_batches(spark, sf):
    out = sampling.epoch_batches(fx.pixels(spark, sf), 5000, epoch=1)
    return out.groupBy(F.col("chrom_ord").cast("long").alias("chrom_ord"), "batch").agg(
        count_rows().alias("n"), F.sum("cell_id").alias("cells"), F.max("copy").cast("long").alias("last_copy")
    )
