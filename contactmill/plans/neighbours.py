"""Neighbour graphs, kernels and sums over neighbours."""

from __future__ import annotations

from pyspark.sql import functions as F

from contactmill.functions import vectors
from contactmill.functions.draws import hash_key_sql
from contactmill.operators import graph
from contactmill.plans import fixtures as fx
from contactmill.plans.catalog import big, query, r6, rounded

K = 15

KNN_SQL = """nv AS MATERIALIZED (SELECT view_id, cell_id, list_transform(features, lambda x: x / sqrt(list_sum(list_transform(features, lambda y: y * y)))) AS f FROM views),
pairs AS MATERIALIZED (SELECT a.view_id, a.cell_id, b.cell_id AS neighbor, list_distance(a.f, b.f) AS distance
  FROM nv a JOIN nv b ON a.view_id = b.view_id AND a.cell_id <> b.cell_id),
ranked AS (SELECT *, row_number() OVER (PARTITION BY view_id, cell_id ORDER BY distance, neighbor) AS rank FROM pairs),
near AS MATERIALIZED (SELECT * FROM ranked WHERE rank <= 14),
sig AS (SELECT view_id, cell_id, distance AS sigma FROM (SELECT *, row_number() OVER (PARTITION BY view_id, cell_id ORDER BY distance) AS r
  FROM near WHERE distance > 0) WHERE r = 7),
uni AS (SELECT view_id, cell_id AS i, neighbor AS j FROM near WHERE distance > 0 UNION SELECT view_id, neighbor, cell_id FROM near WHERE distance > 0),
inter AS (SELECT view_id, cell_id AS i, neighbor AS j FROM near WHERE distance > 0 INTERSECT SELECT view_id, neighbor, cell_id FROM near WHERE distance > 0),
kern AS (SELECT u.view_id, u.i, u.j, exp(-p.distance * p.distance / (a.sigma * b.sigma)) AS w FROM uni u
  JOIN pairs p ON p.view_id = u.view_id AND p.cell_id = u.i AND p.neighbor = u.j
  JOIN sig a ON a.view_id = u.view_id AND a.cell_id = u.i JOIN sig b ON b.view_id = u.view_id AND b.cell_id = u.j
  UNION ALL SELECT view_id, cell_id, cell_id, 1 FROM nv)"""


def points(spark, sf):
    """All views as parts, rows scaled to unit length."""
    unit = vectors.l2_normalize(F.col("features"))
    return fx.views(spark, sf).select(F.col("view_id").cast("long").alias("part"), "cell_id", unit.alias("features"))


def view0(spark, sf):
    return points(spark, sf).where(F.col("part") == 0).select("cell_id", "features")


@query("J7_nearest_cells", f"SELECT {big('view_id', 'view_id')}, cell_id, neighbor, {r6('distance', 'distance')}, {big('rank', 'rank')} FROM near", KNN_SQL)
def nearest_cells(spark, sf):
    out = graph.knn(points(spark, sf), K - 1)
    return out.select(F.col("part").alias("view_id"), "cell_id", "neighbor", rounded("distance"), F.col("rank").cast("long").alias("rank"))


@query("W6_bandwidth", f"SELECT {big('view_id', 'view_id')}, cell_id, {r6('sigma', 'sigma')} FROM sig", KNN_SQL)
def bandwidth(spark, sf):
    out = graph.bandwidths(graph.knn(points(spark, sf), K - 1), K // 2)
    return out.select(F.col("part").alias("view_id"), "cell_id", rounded("sigma"))


@query("U1_union_graph", f"SELECT {big('view_id', 'view_id')}, i, j FROM uni", KNN_SQL)
def union_graph(spark, sf):
    return graph.symmetric_edges(graph.knn(points(spark, sf), K - 1), "union").withColumnRenamed("part", "view_id")


@query("U2_mutual_graph", f"SELECT {big('view_id', 'view_id')}, i, j FROM inter", KNN_SQL)
def mutual_graph(spark, sf):
    return graph.symmetric_edges(graph.knn(points(spark, sf), K - 1), "intersection").withColumnRenamed("part", "view_id")


def kernel(spark, sf):
    return graph.adaptive_kernel(points(spark, sf), K, "union")


@query("M22_adaptive_kernel", f"SELECT {big('view_id', 'view_id')}, i, j, {r6('w', 'w')} FROM kern", KNN_SQL)
def adaptive_kernel(spark, sf):
    return kernel(spark, sf).select(F.col("view").alias("view_id"), "i", "j", rounded("w"))


@query("M23_kernel_norm", f"SELECT {big('view_id', 'view_id')}, {r6('sum(w * w)', 'norm_squared')} FROM kern GROUP BY 1", KNN_SQL)
def kernel_norm(spark, sf):
    return kernel(spark, sf).groupBy(F.col("view").alias("view_id")).agg(rounded(F.sum(F.col("w") * F.col("w")), "norm_squared"))


WEIGHT_SQL = KNN_SQL + """,
q25 AS (SELECT quantile_cont(distance, 0.25) AS q FROM near WHERE view_id = 0 AND rank <= 9),
nbr0 AS (SELECT cell_id, neighbor, exp(-distance / (SELECT q FROM q25)) AS w FROM near WHERE view_id = 0 AND rank <= 9
  UNION ALL SELECT cell_id, cell_id, 1 FROM nv WHERE view_id = 0),
nbr AS (SELECT cell_id, neighbor, w / sum(w) OVER (PARTITION BY cell_id) AS weight FROM nbr0)"""


def neighbor_table(spark, sf):
    return graph.neighbor_weights(view0(spark, sf), 10, start=0)


@query("T2_neighbor_weights", f"SELECT cell_id, neighbor, {r6('weight', 'weight')} FROM nbr", WEIGHT_SQL)
def neighbor_weights(spark, sf):
    return neighbor_table(spark, sf).select("cell_id", "neighbor", rounded("weight"))


@query(
    "J8_batch_balanced_neighbors",
    f"""SELECT cell_id, neighbor, {r6('exp(-w) / sum(exp(-w)) OVER (PARTITION BY cell_id)', 'weight')} FROM (
  SELECT *, row_number() OVER (PARTITION BY cell_id ORDER BY draw, neighbor) AS keep FROM (
    SELECT *, CASE WHEN place = 1 THEN -1 ELSE {hash_key_sql('cell_id', 'neighbor', seed=5)} END AS draw FROM (
      SELECT *, row_number() OVER (PARTITION BY cell_id ORDER BY w, neighbor) AS place FROM (
        SELECT cell_id, neighbor, distance / (avg(distance) OVER (PARTITION BY cell_id, batch) + 1e-15) AS w FROM (
          SELECT a.cell_id, b.cell_id AS neighbor, c.batch, d.batch AS own, list_distance(a.f, b.f) AS distance,
            row_number() OVER (PARTITION BY a.cell_id, c.batch ORDER BY list_distance(a.f, b.f), b.cell_id) AS rank
          FROM nv a JOIN nv b ON a.view_id = 0 AND b.view_id = 0 JOIN cells c ON c.cell_id = b.cell_id JOIN cells d ON d.cell_id = a.cell_id)
        WHERE (batch <> own AND rank <= 5) OR rank = 1)))) WHERE keep <= 10""",
    KNN_SQL,
)
def batch_balanced_neighbors(spark, sf):
    table = view0(spark, sf).join(fx.cells(spark, sf).select("cell_id", "batch"), "cell_id")
    return graph.batch_balanced_neighbors(table, 10, seed=5).select("cell_id", "neighbor", rounded("weight"))


@query(
    "J9_neighbor_pixel_sum",
    f"""SELECT n.cell_id, {big('p.chrom_ord', 'chrom_ord')}, p.bin1, p.bin2, {r6('sum(n.weight * p.value)', 'value')}
FROM pix p JOIN nbr n ON n.neighbor = p.cell_id GROUP BY 1, 2, 3, 4""",
    WEIGHT_SQL,
)
def neighbor_pixel_sum(spark, sf):
    out = graph.neighbor_pixel_sum(fx.pixels(spark, sf), neighbor_table(spark, sf))
    return out.withColumns({"chrom_ord": F.col("chrom_ord").cast("long"), "value": rounded("value")})


# two stand-in imputations of the raw pixels: by distance, and by square
_IMPUTED = """imp1 AS (SELECT cell_id, chrom_ord, bin1, bin2, value / (1 + bin2 - bin1) AS value FROM pix),
imp2 AS (SELECT cell_id, chrom_ord, bin1, bin2, value * value AS value FROM pix WHERE bin2 > bin1)"""


def imputations(spark, sf):
    pix = fx.pixels(spark, sf)
    one = pix.withColumn("value", F.col("value") / (1 + F.col("bin2") - F.col("bin1")))
    two = pix.where(F.col("bin2") > F.col("bin1")).withColumn("value", F.col("value") * F.col("value"))
    return pix, one, two


@query(
    "J10_combined_imputations",
    f"""SELECT cell_id, {big('chrom_ord', 'chrom_ord')}, bin1, bin2, {r6('a.value / a.m + b.value / b.m', 'value')} FROM
  (SELECT *, avg(value) OVER (PARTITION BY cell_id, chrom_ord) AS m FROM imp1) a JOIN
  (SELECT *, avg(value) OVER (PARTITION BY cell_id, chrom_ord) AS m FROM imp2) b USING (cell_id, chrom_ord, bin1, bin2)""",
    _IMPUTED,
)
def combined_imputations(spark, sf):
    _, one, two = imputations(spark, sf)
    out = graph.combine_imputations(one, two)
    return out.withColumns({"chrom_ord": F.col("chrom_ord").cast("long"), "value": rounded("value")})


def _mirror(table):
    return f"""SELECT cell_id, chrom_ord, bin1, bin2, value * CASE WHEN bin1 = bin2 THEN 2 ELSE 1 END AS value FROM {table}
  UNION ALL SELECT cell_id, chrom_ord, bin2, bin1, value FROM {table} WHERE bin1 <> bin2"""


@query(
    "J11_maps_side_by_side",
    f"""SELECT cell_id, {big('chrom_ord', 'chrom_ord')}, bin1, bin2, {r6('coalesce(a.value, 0)', 'raw')}, {r6('coalesce(b.value, 0)', 'imputed_0')}, {r6('coalesce(c.value, 0)', 'imputed_k')}
FROM sym a FULL OUTER JOIN ({_mirror('imp1')}) b USING (cell_id, chrom_ord, bin1, bin2) FULL OUTER JOIN ({_mirror('imp2')}) c USING (cell_id, chrom_ord, bin1, bin2)""",
    _IMPUTED,
)
def maps_side_by_side(spark, sf):
    out = graph.side_by_side(*imputations(spark, sf))
    return out.select(
        "cell_id", F.col("chrom_ord").cast("long").alias("chrom_ord"), "bin1", "bin2", *[rounded(c) for c in ("raw", "imputed_0", "imputed_k")]
    )


def _dims(df):
    out = df.select("cell_id", F.posexplode("features").alias("pos", "value"))
    return out.withColumns({"pos": F.col("pos").cast("long"), "value": rounded("value")})


_MEAN_SQL = """SELECT n.cell_id, CAST(pos AS BIGINT) AS pos, {value} FROM nbr n
JOIN (SELECT cell_id, unnest(range(0, 24)) AS pos, unnest(f) AS x FROM nv WHERE view_id = 0) v ON v.cell_id = n.neighbor GROUP BY 1, 2"""


@query("M33_neighbor_mean", _MEAN_SQL.format(value=r6("avg(x)", "value")), WEIGHT_SQL)
def neighbor_mean(spark, sf):
    return _dims(graph.neighbor_feature_mean(neighbor_table(spark, sf), view0(spark, sf)))


@query("M33_weighted_neighbor_mean", _MEAN_SQL.format(value=r6("sum(weight * x)", "value")), WEIGHT_SQL)
def weighted_neighbor_mean(spark, sf):
    return _dims(graph.neighbor_feature_mean(neighbor_table(spark, sf), view0(spark, sf), weighted=True))


@query("M31_communities")
def communities(spark, sf):
    edges = kernel(spark, sf).where(F.col("view") == 0)
    return graph.communities(edges)
