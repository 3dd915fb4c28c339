"""The metacell model: waypoints, updates, weights, respawn, full fit."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Window
from pyspark.sql import functions as F

from contactmill.operators import graph, model
from contactmill.plans import fixtures as fx
from contactmill.plans.catalog import big, query, r6, rounded
from contactmill.plans.neighbours import KNN_SQL, points
from contactmill.session import materialize

SETTINGS = model.Settings(n_metacells=8)


def unit_views(spark, sf):
    return points(spark, sf).withColumnRenamed("part", "view_id")


def start(spark, sf, settings=SETTINGS):
    return model.initialize(unit_views(spark, sf), settings, seed=32, n_micro=24)


@query("M24_waypoints")
def waypoints(spark, sf):
    chosen = start(spark, sf).waypoints
    return spark.createDataFrame([(i, int(c)) for i, c in enumerate(chosen)], "metacell LONG, cell_id LONG")


@query("R6_layout_waypoints")
def layout_waypoints(spark, sf):
    from contactmill.operators.regions import flag_waypoints
    from contactmill.plans.counts import layout

    out = flag_waypoints(layout(spark, sf, 0), waypoints(spark, sf))
    return out.select("cell_id", rounded("x"), rounded("y"), "is_waypoint")


@query(
    "W9_hard_labels",
    f"""SELECT cell_id, {big('list_position(features, list_max(features))', 'metacell')} FROM views WHERE view_id = 1""",
)
def hard_labels(spark, sf):
    """Views stand for memberships."""
    one = fx.views(spark, sf).where(F.col("view_id") == 1)
    return model.hard_labels(one.select("cell_id", F.col("features").alias("a")))


CENTRE_SQL = """cen AS (SELECT metacell, pos, avg(x) AS c FROM (SELECT v.cell_id, metacell, unnest(range(0, 24)) AS pos, unnest(features) AS x
  FROM views v JOIN cells USING (cell_id) WHERE view_id = 0) GROUP BY 1, 2),
cdist AS (SELECT metacell, cell_id, sqrt(sum((x - c) * (x - c))) AS d FROM (SELECT v.cell_id, metacell, unnest(range(0, 24)) AS pos,
  unnest(features) AS x FROM views v JOIN cells USING (cell_id) WHERE view_id = 0) JOIN cen USING (metacell, pos) GROUP BY 1, 2)"""


def members_and_centres(spark, sf):
    from contactmill.functions.vectors import array_mean

    first = fx.views(spark, sf).where(F.col("view_id") == 0).select("cell_id", "features")
    members = first.join(fx.cells(spark, sf).select("cell_id", "metacell"), "cell_id")
    return members, members.groupBy("metacell").agg(array_mean(F.col("features")).alias("centre"))


@query("W10_nearest_to_centre", "SELECT metacell, arg_min(cell_id, (round(d, 12), cell_id)) AS cell_id FROM cdist GROUP BY 1", CENTRE_SQL)
def nearest_to_centre(spark, sf):
    from contactmill.operators.regions import nearest_to_centres

    members, centres = members_and_centres(spark, sf)
    return nearest_to_centres(members, centres, ["metacell"])


def _outlier_sql(sd: str) -> str:
    return f"""SELECT metacell, cell_id FROM (SELECT *, avg(d) OVER (PARTITION BY metacell) + {sd} * stddev_pop(d) OVER (PARTITION BY metacell) AS lim,
  count(*) OVER (PARTITION BY metacell) AS n FROM cdist) WHERE n >= 5 AND d > lim"""


def outlier_members(spark, sf, **limits):
    members, centres = members_and_centres(spark, sf)
    out = model.outlier_cells(members.withColumnRenamed("metacell", "grp"), centres.toDF("grp", "centroid"), **limits)
    return out.select(F.col("grp").alias("metacell"), "cell_id")


@query("W11_outliers", _outlier_sql("1.5"), CENTRE_SQL)
def outliers(spark, sf):
    """A narrow limit, under which every group of these tables has outliers."""
    return outlier_members(spark, sf, sd=1.5)


@query("W11_default_outliers", _outlier_sql("3"), CENTRE_SQL)
def default_outliers(spark, sf):
    return outlier_members(spark, sf)


@query(
    "T3_largest_clusters",
    f"SELECT label AS cluster, {big('count(*)', 'n')} FROM cells GROUP BY 1 HAVING count(*) >= greatest(2, floor(0.0005 * (SELECT count(*) FROM cells)))",
)
def largest_clusters(spark, sf):
    cells = fx.cells(spark, sf)
    kept = model.largest_clusters(cells.select(F.col("label").alias("micro")), cells.count(), 5)
    sizes = cells.groupBy(F.col("label").alias("cluster")).agg(F.count(F.lit(1)).alias("n"))
    return sizes.where(F.col("cluster").isin(kept))


def given(spark, sf, mixed=False):
    """Kernels of all views, the first two cells of each of eight metacells as archetypes (0.7 and 0.3: no cell ties with an
    archetype of its own), equal weights; A uniform or by metacell."""
    k, cells = SETTINGS.n_metacells, fx.cells(spark, sf)
    kernel = materialize(graph.adaptive_kernel(points(spark, sf), SETTINGS.n_neighbors, "union"))
    place = F.row_number().over(Window.partitionBy("metacell").orderBy("cell_id")).alias("place")
    first = cells.where(F.col("metacell") <= k).select("metacell", "cell_id", place).where("place <= 2").collect()  # two a metacell
    B = [{r["cell_id"]: (0.7, 0.3)[r["place"] - 1] for r in first if r["metacell"] == m} for m in range(1, k + 1)]
    norms = kernel.groupBy("view").agg(F.sum(F.col("w") * F.col("w")).alias("n")).orderBy("view").collect()  # one row a view
    if mixed:
        slots, own = F.sequence(F.lit(0), F.lit(k - 1)), (F.col("metacell") - 1) % k
        a = F.transform(slots, lambda i: F.when(i == own, 0.6).otherwise(0.4 / (k - 1)))
    else:
        a = F.array_repeat(F.lit(1.0 / k), k)
    A = materialize(cells.select("cell_id", a.alias("a")))
    features = unit_views(spark, sf).where(F.col("view_id") == 0).select("cell_id", "features")
    return model.State(
        kernel, features, A, B, np.full(len(norms), 1.0 / len(norms)), cells.count(),
        np.array([r["n"] for r in norms]),
    )


def _by_cell(name: str, rows: str, column: str) -> str:
    """One list of K numbers per cell from (cell_id, k, x), zeros where there is no row."""
    return f"""{name} AS MATERIALIZED (SELECT cell_id, list(coalesce(x, 0) ORDER BY k) AS {column} FROM
  (SELECT cell_id, unnest(range(1, 9)) AS k FROM cells) LEFT JOIN ({rows}) USING (cell_id, k) GROUP BY cell_id)"""


GIVEN_SQL = KNN_SQL + """,
kernel AS MATERIALIZED (SELECT view_id, i, j, w FROM kern),
bs0 AS MATERIALIZED (SELECT metacell AS k, cell_id AS cell, CASE place WHEN 1 THEN CAST(0.7 AS DOUBLE) ELSE CAST(0.3 AS DOUBLE) END AS b FROM
  (SELECT metacell, cell_id, row_number() OVER (PARTITION BY metacell ORDER BY cell_id) AS place FROM cells WHERE metacell <= 8) WHERE place <= 2),
zs0 AS MATERIALIZED (SELECT view_id, m.i AS cell_id, k, sum(w * b) AS x FROM kernel m JOIN bs0 ON m.j = cell GROUP BY 1, 2, 3),
grid8 AS MATERIALIZED (SELECT cell_id, v.view_id, unnest(range(1, 9)) AS k FROM cells CROSS JOIN (SELECT DISTINCT view_id FROM views) v),
mix AS MATERIALIZED (SELECT cell_id, k, CASE WHEN k - 1 = (metacell - 1) % 8 THEN CAST(0.6 AS DOUBLE) ELSE CAST(0.4 AS DOUBLE) / 7 END AS a
  FROM (SELECT cell_id, metacell, unnest(range(1, 9)) AS k FROM cells)),
aa AS MATERIALIZED (SELECT p.k AS r, q.k AS c, sum(p.a * q.a) AS x FROM mix p JOIN mix q USING (cell_id) GROUP BY 1, 2)"""

_STEP = "CAST(2 AS DOUBLE) / (s + 2)"
_SIZES = ", ".join(f"sum(a[{k}]) OVER ()" for k in range(1, 9))
_NEAR_ARCHETYPES = """SELECT m.i AS cell_id, z.k, sum(m.w * z.x) / 3 AS x FROM kernel m
    JOIN zs0 z ON z.view_id = m.view_id AND z.cell_id = m.j GROUP BY 1, 2"""
MEMBERSHIP_SQL = f"""{GIVEN_SQL},
t1 AS MATERIALIZED (SELECT list(x ORDER BY r) AS t1 FROM (SELECT r, list(coalesce(x, 0) ORDER BY c) AS x FROM
  (SELECT r, unnest(range(1, 9)) AS c FROM (SELECT unnest(range(1, 9)) AS r))
  LEFT JOIN (SELECT p.k AS r, q.k AS c, sum(p.x * q.x) / 3 AS x FROM zs0 p JOIN zs0 q USING (view_id, cell_id) GROUP BY 1, 2) USING (r, c) GROUP BY r)),
{_by_cell("tt", _NEAR_ARCHETYPES, "t")},
walk AS (
  SELECT 0 AS s, cell_id, list_transform(range(1, 9), lambda k: CAST(0.125 AS DOUBLE)) AS a,
    list_transform(range(1, 9), lambda c: 2 * (list_sum(list_transform(range(1, 9), lambda r: t1[r][c] / 8)) - t[c])) AS g FROM tt, t1
  UNION ALL
  SELECT s + 1, cell_id, a2, CASE WHEN (s + 1) % 10 = 0
      THEN list_transform(range(1, 9), lambda c: 2 * (list_sum(list_transform(range(1, 9), lambda r: a2[r] * t1[r][c])) - t[c]))
      ELSE list_transform(range(1, 9), lambda c: (1 - {_STEP}) * g[c] + {_STEP} * 2 * (t1[best][c] - t[c])) END
  FROM (
    SELECT *, list_transform(range(1, 9), lambda k: (1 - {_STEP}) * a[k] + CASE WHEN k = best THEN {_STEP} ELSE 0 END) AS a2
    FROM (
      SELECT *, list_position(p, list_min(p)) AS best FROM (
        SELECT *, list_transform(range(1, 9), lambda k: g[k] + CAST(0.01 AS DOUBLE) * greatest(sizes[k] - n / CAST(8 AS DOUBLE), 0)) AS p FROM (
          SELECT *, [{_SIZES}] AS sizes, count(*) OVER () AS n FROM walk WHERE s < 50)))
  ) JOIN tt USING (cell_id), t1)"""


@query(
    "M25_membership_update",
    f"SELECT cell_id, {big('k - 1', 'k')}, {r6('a[k]', 'value')} FROM (SELECT cell_id, a, unnest(range(1, 9)) AS k FROM walk WHERE s = 50)",
    MEMBERSHIP_SQL,
    recursive=True,
)
def membership_update(spark, sf):
    """All 50 steps with group sizes, from archetypes that SQL knows, too."""
    out = model.update_memberships(given(spark, sf), SETTINGS)
    return out.select("cell_id", F.posexplode("a").alias("k", "value")).select("cell_id", F.col("k").cast("long").alias("k"), rounded("value"))


def _archetype_sql() -> str:
    parts = [
        GIVEN_SQL,
        """mixed AS MATERIALIZED (SELECT view_id, m.i AS cell_id, k, sum(w * a) AS x FROM kernel m JOIN mix ON m.j = cell_id GROUP BY 1, 2, 3),
pull AS MATERIALIZED (SELECT m.i AS cell_id, k, sum(w * x) * 2 / 3 AS x FROM kernel m JOIN mixed z ON z.view_id = m.view_id AND z.cell_id = m.j GROUP BY 1, 2)""",
    ]
    for step in range(5):
        stop = 10 * step + 10
        keep = repr(10 * step * (10 * step + 1) / (stop * (stop + 1.0)) if step else 0.0)
        if step:
            parts.append(f"zs{step} AS MATERIALIZED (SELECT view_id, m.i AS cell_id, k, sum(w * b) AS x FROM kernel m JOIN bs{step} ON m.j = cell GROUP BY 1, 2, 3)")
        parts.append(f"""zz{step} AS MATERIALIZED (SELECT view_id, cell_id, k, coalesce(x, 0) AS x FROM grid8 LEFT JOIN zs{step} USING (view_id, cell_id, k)),
qq{step} AS MATERIALIZED (SELECT view_id, p.k AS r, q.k AS c, sum(p.x * q.x) AS x FROM zz{step} p JOIN zz{step} q USING (view_id, cell_id) GROUP BY 1, 2, 3),
turn{step} AS MATERIALIZED (SELECT view_id, r, c, 2 * aa.x / 3 + CASE WHEN r = c THEN 0 ELSE CAST(0.04 AS DOUBLE) * q.x / 3 END AS x
  FROM aa JOIN qq{step} q USING (r, c)),
h{step} AS MATERIALIZED (SELECT view_id, cell_id, k, x + CAST(0.2 AS DOUBLE) / 3 * (3 * z - total) AS x FROM (
    SELECT z.view_id, cell_id, c AS k, sum(z.x * t.x) AS x FROM zz{step} z JOIN turn{step} t ON t.view_id = z.view_id AND t.r = z.k GROUP BY 1, 2, 3)
  JOIN (SELECT view_id, cell_id, k, x AS z, sum(x) OVER (PARTITION BY cell_id, k) AS total FROM zz{step}) USING (view_id, cell_id, k)),
best{step} AS MATERIALIZED (SELECT k, arg_min(cell_id, (g, cell_id)) AS cell FROM (
    SELECT m.i AS cell_id, h.k, sum(m.w * h.x) - any_value(p.x) AS g FROM kernel m JOIN h{step} h ON h.view_id = m.view_id AND h.cell_id = m.j
    JOIN pull p ON p.cell_id = m.i AND p.k = h.k GROUP BY 1, 2) GROUP BY k),
bs{step + 1} AS MATERIALIZED (SELECT k, cell, sum(b) AS b FROM (SELECT k, cell, b * CAST({keep} AS DOUBLE) AS b FROM bs{step}
  WHERE {keep} > 0 UNION ALL SELECT k, cell, 1 - CAST({keep} AS DOUBLE) FROM best{step}) GROUP BY 1, 2)""")
    return ",\n".join(parts)


@query("M26_archetype_update", f"SELECT {big('k - 1', 'k')}, cell AS cell_id, {r6('b', 'w')} FROM bs5", _archetype_sql())
def archetype_update(spark, sf):
    B = model.update_archetypes(given(spark, sf, mixed=True), SETTINGS)
    rows = [(k, int(c), float(w)) for k, col in enumerate(B) for c, w in col.items()]
    return spark.createDataFrame(rows, "k LONG, cell_id LONG, w DOUBLE").select("k", "cell_id", rounded("w"))


FILLED_SQL = GIVEN_SQL + ",\nzz AS MATERIALIZED (SELECT view_id, cell_id, k, coalesce(x, 0) AS x FROM grid8 LEFT JOIN zs0 USING (view_id, cell_id, k))"


@query(
    "M27_view_weights",
    f"""SELECT method, {big('v', 'view_id')}, {r6('weight', 'weight')} FROM (
  SELECT 'consensus' AS method, v, CAST(0.9 AS DOUBLE) / 3 + CAST(0.1 AS DOUBLE) * f / sum(f) OVER () AS weight FROM (
    SELECT v, 1 / (pow(sum(sqrt(d)) / 2, 5) + 1e-6) AS f FROM (
      SELECT p.view_id AS v, q.view_id AS u, sum((p.x - q.x) * (p.x - q.x)) AS d FROM zz p JOIN zz q USING (cell_id, k)
      WHERE p.view_id <> q.view_id GROUP BY 1, 2) GROUP BY v)
  UNION ALL
  SELECT 'awp', v, CAST(0.9 AS DOUBLE) / 3 + CAST(0.1 AS DOUBLE) * f / sum(f) OVER () FROM (
    SELECT view_id AS v, 1 / (2 * sqrt(sum((x - m) * (x - m))) + 1e-6) AS f FROM (
      SELECT *, avg(x) OVER (PARTITION BY cell_id, k) AS m FROM zz) GROUP BY view_id))""",
    FILLED_SQL,
)
def view_weights(spark, sf):
    state = given(spark, sf)
    between, to_mean = model.view_distances(model.kernel_times_b(state), state.n_views, state.k)
    rows = []
    for method in ("consensus", "awp"):
        new = model.new_weights(between, to_mean, state.weights, 0.9, method)
        rows += [(method, v, float(w)) for v, w in enumerate(new)]
    return spark.createDataFrame(rows, "method STRING, view_id LONG, weight DOUBLE").select("method", "view_id", rounded("weight"))


_LOSS = """(SELECT sum(greatest(0, norm + fit - 2 * crossed) / 3 + CAST(0.01 AS DOUBLE) * off / 3) FROM
    (SELECT view_id, sum(w * w) AS norm FROM kernel GROUP BY 1)
    JOIN (SELECT view_id, sum(q.x * aa.x) AS fit, sum(CASE WHEN r = c THEN 0 ELSE q.x * q.x END) AS off FROM
      (SELECT view_id, p.k AS r, q.k AS c, sum(p.x * q.x) AS x FROM zz p JOIN zz q USING (view_id, cell_id) GROUP BY 1, 2, 3) q
      JOIN aa USING (r, c) GROUP BY 1) USING (view_id)
    JOIN (SELECT m.view_id, sum(m.w * a * z.x) AS crossed FROM kernel m JOIN mix ON mix.cell_id = m.j
      JOIN zz z ON z.view_id = m.view_id AND z.cell_id = m.i AND z.k = mix.k GROUP BY 1) USING (view_id))
  + (SELECT CAST(0.005 AS DOUBLE) * sum(pow(greatest(0, s - n / CAST(8 AS DOUBLE)), 2)) FROM
    (SELECT sum(a) AS s, count(*) AS n FROM mix GROUP BY k))
  + (SELECT CAST(0.1 AS DOUBLE) / 3 * sum((p.x - q.x) * (p.x - q.x)) FROM zz p JOIN zz q USING (cell_id, k) WHERE p.view_id < q.view_id)"""


@query("M28_objective", f"SELECT {r6(_LOSS, 'loss')}", FILLED_SQL)
def objective(spark, sf):
    loss = model.objective(given(spark, sf, mixed=True), SETTINGS)
    return spark.createDataFrame([(float(loss),)], "loss DOUBLE").select(rounded("loss"))


@query("M29_respawn")
def respawn(spark, sf):
    """A high threshold makes several groups starve."""
    settings = model.Settings(n_metacells=8, min_size_threshold=0.1)
    state = start(spark, sf, settings)
    state.A = model.update_memberships(state, settings)
    model.respawn(state, settings)
    return state.A.select("cell_id", F.posexplode("a").alias("k", "value")).withColumn("value", rounded("value"))


@query("M30_fit")
def fit(spark, sf):
    state = model.fit(start(spark, sf), SETTINGS)
    return model.hard_labels(state.A)
