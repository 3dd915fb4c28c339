"""Scores of groupings, method comparison and layout tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from contactmill.operators import evaluate, stats
from contactmill.plans import fixtures as fx
from contactmill.plans.catalog import big, query, r6, rounded
from contactmill.plans.counts import layout

SCORES_SQL = """lab AS (SELECT metacell, label, count(*) AS n FROM cells GROUP BY 1, 2),
mc AS (SELECT metacell, max(n) / CAST(sum(n) AS DOUBLE) AS purity, CAST(sum(n) AS BIGINT) AS cell_num,
    arg_min(label, (-n, label)) AS cell_type FROM lab GROUP BY 1),
sc AS (SELECT *, CASE WHEN cell_num = 1 THEN 0 ELSE 1 - 1 / sqrt(cell_num) END AS w_min,
    1 / (1 + greatest(0, (cell_num - 2 * avg(cell_num) OVER ()) / avg(cell_num) OVER ())) AS w_max,
    greatest(0, (purity - 1 / CAST(t AS DOUBLE)) / (1 - 1 / CAST(t AS DOUBLE))) AS p_adj
  FROM mc, (SELECT count(DISTINCT label) AS t FROM cells))"""


@query("A12_purity", f"SELECT metacell, cell_type, {r6('purity', 'purity')}, cell_num FROM mc", SCORES_SQL)
def purity(spark, sf):
    out = evaluate.metacell_scores(fx.cells(spark, sf))
    return out.select("metacell", "cell_type", rounded("purity"), "cell_num")


@query(
    "A13_adjusted_score",
    f"SELECT metacell, {r6('w_min', 'w_min')}, {r6('w_max', 'w_max')}, {r6('p_adj', 'p_adj')}, {r6('p_adj * w_min * w_max', 'ep_v2')} FROM sc",
    SCORES_SQL,
)
def adjusted_score(spark, sf):
    out = evaluate.metacell_scores(fx.cells(spark, sf))
    return out.select("metacell", *[rounded(c) for c in ("w_min", "w_max", "p_adj", "ep_v2")])


@query(
    "A14_overmerging",
    f"""SELECT {r6('1 - max(f * (1 - purity))', 'wcos')}, {r6('1 - sum(f * f * (1 - purity))', 'hwis')}
FROM (SELECT purity, cell_num / CAST(sum(cell_num) OVER () AS DOUBLE) AS f FROM mc)""",
    SCORES_SQL,
)
def overmerging(spark, sf):
    out = evaluate.overmerging(evaluate.metacell_scores(fx.cells(spark, sf)))
    return out.select(rounded("wcos"), rounded("hwis"))


@query(
    "A15_summary",
    f"""SELECT {r6('avg(purity)', 'mean_purity')}, {r6('(SELECT avg(CASE WHEN c.label = m.cell_type THEN 1.0 ELSE 0.0 END) FROM cells c JOIN mc m USING (metacell))', 'accuracy')},
  {r6('sum(p_adj * w_min * w_max * cell_num) / sum(cell_num)', 'global_score')},
  {r6('1 - max(f * (1 - purity))', 'wcos')}, {r6('1 - sum(f * f * (1 - purity))', 'hwis')}
FROM (SELECT *, cell_num / CAST(sum(cell_num) OVER () AS DOUBLE) AS f FROM sc)""",
    SCORES_SQL,
)
def summary(spark, sf):
    out = evaluate.summary(fx.cells(spark, sf))
    return out.select(*[rounded(c) for c in ("mean_purity", "accuracy", "global_score", "wcos", "hwis")])


@query("J3_metacell_label", "SELECT c.cell_id, c.metacell, c.label, m.cell_type AS metacell_label FROM cells c LEFT JOIN mc m USING (metacell)", SCORES_SQL)
def metacell_label(spark, sf):
    cells = fx.cells(spark, sf)
    out = evaluate.label_cells(cells, evaluate.metacell_scores(cells))
    return out.select("cell_id", "metacell", "label", "metacell_label")


@query(
    "A31_score_by_type",
    f"""SELECT cell_type, {r6('avg(purity)', 'purity')}, {r6('avg(p_adj * w_min * w_max)', 'ep_v2')}, {big('count(*)', 'metacells')} FROM sc GROUP BY 1""",
    SCORES_SQL,
)
def score_by_type(spark, sf):
    scores = evaluate.metacell_scores(fx.cells(spark, sf))
    both = stats.score_by_type(scores, "purity").join(stats.score_by_type(scores, "ep_v2").drop("metacells"), "cell_type")
    return both.select("cell_type", rounded("purity"), rounded("ep_v2"), "metacells")


@query(
    "S9_external_grouping",
    f"""SELECT metacell, {big('count(*)', 'cell_count')}, {big('sum(depth)', 'total_depth')}, {r6('max(n) / CAST(sum(n) AS DOUBLE)', 'purity')} FROM (
  SELECT metacell, label, count(*) AS n, sum(depth) AS depth FROM cells JOIN depths USING (cell_id) GROUP BY 1, 2) x
  JOIN (SELECT metacell, count(*) AS c FROM cells GROUP BY 1) y USING (metacell) GROUP BY 1""".replace(
        "CAST(count(*) AS BIGINT) AS cell_count", "CAST(any_value(c) AS BIGINT) AS cell_count"
    ),
)
def external_grouping(spark, sf):
    from contactmill.study import study_from_tables

    cells = fx.cells(spark, sf).join(fx.depths(spark, sf), "cell_id")
    view = fx.views(spark, sf).where(F.col("view_id") == 0).select("cell_id", "features")
    study = study_from_tables(cells, {fx.MB: view}, fx.GENOME, [fx.MB])
    both = evaluate.with_scores(stats.metacell_depths(study.cells), evaluate.metacell_scores(study.cells))
    return both.select("metacell", "cell_count", "total_depth", rounded("purity"))


METRICS = ["mean_purity", "acc", "global_score", "wcos", "hwis"]

# three groupings of the same cells at every K: by a feature cut, by label with one cell in five astray, by id
SWEEP_SQL = """g0 AS (SELECT c.cell_id, c.label, t.m, k.k, CASE t.m
      WHEN 0 THEN CAST(floor((v.features[1] + 1) * 50) AS BIGINT) % k.k + 1
      WHEN 1 THEN CASE WHEN c.cell_id % 5 = 0 THEN c.cell_id % k.k + 1 ELSE CAST(c.label[6:] AS BIGINT) % k.k + 1 END
      ELSE c.cell_id % k.k + 1 END AS metacell
  FROM cells c JOIN views v ON v.cell_id = c.cell_id AND v.view_id = 0
  CROSS JOIN (SELECT unnest(range(11, 40)) AS k) k CROSS JOIN (SELECT unnest([0, 1, 2]) AS m) t),
g1 AS (SELECT m, k, metacell, label, count(*) AS n FROM g0 GROUP BY 1, 2, 3, 4),
g2 AS (SELECT m, k, metacell, max(n) AS top, sum(n) AS s, max(n) / CAST(sum(n) AS DOUBLE) AS p FROM g1 GROUP BY 1, 2, 3),
g3 AS (SELECT *, avg(s) OVER (PARTITION BY m, k) AS a, s / CAST(sum(s) OVER (PARTITION BY m, k) AS DOUBLE) AS f FROM g2),
sweep AS (SELECT concat('method_', CAST(m AS VARCHAR)) AS method, k, avg(p) AS mean_purity, sum(top) / CAST(sum(s) AS DOUBLE) AS acc,
    sum(s * greatest(0, (p - 1 / t) / (1 - 1 / t)) * (CASE WHEN s = 1 THEN 0 ELSE 1 - 1 / sqrt(s) END)
      / (1 + greatest(0, (s - 2 * a) / a))) / sum(s) AS global_score,
    1 - max(f * (1 - p)) AS wcos, 1 - sum(f * f * (1 - p)) AS hwis
  FROM g3, (SELECT CAST(count(DISTINCT label) AS DOUBLE) AS t FROM cells) GROUP BY 1, 2)"""


def sweep_table(spark, sf):
    """Scores of three groupings of the cells at K = 11..39."""
    c = F.col
    based = fx.cells(spark, sf).join(layout(spark, sf, 0), "cell_id").select(
        "cell_id", "label", "x", F.explode(F.sequence(F.lit(11), F.lit(39))).alias("k")
    )
    of_label = F.substring("label", 6, 10).cast("long") % c("k") + 1
    astray = c("cell_id") % c("k") + 1
    groupings = [
        F.floor((c("x") + 1) * 50).cast("long") % c("k") + 1,
        F.when(c("cell_id") % 5 == 0, astray).otherwise(of_label),
        astray,
    ]
    named = F.array(*[
        F.struct(F.lit(f"method_{i}").alias("method"), g.cast("long").alias("metacell")) for i, g in enumerate(groupings)
    ])
    rows = based.select("cell_id", "label", "k", F.explode(named).alias("g")).select(
        "label", "k", "g.method", "g.metacell"
    )
    return evaluate.summary(rows, ["method", "k"]).withColumnRenamed("accuracy", "acc")


@query(
    "M32_score_sweep",
    f"SELECT method, {big('k', 'k')}, " + ", ".join(r6(m, m) for m in METRICS) + " FROM sweep",
    SWEEP_SQL,
)
def score_sweep(spark, sf):
    return sweep_table(spark, sf).select("method", F.col("k").cast("long").alias("k"), *[rounded(m) for m in METRICS])


@query(
    "A28_compare_methods",
    "SELECT method, " + ", ".join(r6(m, m) for m in METRICS) + ", "
    + r6("(" + " + ".join(f"{m}_s" for m in METRICS) + ") / 5", "overall_score") + " FROM (SELECT *, "
    + ", ".join(
        f"({m} - min({m}) OVER ()) / CASE WHEN max({m}) OVER () = min({m}) OVER () THEN 1 ELSE max({m}) OVER () - min({m}) OVER () END AS {m}_s"
        for m in METRICS
    )
    + " FROM (SELECT method, " + ", ".join(f"avg({m}) AS {m}" for m in METRICS) + " FROM sweep GROUP BY 1))",
    SWEEP_SQL,
)
def compare_methods(spark, sf):
    out = stats.compare_methods(sweep_table(spark, sf), METRICS)
    return out.select("method", *[rounded(m) for m in METRICS], rounded("overall_score"))


@query(
    "A29_robustness_curves",
    " UNION ALL ".join(f"SELECT {big('k', 'k')}, '{m}' AS metric, {r6(m, 'value')} FROM sweep WHERE method = 'method_1'" for m in METRICS),
    SWEEP_SQL,
)
def robustness_curves(spark, sf):
    one = sweep_table(spark, sf).where(F.col("method") == "method_1").drop("method")
    return stats.sweep_curves(one, METRICS).select(F.col("k").cast("long").alias("k"), "metric", rounded("value"))


@query(
    "U3_metric_tables",
    f"""SELECT 'purity' AS metric, metacell, {r6('purity', 'value')} FROM sc UNION ALL
SELECT 'ep_v2', metacell, {r6('p_adj * w_min * w_max', 'value')} FROM sc UNION ALL SELECT 'size', metacell, {r6('cell_num', 'value')} FROM sc""",
    SCORES_SQL,
)
def metric_tables(spark, sf):
    scores = evaluate.metacell_scores(fx.cells(spark, sf))
    tables = [
        scores.select(F.lit(n).alias("metric"), "metacell", rounded(c, "value"))
        for n, c in (("purity", "purity"), ("ep_v2", "ep_v2"), ("size", "cell_num"))
    ]
    return tables[0].unionByName(tables[1]).unionByName(tables[2])


@query(
    "P12_metacells_of_type",
    "SELECT m.metacell, c.cell_id FROM mc m JOIN cells c USING (metacell) WHERE m.cell_type IN ('type_1', 'type_2')",
    SCORES_SQL,
)
def metacells_of_type(spark, sf):
    cells = fx.cells(spark, sf)
    chosen = evaluate.metacell_scores(cells).where(F.col("cell_type").isin("type_1", "type_2"))
    return cells.join(chosen, "metacell", "left_semi").select("metacell", "cell_id")


@query(
    "R6_layout_views",
    f"""SELECT {big('v.view_id', 'view_id')}, c.cell_id, c.label, c.metacell, m.cell_type AS predicted, {r6('v.features[1]', 'x')}, {r6('v.features[2]', 'y')},
  c.label = m.cell_type AS agrees
FROM views v JOIN cells c USING (cell_id) JOIN mc m USING (metacell)""",
    SCORES_SQL,
)
def layout_views(spark, sf):
    from contactmill.operators import regions

    cells = fx.cells(spark, sf)
    out = regions.layout_table(fx.views(spark, sf), cells, evaluate.metacell_scores(cells))
    return out.select(
        F.col("view_id").cast("long").alias("view_id"), "cell_id", "label", "metacell", "predicted", rounded("x"), rounded("y"), "agrees"
    )


@query(
    "R6_layout_metacell",
    f"""SELECT c.cell_id, c.metacell = 4 AS member, {r6('v.features[1]', 'x')}, {r6('v.features[2]', 'y')},
  {r6('(SELECT avg(w.features[1]) FROM views w JOIN cells d USING (cell_id) WHERE w.view_id = 0 AND d.metacell = 4)', 'centre_x')},
  {r6('(SELECT avg(w.features[2]) FROM views w JOIN cells d USING (cell_id) WHERE w.view_id = 0 AND d.metacell = 4)', 'centre_y')}
FROM views v JOIN cells c USING (cell_id) WHERE v.view_id = 0""",
)
def layout_metacell(spark, sf):
    from contactmill.operators import regions

    out = regions.highlight_metacell(layout(spark, sf, 0), fx.cells(spark, sf), 4)
    return out.select("cell_id", "member", rounded("x"), rounded("y"), rounded("centre_x"), rounded("centre_y"))
