import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from contactmill import scale
from contactmill.operators import graph, nearest


@pytest.fixture(scope="module")
def skewed():
    rng = np.random.default_rng(1)
    g = np.where(rng.random(4000) < 0.4, 7, rng.integers(0, 5, 4000))
    return pd.DataFrame({"g": g, "id": np.arange(4000), "v": rng.integers(0, 50, 4000).astype(float)})


def test_rank_within(spark, skewed):
    got = scale.rank_within(spark.createDataFrame(skewed), ["g"], ["v", "id"]).toPandas().sort_values("id")
    want = skewed.sort_values(["g", "v", "id"]).groupby("g").cumcount() + 1
    assert (got["rank"].to_numpy() == want.sort_index().to_numpy()).all()


def test_rank_descending_without_groups(spark, skewed):
    got = scale.rank_within(spark.createDataFrame(skewed), [], [F.desc("v"), "id"]).toPandas().sort_values("rank")
    want = skewed.sort_values(["v", "id"], ascending=[False, True])
    assert (got["id"].to_numpy() == want["id"].to_numpy()).all()


def test_quantile_within(spark, skewed):
    got = scale.quantile_within(spark.createDataFrame(skewed), ["g"], "v", 0.23).toPandas().set_index("g")["quantile"]
    for g, part in skewed.groupby("g"):
        assert got[g] == pytest.approx(np.quantile(part["v"], 0.23))


def test_running_sum_and_mean_ranks(spark, skewed):
    df = spark.createDataFrame(skewed)
    got = scale.running_sum(df, ["g"], ["v", "id"], "v", "s").toPandas().set_index("id")["s"]
    want = skewed.sort_values(["g", "v", "id"]).groupby("g")["v"].cumsum()
    want.index = skewed.sort_values(["g", "v", "id"])["id"]
    assert np.allclose(got.sort_index(), want.sort_index())
    ranks = scale.mean_ranks(df, ["g"], "v", "r").toPandas().set_index(["g", "v"])["r"]
    skewed = skewed.assign(r=skewed.groupby("g")["v"].rank())
    for (g, v), part in skewed.groupby(["g", "v"]):
        assert ranks[(g, v)] == part["r"].iloc[0]


def brute_neighbours(queries, data, k, same):
    """(query, rank) -> (neighbour, distance) by all distances; ids are row numbers."""
    d = np.sqrt(((queries[:, None] - data[None]) ** 2).sum(-1))
    if same:
        np.fill_diagonal(d, np.inf)
    near = np.argsort(d, axis=1, kind="stable")[:, :k]
    return near, np.take_along_axis(d, near, axis=1)


def vectors(spark, x, part=None):
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)]
    df = spark.createDataFrame(rows, "cell_id LONG, features ARRAY<DOUBLE>").repartition(4)
    return df if part is None else df.withColumn("part", F.lit(part).cast("long"))


def same_neighbours(got, near, far):
    got = got.toPandas().sort_values(["cell_id", "rank"])
    assert (got.groupby("cell_id").size() == near.shape[1]).all()
    assert got["cell_id"].nunique() == len(near)
    assert np.allclose(got["distance"].to_numpy().reshape(near.shape), far)
    assert (got["neighbor"].to_numpy().reshape(near.shape) == near).all()


@pytest.mark.parametrize("leaf, fan, room", [(2048, 32, 64 << 20), (40, 4, 64 << 20), (12, 3, 0)])
def test_nearest_neighbours_are_exact(spark, monkeypatch, leaf, fan, room):
    """A third of the points sit in one tight cluster; small leaves force levels, no room for pivots forces the join."""
    monkeypatch.setattr(nearest, "LEAF_ROWS", leaf)
    monkeypatch.setattr(nearest, "FAN", fan)
    monkeypatch.setattr(nearest, "PIVOT_BYTES", room)
    rng = np.random.default_rng(3)
    x = rng.normal(size=(400, 5)) * 3
    x[:140] = 8 + 0.01 * rng.normal(size=(140, 5))
    x[200] = x[201]
    report = {}
    same_neighbours(graph.knn(vectors(spark, x), 6, report=report), *brute_neighbours(x, x, 6, True))
    assert report["queries"] == 400 and (report["visits"] == 400) == (leaf == 2048)
    asked = rng.normal(size=(90, 5)) * 4
    found = graph.knn_join(vectors(spark, asked, 0), vectors(spark, x, 0), 3, exclude_self=False)
    same_neighbours(found, *brute_neighbours(asked, x, 3, False))


def test_crowds_of_equal_vectors(spark, monkeypatch):
    """A third of all rows share one vector, more than a leaf takes; they are answered without a search."""
    monkeypatch.setattr(nearest, "LEAF_ROWS", 30)
    monkeypatch.setattr(nearest, "FAN", 4)
    rng = np.random.default_rng(4)
    x = rng.normal(size=(300, 4))
    x[rng.choice(300, 100, replace=False)] = 0.25
    same_neighbours(graph.knn(vectors(spark, x), 5), *brute_neighbours(x, x, 5, True))
    asked = np.vstack([x[:20], np.full((3, 4), 0.25)])
    found = graph.knn_join(vectors(spark, asked, 0), vectors(spark, x, 0), 5, exclude_self=False)
    same_neighbours(found, *brute_neighbours(asked, x, 5, False))


def test_twenty_thousand_points_in_fifty_dimensions(spark):
    """Exact beyond one leaf, in clusters as cells are; most of about 32 leaves are ruled out."""
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(40, 50)) * 4
    x = centres[rng.integers(0, 40, 20_000)] + 0.3 * rng.normal(size=(20_000, 50))
    df = spark.createDataFrame(pd.DataFrame({"cell_id": np.arange(len(x)), "features": list(x)}))
    report = {}
    got = graph.knn(df, 14, report=report).toPandas().sort_values(["cell_id", "rank"])
    near, far = np.zeros((len(x), 14), int), np.zeros((len(x), 14))
    for a in range(0, len(x), 1000):
        rough = (x[a : a + 1000] ** 2).sum(1)[:, None] + (x**2).sum(1)[None] - 2 * x[a : a + 1000] @ x.T
        rough[np.arange(1000), np.arange(a, a + 1000)] = np.inf
        few = np.argpartition(rough, 30, axis=1)[:, :30]
        exact = np.sqrt(((x[a : a + 1000, None] - x[few]) ** 2).sum(-1))
        order = np.lexsort((few, exact), axis=1)[:, :14]
        near[a : a + 1000], far[a : a + 1000] = np.take_along_axis(few, order, 1), np.take_along_axis(exact, order, 1)
    assert (got["neighbor"].to_numpy().reshape(near.shape) == near).all()
    assert np.allclose(got["distance"].to_numpy().reshape(far.shape), far)
    assert report["visits"] / report["queries"] < 16, report


def test_communities_find_two_cliques(spark):
    edges = [(a, b, 1.0) for c in (range(6), range(6, 12)) for a in c for b in c if a != b] + [(0, 6, 0.1), (6, 0, 0.1)]
    df = spark.createDataFrame(edges, "i LONG, j LONG, w DOUBLE")
    labels = graph.communities(df).toPandas().set_index("node")["label"]
    assert labels[list(range(6))].nunique() == 1 and labels[list(range(6, 12))].nunique() == 1
    assert labels[0] != labels[6]


def test_small_levels_take_one_task_and_give_the_same_communities(spark, monkeypatch):
    """Labels are those of the distributed rounds; what is written does not grow with rounds and levels."""
    rng = np.random.default_rng(4)
    group = rng.integers(0, 12, 240)
    weights = {}
    for a, b in rng.integers(0, 240, (4000, 2)).tolist():
        if a != b and (group[a] == group[b] or rng.random() < 0.1):
            weights[min(a, b), max(a, b)] = float(rng.random())
    rows = [(7 * i - 300, 7 * j - 300, w) for (a, b), w in weights.items() for i, j in ((a, b), (b, a))] + [(5000, 5000, 1.0)]
    edges = spark.createDataFrame(rows, "i LONG, j LONG, w DOUBLE")
    written = []
    monkeypatch.setattr(graph, "materialize", lambda df, real=graph.materialize: written.append(1) or real(df))
    got = graph.communities(edges, seed=3).toPandas().set_index("node")["label"].sort_index()
    assert len(written) <= 3
    monkeypatch.setattr(graph, "TASK_LINKS", 60)
    want = graph.communities(edges, seed=3).toPandas().set_index("node")["label"].sort_index()
    assert len(written) > 6 and got.equals(want) and 1 < got.nunique() < 120


def test_every_cell_gets_a_community(spark):
    """Coinciding points have no distance to form a kernel from; they belong together all the same."""
    points = [(i, [0.0, 0.0]) for i in range(20)] + [(20 + i, [5.0 + 0.1 * i, 3.0 - 0.2 * (i % 3)]) for i in range(10)] + [(99, [400.0, 400.0])]
    df = spark.createDataFrame(points, "cell_id LONG, features ARRAY<DOUBLE>")
    edges = graph.adaptive_kernel(df, 5).select("i", "j", "w").union(graph.coincident_edges(df))
    labels = graph.communities(edges).toPandas().set_index("node")["label"]
    assert len(labels) == 31 and labels[list(range(20))].nunique() == 1
    alone = spark.createDataFrame([(1, 1, 1.0), (2, 2, 1.0)], "i LONG, j LONG, w DOUBLE")
    assert {(r["node"], r["label"]) for r in graph.communities(alone).collect()} == {(1, 1), (2, 2)}


def test_null_groups_are_groups(spark):
    rows = [("a", 1.0), (None, 2.0), (None, 3.0), (None, 5.0)]
    df = spark.createDataFrame(rows, "g STRING, v DOUBLE")
    ranked = scale.rank_within(df, ["g"], ["v"]).collect()
    assert sorted((r["g"] or "", r["v"], r["rank"]) for r in ranked) == [("", 2.0, 1), ("", 3.0, 2), ("", 5.0, 3), ("a", 1.0, 1)]
    summed = scale.running_sum(df, ["g"], ["v"], "v", "s").collect()
    assert sorted(r["s"] for r in summed) == [1.0, 2.0, 5.0, 10.0]
    assert {r["quantile"] for r in scale.quantile_within(df, ["g"], "v", 0.5).collect()} == {1.0, 3.0}


def test_loops_clear_their_tables(spark, tmp_path):
    import os

    from contactmill.session import materialize, round_tables

    kept = []
    with round_tables(spark) as rounds:
        for i in range(5):
            kept.append(materialize(spark.range(i + 1)).inputFiles()[0].removeprefix("file:").replace("///", "/"))
            rounds.turn()
    assert [os.path.exists(p) for p in kept] == [False] * 4 + [True] or [os.path.exists(p) for p in kept] == [False] * 3 + [True] * 2


def test_visits_do_not_multiply_what_is_sent(spark, monkeypatch):
    """Points without clusters visit every leaf, yet each vector is sent a fixed number of times."""
    monkeypatch.setattr(nearest, "LEAF_ROWS", 40)
    x = np.random.default_rng(7).normal(size=(1500, 24))
    context, report = spark.sparkContext, {}
    context.setJobGroup("visits", "neighbours without clusters")
    same_neighbours(graph.knn(vectors(spark, x), 6, report=report), *brute_neighbours(x, x, 6, True))
    tracker, store = context.statusTracker(), context._jsc.sc().statusStore()
    stages = {s for j in tracker.getJobIdsForGroup("visits") for s in tracker.getJobInfo(j).stageIds}
    moved = sum(a.shuffleWriteBytes() + a.outputBytes() for a in map(store.lastStageAttempt, stages))
    context.setJobGroup("", "")
    assert report["visits"] > 20 * report["queries"]
    assert moved < 60 * x.nbytes, moved / x.nbytes
