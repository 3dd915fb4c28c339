"""Nearest neighbours, adaptive kernels and neighbourhood sums on edge tables."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from contactmill.functions.draws import hash_key, hash_key_values
from contactmill.operators.binning import symmetrize
from contactmill.operators.nearest import knn, knn_join
from contactmill.scale import quantile_within, with_totals
from contactmill.session import materialize, materialize_layout


def bandwidths(neighbors: DataFrame, nth: int) -> DataFrame:
    """Distance to the nth nearest neighbour at a positive distance."""
    place = Window.partitionBy("part", "cell_id").orderBy("distance", "neighbor")  # k rows per cell
    positive = neighbors.where(F.col("distance") > 0).withColumn("_n", F.row_number().over(place))
    return positive.where(F.col("_n") == nth).select("part", "cell_id", F.col("distance").alias("sigma"))


def symmetric_edges(neighbors: DataFrame, construction: str = "union") -> DataFrame:
    """Edges in both directions between cells of which one (union) or each (intersection) lists the other."""
    edges = neighbors.where(F.col("distance") > 0).select("part", F.col("cell_id").alias("i"), F.col("neighbor").alias("j"))
    mirrored = edges.select("part", F.col("j").alias("i"), F.col("i").alias("j"))
    if construction == "union":
        return edges.union(mirrored).distinct()
    if construction in ("intersection", "intersect"):
        return edges.intersect(mirrored)
    raise ValueError(f"unknown graph construction {construction!r}")


def adaptive_kernel(points: DataFrame, k: int = 15, construction: str = "union") -> DataFrame:
    """exp(-d^2 / (sigma_i sigma_j)) on the symmetric neighbour graph, 1 on the diagonal.

    k counts the cell itself; sigma is the distance to the (k // 2)-th neighbour. Result: view, i, j, w, both
    directions stored. Pairs at distance zero get no edge.
    """
    keyed = points if "part" in points.columns else points.withColumn("part", F.lit(0).cast("long"))
    near = materialize(knn(keyed, k - 1))
    sigma = bandwidths(near, k // 2)
    lengths = near.where(F.col("distance") > 0).select(
        "part", F.least("cell_id", "neighbor").alias("a"), F.greatest("cell_id", "neighbor").alias("b"), "distance"
    ).groupBy("part", "a", "b").agg(F.min("distance").alias("d"))
    edges = symmetric_edges(near, construction).withColumns({"a": F.least("i", "j"), "b": F.greatest("i", "j")})
    joined = edges.join(lengths, ["part", "a", "b"])
    for side in ("i", "j"):
        joined = joined.join(
            sigma.select("part", F.col("cell_id").alias(side), F.col("sigma").alias(f"_s{side}")), ["part", side], "left"
        )
    weight = F.coalesce(F.exp(-F.try_divide(F.col("d") * F.col("d"), F.col("_si") * F.col("_sj"))), F.lit(0.0))
    loops = keyed.select("part", F.col("cell_id").alias("i"), F.col("cell_id").alias("j"), F.lit(1.0).alias("w"))
    return joined.select("part", "i", "j", weight.alias("w")).unionByName(loops).withColumnRenamed("part", "view")


def neighbor_weights(points: DataFrame, n: int, start: int = 0) -> DataFrame:
    """The n nearest cells (itself first) with weights exp(-d / q), q the lower quartile of all listed distances, scaled
    to sum 1 per cell; start = 1 leaves the cell itself out."""
    near = materialize(knn(points, n - 1))
    q = F.lit(quantile_within(near, [], "distance", 0.25, "q").first()[0])  # one number
    itself = points.select("cell_id", F.col("cell_id").alias("neighbor"), F.lit(0.0).alias("distance"))
    listed = near.select("cell_id", "neighbor", "distance")
    if start == 0:
        listed = itself.unionByName(listed)
    raw = listed.withColumn("w", F.exp(-F.col("distance") / q))
    shared = with_totals(raw, ["cell_id"], _sum=F.sum("w"))
    return shared.select("cell_id", "neighbor", "distance", (F.col("w") / F.col("_sum")).alias("weight"))


def batch_balanced_neighbors(points: DataFrame, n: int, start: int = 0, seed: int = 0) -> DataFrame:
    """Neighbours spread over batches: the nearest of the own batch, ceil((n-1)/(batches-1)) of each other batch.

    Distances are scaled by their mean per (cell, batch); the nearest entry stays, the others are thinned to n in a
    reproducible hash order. Weights are exp(-scaled distance), summing to 1. `points` has cell_id, features, batch.
    """
    batches = [r["batch"] for r in points.select("batch").distinct().orderBy("batch").toLocalIterator()]
    if len(batches) < 2:
        raise ValueError("at least two batches are needed")
    each = -(-(n - 1) // (len(batches) - 1))
    index = F.array_position(F.array(*[F.lit(b) for b in batches]), F.col("batch")) - 1
    data = points.select(index.alias("part"), "cell_id", "features")
    every = F.sequence(F.lit(0).cast("long"), F.lit(len(batches) - 1).cast("long"))
    asked = points.select(F.explode(every).alias("part"), "cell_id", "features")
    near = knn_join(asked, data, max(each, 1), exclude_self=False)
    own = points.select("cell_id", index.alias("_own"))
    listed = near.join(own, "cell_id").where((F.col("part") != F.col("_own")) | (F.col("rank") == 1))
    local = Window.partitionBy("cell_id", "part")  # at most `each` rows
    scaled = listed.withColumn("w", F.col("distance") / (F.avg("distance").over(local) + 1e-15))
    mine = Window.partitionBy("cell_id")  # at most n + batches rows
    ordered = scaled.withColumn("_place", F.row_number().over(mine.orderBy("w", "neighbor")))
    drawn = ordered.withColumn(
        "_draw", F.when(F.col("_place") == 1, F.lit(-1).cast("long")).otherwise(hash_key(F.col("cell_id"), F.col("neighbor"), seed=seed))
    )
    thinned = drawn.withColumn("_keep", F.row_number().over(mine.orderBy("_draw", "neighbor"))).where(F.col("_keep") <= n)
    final = thinned.withColumn("_place", F.row_number().over(mine.orderBy("w", "neighbor"))).where(F.col("_place") > start)
    weight = F.exp(-F.col("w"))
    return final.select("cell_id", "neighbor", (weight / F.sum(weight).over(mine)).alias("weight"))


def neighbor_pixel_sum(pixels: DataFrame, neighbors: DataFrame) -> DataFrame:
    """sum over neighbours of weight * map, per cell."""
    edges = neighbors.select("cell_id", F.col("neighbor").alias("_n"), "weight")
    theirs = pixels.withColumnRenamed("cell_id", "_n")
    return (
        theirs.join(edges, "_n")
        .groupBy("cell_id", "chrom_ord", "bin1", "bin2")
        .agg(F.sum(F.col("weight") * F.col("value")).alias("value"))
    )


def scaled_by_mean(imputed: DataFrame) -> DataFrame:
    """Each cell's map of a chromosome divided by its mean over the listed pixels."""
    shared = with_totals(imputed, ["cell_id", "chrom_ord"], _mean=F.avg("value"))
    return shared.withColumn("value", F.try_divide("value", "_mean")).drop("_mean")


def combine_imputations(one: DataFrame, two: DataFrame | None = None) -> DataFrame:
    """Sum of two imputations after scaling each to mean 1; cells missing from either are left out."""
    first = scaled_by_mean(one)
    if two is None:
        return first
    second = scaled_by_mean(two).withColumnRenamed("value", "_other")
    keys = ["cell_id", "chrom_ord", "bin1", "bin2"]
    return first.join(second, keys).select(*keys, (F.col("value") + F.col("_other")).alias("value"))


def side_by_side(raw: DataFrame, near: DataFrame, far: DataFrame) -> DataFrame:
    """Symmetric raw, imputed and neighbour-imputed values of the same maps, 0 where one is missing."""
    keys = ["cell_id", "chrom_ord", "bin1", "bin2"]
    out = symmetrize(raw).withColumnRenamed("value", "raw")
    for name, table in (("imputed_0", near), ("imputed_k", far)):
        out = out.join(symmetrize(table).withColumnRenamed("value", name), keys, "full_outer")
    return out.fillna(0.0, ["raw", "imputed_0", "imputed_k"])


def neighbor_feature_mean(edges: DataFrame, points: DataFrame, weighted: bool = False) -> DataFrame:
    """Mean of the neighbours' features per node: uniform over distinct neighbours, or by weights scaled to sum 1."""
    from contactmill.functions.vectors import array_mean, array_sum, scaled

    theirs = points.select(F.col("cell_id").alias("neighbor"), "features")
    if not weighted:
        joined = edges.select("cell_id", "neighbor").distinct().join(theirs, "neighbor")
        return joined.groupBy("cell_id").agg(array_mean(F.col("features")).alias("features"))
    shared = with_totals(edges.select("cell_id", "neighbor", "weight"), ["cell_id"], _sum=F.sum("weight"))
    joined = shared.join(theirs, "neighbor")
    share = scaled(F.col("features"), F.try_divide("weight", "_sum"))
    return joined.groupBy("cell_id").agg(array_sum(share).alias("features"))


def coincident_edges(points: DataFrame) -> DataFrame:
    """Edges of weight 1 in both directions between cells with equal features and the smallest of them."""
    heads = points.groupBy("features").agg(F.min("cell_id").alias("j"))
    tied = points.select(F.col("cell_id").alias("i"), "features").join(heads, "features").where(F.col("i") != F.col("j"))
    tied = tied.select("i", "j", F.lit(1.0).alias("w"))
    return tied.union(tied.select("j", "i", "w"))


def communities(edges: DataFrame, resolution: float = 1.0, seed: int = 0) -> DataFrame:
    """Communities of a weighted symmetric edge table (i, j, w) by modularity: node, label.

    Every node starts alone. Nodes move to the neighbouring label of largest gain until no node gains by a move; then the
    labels become the nodes of a smaller graph, and so on until no node of a level moves. Nodes without an edge to another
    one, such as those that only stand in a loop (i, i), keep a label of their own.

    A level with TASK_LINKS edges at most, and with it all smaller ones that follow, runs in one task by the same rules.
    """
    nodes = edges.select(F.col("i").alias("node")).union(edges.select("j")).distinct()
    placed = materialize(nodes.withColumn("label", F.col("node")))
    level = materialize(edges.where(F.col("i") != F.col("j")).select("i", "j", "w"))
    total = level.agg(F.sum("w")).first()[0] or 0.0
    while total > 0:
        last = level.count() <= TASK_LINKS
        labels = _last_levels(level, total, resolution, seed) if last else _moved(level, total, resolution, seed)
        if labels is None:
            break
        to = labels.select(F.col("node").alias("label"), F.col("label").alias("_to"))
        placed = materialize(placed.join(to, "label", "left").select("node", F.coalesce("_to", "label").alias("label")))
        if last:
            break
        for side in ("i", "j"):
            level = level.join(labels.select(F.col("node").alias(side), F.col("label").alias(f"_{side}")), side)
        level = materialize(level.groupBy(F.col("_i").alias("i"), F.col("_j").alias("j")).agg(F.sum("w").alias("w")))
    return placed


_NOISE = 1e-12  # of a node's strength: gains below it are rounding
LAST_MOVERS = 200
TASK_LINKS = 4_000_000  # edges of a level that one task takes: about 0.5 GB with what a round needs, less than a second a round
IDLE_ROUNDS = 4


def _moved(edges: DataFrame, total: float, resolution: float, seed: int) -> DataFrame | None:
    """Labels (node, label) after local moves, or None where no node gains by one; loops (i, i) count into strengths.

    In each round the gaining nodes of one half, drawn by a hash, move; gaining nodes of the other half wait.
    Once few move, only nodes that moved, waited, or have a neighbour that moved are looked at again: nothing changed for the
    others but volumes. Weights to the own label, kept per node, and volumes give the modularity of each round without another
    look at the edges. A level is over when at most one node in LAST_MOVERS still gains, whatever the size of the graph:
    labels go on to move as nodes of the next level, and only a level on which no node gains at all is the last. Four rounds
    in a row that do not raise modularity end a level, too (moves at the same time can undo each other).
    """
    spark = edges.sparkSession
    width = int(spark.conf.get("spark.sql.shuffle.partitions"))
    loops = edges.where(F.col("i") == F.col("j")).agg(F.sum("w")).first()[0] or 0.0
    links = materialize_layout(edges.where(F.col("i") != F.col("j")).repartition(width, "i"))
    strength = edges.groupBy(F.col("i").alias("node")).agg(F.sum("w").alias("k"))
    state = materialize(strength.select("node", F.col("node").alias("label"), "k", F.lit(0.0).alias("own")))
    best, best_score, idle, step, active = None, float("-inf"), 0, 0, None
    while True:
        volumes = state.groupBy("label").agg(F.sum("k").alias("volume"))
        seen = links if active is None else links.join(active, "i", "left_semi")
        reach = (
            seen.join(state.select(F.col("node").alias("j"), "label"), "j")
            .groupBy(F.col("i").alias("node"), "label").agg(F.sum("w").alias("to"))
        )
        mine = state.select("node", F.col("label").alias("_l"), "k")
        # the node itself does not count into the volume of its own label
        held = F.col("volume") - F.when(F.col("label") == F.col("_l"), F.col("k")).otherwise(F.lit(0.0))
        gain = F.col("to") - F.lit(resolution) * F.col("k") * held / F.lit(total)
        offers = reach.join(mine, "node").join(volumes, "label").withColumn("gain", gain)
        choice = offers.groupBy("node").agg(
            F.max(F.when(F.col("label") != F.col("_l"), F.struct("gain", (-F.col("label")).alias("l")))).alias("_best"),
            F.max(F.when(F.col("label") == F.col("_l"), F.col("to"))).alias("_to"),
        )
        own = F.when(F.col("_seen"), F.coalesce("_to", F.lit(0.0))).otherwise(F.col("own"))
        stay = own - F.lit(resolution) * F.col("k") * (F.col("volume") - F.col("k")) / F.lit(total)
        gains = F.col("_seen") & (F.col("_best.gain") > stay + F.col("k") * _NOISE)
        turn = hash_key(F.col("node"), F.lit(step).cast("long"), seed=seed) % 2 == 0
        looked = state.join(choice.withColumn("_seen", F.lit(True)), "node", "left").withColumn("_seen", F.coalesce("_seen", F.lit(False)))
        result = materialize(
            looked.join(volumes, "label").withColumn("_gains", F.coalesce(gains, F.lit(False))).select(
                "node", "label", "k", own.alias("own"), (F.col("_gains") & turn).alias("moved"), (F.col("_gains") & ~turn).alias("waits"),
                F.when(F.col("_gains") & turn, -F.col("_best.l")).otherwise(F.col("label")).alias("to"),
            )
        )
        sums = result.groupBy("label").agg(
            F.sum("k").alias("v"), F.sum("own").alias("o"), F.count_if("moved").alias("m"), F.count_if("waits").alias("w"),
            F.count(F.lit(1)).alias("n"),
        ).agg(F.sum(F.col("v") * F.col("v")), F.sum("o"), F.sum("m"), F.sum("w"), F.sum("n")).first()
        score = (sums[1] + loops) / total - resolution * sums[0] / (total * total)
        if score > best_score:
            # the labels of the first round are the nodes themselves
            best, best_score, idle = result.select("node", "label") if best_score > float("-inf") else None, score, 0
        else:
            idle += 1
        gaining, moved = sums[2] + sums[3], sums[2]
        if gaining == 0 or idle >= IDLE_ROUNDS or (step > 1 and gaining * LAST_MOVERS <= sums[4] and best is not None):
            break
        active = None
        if moved * 8 < sums[4]:
            touched = links.join(result.where("moved").select(F.col("node").alias("j")), "j", "left_semi").select("i")
            active = touched.union(result.where("moved OR waits").select("node")).distinct()
        state, step = result.select("node", F.col("to").alias("label"), "k", "own"), step + 1
    return best


def _summed(keys: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(distinct keys in order, sum of weights of each)."""
    if not len(keys):
        return keys, weights
    order = np.argsort(keys, kind="stable")
    keys, weights = keys[order], weights[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[first], np.add.reduceat(weights, first)


def _moved_here(
    nodes: np.ndarray, i: np.ndarray, j: np.ndarray, w: np.ndarray, total: float, resolution: float, seed: int
) -> np.ndarray | None:
    """`_moved` on arrays: labels by node, or None. nodes: identifiers in order; i, j: places in nodes (j may be -1, no node)."""
    n, link = len(nodes), (i != j) & (j >= 0)
    k, loops = np.bincount(i, weights=w, minlength=n), w[i == j].sum()
    i, j, w = i[link], j[link], w[link]
    label, own, share = np.arange(n), np.zeros(n), resolution * k
    best, best_score, idle, step, active = None, float("-inf"), 0, 0, None
    while True:
        volume = np.bincount(label, weights=k, minlength=n)
        seen = slice(None) if active is None else active[i]
        # weight of each node to each label near it
        key, to = _summed(i[seen] * n + label[j[seen]], w[seen])
        node, near = np.divmod(key, n)
        mine = near == label[node]
        looked = np.zeros(n, dtype=bool)
        looked[node] = True
        own = np.where(looked, np.bincount(node[mine], weights=to[mine], minlength=n), own)
        stay = own - share * (volume[label] - k) / total
        node, near, to = node[~mine], near[~mine], to[~mine]
        gain = to - share[node] * volume[near] / total
        # of a node's largest gains the smallest label: runs of a node are sorted by label
        top, goal = np.full(n, -np.inf), np.full(n, -1)
        if len(node):
            first = np.flatnonzero(np.concatenate([[True], node[1:] != node[:-1]]))
            top[node[first]] = np.maximum.reduceat(gain, first)
            at = np.flatnonzero(gain == top[node])[::-1]
            goal[node[at]] = near[at]
        gains = (goal >= 0) & (top > stay + k * _NOISE)
        turn = hash_key_values(nodes, np.full(n, step), seed=seed) % 2 == 0
        moves, waits = gains & turn, gains & ~turn
        score = (own.sum() + loops) / total - resolution * (volume**2).sum() / (total * total)
        if score > best_score:
            # the labels of the first round are the nodes themselves
            best, best_score, idle = label if best_score > float("-inf") else None, score, 0
        else:
            idle += 1
        gaining, moved = int(gains.sum()), int(moves.sum())
        if gaining == 0 or idle >= IDLE_ROUNDS or (step > 1 and gaining * LAST_MOVERS <= n and best is not None):
            return best
        active = None
        if moved * 8 < n:
            active = gains.copy()
            active[i[moves[j]]] = True
        label, step = np.where(moves, goal, label), step + 1


def _last_levels(level: DataFrame, total: float, resolution: float, seed: int) -> DataFrame:
    """Labels (node, label) after all levels from this one on, in one task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches))
        if not table.num_rows:
            return
        i, j = (table.column(c).to_numpy() for c in ("i", "j"))
        w = table.column("w").fill_null(0.0).to_numpy()
        ids = np.unique(i)
        order = np.lexsort((j, i))
        i, j, w = i[order], j[order], w[order]
        # as in `_moved`, a node is a node by its own edges
        a, b = np.searchsorted(ids, i), np.where(np.isin(j, ids), np.searchsorted(ids, j), -1)
        placed, nodes = np.arange(len(ids)), np.arange(len(ids))
        while (labels := _moved_here(ids[nodes], a, b, w, total, resolution, seed)) is not None:
            placed = labels[placed]
            inside = b >= 0
            keys, w = _summed(labels[a[inside]] * len(nodes) + labels[b[inside]], w[inside])
            a, b = np.divmod(keys, len(nodes))
            left, placed = np.unique(placed, return_inverse=True)
            nodes, a, b = nodes[left], np.searchsorted(left, a), np.searchsorted(left, b)
        yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(ids[nodes][placed])], names=["node", "label"])

    kind = level.schema["i"].dataType.simpleString()
    alone = level.select("i", F.col("j").cast(kind).alias("j"), F.col("w").cast("double").alias("w")).repartition(1)
    return alone.mapInArrow(run, f"node {kind}, label {kind}")


def modularity(edges: DataFrame, labels: DataFrame, total: float, resolution: float = 1.0) -> float:
    """Share of edge weight inside labels minus what node strengths let expect."""
    if total == 0:
        return 0.0
    inside = (
        edges.join(labels.select(F.col("node").alias("i"), F.col("label").alias("li")), "i")
        .join(labels.select(F.col("node").alias("j"), F.col("label").alias("lj")), "j")
        .where(F.col("li") == F.col("lj"))
        .agg(F.sum("w"))
        .first()[0]
        or 0.0
    )
    volumes = labels.groupBy("label").agg(F.sum("k").alias("v")).agg(F.sum(F.col("v") * F.col("v"))).first()[0]
    return inside / total - resolution * volumes / (total * total)
