"""Exact nearest neighbours through a tree of pivots.

Data rows are dealt to the nearest of FAN pivots, level by level, until a node holds at most LEAF_ROWS of them. A node knows
its pivot and its covering radius. Rows of a leaf form blocks: identifiers and one flat array of vectors.

1. Each block of queries meets its own leaf, which bounds the distance to the k-th neighbour of each query.
2. Blocks are dealt to tiles: a slice of a part's queries and a slice of its data, TILE_BYTES of vectors each at most. In its
   tile a query meets the leaves that the triangle inequality over pivot, radius and its bound cannot rule out, nearest
   leaves first. Only its k nearest of each tile come back.

Where nothing can be ruled out (many dimensions without clusters) all pairs are computed, but what is written and sent stays
a fixed number of copies of each vector: SLICES of data, one of queries for each TILE_BYTES of the part. Pairs of rows are
never emitted. Vectors that more rows share than fit into a leaf are answered from their smallest
identifiers and enter the tree as these few rows only. Pivots go to every task while their size stays under PIVOT_BYTES;
beyond it, rows and pivots meet by node.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from contactmill.functions.vectors import squared_distance
from contactmill.session import materialize

LEAF_ROWS = 2048
FAN = 32
BITS = 6  # of a node's number per level; FAN < 2**BITS
DEPTH = 9
PIVOT_BYTES = 64 << 20
TILE_BYTES = 32 << 20  # of vectors in a slice of a part
SLICES = 12  # of a part's queries, more only beyond as many TILE_BYTES
_CHUNK = 1024  # queries that look into leaves together
SMALL_ROWS = 200_000  # rows of a table of nodes that may go to every task
_SALTS = 64
_ROOT = 1
_PLACED = "part LONG, cell_id LONG, features ARRAY<DOUBLE>, side INT, node LONG, away DOUBLE, before DOUBLE"
_SLACK = 1e-6  # rounding of distances never hides a neighbour

NODE, BLOCK = ["part", "node"], ["part", "node", "sub"]


def _to_points(x: np.ndarray, points: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum((x**2).sum(1)[:, None] + (points**2).sum(1)[None] - 2 * x @ points.T, 0.0))


def _small(table: DataFrame) -> DataFrame:
    """A written table with few rows, as a broadcast; a larger one as it is."""
    return F.broadcast(table) if table.count() <= SMALL_ROWS else table


def _parent(node: Column) -> Column:
    return F.shiftright(node, BITS)


# ---- the tree


def _placed(pdf: pd.DataFrame, pivots: dict[tuple[int, int], np.ndarray]) -> pd.DataFrame:
    """Rows moved from their node to the child with the nearest pivot."""
    pdf = pdf.copy()
    node, away = pdf["node"].to_numpy().copy(), pdf["away"].to_numpy().copy()
    for key, at in pdf.groupby(NODE).indices.items():
        points = pivots[key]
        d = _to_points(np.stack(pdf["features"].to_numpy()[at]), points)
        node[at], away[at] = (key[1] << BITS) + 1 + d.argmin(axis=1), d.min(axis=1)
    return pdf.assign(node=node, before=pdf["away"], away=away)


def _split(rows: DataFrame, pivots: DataFrame) -> DataFrame:
    """rows of nodes that have pivots (part, node, pivots ARRAY<ARRAY<DOUBLE>>), one level down."""
    stats = pivots.agg(F.count(F.lit(1)), F.max(F.size(F.element_at("pivots", 1)))).first()
    columns = [c.split()[0] for c in _PLACED.split(", ")]
    if stats[0] * FAN * stats[1] * 8 <= PIVOT_BYTES:
        known = {(r["part"], r["node"]): np.array(r["pivots"]) for r in pivots.collect()}

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                yield _placed(pdf, known)[columns]

        return rows.mapInPandas(run, _PLACED)
    loads = rows.groupBy(*NODE).agg(F.ceil(F.count(F.lit(1)) / (16 * LEAF_ROWS)).alias("_chunks"))
    asked = rows.join(loads, NODE).withColumn("chunk", F.pmod(F.xxhash64("cell_id"), F.col("_chunks"))).drop("_chunks")
    spread = pivots.join(loads, NODE).withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_chunks") - 1)))

    def meet(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if left.empty:
            return left.assign(before=0.0)[columns]
        key = (int(left["part"].iloc[0]), int(left["node"].iloc[0]))
        return _placed(left, {key: np.array([list(p) for p in right["pivots"].iloc[0]])})[columns]

    by = [*NODE, "chunk"]
    return asked.groupBy(*by).cogroup(spread.drop("_chunks").groupBy(*by)).applyInPandas(meet, _PLACED)


def _pivots(rows: DataFrame, sizes: DataFrame) -> DataFrame:
    """Up to FAN different data vectors of each node of `sizes` (part, node, _n), drawn by a hash of the identifier."""
    draw = F.xxhash64("cell_id", "node")
    likely = F.pmod(draw, F.lit(1 << 32)) < F.lit(float(1 << 32)) * FAN * 8 / F.col("_n")
    drawn = rows.where(F.col("side").bitwiseAND(F.lit(1)) == 1).join(sizes, NODE).where(likely)
    place = F.row_number().over(Window.partitionBy(*NODE).orderBy(draw, "cell_id"))  # about 8 FAN rows a node
    chosen = drawn.withColumn("_place", place).where(F.col("_place") <= FAN)
    points = F.array_distinct(F.collect_list("features"))
    return chosen.groupBy(*NODE).agg(points.alias("pivots")).where(F.size("pivots") > 1)


def _tree(rows: DataFrame, leaf_rows: int) -> tuple[DataFrame, DataFrame | None]:
    """(rows at their leaves, all nodes below the root). rows: part, cell_id, features, side (1 data, 2 queries, 3 both).

    A node: part, node, pivot, radius and rows (of its data), leaf.
    """
    data = F.col("side").bitwiseAND(F.lit(1))
    level = rows.withColumns({"node": F.lit(_ROOT).cast("long"), "away": F.lit(float("inf")), "before": F.lit(float("inf"))})
    done, nodes, depth = [], [], 0
    while True:
        sizes = materialize(level.groupBy(*NODE).agg(F.sum(data).alias("_n")).where(F.col("_n") > leaf_rows))
        pivots = None
        if depth < DEPTH and not sizes.isEmpty():
            pivots = materialize(_pivots(level, _small(sizes)))
        split = pivots is not None and not pivots.isEmpty()
        if nodes:
            inner = pivots.select(*NODE, F.lit(False).alias("leaf")) if split else None
            found = nodes.pop()
            nodes.append(found.withColumn("leaf", F.lit(True)) if not split else
                         found.join(inner, NODE, "left").withColumn("leaf", F.coalesce("leaf", F.lit(True))))
        if not split:
            done.append(level)
            break
        names = _small(pivots.select(*NODE))
        done.append(level.join(names, NODE, "left_anti"))
        going = level.join(names, NODE, "left_semi").select(*level.columns)
        level = materialize(_split(going, pivots))
        points = pivots.select("part", F.col("node").alias("_up"), F.posexplode("pivots").alias("_at", "pivot")).select(
            "part", (F.shiftleft("_up", BITS) + 1 + F.col("_at")).alias("node"), "pivot"
        )
        extent = level.groupBy(*NODE).agg(F.max(F.when(data == 1, F.col("away"))).alias("radius"), F.sum(data).alias("rows"))
        nodes.append(points.join(extent, NODE))
        depth += 1
    columns = [c.split()[0] for c in _PLACED.split(", ")]
    leaves = done[0].select(*columns)
    for other in done[1:]:
        leaves = leaves.unionByName(other.select(*columns))
    if not nodes:
        return leaves, None
    whole = nodes[0]
    for other in nodes[1:]:
        whole = whole.unionByName(other)
    return leaves, materialize(whole.select(*NODE, "pivot", "radius", "rows", "leaf"))


def _blocks(leaves: DataFrame, side: int, nodes: DataFrame | None) -> DataFrame:
    """The rows of one side as blocks: part, node, sub, ids, x (flat), cover (bounds from the parent), reach.

    cover: the distance within which the parent of the leaf holds more rows than a leaf; reach: how far rows are from the
    leaf's pivot at most.
    """
    mine = leaves.where(F.col("side").bitwiseAND(F.lit(side)) == side)
    loads = mine.groupBy(*NODE).agg(F.ceil(F.count(F.lit(1)) / LEAF_ROWS).alias("_subs"))
    parted = mine.join(loads, NODE).withColumn("sub", F.pmod(F.xxhash64("cell_id"), F.col("_subs")))
    if nodes is None:
        parted = parted.withColumn("cover", F.lit(float("inf")))
    else:
        up = nodes.select("part", F.col("node").alias("_up"), F.col("radius").alias("_wide"))
        parted = parted.withColumn("_up", _parent(F.col("node"))).join(up, ["part", "_up"], "left")
        parted = parted.withColumn("cover", F.col("before") + F.coalesce("_wide", F.lit(float("inf"))))
    entries = F.array_sort(F.collect_list(F.struct("cell_id", "features", "cover")))  # at most about LEAF_ROWS
    packed = parted.groupBy(*BLOCK).agg(entries.alias("_e"), F.max("away").alias("reach"))
    return packed.select(
        *BLOCK, F.col("_e.cell_id").alias("ids"), F.flatten("_e.features").alias("x"), F.col("_e.cover").alias("cover"), "reach"
    )


# ---- search


def _matrix(flat: np.ndarray, rows: int) -> np.ndarray:
    return np.asarray(flat).reshape(rows, -1)


def _nearest(
    qid: np.ndarray, x: np.ndarray, did: np.ndarray, y: np.ndarray, k: int, exclude_self: bool
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place of query, neighbour, distance), exact, k a query: a fast product finds candidates, differences measure them."""
    rough = (x**2).sum(1)[:, None] + (y**2).sum(1)[None] - 2 * x @ y.T
    if exclude_self:
        rough[qid[:, None] == did[None]] = np.inf
    take = min(k, len(did))
    limit = np.partition(rough, take - 1, axis=1)[:, take - 1]
    slack = 1e-9 * (1.0 + (x**2).sum(1) + (y**2).sum(1).max())
    near = (rough <= (limit + slack)[:, None]) & np.isfinite(rough)
    qi, di = np.nonzero(near)
    exact = np.sqrt(((x[qi] - y[di]) ** 2).sum(1))
    order = np.lexsort((did[di], exact, qi))
    qi, di, exact = qi[order], di[order], exact[order]
    keep = np.arange(len(qi)) - np.searchsorted(qi, qi, side="left") < k
    return qi[keep], did[di[keep]], exact[keep]


_FOUND = "part LONG, node LONG, sub LONG, bounds ARRAY<DOUBLE>, found ARRAY<STRUCT<cell_id: LONG, neighbor: LONG, distance: DOUBLE>>"
_PAIR = pa.struct([("cell_id", pa.int64()), ("neighbor", pa.int64()), ("distance", pa.float64())])


def _searched(pairs: DataFrame, k: int, exclude_self: bool) -> DataFrame:
    """pairs: a block of queries (part, node, sub, ids, x, cover) and one of data (d_ids, d_x) in a row.

    bounds: per query the distance within which k neighbours are known; found: up to k neighbours within `cover`.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
            for r in range(batch.num_rows):
                qid, did, cover = (columns[c][r].values.to_numpy() for c in ("ids", "d_ids", "cover"))
                x, y = _matrix(columns["x"][r].values, len(qid)), _matrix(columns["d_x"][r].values, len(did))
                at, neighbor, distance = _nearest(qid, x, did, y, k, exclude_self)
                ends = np.searchsorted(at, np.arange(len(qid)), side="right")
                counts = np.bincount(at, minlength=len(qid))
                bounds = cover.copy()
                full = counts >= k
                bounds[full] = np.minimum(bounds[full], distance[ends[full] - 1])
                near = distance <= cover[at] + _SLACK
                found = pa.StructArray.from_arrays(
                    [pa.array(qid[at[near]]), pa.array(neighbor[near]), pa.array(distance[near])], fields=list(_PAIR)
                )
                yield pa.RecordBatch.from_arrays(
                    [pa.array([columns[c][r].as_py()]) for c in BLOCK]
                    + [pa.array([bounds], pa.list_(pa.float64())), pa.ListArray.from_arrays([0, len(found)], found)],
                    names=[*BLOCK, "bounds", "found"],
                )

    return pairs.select(*BLOCK, "ids", "x", "cover", "d_ids", "d_x").mapInArrow(run, _FOUND)


def _bounded(q: DataFrame, home: DataFrame, nodes: DataFrame, k: int) -> DataFrame:
    """The blocks of queries with what their own leaf says about the k-th distance, in `cover`.

    Where that is nothing (few rows in the leaf, and its parent is the root), any node below the root with enough rows
    bounds it by the way to the node's far side.
    """
    bounds = home.groupBy(*BLOCK).agg(F.collect_list("bounds").alias("_all")).select(
        *BLOCK, F.aggregate("_all", F.element_at("_all", 1), lambda a, b: F.zip_with(a, b, lambda x, y: F.least(x, y))).alias("_b")
    )
    known = q.join(bounds, BLOCK, "left").withColumn("cover", F.coalesce("_b", "cover")).drop("_b")
    open_ = known.where(F.array_max("cover") == float("inf")).select(*BLOCK, "reach")
    centres = nodes.select(*NODE, F.col("pivot").alias("_centre"))
    wide = nodes.where((_parent(F.col("node")) == _ROOT) & (F.col("rows") > k)).select("part", "pivot", "radius")
    far = F.sqrt(squared_distance(F.col("_centre"), F.col("pivot"))) + F.col("reach") + F.col("radius")
    other = open_.join(centres, NODE).join(wide, "part").groupBy(*BLOCK).agg(F.min(far).alias("_far"))
    limited = F.transform("cover", lambda c: F.least(c, F.coalesce("_far", F.lit(float("inf")))))
    return known.join(other, BLOCK, "left").withColumn("cover", limited).drop("_far")


_MET = "part LONG, visits LONG, found ARRAY<STRUCT<cell_id: LONG, neighbor: LONG, distance: DOUBLE>>"


def _best(at: np.ndarray, neighbor: np.ndarray, distance: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k nearest neighbours of each query, in the order of (query, distance, neighbour)."""
    order = np.lexsort((neighbor, distance, at))
    at, neighbor, distance = at[order], neighbor[order], distance[order]
    keep = np.arange(len(at)) - np.searchsorted(at, at, side="left") < k
    return at[keep], neighbor[keep], distance[keep]


class _Leaf:
    """The rows of a leaf, moved to its pivot, from where short floats measure; their error bound lets no neighbour go."""

    def __init__(self, ids: np.ndarray, y: np.ndarray, pivot: np.ndarray) -> None:
        self.ids, self.y, self.pivot = ids, y, pivot
        moved = y - pivot
        squares = (moved**2).sum(1)
        self.widest = squares.max()
        self.right = np.column_stack([-2 * moved, np.ones(len(y)), squares])

    def near(self, x: np.ndarray, limits: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(place of query, neighbour, distance) for all rows within the limits of the queries."""
        moved = x - self.pivot
        squares = (moved**2).sum(1)
        left = np.column_stack([moved, squares, np.ones(len(x))])
        slack = 2.5e-7 * (x.shape[1] + 8) * (squares + self.widest)
        kind = np.float32 if 1e-24 < slack.min() and slack.max() < 1e24 else np.float64
        rough = left.astype(kind) @ self.right.astype(kind).T
        hits = np.flatnonzero(rough <= ((limits + _SLACK) ** 2 + slack).astype(kind)[:, None])
        at, place = np.divmod(hits, len(self.ids))
        exact = np.sqrt(((x[at] - self.y[place]) ** 2).sum(1))
        keep = exact <= limits[at] + _SLACK
        return at[keep], self.ids[place[keep]], exact[keep]


def _chunk_neighbours(
    ids: np.ndarray, home: np.ndarray, x: np.ndarray, limits: np.ndarray, leaves: list[_Leaf],
    nodes: np.ndarray, pivots: np.ndarray, radii: np.ndarray, k: int, exclude_self: bool,
) -> tuple[int, np.ndarray, np.ndarray, np.ndarray]:
    """(visits, place of query, neighbour, distance): up to k neighbours of each query in leaves other than its own.

    Leaves come by falling nearness and only meet the queries whose bound reaches them; what they hold narrows the bounds.
    """
    gaps = np.where(home[:, None] == nodes[None], np.inf, _to_points(x, pivots) - radii[None])
    found, fresh, visits, limits = [np.zeros(0, int), np.zeros(0, int), np.zeros(0)], 0, 0, limits.copy()
    waiting = [found]
    for leaf in np.argsort(gaps.min(axis=0), kind="stable"):
        rows = np.flatnonzero(gaps[:, leaf] <= limits + _SLACK)
        if not len(rows) or not np.isfinite(gaps[rows, leaf]).any():
            continue
        rows = rows[np.isfinite(gaps[rows, leaf])]
        visits += len(rows)
        at, neighbor, distance = leaves[leaf].near(x[rows], limits[rows])
        at = rows[at]
        if exclude_self:
            other = ids[at] != neighbor
            at, neighbor, distance = at[other], neighbor[other], distance[other]
        waiting.append([at, neighbor, distance])
        fresh += len(at)
        if fresh >= k * len(ids):
            waiting, fresh = [list(_best(*map(np.concatenate, zip(*waiting, strict=True)), k))], 0
            counts = np.bincount(waiting[0][0], minlength=len(ids))
            full = counts >= k
            limits[full] = np.minimum(limits[full], waiting[0][2][np.cumsum(counts)[full] - 1])
    return visits, *_best(*map(np.concatenate, zip(*waiting, strict=True)), k)


def _met(q: DataFrame, d: DataFrame, nodes: DataFrame, k: int, exclude_self: bool) -> DataFrame:
    """Blocks of queries against all leaves of their part but their own: part, visits, found.

    The queries of a part are dealt to a few slices, its data to as many as TILE_BYTES asks for; a task gets a slice of each
    and looks into leaves by the triangle inequality there. So a vector is sent a fixed number of times, however many leaves
    have to be visited, until a slice of a part is full.
    """
    leaves = d.select(*BLOCK, "ids", "x").join(_small(nodes.select(*NODE, "pivot", "radius")), NODE)
    weight = F.ceil(F.sum(F.size("x")) * 8 / TILE_BYTES)
    rows = F.ceil(F.sum(F.size("ids")) / (4 * LEAF_ROWS))
    theirs = leaves.groupBy("part").agg(weight.alias("_d"))
    mine = q.groupBy("part").agg(F.greatest(weight, F.least(F.lit(SLICES), rows)).alias("_q"))
    parts = materialize(mine.join(theirs, "part"))
    tiles = parts.agg(F.sum(F.col("_q") * F.col("_d"))).first()[0] or 1
    small, place = _small(parts), F.xxhash64("node", "sub")

    def every(n: str) -> Column:
        return F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))

    by = ["part", "g", "h"]
    left = q.join(small, "part").withColumn("g", F.pmod(place, F.col("_q"))).withColumn("h", every("_d"))
    right = leaves.join(small, "part").withColumn("h", F.pmod(place, F.col("_d"))).withColumn("g", every("_q"))
    left = left.select(*by, "node", "ids", "x", "cover").repartition(2 * tiles, *by)
    # new columns, for both sides may come from one table
    right = right.select(*[F.col(c).alias(c) for c in (*by, "node", "ids", "x", "pivot", "radius")]).repartition(2 * tiles, *by)

    def meet(asked: pa.Table, held: pa.Table) -> pa.Table:
        def flat(table: pa.Table, column: str) -> np.ndarray:
            return table[column].combine_chunks().flatten().to_numpy()

        out: list[list] = [[], [], []]
        if asked.num_rows and held.num_rows:
            part, counts = asked["part"][0].as_py(), held["ids"].combine_chunks().value_lengths().to_numpy()
            nodes, radii = held["node"].to_numpy(), held["radius"].to_numpy()
            pivots, ends = _matrix(flat(held, "pivot"), held.num_rows), np.cumsum(counts)
            y, did = _matrix(flat(held, "x"), int(ends[-1])), flat(held, "ids")
            leaves = [_Leaf(did[e - n : e], y[e - n : e], p) for e, n, p in zip(ends, counts, pivots, strict=True)]
            asked = asked.sort_by("node")
            qid, cover = flat(asked, "ids"), flat(asked, "cover")
            x, home = _matrix(flat(asked, "x"), len(qid)), np.repeat(
                asked["node"].to_numpy(), asked["ids"].combine_chunks().value_lengths().to_numpy()
            )
            for a in range(0, len(qid), _CHUNK):
                at = slice(a, a + _CHUNK)
                visits, place, neighbor, distance = _chunk_neighbours(
                    qid[at], home[at], x[at], cover[at], leaves, nodes, pivots, radii, k, exclude_self
                )
                found = pa.StructArray.from_arrays(
                    [pa.array(qid[at][place]), pa.array(neighbor), pa.array(distance)], fields=list(_PAIR)
                )
                for values, value in zip(out, (part, visits, found), strict=True):
                    values.append(value)
        offsets = np.cumsum([0, *map(len, out[2])])
        entries = pa.concat_arrays(out[2]) if out[2] else pa.array([], pa.struct(list(_PAIR)))
        return pa.table({
            "part": pa.array(out[0], pa.int64()), "visits": pa.array(out[1], pa.int64()),
            "found": pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), entries),
        })

    return left.groupBy(*by).cogroup(right.groupBy(*by)).applyInArrow(meet, _MET)


def _crowded(data: DataFrame, k: int) -> DataFrame | None:
    """(part, features, heads) for vectors of more rows than a leaf takes; heads are their k + 1 smallest identifiers."""
    name = F.xxhash64("features").alias("_v")
    many = data.groupBy("part", name).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > max(LEAF_ROWS, k)).drop("_n")
    many = materialize(many)  # at most rows / LEAF_ROWS
    if many.isEmpty():
        return None
    rows = data.withColumn("_v", F.xxhash64("features")).join(many, ["part", "_v"])
    salt = F.pmod(F.xxhash64("cell_id"), F.lit(_SALTS))
    for by in (["part", "features", salt], ["part", "features"]):
        rows = rows.withColumn("_r", F.row_number().over(Window.partitionBy(*by).orderBy("cell_id"))).where(F.col("_r") <= k + 1)
    heads = F.array_sort(F.collect_list("cell_id")).alias("heads")
    return materialize(rows.groupBy("part", "features").agg(heads).where(F.size("heads") > k))


def _ranked(found: DataFrame, k: int) -> DataFrame:
    place = Window.partitionBy("part", "cell_id").orderBy("distance", "neighbor")
    return found.withColumn("rank", F.row_number().over(place)).where(F.col("rank") <= k)


def knn_join(
    queries: DataFrame, data: DataFrame, k: int, exclude_self: bool = True, report: dict | None = None
) -> DataFrame:
    """Exact k nearest data rows of every query row in the same part (euclidean, ties by id).

    Both tables: part LONG, cell_id LONG, features ARRAY<DOUBLE>. Result: part, cell_id, neighbor, distance, rank. A dict
    given as `report` receives the number of queries and of their visits to leaves, own leaf included.
    """
    columns = [F.col("part").cast("long").alias("part"), "cell_id", "features"]
    same = queries is data
    held = data.select(*columns)
    crowds = _crowded(held, k)
    asked = held if same else queries.select(*columns)
    answered = None
    if crowds is not None:
        neighbor = F.explode(F.slice(F.filter("heads", lambda h: h != F.col("cell_id")) if exclude_self else F.col("heads"), 1, k))
        crowds = _small(crowds)
        answered = asked.join(crowds, ["part", "features"]).select("part", "cell_id", neighbor.alias("neighbor"))
        answered = answered.withColumn("distance", F.lit(0.0))
        asked = asked.join(crowds, ["part", "features"], "left_anti").select("part", "cell_id", "features")
        few = crowds.select("part", F.explode("heads").alias("cell_id"), "features")
        held = held.join(crowds, ["part", "features"], "left_anti").select("part", "cell_id", "features")
        rows = held.withColumn("side", F.lit(3 if same else 1)).unionByName(few.withColumn("side", F.lit(1)))
        if not same:
            rows = rows.unionByName(asked.withColumn("side", F.lit(2)))
    elif same:
        rows = held.withColumn("side", F.lit(3))
    else:
        rows = held.withColumn("side", F.lit(1)).unionByName(asked.withColumn("side", F.lit(2)))
    leaves, nodes = _tree(materialize(rows), max(LEAF_ROWS, k + 1))
    d = materialize(_blocks(leaves, 1, nodes))
    q = d if same and crowds is None else materialize(_blocks(leaves, 2, nodes))
    theirs = d.select(*NODE, F.col("ids").alias("d_ids"), F.col("x").alias("d_x"))
    home = materialize(_searched(q.join(theirs, NODE), k, exclude_self))
    parts = [home]
    if nodes is not None:
        met = _met(_bounded(q, home, nodes, k), d, nodes, k, exclude_self)
        if report is not None:
            met = materialize(met)
        parts.append(met)
    if report is not None:
        report["queries"] = q.agg(F.sum(F.size("ids"))).first()[0] or 0
        later = met.agg(F.sum("visits")).first()[0] or 0 if nodes is not None else 0
        report["visits"] = report["queries"] + later
    found = parts[0].select("part", F.inline("found"))
    for other in parts[1:]:
        found = found.unionByName(other.select("part", F.inline("found")))
    if answered is not None:
        found = found.unionByName(answered)
    return _ranked(found, k)


def knn(points: DataFrame, k: int, exclude_self: bool = True, report: dict | None = None) -> DataFrame:
    """k nearest other cells of every cell; points: cell_id, features (and part, to keep several sets apart)."""
    keyed = points if "part" in points.columns else points.withColumn("part", F.lit(0).cast("long"))
    return knn_join(keyed, keyed, k, exclude_self, report)
