"""Centroid clustering over exact whole numbers; nearest centroids by progressive Walsh-Hadamard search.

The transform H of 64 components is whole-numbered, linear, and multiplies squared distances by 64 exactly. It gathers what
neighbouring components share in its first coefficients (fewest sign changes first), so a few coefficients already bound
the distance from below. A search adds up squared coefficient differences from coarse to fine. After each step the
centroid that leads is measured in full, and centroids whose unfinished sum is above the best full distance go; what is
left at the end has all 64 coefficients, so the result equals a search over everything, ties included.

Vectors are transformed once and stay distributed. A round returns one sum per centroid and task; since H is linear and
H(H(x)) = 64 x, component sums follow exactly from sums of coefficients. The driver holds centroids only.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from contactmill.session import materialize

WIDTH = 64
STOPS = (4, 8, 16, 32, 64)  # coefficients added up after each step
SCALE = 256.0
LIMIT = 1 << 56  # components saturate here, so that coefficients fit in 64 bits
EXACT = 1 << 27  # coefficients up to here have squared distances that fit in 64 bits
LONG = (1 << 63) - 1
ROWS = 1024  # vectors searched at once


def transform(x: np.ndarray) -> np.ndarray:
    """Walsh-Hadamard coefficients of the rows of x in natural order."""
    out, h = x, 1
    while h < WIDTH:
        pair = out.reshape(-1, WIDTH // (2 * h), 2, h)
        out = np.stack([pair[:, :, 0] + pair[:, :, 1], pair[:, :, 0] - pair[:, :, 1]], axis=2).reshape(-1, WIDTH)
        h *= 2
    return out


def _coarse_first() -> np.ndarray:
    """Numbers of the coefficients by number of sign changes."""
    basis = transform(np.eye(WIDTH, dtype=np.int64))
    return np.argsort((np.diff(basis, axis=1) != 0).sum(axis=1), kind="stable")


ORDER = _coarse_first()


def coefficients(x: np.ndarray) -> np.ndarray:
    return transform(x)[:, ORDER]


def components(coefs: np.ndarray) -> np.ndarray:
    """The inverse of `coefficients`, exact for whole-numbered sums of transformed vectors."""
    natural = np.empty_like(coefs)
    natural[:, ORDER] = coefs
    return transform(natural) // WIDTH


def _first_least(values: np.ndarray, starts: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Place of the first smallest value of each row; rows are consecutive and begin at `starts`."""
    least = np.minimum.reduceat(values, starts)
    places = np.flatnonzero(values == least[rows])
    return places[np.unique(rows[places], return_index=True)[1]]


def _search(vectors: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums stand in a full table while most centroids are left, and in a list of what is left afterwards."""
    n, k = len(vectors), len(centroids)
    every, best, done = np.arange(n), None, 0
    sums, rows, cents = np.zeros((n, k), vectors.dtype), None, None
    for stop in STOPS:
        if rows is None:
            for j in range(done, stop):
                away = vectors[:, j, None] - centroids[:, j]
                sums += away * away
            lead, least = sums.argmin(axis=1), sums.min(axis=1)
        else:
            away = vectors[rows, done:stop] - centroids[cents, done:stop]
            sums = sums + (away * away).sum(axis=1)
            places = _first_least(sums, starts, rows)
            lead, least = cents[places], sums[places]
        done = stop
        if stop == WIDTH:
            return lead, least // WIDTH
        rest = vectors[:, stop:] - centroids[lead, stop:]
        full = least + (rest * rest).sum(axis=1)
        best = full if best is None else np.minimum(best, full)
        if rows is None:
            alive = (sums <= best[:, None]).astype(bool)
            if 4 * np.count_nonzero(alive) > n * k:
                continue
            rows, cents = np.nonzero(alive)
            sums = sums[rows, cents]
        else:
            alive = (sums <= best[rows]).astype(bool)
            rows, cents, sums = rows[alive], cents[alive], sums[alive]
        starts = np.searchsorted(rows, every)
    raise AssertionError("the last stop is the width")


def nearest(vectors: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(centroid, squared distance) of each row, both given by coefficients; of several nearest the smallest number.

    Beyond the range where 64 bits hold every sum, the same steps run on Python's whole numbers.
    """
    if max(np.abs(vectors).max(initial=0), np.abs(centroids).max(initial=0)) > EXACT:
        vectors, centroids = vectors.astype(object), centroids.astype(object)
    parts = [_search(vectors[i : i + ROWS], centroids) for i in range(0, len(vectors), ROWS)]
    return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, WIDTH)


def _rows_of(matrix: np.ndarray) -> pa.Array:
    return pa.FixedSizeListArray.from_arrays(pa.array(matrix.reshape(-1)), WIDTH).cast(pa.list_(pa.int64()))


def kept_vectors(table: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """vec_id and the whole-numbered vector of every row that has exactly 64 finite components."""
    x = F.col(f"`{vector_col}`").cast("array<double>")
    odd = F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == F.lit(float("inf"))))
    bound = F.lit(float(LIMIT))
    whole = F.transform(x, lambda v: F.floor(F.greatest(F.least(v * SCALE, bound), -bound)).cast("bigint"))
    return table.where((F.size(x) == WIDTH) & ~odd).select(F.col(f"`{id_col}`").alias("vec_id"), whole.alias("x"))


def _transformed(vectors: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            coefs = _rows_of(coefficients(_matrix(batch.column(1))))
            yield pa.RecordBatch.from_arrays([batch.column(0), coefs], names=["vec_id", "coefs"])

    id_type = vectors.schema["vec_id"].dataType.simpleString()
    return vectors.mapInArrow(run, f"vec_id {id_type}, coefs ARRAY<BIGINT>")


def _moved(points: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """Centroids after one round: floor of the mean of their vectors, per component; centroids without vectors stay."""
    k = len(centroids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, sums, counts = coefficients(centroids), np.zeros((2, k, WIDTH), np.int64), np.zeros(k, np.int64)
        for batch in batches:
            vectors = _matrix(batch.column(0))
            cluster, _ = nearest(vectors, own)
            counts += np.bincount(cluster, minlength=k)
            np.add.at(sums[0], cluster, vectors >> 32)  # two halves: sums of either stay within 64 bits
            np.add.at(sums[1], cluster, vectors & 0xFFFFFFFF)
        used = np.flatnonzero(counts)
        columns = [pa.array(used.astype(np.int32)), pa.array(counts[used]), _rows_of(sums[0, used]), _rows_of(sums[1, used])]
        yield pa.RecordBatch.from_arrays(columns, names=["cluster", "n", "high", "low"])

    parts = points.select("coefs").mapInArrow(run, "cluster INT, n BIGINT, high ARRAY<BIGINT>, low ARRAY<BIGINT>")

    def total(half: str) -> F.Column:
        return F.array(*[F.sum(F.col(half)[i].cast("decimal(20,0)")) for i in range(WIDTH)]).alias(half)

    moved = centroids.astype(object)
    for r in parts.groupBy("cluster").agg(F.sum("n").alias("n"), total("high"), total("low")).collect():  # k rows
        coefs = np.array([[(int(h) << 32) + int(low) for h, low in zip(r["high"], r["low"], strict=True)]], dtype=object)
        moved[r["cluster"]] = components(coefs)[0] // r["n"]
    return moved.astype(np.int64)


def clusters(
    table: DataFrame, k: int = 40, rounds: int = 5, id_col: str = "vec_id", vector_col: str = "embedding"
) -> DataFrame:
    """One row per kept vector: vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256.

    Vectors that are null, have another number of components than 64, or a null or non-finite component are left out. A
    component x counts as floor(256 x), saturated at +-2**56. The k kept vectors with the smallest SHA-256 of `2:` and
    the identifier are the first centroids (rows with equal hashes by their vectors; a null identifier counts as empty;
    with fewer than k vectors all of them). Each round assigns all vectors to the nearest centroid, the smaller number
    among equals, and moves centroids to the floor of the mean; then all are assigned once more. Repeated rows count as
    often as they occur. Distances and inertias that do not fit in 64 bits are null. No vectors give no rows.
    """
    points = materialize(_transformed(kept_vectors(table, id_col, vector_col)))
    name = F.sha2(F.concat(F.lit("2:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    seeds = points.select("coefs", name.alias("_name")).orderBy("_name", "coefs").limit(k).collect()  # k rows
    spark, id_type = table.sparkSession, points.schema["vec_id"].dataType.simpleString()
    centroids = components(np.array([r["coefs"] for r in seeds], dtype=np.int64).reshape(-1, WIDTH))
    for _ in range(rounds if seeds else 0):
        centroids = _moved(points, centroids)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = coefficients(centroids)
        for batch in batches:
            if batch.num_rows:
                cluster, distance = nearest(_matrix(batch.column(1)), own)
                fitting = [int(d) if d <= LONG else None for d in distance]
                columns = [batch.column(0), pa.array(cluster.astype(np.int32)), pa.array(fitting, pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, names=["vec_id", "cluster", "distance"])

    assigned = materialize(points.mapInArrow(assign, f"vec_id {id_type}, cluster INT, distance BIGINT"))
    sums = assigned.groupBy("cluster").agg(
        F.sum(F.col("distance").cast("decimal(20,0)")).alias("s"), F.count_if(F.col("distance").isNull()).alias("odd")
    )
    found = {r["cluster"]: None if r["odd"] else int(r["s"]) for r in sums.collect()}  # k rows
    whole = None if None in found.values() else sum(found.values())
    rows = [
        (c, _fitting(found[c]), _fitting(whole), sha256(",".join(map(str, centroids[c].tolist())).encode()).hexdigest())
        for c in sorted(found)
    ]
    heads = spark.createDataFrame(rows, "cluster INT, cluster_inertia BIGINT, inertia BIGINT, centroid_sha256 STRING")
    return assigned.join(F.broadcast(heads), "cluster").select("vec_id", "cluster", "distance", *heads.columns[1:])


def _fitting(number: int | None) -> int | None:
    return number if number is not None and number <= LONG else None
