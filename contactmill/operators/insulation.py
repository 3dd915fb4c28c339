"""Operators along the genomic axis: insulation, boundaries, smoothing."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from contactmill.genome import Genome


def insulation_scores(
    pixels: DataFrame, owners: DataFrame, genome: Genome, resolution: int, window: int = 6, normalize: bool = True,
    owner: str = "cell_id",
) -> DataFrame:
    """Insulation of every bin of every owner (cell or metacell): the sum of the w x w square up-left of the diagonal.

    Only pixels nearer than 2w touch a square. Such a pixel lies in the squares of consecutive bins, so it is two steps of
    a curve, up and down, whatever w is; the steps of one owner and chromosome meet once, and their running sum holds
    every square until the next step. Bins closer than w to a chromosome end have no score, unless the whole chromosome is
    empty, which scores 0 everywhere. Owners without pixels have their bins too; pixels of other owners do not count.
    """
    w = window
    n = genome.n_bins(F.col("chrom_ord"), resolution)
    near = pixels.where((F.col("bin2") > F.col("bin1")) & (F.col("bin2") - F.col("bin1") < 2 * w))
    first = F.greatest(F.col("bin1") + 1, F.col("bin2") - w + 1, F.lit(w).cast("long"))
    last = F.least(F.col("bin2"), F.col("bin1") + w, n - w - 1)
    value = F.col("value").cast("double")
    up, down = (F.struct(at.cast("long").alias("bin"), by.alias("step")) for at, by in ((first, value), (last + 1, -value)))
    steps = near.where(first <= last).select(owner, "chrom_ord", F.lit(False).alias("asked"), F.inline(F.array(up, down)))
    starts = owners.select(
        owner, F.explode(F.sequence(F.lit(0), F.lit(len(genome.chroms) - 1))).alias("chrom_ord"),
        F.lit(True).alias("asked"), F.lit(0).cast("long").alias("bin"), F.lit(0.0).alias("step"),
    )
    # a group is one curve: its steps are fewer than the bins of a chromosome
    curve = [owner, "chrom_ord"]
    placed = steps.unionByName(starts).repartition(*curve).groupBy(*curve, "bin").agg(
        F.coalesce(F.sum("step"), F.lit(0.0)).alias("step"), F.max("asked").alias("asked")
    )
    along = Window.partitionBy(*curve).orderBy("bin")
    level = placed.withColumns({
        "square": F.sum("step").over(along.rowsBetween(Window.unboundedPreceding, Window.currentRow)),
        "stop": F.coalesce(F.lead("bin").over(along), n),
    })
    whole = Window.partitionBy(*curve)
    spans = level.withColumns({
        "_total": F.sum(F.col("square") * (F.col("stop") - F.col("bin"))).over(whole), "asked": F.max("asked").over(whole),
    }).where("asked")
    filled = spans.select(*curve, "square", "_total", F.explode(F.sequence(F.col("bin"), F.col("stop") - 1)).alias("bin"))
    count = n - 2 * w
    square = F.when((count > 0) & F.col("bin").between(F.lit(w), n - w - 1), F.col("square"))
    if not normalize:
        return filled.select(*curve, "bin", square.alias("score"))
    mean = F.col("_total") / F.greatest(count, F.lit(1).cast("long"))
    score = (
        F.when(count <= 0, F.lit(None).cast("double"))
        .when(mean > 0, F.log2(square / mean + F.lit(1e-5)))
        .otherwise(F.lit(0.0))
    )
    return filled.select(*curve, "bin", score.alias("score"))


def _peaks(values: np.ndarray, distance: int, prominence: float) -> np.ndarray:
    """Local maxima (plateaus by their middle), thinned to a minimum distance by height, then by prominence."""
    n = len(values)
    if n < 3:
        return np.empty(0, dtype=np.int64)
    starts = np.flatnonzero(np.r_[True, values[1:] != values[:-1]])
    ends = np.r_[starts[1:], n] - 1
    inner = (starts > 0) & (ends < n - 1)
    s, e = starts[inner], ends[inner]
    rise = (values[s] > values[s - 1]) & (values[e] > values[e + 1])
    peaks = (s[rise] + e[rise]) // 2
    keep = np.ones(len(peaks), dtype=bool)
    for i in np.argsort(values[peaks], kind="stable")[::-1]:
        if keep[i]:
            near = np.abs(peaks - peaks[i]) < distance
            near[i] = False
            keep[near] = False
    strong = []
    for p in peaks[keep]:
        higher_left = np.flatnonzero(values[:p] > values[p])
        higher_right = np.flatnonzero(values[p + 1 :] > values[p])
        left = higher_left[-1] + 1 if len(higher_left) else 0
        right = p + higher_right[0] if len(higher_right) else n - 1
        base = max(values[left : p + 1].min(), values[p : right + 1].min())
        if values[p] - base >= prominence:
            strong.append(p)
    return np.asarray(strong, dtype=np.int64)


def tad_boundaries(
    scores: DataFrame, window: int = 5, min_prominence: float = 0.1, owner: str = "metacell"
) -> DataFrame:
    """Bins that are prominent local minima of the score. A group is one chromosome's bins, fixed by the genome."""
    schema = f"{owner} LONG, chrom_ord INT, bin LONG, score DOUBLE"

    def pick(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("bin")
        return pdf.iloc[_peaks(-pdf["score"].to_numpy(), window, min_prominence)]

    return (
        scores.where(F.col("score").isNotNull())
        .select(F.col(owner).cast("long").alias(owner), F.col("chrom_ord").cast("int").alias("chrom_ord"), "bin", "score")
        .groupBy(owner, "chrom_ord")
        .applyInPandas(pick, schema)
    )


def reflect(position: Column, n: Column) -> Column:
    """Index mirrored at both ends with the edge repeated (d c b a | a b c d | d c b a)."""
    turn = F.pmod(position, n * 2)
    return F.least(turn, n * 2 - 1 - turn)


def gaussian_taps(sigma: float, radius: int) -> list[float]:
    raw = [math.exp(-0.5 * (i / sigma) ** 2) for i in range(-radius, radius + 1)]
    total = sum(raw)
    return [x / total for x in raw]


def gaussian_smooth(
    curve: DataFrame, keys: Sequence[str], position: str, value: str, n: int, sigma: float = 3.0, truncate: float = 4.0
) -> DataFrame:
    """Gaussian filter of a complete curve over positions 0..n-1, mirrored at the ends.

    Each point sends its weighted value to the positions whose mirrored window reaches it: position i receives
    sum_o tap(o) * x[reflect(i + o)], and one aggregate adds up what arrives.
    """
    radius = int(truncate * sigma + 0.5)
    taps = gaussian_taps(sigma, radius)
    length = F.lit(n).cast("long")
    offsets = F.array(*[F.struct(F.lit(o).cast("long").alias("o"), F.lit(t).alias("t")) for o, t in zip(range(-radius, radius + 1), taps)])
    targets = curve.select(*keys, F.col(position).alias("_at")).select(*keys, "_at", F.explode(offsets).alias("_s"))
    sources = targets.select(
        *keys, "_at", F.col("_s.t").alias("_tap"), reflect(F.col("_at") + F.col("_s.o"), length).alias(position)
    )
    return (
        sources.join(curve, [*keys, position])
        .groupBy(*keys, F.col("_at").alias(position))
        .agg(F.sum(F.col("_tap") * F.col(value)).alias(value))
    )


def moving_average(pixels: DataFrame, keys: Sequence[str], n: Column, moving_range: int) -> DataFrame:
    """Row-wise Gaussian moving sum with repeated edge rows: pdf(0)*x[i] + sum_s pdf(s/r) * (x[i-s] + x[i+s]).

    Row b feeds rows b-s and b+s; an edge row also feeds every row whose window would leave the map there.
    """
    steps = 2 * moving_range

    def pdf(x: float) -> float:
        return math.exp(-0.5 * x * x) / math.sqrt(2 * math.pi)

    def moves(weights: dict[int, float]) -> Column:
        return F.array(*[F.struct(F.lit(s).cast("long").alias("s"), F.lit(t).alias("t")) for s, t in weights.items()])

    # rows i < s read row 0 above themselves, rows i > n-1-s read row n-1 below themselves
    beyond = {o: sum(pdf(s / moving_range) for s in range(o + 1, steps + 1)) for o in range(steps)}
    inside = {s: pdf(abs(s) / moving_range) for s in range(-steps, steps + 1)}
    top, bottom = F.col("bin1") == 0, F.col("bin1") == n - 1

    def with_edges(*signs: int) -> Column:
        return moves({s: t + sum(beyond.get(sign * s, 0.0) for sign in signs) for s, t in inside.items()})

    # pixels of a column meet before they multiply, so that sums need no shuffle of their own
    met = pixels.repartition(*keys, "bin2")
    each = F.when(top & bottom, with_edges(1, -1)).when(top, with_edges(1)).when(bottom, with_edges(-1)).otherwise(moves(inside))
    moved = met.select(*keys, "bin1", "bin2", "value", F.explode(each).alias("_s"))
    plain = moved.select(
        *keys, (F.col("bin1") + F.col("_s.s")).alias("bin1"), "bin2", (F.col("value") * F.col("_s.t")).alias("value")
    ).where((F.col("bin1") >= 0) & (F.col("bin1") < n))
    return plain.groupBy(*keys, "bin1", "bin2").agg(F.sum("value").alias("value"))


def complete_bins(scores: DataFrame, n_owners: Column) -> DataFrame:
    """Bins that have a score in every owner."""
    return (
        scores.groupBy("chrom_ord", "bin").agg(F.count("score").alias("_n")).where(F.col("_n") == n_owners).drop("_n")
    )


def rank_match(source: DataFrame, target: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Give `source` entries the sorted values of `target`, smallest to smallest.

    Both have keys, bin1, bin2, value and equally many rows per key; equal values follow (bin1, bin2).
    """
    from contactmill.scale import rank_within

    order = ["value", "bin1", "bin2"]
    ranked = rank_within(source.select(*keys, *order), list(keys), order, "_rank").drop("value")
    values = rank_within(target.select(*keys, *order), list(keys), order, "_rank").select(*keys, "_rank", "value")
    return ranked.join(values, [*keys, "_rank"]).select(*keys, "bin1", "bin2", "value")
