"""Scoring a grouping of cells against known labels."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def metacell_scores(cells: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Purity, size and size-adjusted score of each metacell; `keys` separate several groupings in one table.

    All sums start from one count per (metacell, label), so nothing later grows with the number of cells.
    """
    keys = list(keys)
    one = [*keys, "_all"]
    counted = cells.groupBy(*keys, "metacell", "label").agg(F.count(F.lit(1)).alias("n")).withColumn("_all", F.lit(0))
    groups = counted.groupBy(*one, "metacell").agg(
        F.min_by("label", F.struct(-F.col("n"), F.col("label"))).alias("cell_type"),
        F.max("n").alias("top"),
        F.sum("n").alias("cell_num"),
    )
    sizes = groups.groupBy(*one).agg(F.avg("cell_num").alias("_avg"))
    # labels first become distinct rows, so the count below is over labels, not cells
    kinds = counted.select(*one, "label").distinct().groupBy(*one).agg(F.count(F.lit(1)).alias("_kinds"))
    n, avg = F.col("cell_num"), F.col("_avg")
    purity = F.col("top") / n
    chance = 1.0 / F.col("_kinds")
    excess = F.greatest(F.lit(0.0), (n - 2 * avg) / avg)
    adjusted = F.greatest(F.lit(0.0), F.try_divide(purity - chance, 1 - chance))
    out = groups.join(sizes, one).join(kinds, one)
    return out.select(
        *keys,
        "metacell",
        "cell_type",
        purity.alias("purity"),
        "cell_num",
        F.when(n == 1, F.lit(0.0)).otherwise(1 - 1 / F.sqrt(n)).alias("w_min"),
        (1 / (1 + excess)).alias("w_max"),
        F.when(F.col("_kinds") > 1, adjusted).alias("p_adj"),
    ).withColumn("ep_v2", F.col("p_adj") * F.col("w_min") * F.col("w_max"))


def overmerging(scores: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """WCOS (one minus the worst share x impurity) and HWIS (one minus the sum of squared share x impurity)."""
    keys = list(keys)
    one = [*keys, "_all"]
    tagged = scores.withColumn("_all", F.lit(0))
    totals = tagged.groupBy(*one).agg(F.sum("cell_num").alias("_total"))
    share = F.col("cell_num") / F.col("_total")
    return (
        tagged.join(totals, one)
        .groupBy(*keys)
        .agg(
            (1 - F.max(share * (1 - F.col("purity")))).alias("wcos"),
            (1 - F.sum(share * share * (1 - F.col("purity")))).alias("hwis"),
        )
    )


def label_cells(cells: DataFrame, scores: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Each cell with its metacell's dominant label."""
    mapped = scores.select(*keys, "metacell", F.col("cell_type").alias("metacell_label"))
    return cells.join(mapped, [*keys, "metacell"], "left")


def summary(cells: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Mean purity, accuracy, size-weighted global score, WCOS and HWIS; one row per key."""
    keys = list(keys)
    scores = metacell_scores(cells, keys)
    # a cell is right when it carries its metacell's dominant label, so the right ones number purity x size
    core = scores.groupBy(*keys).agg(
        F.avg("purity").alias("mean_purity"),
        (F.sum(F.round(F.col("purity") * F.col("cell_num"))) / F.sum("cell_num")).alias("accuracy"),
        (F.sum(F.col("ep_v2") * F.col("cell_num")) / F.sum("cell_num")).alias("global_score"),
    )
    extra = overmerging(scores, keys)
    if keys:
        return core.join(extra, keys)
    one = F.lit(0).alias("_one")
    return core.select("*", one).join(extra.select("*", one), "_one").drop("_one")


def with_scores(metacells: DataFrame, scores: DataFrame) -> DataFrame:
    """Depth columns and score columns of each metacell side by side; scores it had before give way."""
    fresh = scores.drop("cell_type", "cell_num")
    return metacells.drop(*[c for c in fresh.columns if c != "metacell"]).join(fresh, "metacell", "left")
