"""Linear algebra on arrays per cell and on long sparse tables.

Only matrices whose size is set by the number of components (Gram matrices) reach the driver.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from contactmill.functions.vectors import array_sum, scaled
from contactmill.operators.tiles import check_gram_size, components, randomized_svd

EXACT_WIDTH = 4096  # columns up to which the whole covariance goes to the driver


def gram(df: DataFrame, key: str, left: str, right: str) -> dict[int, np.ndarray]:
    """sum over rows of outer(left, right) per key value; one partial matrix per task and key, then a sum in Spark."""

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[int, np.ndarray] = {}
        for pdf in batches:
            for k, part in pdf.groupby(key):
                x, y = np.stack(part[left].to_numpy()), np.stack(part[right].to_numpy())
                sums[k] = sums.get(k, 0.0) + x.T @ y
        for k, m in sums.items():
            yield pd.DataFrame({"key": k, "row": np.arange(len(m)), "values": list(m)})

    columns = list(dict.fromkeys([key, left, right]))
    parts = df.select(*columns).mapInPandas(partial, "key LONG, row LONG, values ARRAY<DOUBLE>")
    rows = parts.groupBy("key", "row").agg(array_sum(F.col("values")).alias("values")).toLocalIterator()
    found: dict[int, dict[int, list[float]]] = {}
    for r in rows:  # width rows per key
        found.setdefault(r["key"], {})[r["row"]] = r["values"]
    return {k: np.array([m[i] for i in sorted(m)]) for k, m in found.items()}


def concat_blocks(blocks: DataFrame, row: str, order: Sequence[str], column: str) -> DataFrame:
    """Arrays of one row joined end to end in the order of `order` (as many blocks as the genome has parts)."""
    packed = F.array_sort(F.collect_list(F.struct(*order, column)))
    return blocks.groupBy(row).agg(F.flatten(F.transform(packed, lambda b: b[column])).alias("features"))


def column_moments(df: DataFrame, column: str = "features") -> tuple[Column, Column]:
    """Per-dimension mean and population deviation, as one-row lookups."""
    summed = Summarizer.metrics("mean", "variance", "count").summary(F.col("v"))
    stats = df.select(array_to_vector(column).alias("v")).agg(summed.alias("s"))
    n = F.col("s.count")
    # MLlib divides by n - 1
    sd = F.transform(vector_to_array("s.variance"), lambda v: F.sqrt(v * (n - 1) / n))
    return stats.select(vector_to_array("s.mean")).scalar(), stats.select(sd).scalar()


def standardize(df: DataFrame, column: str = "features") -> DataFrame:
    """Each dimension to mean 0 and population deviation 1; constant dimensions only lose their mean."""
    mean, sd = column_moments(df, column)
    moved = df.withColumns({"_mean": mean, "_sd": sd})
    centred = F.zip_with(column, "_mean", lambda x, m: x - m)
    return moved.withColumn(
        column, F.zip_with(centred, F.col("_sd"), lambda x, s: F.when(s > 0, x / s).otherwise(x))
    ).drop("_mean", "_sd")


def standardize_all(df: DataFrame, column: str = "features") -> DataFrame:
    """One mean and one population deviation over all entries of all rows."""
    sums = df.agg(
        F.sum(F.aggregate(column, F.lit(0.0), lambda s, x: s + x)).alias("s"),
        F.sum(F.aggregate(column, F.lit(0.0), lambda s, x: s + x * x)).alias("ss"),
        F.sum(F.size(column)).alias("n"),
    )
    mean = F.col("s") / F.col("n")
    sd = F.sqrt(F.greatest(F.col("ss") / F.col("n") - mean * mean, F.lit(0.0)))
    m, d = sums.select(mean).scalar(), sums.select(sd).scalar()
    moved = df.withColumns({"_m": m, "_d": d})
    return moved.withColumn(
        column,
        F.transform(column, lambda x: F.when(F.col("_d") > 0, (x - F.col("_m")) / F.col("_d")).otherwise(x - F.col("_m"))),
    ).drop("_m", "_d")


def principal_components(
    df: DataFrame, keep: int | float, column: str = "features", key: str = "cell_id"
) -> DataFrame:
    """Centred projection on the leading components: a number of them, or as many as exceed a variance share.

    Wide rows are decomposed in tiles, without a covariance of all columns.
    """
    width = df.select(F.max(F.size(column))).first()[0]
    if width > EXACT_WIDTH:
        one = F.lit(0).cast("long").alias("part")
        keyed = df.select(F.xxhash64(key).alias("row"), F.col(key), column)
        entries = keyed.select(one, "row", F.posexplode(column).alias("col", "value")).where(F.col("value") != 0)
        rows = keyed.select(one, "row")
        found = components(entries.withColumn("col", F.col("col").cast("long")), rows, keep).select("row", F.col("scores").alias(column))
        return keyed.select("row", key).join(found, "row").select(key, column)
    mean, _ = column_moments(df, column)
    centred = df.withColumn("_mean", mean).select(
        key, array_to_vector(F.zip_with(column, "_mean", lambda x, m: x - m)).alias("_v")
    )
    whole = isinstance(keep, int)
    model = PCA(k=min(keep, width) if whole else width, inputCol="_v", outputCol="_p").fit(centred)
    if whole:
        n = min(keep, width)
    else:
        n = int(np.searchsorted(np.cumsum(model.explainedVariance.toArray()), keep, side="right")) + 1
        n = min(n, width)
    return model.transform(centred).select(key, F.slice(vector_to_array("_p"), 1, n).alias(column))


def shift_non_negative(df: DataFrame, column: str = "features") -> DataFrame:
    """Add |smallest entry| to every entry when the smallest is negative."""
    low = df.select(F.min(F.array_min(column))).scalar()
    return df.withColumn("_low", F.least(low, F.lit(0.0))).withColumn(
        column, F.transform(column, lambda x: x - F.col("_low"))
    ).drop("_low")


def pseudo_counts(df: DataFrame, column: str = "features", top: float = 1000.0) -> DataFrame:
    """Entries moved to start at 0 and scaled so that the largest is `top`."""
    low = df.select(F.min(F.array_min(column))).scalar()
    high = df.select(F.max(F.array_max(column))).scalar()
    moved = df.withColumns({"_low": low, "_span": high - low})
    return moved.withColumn(
        column, F.transform(column, lambda x: (x - F.col("_low")) / F.col("_span") * F.lit(top))
    ).drop("_low", "_span")


def target_count(counts: DataFrame, k: int, column: str = "features") -> DataFrame:
    """Total pseudo count and its integer share per metacell for a wanted K."""
    total = F.sum(F.aggregate(column, F.lit(0.0), lambda s, x: s + x))
    return counts.agg(total.alias("total")).withColumn("target", F.floor(F.col("total") / k))


def regress_out(df: DataFrame, covariate: str, column: str = "features", key: str = "cell_id") -> DataFrame:
    """Residuals of each dimension after a linear fit on one covariate with intercept."""
    long = df.select(covariate, F.posexplode(column).alias("pos", "y"))
    x = F.col(covariate)
    fits = long.groupBy("pos").agg(
        F.avg(x).alias("mx"), F.avg("y").alias("my"), F.covar_pop(x, F.col("y")).alias("cxy"), F.var_pop(x).alias("vx")
    )
    slope = F.coalesce(F.try_divide("cxy", "vx"), F.lit(0.0))
    # one row per dimension, packed into a single array
    packed = fits.agg(
        F.array_sort(F.collect_list(F.struct("pos", slope.alias("slope"), "mx", "my")))
    ).scalar()
    fitted = df.withColumn("_fit", packed)
    return fitted.withColumn(
        column,
        F.zip_with(column, "_fit", lambda y, f: y - f["my"] - f["slope"] * (F.col(covariate) - f["mx"])),
    ).drop("_fit")
