"""The tables behind heatmap and layout views."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from contactmill.functions.vectors import squared_distance


def layout_table(views: DataFrame, cells: DataFrame, scores: DataFrame) -> DataFrame:
    """Every view's first two features with true label, metacell, and the metacell's dominant label."""
    placed = views.select(
        "view_id", "cell_id", F.element_at("features", 1).alias("x"), F.element_at("features", 2).alias("y")
    )
    predicted = scores.select("metacell", F.col("cell_type").alias("predicted"))
    return (
        placed.join(cells, "cell_id")
        .join(predicted, "metacell", "left")
        .withColumn("agrees", F.col("label") == F.col("predicted"))
    )


def highlight_metacell(layout: DataFrame, cells: DataFrame, metacell: int) -> DataFrame:
    """All cells of a layout, members of one metacell marked, with that metacell's centre."""
    placed = layout.join(cells.select("cell_id", "metacell"), "cell_id")
    members = placed.where(F.col("metacell") == metacell)
    return placed.select(
        "cell_id", (F.col("metacell") == metacell).alias("member"), "x", "y",
        members.select(F.avg("x")).scalar().alias("centre_x"),
        members.select(F.avg("y")).scalar().alias("centre_y"),
    )


def nearest_to_centres(points: DataFrame, centres: DataFrame, keys: list[str]) -> DataFrame:
    """Per group, the member nearest its centre; `points` has keys, cell_id, features, `centres` keys, centre."""
    away = squared_distance(F.col("features"), F.col("centre"))
    near = F.min_by("cell_id", F.struct(away.alias("d"), F.col("cell_id")))
    return points.join(centres, keys).groupBy(*keys).agg(near.alias("cell_id"))


def flag_waypoints(layout: DataFrame, waypoints: DataFrame) -> DataFrame:
    """Layout rows with a mark on the chosen waypoint cells."""
    marked = waypoints.select("cell_id", F.lit(True).alias("_w")).distinct()
    return layout.join(marked, "cell_id", "left").select(
        *layout.columns, F.coalesce("_w", F.lit(False)).alias("is_waypoint")
    )
