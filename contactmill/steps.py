"""The analysis from contact files to metacell maps, as steps on a Study."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from contactmill.functions.vectors import l2_normalize
from contactmill.operators import balance as balancing
from contactmill.operators import binning, evaluate as scoring, graph, insulation, maps, model, pipeline, stats
from contactmill.session import materialize
from contactmill.sources import pairs, stores
from contactmill.study import Study

# ---- from files to views -------------------------------------------------------------------------------------------


def process_and_load(
    spark: SparkSession,
    data_dir: str,
    output_dir: str,
    genome_reference_path: str,
    chrom_list: Sequence[str],
    resolutions: Sequence[int],
    scaler_data: bool | Sequence[bool] = True,
    n_components: int | float = 0.75,
    force_process: bool = True,
) -> Study:
    """Contacts, depths, pixels and views of a directory of contact files; views already stored are reused unless forced."""
    if not resolutions:
        raise ValueError("resolutions must not be empty")
    genome = pairs.read_chrom_sizes(spark, genome_reference_path, list(chrom_list))
    contacts, cells = pairs.load_cells(spark, data_dir)
    contacts, cells = materialize(contacts), materialize(cells)
    cells = cells.join(stats.cell_depth(contacts, cells), "cell_id")
    ordered = tuple(sorted(resolutions))
    path = f"{output_dir}/views"
    stored = None if force_process else stores.read_views(spark, path)
    have = set() if stored is None else {r["resolution"] for r in stored.select("resolution").distinct().collect()}
    pixels, views = {}, {}
    scales = {r: scaler_data if isinstance(scaler_data, bool) else scaler_data[i] for i, r in enumerate(resolutions)}
    for resolution in ordered:
        pixels[resolution] = materialize(binning.cis_pixels(contacts, genome, resolution))
        if resolution not in have:
            table = pipeline.cell_features(pixels[resolution], cells, genome, resolution)
            components, _ = pipeline.view_of(table, scales[resolution], n_components)
            stores.write_views(components, resolution, path)
        views[resolution] = stores.read_views(spark, path).where(F.col("resolution") == resolution).drop("resolution")
    return Study(genome, ordered, cells, contacts, pixels, views)


def cal_is(study: Study, resolution: int = 50_000, window: int = 6) -> Study:
    """Insulation scores of all cells at one of the study's resolutions."""
    if resolution not in study.pixels:
        raise ValueError(f"no pixels at resolution {resolution}")
    scores = insulation.insulation_scores(
        study.pixels[resolution], study.cells.select("cell_id"), study.genome, resolution, window
    )
    return study.having(insulation={**study.insulation, resolution: scores})


# ---- metacells ------------------------------------------------------------------------------------------------------


def recommend_metacell_num(
    study: Study,
    target_depth_min: float = 20e6,
    target_depth_max: float = 40e6,
    resolution_param: float = 2.0,
    n_neighbors: int = 15,
    ref_view: int = 1_000_000,
) -> tuple[int, int]:
    """Range of K from the depth of graph communities."""
    view = study.views[ref_view]
    edges = graph.adaptive_kernel(view, n_neighbors, "union").select("i", "j", "w").union(graph.coincident_edges(view))
    found = graph.communities(edges, resolution_param)
    clustered = study.cells.join(found.select(F.col("node").alias("cell_id"), F.col("label").alias("cluster")), "cell_id")
    total = stats.recommend_total(stats.recommend_per_cluster(clustered, target_depth_min, target_depth_max)).first()
    return total["min_k"], total["max_k"]


def unit_views(study: Study) -> DataFrame:
    """All views with unit rows, numbered by resolution."""
    tables = [
        v.select(F.lit(i).cast("long").alias("view_id"), "cell_id", l2_normalize(F.col("features")).alias("features"))
        for i, (_, v) in enumerate(sorted(study.views.items()))
    ]
    return materialize(reduce(DataFrame.unionByName, tables))


def initialize_waypoints(
    study: Study, settings: model.Settings, seed: int = 32, n_micro_clusters: int | None = None
) -> model.State:
    """Kernels, waypoints and starting matrices; as many micro-clusters as metacells unless given."""
    return model.initialize(unit_views(study), settings, seed, n_micro_clusters or settings.n_metacells)


def fit(study: Study, settings: model.Settings, state: model.State | None = None, seed: int = 32) -> Study:
    """Fit the model, label the cells from 1 on, and sum up each metacell."""
    state = model.fit(state or initialize_waypoints(study, settings, seed), settings)
    cells = materialize(study.cells.drop("metacell").join(model.hard_labels(state.A), "cell_id"))
    table = stats.metacell_depths(cells)
    if "label" in cells.columns:
        table = table.join(stats.dominant_labels(cells), "metacell")
    return study.having(cells=cells, metacells=table, notes={**study.notes, "losses": state.losses})


def evaluate(study: Study, label: str = "label") -> tuple[DataFrame, DataFrame, Study]:
    """(scores per metacell, one-row summary, study whose metacells carry depths and scores)."""
    labelled = study.cells.withColumn("label", F.col(label))
    scores = scoring.metacell_scores(labelled)
    table = scores if study.metacells is None else scoring.with_scores(study.metacells, scores)
    return scores, scoring.summary(labelled), study.having(metacells=table)


def sweep(study: Study, ks: Sequence[int], seed: int = 32, **settings: Any) -> DataFrame:
    """Summary of one fit per K."""
    rows = []
    for k in ks:
        fitted = fit(study, model.Settings(n_metacells=k, **settings), seed=seed)
        rows.append(materialize(evaluate(fitted)[1].select(F.lit(k).alias("k"), "*")))
    return reduce(DataFrame.unionByName, rows)


# ---- metacell maps --------------------------------------------------------------------------------------------------


def aggregate_metacell_pairs(
    study: Study,
    output_dir: str,
    resolution: int,
    mcool_resolutions: Sequence[int] = (),
    force_aggregate: bool = False,
    write_pairs: bool = True,
    one_based: bool = False,
) -> Study:
    """Metacell maps from all contacts at a base resolution and its multiples, kept in stores under output_dir.

    A second run rebuilds only the metacells whose members changed. The study's `pair` maps are those inside
    chromosomes, `pair_all` hold the trans pixels too (chrom_ord2).
    """
    spark = study.cells.sparkSession
    levels = sorted({resolution, *(mcool_resolutions or study.resolutions)})
    done = stores.refresh_metacell_pixels(
        study.contacts, study.cells, study.genome, resolution, output_dir, force_aggregate, levels, one_based
    )
    if write_pairs and done != "skipped":
        stores.write_merged_pairs(stores.merged_pairs(study.contacts, study.cells), f"{output_dir}/pairs")
    stores.write_bins(spark, study.genome, resolution, f"{output_dir}/bins")
    found = dict(study.maps)
    for level in levels:
        table = stores.read_metacell_pixels(spark, f"{output_dir}/pixels", "pair", level)
        found[("pair", level)], found[("pair_all", level)] = maps.cis_maps(table), table
    return study.having(maps=found)


def aggregate_metacell_mat(study: Study) -> Study:
    """Sums of per-cell maps without each map's lowest fifth of values, at every resolution."""
    made = {("mat", r): maps.filtered_metacell_maps(p, study.cells) for r, p in study.pixels.items()}
    return study.having(maps={**study.maps, **made})


def aggregate_metacell_mat_consensus(study: Study, target_sum: float = 1e5) -> Study:
    """Sums of log-scaled per-cell maps of equal weight, at every resolution."""
    made = {("mat_consensus", r): maps.consensus_maps(p, study.cells, target_sum) for r, p in study.pixels.items()}
    return study.having(maps={**study.maps, **made})


def balance_metacells(study: Study, resolution: int, **options: Any) -> Study:
    """Balancing weights at one resolution, trans contacts included; metacells that have weights already are left alone."""
    if ("pair_all", resolution) not in study.maps:
        raise ValueError(f"no metacell maps at resolution {resolution}; run aggregate_metacell_pairs first")
    weights = balancing.balance(
        study.maps[("pair_all", resolution)], study.genome, resolution, existing=study.weights.get(resolution), **options
    )
    return study.having(weights={**study.weights, resolution: weights})


# ---- region tables --------------------------------------------------------------------------------------------------


def metacell_regions(
    study: Study,
    chrom: str,
    start: int,
    end: int,
    resolution: int,
    metacells: Sequence[int] | None = None,
    cell_type: str | None = None,
    balance: bool = True,
    base_on: str = "pair",
    log1p: bool = True,
    fill_diagonal_zero: bool = True,
    observed_expected: bool = False,
) -> DataFrame:
    """Dense region of one, several, one type's, or all metacells; optionally observed over expected."""
    if base_on not in ("pair", "mat", "mat_consensus"):
        raise ValueError("base_on must be pair, mat or mat_consensus")
    if (base_on, resolution) not in study.maps:
        raise ValueError(f"no {base_on} maps at resolution {resolution}")
    keys = study.cells.select("metacell").distinct()
    if metacells is not None:
        keys = keys.where(F.col("metacell").isin(list(metacells)))
    if cell_type is not None:
        keys = keys.join(stats.dominant_labels(study.cells).where(F.col("dominant_label") == cell_type), "metacell", "left_semi")
    weights = None
    if balance and base_on == "pair":
        if resolution not in study.weights:
            raise ValueError(f"no balancing weights at resolution {resolution}; run balance_metacells first")
        weights = study.weights[resolution]
    plain = observed_expected
    table = maps.region_map(
        study.maps[(base_on, resolution)], keys, study.genome, chrom, start, end, resolution,
        symmetric=base_on != "pair", weights=weights,
        log1p=log1p and not plain, zero_diagonal=fill_diagonal_zero and not plain,
    )
    return _enhanced(study, table, ["metacell"], chrom, start, end, resolution) if plain else table


def cell_region(
    study: Study,
    cell_id: int,
    chrom: str,
    start: int,
    end: int,
    resolution: int,
    log1p: bool = True,
    fill_diagonal_zero: bool = True,
    observed_expected: bool = False,
) -> DataFrame:
    """Dense region of one cell."""
    key = study.cells.where(F.col("cell_id") == cell_id).select("cell_id")
    plain = observed_expected
    table = maps.region_map(
        study.pixels[resolution], key, study.genome, chrom, start, end, resolution,
        double_diagonal=True, log1p=log1p and not plain, zero_diagonal=fill_diagonal_zero and not plain,
    )
    return _enhanced(study, table, ["cell_id"], chrom, start, end, resolution) if plain else table


def _enhanced(study: Study, table: DataFrame, keys: list[str], chrom: str, start: int, end: int, resolution: int) -> DataFrame:
    _, first, stop = maps.region_bounds(study.genome, chrom, start, end, resolution)
    local = table.withColumns({"bin1": F.col("bin1") - first, "bin2": F.col("bin2") - first})
    out = maps.observed_over_expected(local, keys, stop - first)
    return out.withColumns({"bin1": F.col("bin1") + first, "bin2": F.col("bin2") + first})
