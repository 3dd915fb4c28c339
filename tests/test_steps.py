"""From files on disk to metacell maps, on a small made-up experiment with two cell types."""

import gzip

import numpy as np
import pytest
from pyspark.sql import functions as F

from contactmill import steps, study_from_tables
from contactmill.genome import Genome
from contactmill.operators import model
from contactmill.sources import pairs, stores, tables
from contactmill.study import Study


@pytest.fixture(scope="module")
def experiment(tmp_path_factory):
    root = tmp_path_factory.mktemp("experiment")
    rng = np.random.default_rng(4)
    (root / "pairs").mkdir()
    for c in range(24):
        kind = "A" if c % 2 else "B"
        lines = ["## pairs format v1.0", "readID\tchrom1\tpos1\tchrom2\tpos2\tstrand1\tstrand2"]
        for r in range(300):
            chrom = f"chr{rng.integers(1, 3)}"
            p1 = int(rng.integers(0, 20_000_000))
            # one type keeps to its own half of each chromosome
            p1 = p1 // 2 + (10_000_000 if kind == "A" else 0)
            p2 = min(max(p1 + int(rng.normal(0, 3_000_000)), 0), 19_999_999)
            lines.append(f"r{r}\t{chrom}\t{p1}\t{chrom}\t{p2}\t+\t-")
        lines += ["broken line", "r\tchr1\tx\tchr1\t5"]
        name = f"cell{c:02d}_{kind}_x.pairs"
        text = "\n".join(lines) + "\n"
        if c % 3:
            (root / "pairs" / name).write_text(text)
        else:
            with gzip.open(root / "pairs" / f"{name}.gz", "wt") as f:
                f.write(text)
    (root / "pairs" / "notes.txt").write_text("not a cell")
    (root / "sizes.tsv").write_text("chr2\t20000000\nchr1\t20000000\nchrX\t5\n")
    return root


@pytest.fixture(scope="module")
def study(spark, experiment):
    return steps.process_and_load(
        spark, str(experiment / "pairs"), str(experiment / "out"), str(experiment / "sizes.tsv"), ["chr1", "chr2"], [500_000, 1_000_000]
    )


def test_files_to_cells(spark, study, experiment):
    cells = study.cells.toPandas().sort_values("cell_id")
    assert cells["cell_id"].tolist() == list(range(24))
    assert cells["cell_name"].is_monotonic_increasing and set(cells["label"]) == {"A", "B"}
    assert (cells["depth"] == 300).all()
    assert study.genome.names == ["chr1", "chr2"]
    with pytest.raises(ValueError):
        pairs.read_chrom_sizes(spark, str(experiment / "sizes.tsv"), ["chr9"])


def test_views_are_stored_and_reused(spark, study, experiment):
    again = steps.process_and_load(
        spark, str(experiment / "pairs"), str(experiment / "out"), str(experiment / "sizes.tsv"), ["chr1", "chr2"],
        [500_000, 1_000_000], force_process=False,
    )
    for r in (500_000, 1_000_000):
        assert study.views[r].count() == 24 and again.views[r].count() == 24


@pytest.fixture(scope="module")
def fitted(study):
    return steps.fit(study, model.Settings(n_metacells=4, max_iter=2, max_franke_wolfe_iters=10, n_neighbors=6, lambda_balance=0.0))


def test_fit_and_evaluate(fitted):
    scores, summary, scored = steps.evaluate(fitted)
    one = summary.first()
    assert one["accuracy"] > 0.75  # two types of equal size: chance is one half
    assert scored.metacells.select(F.sum("cell_count")).first()[0] == 24
    assert {"total_depth", "ep_v2"} <= set(scored.metacells.columns)


def test_recommend(study):
    low, high = steps.recommend_metacell_num(study, 600, 1800, n_neighbors=6, ref_view=1_000_000)
    assert 1 <= low <= high


def test_maps_balance_and_regions(fitted, experiment):
    out = str(experiment / "maps")
    s = steps.aggregate_metacell_pairs(fitted, out, 500_000, [1_000_000])
    s = steps.aggregate_metacell_mat_consensus(steps.aggregate_metacell_mat(s))
    s = steps.balance_metacells(s, 1_000_000, min_nnz=1, mad_max=0, max_iters=20)
    assert {"chrom_ord", "chrom_ord2"} <= set(s.maps[("pair_all", 1_000_000)].columns)
    for options in ({"base_on": "mat"}, {"base_on": "mat_consensus"}, {"balance": False}, {}, {"balance": False, "observed_expected": True}):
        table = steps.metacell_regions(s, "chr1", 0, 5_000_000, 1_000_000, **options)
        assert table.count() == 25 * s.cells.select("metacell").distinct().count()
        assert table.where(F.col("value").isNull()).isEmpty()
    assert steps.cell_region(s, 3, "chr2", 0, 3_000_000, 1_000_000).count() == 9
    assert steps.cal_is(s, 500_000, 3).insulation[500_000].count() == 24 * 80
    with pytest.raises(ValueError):
        steps.metacell_regions(s, "chr1", 0, 5_000_000, 500_000)


def test_balancing_step_sees_trans_pixels(spark):
    sizes = (3, 2, 2)
    genome = Genome(tuple((f"c{i}", 100 * n) for i, n in enumerate(sizes)))
    bins = [(c, b) for c, n in enumerate(sizes) for b in range(n)]
    rows = [(1, *p, *q, float(1 + (i + j) % 3)) for i, p in enumerate(bins) for j, q in enumerate(bins) if i <= j]
    maps = spark.createDataFrame(rows, "metacell LONG, chrom_ord INT, bin1 LONG, chrom_ord2 INT, bin2 LONG, value DOUBLE")
    s = Study(genome, (100,), None, None, {}, {}).having(maps={("pair_all", 100): maps})
    s = steps.balance_metacells(s, 100, min_nnz=1, mad_max=0, max_iters=5, trans_only=True)
    assert s.weights[100].where("weight IS NOT NULL").count() == len(bins)


def test_only_changed_metacells_are_rebuilt(spark, fitted, experiment):
    out = str(experiment / "refresh")
    args = (fitted.genome, 1_000_000, out)
    assert stores.refresh_metacell_pixels(fitted.contacts, fitted.cells, *args) == "rebuilt"
    assert stores.refresh_metacell_pixels(fitted.contacts, fitted.cells, *args) == "skipped"
    moved = fitted.cells.withColumn("metacell", F.when(F.col("cell_id") == 0, 99).otherwise(F.col("metacell")).cast("long"))
    assert stores.refresh_metacell_pixels(fitted.contacts, moved, *args) == "updated"
    got = stores.read_metacell_pixels(spark, f"{out}/pixels", "pair", 1_000_000).where("metacell = 99")
    assert got.select(F.sum("value")).first()[0] == fitted.contacts.where("cell_id = 0").count()


def store_totals(spark, out, level):
    table = stores.read_metacell_pixels(spark, f"{out}/pixels", "pair", level)
    return {r["metacell"]: r["n"] for r in table.groupBy("metacell").agg(F.sum("value").alias("n")).collect()}


def test_stores_forget_what_is_gone(spark, tmp_path):
    """Short and trans contacts count; a metacell that is dissolved, or has no contacts any more, leaves nothing behind."""
    genome = Genome((("chr1", 4000), ("chr2", 4000)))
    rows = [(c, "chr1", 100 * c, other, 100 * c + 700) for c in range(6) for other in ("chr1", "chr2")] + [(0, "chr1", 5, "chr9", 5)]
    rows = [r for r in rows if r[0] != 5]  # the last cell has none
    contacts = spark.createDataFrame(rows, "cell_id LONG, chrom1 STRING, pos1 LONG, chrom2 STRING, pos2 LONG")
    out, layout = str(tmp_path / "out"), "cell_id LONG, metacell LONG"
    groupings = [
        ([1, 1, 2, 2, 3, 3], {1: 4, 2: 4, 3: 2}, "rebuilt"),
        ([1, 1, 2, 2, 1, 3], {1: 6, 2: 4}, "updated"),  # metacell 3 keeps a cell without contacts
        ([1, 1, 1, 1, 1, 1], {1: 10}, "updated"),
    ]
    for labels, want, done in groupings:
        cells = spark.createDataFrame(list(enumerate(labels)), layout)
        assert stores.refresh_metacell_pixels(contacts, cells, genome, 1000, out, levels=[2000]) == done
        assert store_totals(spark, out, 1000) == store_totals(spark, out, 2000) == want
        stores.write_merged_pairs(stores.merged_pairs(contacts, cells), f"{out}/pairs")
        assert stores.read_merged_pairs(spark, f"{out}/pairs").count() == len(rows)
    assert stores.refresh_metacell_pixels(contacts, cells, genome, 1000, out, levels=[4000]) == "rebuilt"
    assert store_totals(spark, out, 4000) == {1: 10}


def test_a_run_that_dies_leaves_the_old_content(spark, tmp_path, monkeypatch):
    """Before the commit nothing that readers see changes; returning to the saved grouping then needs no work."""
    genome = Genome((("chr1", 4000),))
    contacts = spark.createDataFrame([(c, "chr1", 100 * c, "chr1", 100 * c + 700) for c in range(4)], "cell_id LONG, chrom1 STRING, pos1 LONG, chrom2 STRING, pos2 LONG")
    out, layout = str(tmp_path / "out"), "cell_id LONG, metacell LONG"
    one, two = (spark.createDataFrame(list(enumerate(labels)), layout) for labels in ([1, 1, 2, 2], [1, 3, 2, 2]))
    args = (genome, 1000, out)
    assert stores.refresh_metacell_pixels(contacts, one, *args, levels=[2000]) == "rebuilt"

    class Died(Exception):
        pass

    def die(*a, **k):
        raise Died

    with monkeypatch.context() as patch:
        patch.setattr(stores.CommitLog, "commit", die)
        with pytest.raises(Died):
            stores.refresh_metacell_pixels(contacts, two, *args, levels=[2000])
        with pytest.raises(Died):
            stores.write_merged_pairs(stores.merged_pairs(contacts, two), f"{out}/pairs")
    for level in (1000, 2000):
        assert store_totals(spark, out, level) == {1: 2, 2: 2}
    assert stores.refresh_metacell_pixels(contacts, one, *args, levels=[2000]) == "skipped"
    assert store_totals(spark, out, 1000) == {1: 2, 2: 2}
    for done in ("updated", "skipped"):
        assert stores.refresh_metacell_pixels(contacts, two, *args, levels=[2000]) == done
        assert store_totals(spark, out, 1000) == store_totals(spark, out, 2000) == {1: 1, 2: 2, 3: 1}
    folders = list((tmp_path / "out/pixels/source=pair/resolution=1000").glob("version=*"))
    assert len(folders) == 2, "what the run that died has written is gone"
    # another base resolution in the same store keeps its own allocation
    assert stores.refresh_metacell_pixels(contacts, one, genome, 500, out) == "rebuilt"
    assert store_totals(spark, out, 500) == {1: 2, 2: 2} and store_totals(spark, out, 1000) == {1: 1, 2: 2, 3: 1}
    assert stores.refresh_metacell_pixels(contacts, two, *args, levels=[2000]) == "skipped"


def test_two_writers_do_not_share_a_commit(spark, tmp_path):
    log, table = stores.CommitLog(spark, str(tmp_path / "log")), spark.range(1)
    log.commit(table)
    (tmp_path / "log" / "done-2").write_text("")
    slow = stores.CommitLog(spark, str(tmp_path / "log"))
    slow.numbers = lambda: [1]
    with pytest.raises(Exception, match="done-2|exist"):
        slow.commit(table)


def test_scores_can_be_taken_twice(fitted):
    once = steps.evaluate(fitted)[2]
    assert steps.evaluate(once)[2].metacells.select("purity").count() == fitted.metacells.count()


def test_cell_store_and_signals(spark, study, experiment):
    path = str(experiment / "cells")
    stores.write_cell_pixels(study.pixels[1_000_000], study.genome, 1_000_000, path)
    back = spark.read.parquet(path)
    assert back.count() == study.pixels[1_000_000].count() and back.where("gbin1 > gbin2").isEmpty()
    stores.write_merged_pairs(stores.merged_pairs(study.contacts, study.cells.withColumn("metacell", F.lit(1))), str(experiment / "merged"))
    assert stores.read_merged_pairs(spark, str(experiment / "merged")).count() == 24 * 300


def test_side_tables(spark, tmp_path):
    (tmp_path / "bands.tsv").write_text("chr1\t0\t100\tp1\tacen\nchr1\t100\t200\tp2\tgneg\n")
    assert tables.read_cytobands(spark, str(tmp_path / "bands.tsv")).where("type = 'acen'").count() == 1
    (tmp_path / "sweep.csv").write_text(",mean_purity,acc,global_score,wcos,hwis\n11,0.5,0.4,0.3,0.2,0.1\n")
    row = tables.read_sweep(spark, str(tmp_path / "sweep.csv"), "m").first()
    assert (row["method"], row["k"], row["hwis"]) == ("m", 11, 0.1)
    genome = Genome((("chr1", 300),))
    own = spark.createDataFrame([(0, 0, 0, 0.5)], "chrom_ord INT, bin1 LONG, bin2 LONG, value DOUBLE")
    given = spark.createDataFrame([(0, 3, 0, 0, 6.0), (0, 3, 1, 1, 2.0)], "chrom_ord INT, n_bins INT, bin1 LONG, bin2 LONG, value DOUBLE")
    assert tables.choose_bulk(given, own, genome, 100).agg(F.sum("value")).first()[0] == pytest.approx(3.0)
    assert tables.choose_bulk(given.withColumn("n_bins", F.lit(4)), own, genome, 100).first()["value"] == 0.5
    assert tables.choose_bulk(None, own, genome, 100) is own


def test_external_grouping_is_checked(spark):
    genome = Genome((("chr1", 300),))
    cells = spark.createDataFrame([(1, 1, "x")], "cell_id LONG, metacell LONG, label STRING")
    view = spark.createDataFrame([(1, [0.0])], "cell_id LONG, features ARRAY<DOUBLE>")
    assert study_from_tables(cells, {100: view}, genome, [100]).n_cells == 1
    for bad in ((None, {100: view}), (cells.limit(0), {100: view}), (cells, {}), (cells, {100: cells})):
        with pytest.raises(ValueError):
            study_from_tables(*bad, genome, [100])
