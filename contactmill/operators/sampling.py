"""Link tables for training and testing: hyperedges, negatives, splits, batches.

Random draws are arithmetic hashes of row keys, so every run and every retry draws the same.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from contactmill.functions.draws import MODULUS, hash_further, hash_key, unit_draw
from contactmill.genome import Genome
from contactmill.operators.binning import symmetrize
from contactmill.scale import quantile_within, rank_within
from contactmill.session import materialize

EDGE = ["cell_id", "chrom_ord", "bin1", "bin2"]
BUCKET_SLOTS = 1 << 17  # slots for each bucket of maps in which tries meet contacts
_BUNDLE = 1 << 19  # tries that a task bundles at once


def padded_edges(edges: DataFrame, nodes: Sequence[str]) -> DataFrame:
    """Ids shifted by one (0 is padding) and sorted within each row."""
    return edges.select(F.array_sort(F.array(*[F.col(n) + 1 for n in nodes])).alias("edge"))


def distinct_edges(edges: DataFrame) -> DataFrame:
    """Sorted hyperedges, each once."""
    return edges.select(F.array_sort("edge").alias("edge")).distinct()


def node_pairs(edges: DataFrame) -> DataFrame:
    """Ordered pairs of different nodes that share a hyperedge (edges have a fixed small width)."""
    first = edges.select(F.explode("edge").alias("x"), "edge")
    return first.select("x", F.explode("edge").alias("y")).where(F.col("x") != F.col("y")).distinct()


def leave_one_out(edges: DataFrame) -> DataFrame:
    """Each triple with one position at a time replaced by 0."""
    drop = F.explode(F.sequence(F.lit(0), F.lit(2))).alias("hole")
    holes = edges.select("edge", drop)
    return holes.select(F.transform("edge", lambda v, i: F.when(i == F.col("hole"), F.lit(0)).otherwise(v)).alias("edge")).distinct()


def stencil_edges(edges: DataFrame) -> DataFrame:
    """The 5-point neighbourhood of each contact triple (cell, bin1, bin2), each neighbour sorted."""
    moves = F.array(*[
        F.struct(F.lit(i).cast("long").alias("i"), F.lit(j).cast("long").alias("j"))
        for i, j in ((-1, 0), (0, -1), (0, 0), (0, 1), (1, 0))
    ])
    moved = edges.select("edge", F.explode(moves).alias("m"))
    e = F.col("edge")
    return moved.select(
        "edge", F.array_sort(F.array(e[0], e[1] + F.col("m.i"), e[2] + F.col("m.j"))).alias("neighbor")
    )


def _touches(candidates: DataFrame, pixels: DataFrame, n: Column) -> tuple[DataFrame, DataFrame]:
    """(candidates exploded over their 3x3 neighbourhood, symmetric contacts), ready for a semi or anti join.

    The neighbourhood ends before the last bin of the chromosome.
    """
    def around(bin_: Column) -> Column:
        low, high = F.greatest(bin_ - 1, F.lit(0).cast("long")), F.least(bin_ + 1, n - 2)
        return F.when(low <= high, F.sequence(low, high)).otherwise(F.array().cast("array<bigint>"))

    keys = candidates.columns
    spread = candidates.select(*keys, F.explode(around(F.col("bin1"))).alias("_b1"))
    spread = spread.select(*keys, "_b1", F.explode(around(F.col("bin2"))).alias("_b2"))
    found = symmetrize(pixels).select(
        "cell_id", "chrom_ord", F.col("bin1").alias("_b1"), F.col("bin2").alias("_b2")
    )
    return spread, found


def near_contacts(candidates: DataFrame, pixels: DataFrame, n: Column) -> DataFrame:
    """Candidates with a stored contact in their 3x3 neighbourhood. Contacts are distinct, so the join stays lean."""
    spread, found = _touches(candidates, pixels, n)
    hit = spread.join(found, ["cell_id", "chrom_ord", "_b1", "_b2"], "left_semi")
    return hit.select(*candidates.columns).distinct()


def _code(genome: Genome, resolution: int) -> tuple[Column, int]:
    """A number per triple, and what lies between the numbers of neighbouring bin1. A map has an empty border."""
    width = max(genome.bins(resolution)) + 2
    code = F.lit(0).cast("long")
    for column, size in (("cell_id", 1), ("chrom_ord", len(genome.chroms)), ("bin1", width), ("bin2", width)):
        code = code * size + F.col(column) + (1 if size == width else 0)
    return code, width


def _bundled(table: DataFrame, bucket: Column, columns: Sequence[str]) -> DataFrame:
    """Whole numbers in `columns` as arrays: a row holds what goes from some batches of a task to one bucket."""

    def pack(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, *rest = (np.concatenate([b.column(i).to_numpy() for b in held]) for i in range(len(columns) + 1))
        order = np.argsort(first, kind="stable")
        found, starts = np.unique(first[order], return_index=True)
        offsets = pa.array(np.r_[starts, len(order)].astype(np.int32))
        lists = [pa.ListArray.from_arrays(offsets, pa.array(x[order])) for x in rest]
        yield pa.RecordBatch.from_arrays([pa.array(found), *lists], names=["bucket", *columns])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            held += [batch] if batch.num_rows else []
            if sum(b.num_rows for b in held) >= _BUNDLE:
                yield from pack(held)
                held = []
        if held:
            yield from pack(held)

    flat = table.select(bucket.alias("bucket"), *[F.col(c).cast("long").alias(c) for c in columns])
    return flat.mapInArrow(run, ", ".join(["bucket LONG", *(f"{c} ARRAY<LONG>" for c in columns)]))


def _free(tries: DataFrame, contacts: DataFrame, width: int) -> DataFrame:
    """(_slot, attempt) of bundled tries (bucket, code, _slot, attempt) without one of the bundled contacts (bucket, code) within
    their 3x3 neighbourhood: what a contact forbids is worked out in the task of its bucket.

    Stored contacts are upper-triangle: mirrored ones reach no further than the diagonal band, which no try falls on.
    """

    def run(asked: pa.Table, seen: pa.Table) -> pa.Table:
        columns = [pc.list_flatten(asked.column(c)).to_numpy() for c in ("code", "_slot", "attempt")]
        code = pc.list_flatten(seen.column("code")).to_numpy()
        blocked = np.concatenate([code + i * width + j for i in (-1, 0, 1) for j in (-1, 0, 1)])
        free = ~np.isin(columns[0], blocked)
        return pa.table({"_slot": columns[1][free], "attempt": columns[2][free].astype(np.int32)})

    return tries.groupBy("bucket").cogroup(contacts.groupBy("bucket")).applyInArrow(run, "_slot LONG, attempt INT")


def _in_band(max_bin: int) -> Column:
    span = F.col("bin2") - F.col("bin1")
    return (span > 1) & (span < max_bin)


def negatives(
    positives: DataFrame,
    pixels: DataFrame,
    genome: Genome,
    resolution: int,
    n_cells: int,
    per_positive: int,
    max_bin: int,
    pair_ratio: float = 0.5,
    tries: int = 50,
    seed: int = 0,
) -> DataFrame:
    """Per positive, `per_positive` corrupted triples away from stored contacts.

    A draw below pair_ratio changes one node, else all three; accepted triples have 1 < bin2 - bin1 < max_bin and no
    contact within their 3x3 neighbourhood. Each slot takes its first accepted try of `tries`; a slot whose tries all
    fail gives none. Slots try in rounds, one try first and then four times as many as before, and only slots still open go on. Tries
    and contacts are three numbers and one; they go to buckets of maps in bundles, not row by row, and meet there. Buckets grow
    in number with the slots. What a try draws follows from its slot and number, so rounds pass on numbers only.
    """
    n = genome.n_bins(F.col("chrom_ord"), resolution)
    code, code_width = _code(genome, resolution)
    slots = positives.select(*[F.col(c).alias(f"of_{c}") for c in EDGE]).select(
        "*", F.explode(F.sequence(F.lit(0), F.lit(per_positive - 1))).alias("slot")
    )

    base = hash_key(*[F.col(c).cast("long") for c in (*[f"of_{c}" for c in EDGE], "slot")], seed=seed)

    def drawn(table: DataFrame) -> DataFrame:
        return _drawn(table, n, n_cells, max_bin, pair_ratio)

    open_slots = materialize(slots.withColumns({"_slot": F.monotonically_increasing_id(), "_base": base}))
    bucket = F.pmod(F.xxhash64("cell_id", "chrom_ord"), F.lit(open_slots.count() // BUCKET_SLOTS + 1))
    inner = pixels.where((F.col("bin1") < n - 1) & (F.col("bin2") < n - 1))  # those in the last bin forbid nothing
    contacts = materialize(_bundled(inner.withColumn("code", code), bucket, ["code"]))
    done, first_try, width = [], 1, 1
    while first_try <= tries:
        last = min(tries, first_try + width - 1)
        made = drawn(open_slots.withColumn("attempt", F.explode(F.sequence(F.lit(first_try), F.lit(last)))))
        asked = made.where(_in_band(max_bin)).withColumn("code", code)
        free = _free(_bundled(asked, bucket, ["code", "_slot", "attempt"]), contacts, code_width)
        found = free.groupBy("_slot").agg(F.min("attempt").alias("attempt"))
        tried = materialize(open_slots.join(found, "_slot", "left"))
        done.append(tried.where(F.col("attempt").isNotNull()))
        open_slots = tried.where(F.col("attempt").isNull()).drop("attempt")
        first_try, width = last + 1, width * 4
        if open_slots.isEmpty():
            break
    return drawn(reduce(DataFrame.unionByName, done)).select(
        "of_cell_id", "of_bin1", "of_bin2", "chrom_ord", "slot", "cell_id", "bin1", "bin2"
    )


def _drawn(slots: DataFrame, n: Column, n_cells: int, max_bin: int, pair_ratio: float) -> DataFrame:
    """slots (of_cell_id, of_chrom_ord, of_bin1, of_bin2, slot, _base, attempt) with the triple that this try draws.

    _base hashes what a slot is; draws go on from it, so each costs one step.
    """

    def long(number: int) -> Column:
        return F.lit(number).cast("long")

    def fixed(**values: Column) -> Column:
        """Columns that later steps read instead of repeating the arithmetic behind them."""
        return F.inline(F.array(F.struct(*[v.alias(name) for name, v in values.items()])))

    def pick(salt: int, low: Column, high: Column) -> Column:
        """An id in [low, high)."""
        draw = hash_further(F.col("_try"), long(salt)) / F.lit(float(MODULUS))
        return low + F.floor(draw * (high - low)).cast("long")

    change = hash_further(F.col("_base"), long(1)) % 3
    easy = hash_further(F.col("_base"), long(2)) / F.lit(float(MODULUS)) <= pair_ratio
    zero, of2, kept = long(0), F.col("of_bin2"), slots.columns
    tries = slots.withColumn("chrom_ord", F.col("of_chrom_ord")).select(
        *kept, "chrom_ord", fixed(_change=change, _one=easy, _try=hash_further(F.col("_base"), F.col("attempt").cast("long")))
    )
    low, high = F.greatest(zero, of2 - max_bin), F.least(n, of2 + max_bin)
    tries = tries.select("*", fixed(
        _cell=pick(3, zero, long(n_cells)), _new1=pick(4, low, high), _new2=pick(5, low, high), _all1=pick(6, zero, n)
    ))
    around = F.greatest(zero, F.col("_all1") - max_bin), F.least(n, F.col("_all1") + max_bin)
    tries = tries.select("*", fixed(_all2=pick(7, *around)))
    one = F.col("_one")
    cell = F.when(one & (F.col("_change") != 0), F.col("of_cell_id")).otherwise(F.col("_cell"))
    b1 = F.when(one, F.when(F.col("_change") == 1, F.col("_new1")).otherwise(F.col("of_bin1"))).otherwise(F.col("_all1"))
    b2 = F.when(one, F.when(F.col("_change") == 2, F.col("_new2")).otherwise(of2)).otherwise(F.col("_all2"))
    return tries.select(*kept, "chrom_ord", cell.alias("cell_id"), F.least(b1, b2).alias("bin1"), F.greatest(b1, b2).alias("bin2"))


def negatives_per_positive(n_edges: Column, n_cells: Column, genome: Genome, resolution: int) -> Column:
    """1 to 5 negatives per positive, more for sparser data."""
    possible = float(sum(n * (n + 1) // 2 for n in genome.bins(resolution)))
    density = n_edges / (n_cells * F.lit(possible))
    # fixed values: density steps
    return (
        F.when(density > 0.3, 1).when(density > 0.2, 2).when(density > 0.15, 3).when(density > 0.1, 4).otherwise(5)
    )


def class_weights(weights: DataFrame, mean: float, ratio: float, column: str = "value") -> DataFrame:
    """log2(w + 1) capped at its 99th percentile, over a mean, times the negative ratio. Counts take few values."""
    logs = weights.withColumn("_log", F.log2(F.col(column) + 1))
    cap = F.lit(quantile_within(logs, [], "_log", 0.99).first()[0])  # one number, from a range sort
    return logs.withColumn("weight", F.least("_log", cap) / F.lit(mean) * F.lit(ratio)).drop("_log")


def train_test_split(pixels: DataFrame, share: float = 0.85, seed: int = 0) -> DataFrame:
    """Pixels at distance >= 2 with a train flag: int(share * n) of each chromosome in hash order.

    A chromosome may hold a large part of all rows, so ranks come from a range sort.
    """
    far = pixels.where(F.col("bin2") - F.col("bin1") >= 2)
    drawn = far.withColumn("_draw", hash_key(*[F.col(c).cast("long") for c in EDGE], seed=seed))
    ranked = rank_within(drawn, ["chrom_ord"], ["_draw", "cell_id", "bin1", "bin2"], "_rank")
    sizes = far.groupBy("chrom_ord").agg(F.floor(F.count(F.lit(1)) * F.lit(share)).alias("_n"))
    joined = ranked.join(F.broadcast(sizes), "chrom_ord")  # one row per chromosome
    return joined.select(*pixels.columns, (F.col("_rank") <= F.col("_n")).alias("train"))


def epoch_batches(pixels: DataFrame, batch_size: int, epoch: int = 0) -> DataFrame:
    """Shuffled mini-batches per chromosome: columns batch and copy.

    A chromosome with at most batch_size rows is doubled until it exceeds batch_size.
    """
    sizes = pixels.groupBy("chrom_ord").agg(F.count(F.lit(1)).alias("_n"))
    doublings = F.greatest(F.floor(F.log2(F.lit(float(batch_size)) / F.col("_n"))) + 1, F.lit(0))
    copies = F.when(F.col("_n") > batch_size, F.lit(1)).otherwise(F.pow(F.lit(2.0), doublings).cast("int"))
    counted = pixels.join(F.broadcast(sizes), "chrom_ord")  # one row per chromosome
    repeated = counted.select(*pixels.columns, F.explode(F.sequence(F.lit(0), copies - 1)).alias("copy"))
    drawn = repeated.withColumn(
        "_draw", hash_key(*[F.col(c).cast("long") for c in EDGE], F.col("copy").cast("long"), seed=epoch)
    )
    ranked = rank_within(drawn, ["chrom_ord"], ["_draw", "cell_id", "bin1", "bin2", "copy"], "_rank")
    return ranked.withColumn("batch", F.floor((F.col("_rank") - 1) / batch_size)).drop("_rank", "_draw")


def adjacency_rows(
    edges: DataFrame, keys: Sequence[str], column: str, partner: Column | None = None, drop_rate: float = 0.4, seed: int = 0
) -> DataFrame:
    """Neighbours of each node with duplicate columns summed and log1p weights.

    With a partner column, the partner is left out of a node's neighbours for a drop_rate share of the nodes that have
    other neighbours; a hash of the node decides.
    """
    keys = list(keys)
    summed = edges.groupBy(*keys, column).agg(F.sum("value").alias("value"))
    if partner is not None:
        count = Window.partitionBy(*keys)  # neighbours of one bin in one cell
        hidden = (F.col(column) == partner) & (unit_draw(*[F.col(k).cast("long") for k in keys], seed=seed) >= 1 - drop_rate)
        summed = summed.withColumn("_n", F.count(F.lit(1)).over(count)).where(~(hidden & (F.col("_n") > 1))).drop("_n")
    return summed.withColumn("value", F.log1p("value"))
