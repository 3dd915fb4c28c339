"""Mixing sources to target weights by a low-discrepancy schedule of equal-token blocks.

The mix is a sequence of slots of `block_words` words. Slot i falls on the point frac((i + 1/2) * golden ratio), and the
cumulative target shares map the point to a source, so every stretch of the mix holds the sources in their shares. The
r-th slot of a source takes the r-th block of that source's shuffled word stream, which passes over the source as often
as the target asks (the cap keeps that to two passes). A source whose target is reached takes no more slots; the few
blocks by which the schedule fell short of a target follow at the end.
"""

from __future__ import annotations

from collections.abc import Sequence
from math import ceil

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from contactmill.llm.common import WORD, whole_text
from contactmill.scale import rank_within, running_sum
from contactmill.session import materialize

_GOLDEN = 0.6180339887498949
_LOW_BITS = 24
_CELLS = 1 << 12


def n_words(column: str) -> Column:
    return F.regexp_count(whole_text(column), F.lit(WORD)).cast("bigint")


def _own(id_col: str, text_col: str) -> Column:
    return F.xxhash64(F.col(f"`{id_col}`"), whole_text(text_col))


def _rest(docs: DataFrame, columns: Sequence[str]) -> Column:
    """A hash of the columns that tells null from any value; 0 without columns."""
    if not columns:
        return F.lit(0).cast("bigint")
    maps = {c for c in columns if "map<" in docs.schema[c].dataType.simpleString()}
    values = [F.to_json(F.struct(F.col(f"`{c}`"))) if c in maps else F.col(f"`{c}`") for c in columns]
    return F.xxhash64(*values, *[F.col(f"`{c}`").isNull() for c in columns])


def source_targets(
    sizes: DataFrame, weights: Sequence[float] = (5, 2, 1), share: float = 1.5, cap: float = 2.0
) -> DataFrame:
    """Per source of (source, size) rows: source, source_no, source_size, target.

    Sources in code-point order, null last, weigh `weights` in turn and share `share` of all words by weight; what lies
    above `cap` times a source's size is shared anew among the others until no source is above. A table without words
    gives targets of 0. The driver sees three sums per round; a round fixes all sources above their cap.
    """
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    ordered = rank_within(totals, [], [F.col("source").isNull(), "source"], "_rank")
    cycle = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.col("_rank") - 1, F.lit(len(weights))) + 1).cast("int"))
    table = materialize(ordered.select(
        "source", F.col("_rank").alias("source_no"), "source_size", cycle.alias("_weight"),
        (F.col("source_size") * F.lit(cap)).alias("_cap"),
    ))
    words = table.agg(F.sum("source_size")).first()[0] or 0
    rate, capped_before = 0.0, -1
    while True:
        over = F.lit(False) if capped_before < 0 else F.col("_cap") < F.col("_weight") * F.lit(rate)
        n_capped, capped, free = table.agg(
            F.count_if(over), F.sum(F.when(over, F.col("_cap")).otherwise(0.0)), F.sum(F.when(over, 0.0).otherwise(F.col("_weight")))
        ).first()
        if n_capped == capped_before or not free:
            break
        rate, capped_before = (words * share - capped) / free, n_capped
    return table.select(
        "source", "source_no", "source_size", F.least(F.col("_cap"), F.col("_weight") * F.lit(rate)).alias("target")
    )


def _low_discrepancy(i: Column) -> Column:
    """frac((i + 1/2) * golden ratio), in two parts so that large i keep their digits."""
    high, low = F.shiftright(i, _LOW_BITS), F.pmod(i, F.lit(1 << _LOW_BITS))
    step = (_GOLDEN * (1 << _LOW_BITS)) % 1.0
    part = high * F.lit(step)
    point = (part - F.floor(part)) + (low + F.lit(0.5)) * F.lit(_GOLDEN)
    return point - F.floor(point)


def schedule(targets: DataFrame, block_words: int) -> DataFrame:
    """The slots of the mix: slot, source_no, block (from 0, of the source's stream), words (in the block)."""
    spark = targets.sparkSession
    quota = materialize(running_sum(targets.withColumn("_quota", F.round("target").cast("bigint")), [], ["source_no"], "_quota", "_upto"))
    total = quota.agg(F.sum("_quota")).first()[0] or 0
    n_slots = -(-total // block_words)
    scale = float(max(total, 1))
    spans = quota.where("_quota > 0").select(
        "source_no", "_quota",
        ((F.col("_upto") - F.col("_quota")) / F.lit(scale)).alias("_low"), (F.col("_upto") / F.lit(scale)).alias("_high"),
    )
    cells = spans.withColumn("_cell", F.explode(F.sequence(
        F.floor(F.col("_low") * _CELLS).cast("int"), F.least(F.floor(F.col("_high") * _CELLS), F.lit(_CELLS - 1)).cast("int")
    )))
    slots = spark.range(n_slots).select(F.col("id").alias("slot"), _low_discrepancy(F.col("id")).alias("_point"))
    slots = slots.withColumn("_cell", F.floor(F.col("_point") * _CELLS).cast("int"))
    dealt = slots.join(cells, "_cell").where((F.col("_point") >= F.col("_low")) & (F.col("_point") < F.col("_high")))
    ranked = rank_within(dealt.select("slot", "source_no"), ["source_no"], ["slot"], "_r")
    own = ranked.join(quota.select("source_no", "_quota"), "source_no").where((F.col("_r") - 1) * block_words < F.col("_quota"))
    own = own.select("slot", "source_no", (F.col("_r") - 1).alias("block"), "_quota")
    made = own.groupBy("source_no").agg(F.count(F.lit(1)).alias("_made"))
    short = quota.join(made, "source_no", "left").withColumn("_made", F.coalesce("_made", F.lit(0).cast("bigint")))
    short = short.withColumn("_need", F.ceil(F.col("_quota") / F.lit(block_words))).where("_made < _need")
    rest = short.withColumn("block", F.explode(F.sequence("_made", F.col("_need") - 1))).select(
        F.lit(n_slots).cast("bigint").alias("slot"), "source_no", "block", "_quota"
    )
    return own.unionByName(rest).select(
        "slot", "source_no", "block", F.least(F.lit(block_words).cast("bigint"), F.col("_quota") - F.col("block") * block_words).alias("words")
    )


def mix(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
    weights: Sequence[float] = (5, 2, 1), share: float = 1.5, cap: float = 2.0, block_words: int = 1024,
    other_cols: Sequence[str] = (),
) -> tuple[DataFrame, DataFrame]:
    """(rows, pieces) of the mix.

    rows: one per row of docs, in a table: _row, doc_id, source, size, source_size, target. pieces: what the mix takes:
    _row, slot, pass (from 0), first, last; words first..last (from 0, last excluded) of that row's text go into the slot.

    A size is the number of runs without ASCII white space; null and blank texts have size 0 and give no piece. Repeated
    rows count as often as they stand there. Null sources form one source, the last. Documents are shuffled inside their
    source by the hash of their identifier, so reruns agree. No rows give no rows. Of other
    columns only `other_cols` are read: they tell rows apart that are equal in identifier and text.
    """
    sizes = materialize(docs.select(
        F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{source_col}`").cast("string").alias("source"), n_words(text_col).alias("size"),
        _own(id_col, text_col).alias("_own"), _rest(docs, other_cols).alias("_rest"),
    ).withColumn("_row", F.monotonically_increasing_id()))
    targets = materialize(source_targets(sizes, weights, share, cap))
    known = targets.select(F.col("source").alias("_source"), "source_no", "source_size", "target")
    rows = sizes.join(known, F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    filled = rows.where("size > 0").select("_row", "doc_id", "_own", "_rest", "size", "source_no", "source_size", "target")
    placed = running_sum(filled, ["source_no"], [F.md5(F.col("doc_id").cast("string")), "doc_id", "_own", *(["_rest"] if other_cols else [])], "size", "_upto")
    passes = placed.withColumn("pass", F.explode(F.sequence(F.lit(0), F.lit(max(ceil(cap), 1) - 1)))).withColumn(
        "_start", F.col("_upto") - F.col("size") + F.col("pass") * F.col("source_size")
    ).where(F.col("_start") < F.round("target"))
    cut = passes.withColumn("block", F.explode(F.sequence(
        F.floor(F.col("_start") / block_words), F.floor((F.col("_start") + F.col("size") - 1) / block_words)
    )))
    taken = cut.join(schedule(targets, block_words), ["source_no", "block"]).withColumn("_at", F.col("block") * block_words)
    pieces = taken.select(
        "_row", "slot", "pass",
        F.greatest(F.col("_at") - F.col("_start"), F.lit(0).cast("bigint")).alias("first"),
        F.least(F.col("_at") + F.col("words") - F.col("_start"), F.col("size")).alias("last"),
    ).where("last > first")
    return rows, pieces


def mixed_sizes(docs: DataFrame, **settings) -> DataFrame:
    """One row per row of docs: doc_id, size, source_size, target, taken (words the mix takes, repeats counted)."""
    rows, pieces = mix(docs, **settings)
    taken = pieces.groupBy("_row").agg(F.sum(F.col("last") - F.col("first")).alias("taken"))
    return rows.join(taken, "_row", "left").select(
        "doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0).cast("bigint")).alias("taken")
    )


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **settings) -> DataFrame:
    """The mix as rows with the columns of docs: a row per document and pass, whole, or cut to the words the mix takes.

    A source's stream ends inside one document at most, so at most one text per source is cut; `n_chars`, where docs has
    it, is counted anew for that one. Documents without words and those beyond their source's target give no row. Rows
    equal in all columns are interchangeable: one of them stands for all and is repeated as often as all are.
    """
    others = [c for c in docs.columns if c not in (id_col, text_col)]
    rows, pieces = mix(docs, id_col, text_col, other_cols=others, **settings)
    spans = pieces.groupBy("_row", "pass").agg(F.sum(F.col("last") - F.col("first")).alias("_words"))
    shares = rows.join(spans, "_row").select("_own", "_rest", "size", "_words")
    one = docs.select(F.struct("*").alias("doc"), _own(id_col, text_col).alias("_own"), _rest(docs, others).alias("_rest"))
    out = one.dropDuplicates(["_own", "_rest"]).join(shares, ["_own", "_rest"])
    whole, text = F.col("_words") >= F.col("size"), F.col(f"doc.`{text_col}`")
    parts = F.regexp_extract_all(text.cast("string"), F.lit("([\\x20\\x09-\\x0D]*[^\\x20\\x09-\\x0D]+)"), F.lit(1))
    cut = F.when(whole, text).otherwise(F.array_join(F.slice(parts, 1, F.col("_words").cast("int")), ""))
    given = {c: F.col(f"doc.`{c}`") for c in docs.columns} | {text_col: cut}
    if "n_chars" in docs.columns:
        counted = F.length(cut).cast(docs.schema["n_chars"].dataType)
        given["n_chars"] = F.when(whole, given["n_chars"]).otherwise(counted)
    return out.select(*[value.alias(c) for c, value in given.items()])
