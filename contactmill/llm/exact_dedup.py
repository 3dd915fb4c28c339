"""Exact duplicates by a tree merge of sorted digest runs.

Rows are dealt to numbered runs by their identifier, so that the copies of one text, however many, are spread over all
runs. A run holds one entry per text: digest, smallest identifier, number of rows. In each round the runs whose numbers
share the leading digits are merged, which keeps the smallest identifier and adds the counts; after log(runs) rounds one
run is left, itself spread over all tasks by digest. The winners then go down to (text, run) and from there to the rows,
so no join key ever stands for more than one run's copies.

An entry is identified by SHA-256, byte length and a second, unrelated hash of the normalised text: two texts that agree
in one of the three only are never merged at any level.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from contactmill.llm.common import WHITE, whole_text
from contactmill.session import materialize

_ENTRY = ["_digest", "_bytes", "_check"]


def normalised(column: str) -> Column:
    return F.regexp_replace(whole_text(column), WHITE, " ")


def _identified(df: DataFrame, text: str) -> DataFrame:
    """df without its text, with the three columns that identify the normalised text in `text`."""
    return df.select(
        *[c for c in df.columns if c != text],
        F.unhex(F.sha2(F.col(text), 256)).alias("_digest"),
        F.octet_length(text).alias("_bytes"),
        F.xxhash64(text).alias("_check"),
    )


def _merged(runs: DataFrame, arity: int) -> DataFrame:
    return runs.groupBy(*_ENTRY, F.shiftright("_run", arity).alias("_run")).agg(
        F.min("_smallest").alias("_smallest"), F.sum("_n").alias("_n")
    )


def exact_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", run_bits: int = 6, round_bits: int = 3
) -> DataFrame:
    """One row per row of docs: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when they are identical after every run of ASCII white space became one space. Null texts count as
    empty and form one group. The smallest identifier stays; identifiers that are null stay only where a group has no
    other. Of several rows with that same identifier and text exactly one is kept. No rows give no rows. Other columns,
    whatever their names, are neither read nor returned.
    """
    text = docs.select(F.col(f"`{id_col}`").alias("doc_id"), normalised(text_col).alias("_text"))
    rows = materialize(
        _identified(text, "_text").withColumn("_run", F.pmod(F.xxhash64("doc_id"), F.lit(1 << run_bits)).cast("int"))
    )
    copies = rows.groupBy("doc_id", *_ENTRY, "_run").agg(F.count(F.lit(1)).alias("_copies"))
    leaves = rows.groupBy(*_ENTRY, "_run").agg(F.min("doc_id").alias("_smallest"), F.count(F.lit(1)).alias("_n"))
    top, bits = leaves, run_bits
    while bits > 0:
        top, bits = _merged(top, min(round_bits, bits)), bits - round_bits
    winners = top.select(*_ENTRY, F.col("_smallest").alias("keep_id"), F.col("_n").alias("group_size"))
    heads = leaves.select(*_ENTRY, "_run").join(winners, _ENTRY)
    return (
        copies.join(heads, [*_ENTRY, "_run"])
        .withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("_copies"))))
        .select(
            "doc_id", "keep_id", "group_size",
            (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("_copy") == 1)).alias("kept"),
            F.lower(F.hex("_digest")).alias("text_sha256"),
        )
    )


def drop_exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that stay, with all their columns."""
    kept = exact_duplicates(docs, id_col, text_col).where("kept").select(
        F.col("doc_id").alias("_kept_id"), F.unhex("text_sha256").alias("_kept_digest")
    )
    digest = F.unhex(F.sha2(normalised(text_col), 256))
    marked = docs.select(F.struct("*").alias("doc"), F.col(f"`{id_col}`").alias("_id"), digest.alias("_own_digest"))
    same = F.col("_id").eqNullSafe(F.col("_kept_id")) & (F.col("_own_digest") == F.col("_kept_digest"))
    return marked.join(kept, same, "left_semi").dropDuplicates(["_id", "_own_digest"]).select("doc.*")
