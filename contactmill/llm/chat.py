"""Logged conversations: collapse of cumulative snapshots, then chat formatting.

Logs often hold a conversation once per turn, each snapshot containing all turns before it. A conversation whose turns
are the first turns of a longer one says nothing new. Turns are numbered inside their conversation, every turn is hashed
together with its number, and the running sums of these hashes identify every prefix. A conversation goes when its whole
hash equals a shorter prefix's hash in another one; of equal conversations the one with the smallest conv_id stays.

Sums of hashes can be taken in any order and in parts, so a conversation with a third of all turns is spread over many
tasks; it is rendered in parts of a fixed number of turns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from contactmill.scale import rank_within, running_sum
from contactmill.session import materialize

#: Turns rendered into one row.
PART_TURNS = 256
BEGIN, END = "<|im_start|>", "<|im_end|>"


def _turn_hash() -> Column:
    """A 95-bit hash of a numbered turn as a decimal, whose sums stay exact for two billion turns."""
    first, second = (
        F.xxhash64(F.lit(seed), "n", "role", F.col("role").isNull(), "text", F.col("text").isNull()) for seed in (11, 29)
    )
    return first.cast("decimal(20,0)") * F.lit(1 << 31) + F.pmod(second, F.lit(1 << 31)).cast("decimal(10,0)")


def numbered_turns(
    turns: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text"
) -> DataFrame:
    """conv_id, n (1, 2, ... inside the conversation), role, text, prefix (hash of the first n turns), in a table.

    Turns stand by their number, null last; ties by role and text. Rows without conv_id belong to no conversation.
    """
    rows = turns.select(
        F.col(f"`{id_col}`").alias("conv_id"), F.col(f"`{turn_col}`").alias("_turn"),
        F.col(f"`{role_col}`").cast("string").alias("role"), F.col(f"`{text_col}`").cast("string").alias("text"),
    ).where(F.col("conv_id").isNotNull())
    order = [F.col("_turn").isNull(), "_turn", F.col("role").isNull(), "role", F.col("text").isNull(), "text"]
    rows = materialize(rank_within(rows, ["conv_id"], order, "n").select("conv_id", "n", "role", "text"))
    sums = running_sum(rows.select("conv_id", "n", _turn_hash().alias("_hash")), ["conv_id"], ["n"], "_hash", "prefix")
    return materialize(rows.join(sums.select("conv_id", "n", "prefix"), ["conv_id", "n"]))


def maximal_conversations(numbered: DataFrame) -> DataFrame:
    """conv_id, n_turns, n_copies (equal conversations, itself included) of the conversations that stay."""
    whole = numbered.groupBy("conv_id").agg(F.max(F.struct("n", "prefix")).alias("_last")).select("conv_id", "_last.*")
    kept = whole.groupBy("n", "prefix").agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_copies"))
    ends = whole.select("conv_id", F.col("n").alias("_n_turns"))
    continued = numbered.select("conv_id", "n", "prefix").join(ends, "conv_id").where("n < _n_turns").select("n", "prefix").distinct()
    return kept.join(continued, ["n", "prefix"], "left_anti").select("conv_id", F.col("n").alias("n_turns"), "n_copies")


def rendered(role: Column, text: Column) -> Column:
    """One turn in chat markup; markers inside a text are broken by a space."""
    bare = F.regexp_replace(F.coalesce(text, F.lit("")), "<\\|(im_start|im_end)\\|>", "< |$1|>")
    return F.concat(F.lit(BEGIN), F.coalesce(role, F.lit("unknown")), F.lit("\n"), bare, F.lit(END + "\n"))


def format_chats(
    turns: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text",
    part_turns: int = PART_TURNS,
) -> DataFrame:
    """The conversations that stay, rendered: conv_id, part, n_turns, n_copies, text.

    Part k holds the turns k * part_turns + 1 to (k + 1) * part_turns; the parts of a conversation in order are its text.
    n_turns and n_copies belong to the whole conversation. Null roles are written as `unknown`, null texts as empty ones;
    null and empty still count as different turns. Repeated rows are repeated turns. No rows give none. Other columns are
    not read.
    """
    numbered = numbered_turns(turns, id_col, turn_col, role_col, text_col)
    kept = numbered.join(maximal_conversations(numbered), "conv_id")
    part = F.floor((F.col("n") - 1) / part_turns).alias("part")
    parts = kept.groupBy("conv_id", part, "n_turns", "n_copies").agg(
        F.array_sort(F.collect_list(F.struct("n", rendered(F.col("role"), F.col("text")).alias("turn")))).alias("_turns")
    )
    return parts.select("conv_id", "part", "n_turns", "n_copies", F.array_join("_turns.turn", "").alias("text"))
