"""Merkle manifest of a table: one tree of digests per group, one tree over the groups, a proof for every row.

Nodes of a tree stand in order; every 8 consecutive ones have a parent, the digest of their concatenated hex texts. Work
goes by aligned blocks of 8**3 consecutive nodes. A block keeps each of its levels as one string of 64 hex digits a node, so
a parent is the digest of a fixed-width substring, and the siblings of a node are what flanks it inside that substring. An
aligned block needs nothing from outside for three levels; its top digest is one node of the next, 512 times smaller level,
which goes through the same steps until every tree is down to its root. What a block learns on the way up (the siblings of
its top) comes down by one join per level of blocks, so no task ever holds a tree and rows of text never move: the first
scan turns each row into a leaf of 64 digits.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from contactmill.scale import _joined, rank_within, with_totals
from contactmill.session import materialize

DIGITS = 64  # hex digits of a digest
ARITY_BITS = 3  # 8 children a node
RUN = DIGITS << ARITY_BITS
LEVELS = 3  # levels a block works out by itself
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def digest(parts: Sequence[Column]) -> Column:
    return F.sha2(F.concat(*parts), 256)


def field(value: Column) -> Column:
    """`-` for null, else the number of UTF-8 bytes, a colon and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def row_digest(columns: Sequence[str], **changed: Column) -> Column:
    """Digest of a row: its columns in the given order, those in `changed` by another value."""
    return digest([field(changed.get(c, F.col(f"`{c}`"))) for c in columns])


def _parents(level: Column) -> Column:
    runs = F.ceil(F.length(level) / RUN).cast("int")
    starts = F.sequence(F.lit(0), runs - 1)
    return F.array_join(F.transform(starts, lambda r: F.sha2(F.substr(level, r * RUN + 1, F.lit(RUN)), 256)), "")


def _flanks(run: Column, at: Column) -> Column:
    """The run without its node number `at`."""
    return F.concat(F.substr(run, F.lit(1), at * DIGITS), F.substr(run, at * DIGITS + DIGITS + 1, F.lit(RUN)))


def _blocks(ranked: DataFrame, items: Sequence[str]) -> DataFrame:
    """One row per block of a tree: _tree, _block, _items (in order), _l0.._l3 (its levels), _n (nodes of the tree).

    ranked: _tree, _rank (1, 2, ... in a tree), _digest, and the columns `items`.
    """
    node = F.struct("_rank", F.col("_digest").alias("_d"), *items)
    rows = ranked.groupBy("_tree", F.shiftright(F.col("_rank") - 1, ARITY_BITS * LEVELS).alias("_block")).agg(
        F.array_sort(F.collect_list(node)).alias("_items")  # at most 512
    )
    rows = rows.withColumn("_l0", F.array_join(F.transform("_items", lambda x: x["_d"]), ""))
    for j in range(LEVELS):
        rows = rows.withColumn(f"_l{j + 1}", _parents(F.col(f"_l{j}")))
    return with_totals(materialize(rows), ["_tree"], _n=F.sum(F.size("_items")))


def _height(n: Column) -> Column:
    """Levels that a block climbs: as many as its tree still has, three at most."""
    return sum((F.when(n > 1 << ARITY_BITS * j, 1).otherwise(0) for j in range(1, LEVELS)), F.when(n > 1, 1).otherwise(0))


def _climbed(ranked: DataFrame, items: Sequence[str]) -> DataFrame:
    """The blocks of `ranked` with _height, _root (of the tree) and _above (siblings of the block's top, upwards)."""
    blocks = materialize(_blocks(ranked, items)).withColumn("_height", _height(F.col("_n")))
    tops = F.array(*[F.col(f"_l{j}") for j in range(LEVELS + 1)])
    blocks = blocks.withColumn("_top", F.element_at(tops, F.col("_height") + 1))
    no_path = F.array().cast("array<struct<at:int,others:string>>")
    whole = blocks.where(F.col("_n") <= 1 << ARITY_BITS * LEVELS).withColumns({"_root": F.col("_top"), "_above": no_path})
    tall = blocks.where(F.col("_n") > 1 << ARITY_BITS * LEVELS)
    if tall.isEmpty():
        return whole
    upper = tall.select("_tree", (F.col("_block") + 1).alias("_rank"), F.col("_top").alias("_digest"), "_block")
    paths = _nodes(_climbed(upper, ["_block"])).select("_tree", "_block", "_root", F.col("_path").alias("_above"))
    return whole.unionByName(_joined(tall, paths, ["_tree", "_block"]))


def _nodes(blocks: DataFrame) -> DataFrame:
    """Every node of the lowest level: _tree, its items, _digest, _root and _path, the siblings level by level upwards."""

    def step(level: str, node: Column) -> Column:
        """Siblings of a node of a level inside its block."""
        at = node.bitwiseAND(F.lit((1 << ARITY_BITS) - 1)).cast("int")
        run = F.substr(F.col(level), F.shiftright(node, ARITY_BITS) * RUN + 1, F.lit(RUN))
        return F.struct(at.alias("at"), _flanks(run, at).alias("others"))

    def run_of(r: Column) -> Column:
        upper = F.array(*[step(f"_l{j}", F.shiftright(r, ARITY_BITS * (j - 1))) for j in range(1, LEVELS)])
        return F.struct(
            F.slice("_items", r * (1 << ARITY_BITS) + 1, 1 << ARITY_BITS).alias("nodes"),
            F.substr(F.col("_l0"), r * RUN + 1, F.lit(RUN)).alias("text"),
            F.slice(upper, F.lit(1), F.greatest(F.col("_height") - 1, F.lit(0))).alias("upper"),
        )

    last = F.shiftright(F.size("_items") - 1, ARITY_BITS)
    runs = blocks.select(
        "_tree", "_root", "_above", "_height", F.explode(F.transform(F.sequence(F.lit(0), last), run_of)).alias("_run")
    )
    nodes = runs.select("_tree", "_root", "_above", "_height", "_run.text", "_run.upper", F.posexplode("_run.nodes").alias("_at", "_item"))
    own = F.array(F.struct(F.col("_at").alias("at"), _flanks(F.col("text"), F.col("_at")).alias("others")))
    path = F.concat(F.slice(own, F.lit(1), F.least(F.col("_height"), F.lit(1))), F.col("upper"), F.col("_above"))
    return nodes.select("_tree", "_root", path.alias("_path"), "_item.*").drop("_rank").withColumnRenamed("_d", "_digest")


def fold(start: Column, path: Column) -> Column:
    """The root that follows from a leaf and the siblings on its path, level by level upwards."""

    def up(own: Column, step: Column) -> Column:
        before = step["at"] * DIGITS
        left, right = F.substr(step["others"], F.lit(1), before), F.substr(step["others"], before + 1, F.lit(RUN))
        return digest([left, own, right])

    return F.aggregate(path, start, up)


def proofs(
    docs: DataFrame,
    columns: Sequence[str] = COLUMNS,
    id_col: str = "doc_id",
    group_col: str = "lang",
    **extra: Column,
) -> DataFrame:
    """One row per row of docs: doc_id, leaf, subroot, root, path, and the columns named in `extra`.

    A leaf is the digest of the listed columns. The leaves of a group (null is a group) stand in the order of id_col, null
    first; equal identifiers by their digest, so rows that are equal in all listed columns can change places without any
    change in the result. Groups stand in the order of their names, null first, names compared by their UTF-8 bytes. `path`
    is an array of (at, others): the siblings of one level as concatenated digests and the place of the own node among
    them. A run of one node has no siblings but still has a parent. No rows give no rows. Columns that are not listed,
    whatever their names, are not read.
    """
    leaves = docs.select(
        F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{group_col}`").alias("_tree"), row_digest(columns).alias("_digest"),
        *[c.alias(n) for n, c in extra.items()],
    )
    items = ["doc_id", *extra]
    leaves = materialize(leaves)  # ranks are taken from two passes; only the first may read texts
    groups = materialize(_climbed(rank_within(leaves, ["_tree"], ["doc_id", "_digest"], "_rank"), items))
    subroots = groups.where("_block = 0").select("_tree", F.col("_root").alias("_digest"))
    ordered = rank_within(subroots, [], ["_tree"], "_rank").withColumn("_name", F.col("_tree"))
    whole = _nodes(_climbed(ordered.withColumn("_tree", F.lit(0)), ["_name"]))
    tops = whole.select(F.col("_name").alias("_tree"), F.col("_root").alias("root"), F.col("_path").alias("_top_path"))
    joined = _joined(groups.withColumnRenamed("_root", "subroot"), materialize(tops), ["_tree"])
    placed = joined.withColumns({"_root": F.struct("subroot", "root"), "_above": F.concat("_above", "_top_path")})
    return _nodes(placed).select(
        "doc_id", F.col("_digest").alias("leaf"), "_root.subroot", "_root.root", F.col("_path").alias("path"), *extra
    )


def lower_case_every_third(id_col: str = "doc_id", text_col: str = "text") -> Callable[[Sequence[str]], Column]:
    """Leaf of a row as tampering leaves it: A-Z of the text become a-z where 3 divides crc32 of the decimal identifier."""

    def tampered(columns: Sequence[str]) -> Column:
        chosen = F.crc32(F.col(f"`{id_col}`").cast("string")) % 3 == 0
        changed = row_digest(columns, **{text_col: F.translate(F.col(f"`{text_col}`"), UPPER, LOWER)})
        return F.when(chosen, changed)

    return tampered


def manifest(docs: DataFrame, columns: Sequence[str] = COLUMNS, id_col: str = "doc_id", group_col: str = "lang") -> DataFrame:
    """One row per row of docs: doc_id, leaf, subroot, root, proof_sha256, folded_root, verified.

    Rows are as in `proofs`. proof_sha256 is the digest of all siblings of a leaf. folded_root is worked out from the leaf
    of the row as tampering leaves it and the original siblings; verified says whether it equals the root. Tampering
    changes rows whose identifier's crc32 is a multiple of 3; rows without identifier stay, and so do null texts.
    """
    proven = proofs(docs, columns, id_col, group_col, _tampered=lower_case_every_third(id_col)(columns))
    siblings = F.array_join(F.transform("path", lambda s: s["others"]), "")
    folded = fold(F.coalesce("_tampered", "leaf"), F.col("path"))
    return proven.select(
        "doc_id", "leaf", "subroot", "root", F.sha2(siblings, 256).alias("proof_sha256"), folded.alias("folded_root")
    ).withColumn("verified", F.col("folded_root") == F.col("root"))
