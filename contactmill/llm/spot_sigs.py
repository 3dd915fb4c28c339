"""Document fingerprints by SpotSigs.

Common words are spread evenly over running text and rare in menus and tables. Each occurrence of such an anchor spots
the chain of the content words that follow it; the set of all (anchor, chain) signatures is the fingerprint. Two
fingerprints are compared by Jaccard similarity. Sets whose lengths differ by more than a threshold allows cannot be
similar, so fingerprints are partitioned by set length and a partition meets itself and the next one only.

Everything is array expressions; a signature is 48 bits of a hash.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from contactmill.llm.common import whole_text
from contactmill.scale import rank_within
from contactmill.session import materialize

# Frequent function words of English, French, German and Spanish.
ANCHORS = (
    "the of and to a in is it that this for was with on as are be by at from or an not have he you which but his they we were "
    "le la les de des du un une et est en que qui dans pour par sur au avec pas ce il se plus "
    "der die das und den dem ein eine ist im nicht mit von zu auf für sich als auch es an wird bei "
    "el los las del y con su una para por no lo como más al sus este"
).split()
CHAIN = 3
#: Texts with fewer chains than this are also described by their plain word chains.
SPARSE = 8
CHUNK = 64
_BITS = (1 << 48) - 1


def _hash(*parts: Column | str) -> Column:
    return F.xxhash64(*parts).bitwiseAND(F.lit(_BITS))


def signatures(text: Column, anchors: Sequence[str] = ANCHORS, chain: int = CHAIN) -> Column:
    """The sorted signature set of a text column; never empty, equal for equal texts.

    Words are runs of letters, marks and digits in lower case. A text without words has one signature of its own.
    """
    words = F.filter(F.split(F.lower(text), "[^\\p{L}\\p{M}\\p{N}]+"), lambda w: w != "")
    return F.transform(F.array(F.struct(words.alias("w"), text.alias("t"))), lambda s: _set(s["w"], s["t"], list(anchors), chain))[0]


def _set(words: Column, text: Column, anchors: list[str], chain: int) -> Column:
    """An anchor at place i with j anchors before it has i - j content words before it: its chain begins there."""
    content = F.filter(words, lambda w: ~w.isin(anchors))
    spots = F.filter(F.transform(words, lambda w, i: F.struct(w.alias("w"), i.alias("i"))), lambda s: s["w"].isin(anchors))

    def bound(pair: Column) -> Column:
        own, marks = pair["c"], pair["s"]
        found = F.transform(marks, lambda s, j: F.when(
            s["i"] - j + chain <= F.size(own), _hash(s["w"], *[F.get(own, s["i"] - j + k) for k in range(chain)])
        ))
        return F.filter(found, lambda x: x.isNotNull())

    chains = F.transform(F.array(F.struct(content.alias("c"), spots.alias("s"))), bound)[0]
    n = F.least(F.size(words), F.lit(chain))
    plain = F.transform(F.sequence(F.lit(0), F.size(words) - n), lambda i: _hash(F.lit(""), F.array_join(F.slice(words, i + 1, n), " ")))

    def filled(found: Column) -> Column:
        return F.when(F.size(found) >= SPARSE, found).when(F.size(words) > 0, F.concat(found, plain)).otherwise(F.array(_hash(F.lit("text"), text)))

    return F.array_sort(F.array_distinct(F.transform(F.array(chains), filled)[0]))


def as_string(found: Column) -> Column:
    """A fingerprint as a string: its signatures in order, in hexadecimal."""
    return F.lower(F.array_join(F.transform(found, lambda x: F.hex(x)), " "))


def likeness(a: Column, b: Column) -> Column:
    """Jaccard similarity of two fingerprints."""
    both = F.size(F.array_intersect(a, b))
    return both / (F.size(a) + F.size(b) - both)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, signatures (array), fingerprint (string) per row of docs; null texts count as empty. Other columns are not read."""
    found = docs.select(F.col(f"`{id_col}`").alias("doc_id"), signatures(whole_text(text_col)).alias("signatures"))
    return found.withColumn("fingerprint", as_string(F.col("signatures")))


def near_pairs(found: DataFrame, threshold: float = 0.75) -> DataFrame:
    """(a, b, similarity) of fingerprints that differ and are at least `threshold` alike, and are linked by a < b.

    found: doc_id, signatures. Equal fingerprints count once, by their smallest doc_id. A pair that similar shares one of
    the rarest (1 - threshold) of the signatures of either set, so only these meet, within a length partition or the next.
    """
    heads = materialize(found.groupBy("signatures").agg(F.min("doc_id").alias("doc_id")).select("doc_id", "signatures", F.size("signatures").alias("n")))
    each = heads.select("doc_id", "n", F.explode("signatures").alias("s"))
    rarity = each.groupBy("s").agg(F.count(F.lit(1)).alias("_in")).where("_in > 1")
    shared = each.join(rarity, "s")
    # signatures of one set only are rarer than all others: they fill the head of the set's order but meet nothing
    order = Window.partitionBy("doc_id").orderBy("_in", "s")
    counted = shared.withColumn("_k", F.row_number().over(order)).withColumn("_all", F.count(F.lit(1)).over(Window.partitionBy("doc_id")))
    rare = counted.where(F.col("_k") + F.col("n") - F.col("_all") <= F.col("n") - F.ceil(F.col("n") * threshold) + 1)
    part = F.floor(F.log(F.col("n").cast("double")) / -math.log(threshold) + 1e-9)
    rare = rare.select("doc_id", "n", "s", part.alias("part"))
    other = rare.withColumn("part", F.explode(F.array(F.col("part"), F.col("part") + 1)))
    a, b = rare.alias("a"), other.alias("b")
    fits = (F.col("b.n") >= F.col("a.n") * threshold) & (F.col("a.n") >= F.col("b.n") * threshold) & (F.col("a.doc_id") != F.col("b.doc_id"))
    met = a.join(b, (F.col("a.s") == F.col("b.s")) & (F.col("a.part") == F.col("b.part")) & fits)
    pairs = met.select(F.least("a.doc_id", "b.doc_id").alias("a"), F.greatest("a.doc_id", "b.doc_id").alias("b")).distinct()
    for side in ("a", "b"):
        pairs = pairs.join(heads.select(F.col("doc_id").alias(side), F.col("signatures").alias(f"_{side}")), side)
    return pairs.select("a", "b", likeness(F.col("_a"), F.col("_b")).alias("similarity")).where(F.col("similarity") >= threshold)


def with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text, chunk, seat, guest: documents by descending doc_id in chunks; in each, the next seat holds the next one.

    Documents get their place in the order, and chunks of neighbouring places are brought together; the first document of
    a chunk is also a guest at the end of the one before, that of the first chunk at the end of the last. Equal doc_ids
    follow each other by the hash of their text, null ones come last.
    """
    text, doc_id = whole_text(text_col), F.col(f"`{id_col}`")
    name = F.coalesce(F.concat(F.lit("="), doc_id.cast("string")), F.lit("")).alias("_name")
    keyed = docs.select(doc_id.alias("doc_id"), name, F.xxhash64(text).alias("_key"), text.alias("text"))
    ids = keyed.groupBy("doc_id", "_name", "_key").agg(F.count(F.lit(1)).alias("_copies"))
    ids = ids.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("_copies"))))
    placed = rank_within(ids, [], [F.col("doc_id").isNull(), F.col("doc_id").desc(), "_key", "_copy"], "_place")
    places = materialize(placed.groupBy("_name", "_key").agg(F.min("_place").alias("_first"), F.count(F.lit(1)).alias("_copies")))
    total = places.agg(F.sum("_copies")).first()[0] or 0
    # rows equal in doc_id and text are interchangeable: one of them takes all their places
    own = keyed.join(places, ["_name", "_key"]).dropDuplicates(["_name", "_key"])
    own = own.withColumn("seat", F.explode(F.sequence(F.col("_first") - 1, F.col("_first") + F.col("_copies") - 2)))

    def at(chunk: Column, seat: Column, guest: bool) -> Column:
        return F.struct(chunk.cast("bigint").alias("chunk"), seat.cast("bigint").alias("seat"), F.lit(guest).alias("guest"))

    chunk, seat = F.floor(F.col("seat") / CHUNK), F.col("seat")
    visit = F.when(seat == 0, at(F.lit((total - 1) // CHUNK), F.lit(total), True)).otherwise(at(chunk - 1, seat, True))
    seats = F.when(seat % CHUNK == 0, F.array(at(chunk, seat, False), visit)).otherwise(F.array(at(chunk, seat, False)))
    return own.select("doc_id", "text", F.explode(seats).alias("_at")).select("doc_id", "text", "_at.*").repartition("chunk")


def edited_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The edited text is the text with its last floor(n_chars / 2) characters replaced by the first as many (or all) of the
    next document, in descending order of doc_id, after the last the first. Null texts count as empty; equal texts have
    equal fingerprints; one row alone is its own next document. No rows give no rows. Other columns are not read.
    """
    seated = with_next(docs, id_col, text_col).withColumn("own", signatures(F.col("text")))
    order = Window.partitionBy("chunk").orderBy("seat")
    paired = seated.withColumn("next_text", F.lead("text").over(order)).withColumn("next", F.lead("own").over(order))
    paired = paired.where("NOT guest").withColumn("n_chars", F.length("text").cast("bigint"))
    half = F.floor(F.col("n_chars") / 2).cast("int")
    edited = paired.withColumn("edited", F.concat(
        F.substring("text", F.lit(1), F.col("n_chars").cast("int") - half), F.substring("next_text", F.lit(1), half)
    ))
    edited = edited.withColumn("changed", signatures(F.col("edited")))
    return edited.select(
        "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"),
        as_string(F.col("own")).alias("fingerprint"), as_string(F.col("changed")).alias("edited_fingerprint"),
        likeness(F.col("own"), F.col("changed")).alias("near_edited"), likeness(F.col("own"), F.col("next")).alias("near_next"),
    )
