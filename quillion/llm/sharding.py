"""Hierarchical weighted hash tree (operator 6).

Shards hang under racks, racks under regions. A row descends level by level:
each child draws ``ln(u) / weight`` with ``u`` hashed from the row's key and
the child's name, and the largest draw wins, so a child gets rows in proportion
to its weight. A draw depends on nothing but key, name and weight: when weights
change, draws of all other children stay, and rows move only into subtrees
whose weight grew or out of those whose weight shrank.

Trees grow by whole new subtrees: shard ``n`` opens a new region, or joins the
last one, by the fixed shape of :func:`tree`. With 24 shards in three full
regions, the 25th is a region of its own and takes rows only into itself.

Defined results: the law is ``key``: a row's shard depends on its id and the
number of shards only; a null id is a key like any other; a null text has 8
bytes of size and the checksum of no bytes; repeated rows get the same shard
and different slots; an empty table gives an empty table; other columns are
ignored, whatever their names; texts of any length are only measured.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillion.llm.cluster import checkpointed, numbered, part_of

SHARDS_A_RACK, RACKS_A_REGION = 4, 2


@dataclass(frozen=True)
class Node:
    """A subtree; ``shard`` is set at leaves. ``number`` is its name among all nodes of its level."""

    number: int
    weight: float
    children: tuple[Node, ...] = ()
    shard: int | None = None


def inner(number: int, children: list[Node]) -> Node:
    return Node(number, sum(c.weight for c in children), tuple(children))


def tree(n_shards: int, weights: dict[int, float] | None = None) -> Node:
    """Shards 0 to n - 1 in order: 4 to a rack, 2 racks to a region; weights are 1 unless given."""
    weight = weights or {}
    leaves = [Node(i, weight.get(i, 1.0), shard=i) for i in range(n_shards)]
    racks = [inner(i, leaves[at : at + SHARDS_A_RACK]) for i, at in enumerate(range(0, n_shards, SHARDS_A_RACK))]
    regions = [inner(i, racks[at : at + RACKS_A_REGION]) for i, at in enumerate(range(0, len(racks), RACKS_A_REGION))]
    return inner(0, regions)


def _draw(key_hash: Column, node: Node, level: int) -> Column:
    """ln(u) / weight for u in (0, 1], from 53 bits of a hash of key, level and name."""
    h = F.xxhash64(key_hash, F.lit((level << 32) + node.number).cast("long"))
    u = (F.shiftrightunsigned(h, 11) + 1) / F.lit(float(1 << 53))
    return F.log(u) / F.lit(node.weight)


def shard_of(key_hash: Column, node: Node, level: int = 0) -> Column:
    """The shard to which a key descends, as one expression; of equal draws the higher name wins."""
    if node.shard is not None:
        return F.lit(node.shard)
    heirs = [c for c in node.children if c.weight > 0]
    if len(heirs) == 1:
        return shard_of(key_hash, heirs[0], level + 1)
    best = F.greatest(*[F.struct(_draw(key_hash, c, level).alias("d"), F.lit(i).alias("i")) for i, c in enumerate(heirs)])["i"]
    if all(c.shard is not None for c in heirs):
        return F.get(F.array(*[F.lit(c.shard) for c in heirs]), best)
    out = F.when(best == 0, shard_of(key_hash, heirs[0], level + 1))
    for i, c in enumerate(heirs[1:], 1):
        out = out.when(best == i, shard_of(key_hash, c, level + 1))
    return out


def place(docs: DataFrame, n_shards: int, id_col: str = "doc_id", text_col: str = "text", weights: dict[int, float] | None = None) -> DataFrame:
    """(id, size, text_crc32, shard, slot, grown_shard) of every row; ``grown_shard`` is its shard if there were one more."""
    key = F.xxhash64(F.coalesce(F.col(id_col).cast("string"), F.lit("\x00null")))
    text = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    rows = docs.select(F.col(id_col).alias("id"), (F.octet_length(text).cast("long") + 8).alias("size"), F.crc32(text).alias("text_crc32"), key.alias("key"))
    rows = rows.select("id", "size", "text_crc32", shard_of(F.col("key"), tree(n_shards, weights)).alias("shard"), shard_of(F.col("key"), tree(n_shards + 1, weights)).alias("grown_shard"), part_of(F.col("key"), F.col("text_crc32")).alias("part"))
    # Texts are read once; what is kept of a row is a few numbers.
    slots = numbered(checkpointed(rows), ["shard"], "part", [F.col("id"), F.col("text_crc32"), F.col("size")], "slot")
    return slots.select(F.col("id").alias(id_col), "size", "text_crc32", "shard", "slot", "grown_shard")
