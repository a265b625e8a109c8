"""Shards by a weighted hash tree: region, then rack, then shard.

At each level every child of the node that a row has come to draws -ln(u) / weight,
with u from a hash of the row's key and the child's name, and the least draw wins:
a child's share is that of its weight, the total of the shards below it. A changed
weight changes the draws of that shard, its rack and its region alone. So rows
cross regions only into or out of a region whose total has changed, racks of a
region that they stay in only into or out of a changed rack, and so on: weight
that is shifted within a rack moves rows between the shards that it concerns and
nowhere else. A row pays for the draws on its way down, not for those of all shards.
"""

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

#: Shards and regions of the full tree, and rows that a part of a shard should hold when slots are counted.
BASE, REGIONS, PART = 24, 4, 1 << 18


@dataclass(frozen=True)
class Leaf:
    region: int
    rack: int
    shard: int
    weight: float = 1.0


def layout(shards: int, base: int = BASE, regions: int = REGIONS, racks: int = 3) -> list[Leaf]:
    """Equal weights. The first `base` shards fill regions and racks by turns; each one more
    opens a region of its own, as does every shard of a tree smaller than that: so one
    more shard takes rows only into itself."""
    full = base if shards >= base else 0
    return [Leaf(s % regions, s // regions % racks, s) if s < full else Leaf(regions + s, 0, s) for s in range(shards)]


def grown(tree: list[Leaf]) -> list[Leaf]:
    """The tree with one more shard of weight 1 as a region of its own."""
    name = max((x.shard for x in tree), default=-1) + 1
    return [*tree, Leaf(max(x.region for x in [Leaf(REGIONS + name - 1, 0, 0), *tree]) + 1, 0, name)]


def place(key: Column, tree: list[Leaf]) -> Column:
    """The shard of a row with this key (null has a place, too)."""
    if len({x.shard for x in tree}) < len(tree) or not all(x.weight > 0 for x in tree):
        raise ValueError("shards need distinct names and weights above 0")
    own = F.xxhash64(key.cast("string"))

    def descend(leaves: list[Leaf], names: tuple, levels: list[str]) -> Column:
        level, *below = levels
        children: dict[int, list[Leaf]] = {}
        for x in leaves:
            children.setdefault(getattr(x, level), []).append(x)

        def draw(name: int, some: list[Leaf]) -> Column:
            # 52 bits, and a half so that neither 0 nor 1 comes out
            u = (F.shiftrightunsigned(F.xxhash64(own, *[F.lit(n) for n in (level, *names, name)]), 12).cast("double") + 0.5) / F.lit(float(2**52))
            return F.struct((-F.log(u) / F.lit(sum(x.weight for x in some))).alias("draw"), F.lit(name).alias("name"))

        drawn = [draw(n, some) for n, some in children.items()]
        won = (drawn[0] if len(drawn) == 1 else F.least(*drawn))["name"]
        if not below or len(leaves) == 1:
            return F.lit(leaves[0].shard) if len(leaves) == 1 else won
        if len(children) == 1:
            name, some = next(iter(children.items()))
            return descend(some, (*names, name), below)
        # only the branch that won is drawn further; one comparison a child
        out, picked = None, won
        for name, some in children.items():
            sub = descend(some, (*names, name), below)
            out = F.when(picked == name, sub) if out is None else out.when(picked == name, sub)
        return out

    return descend(tree, (), ["region", "rack", "shard"])


def shard(docs: DataFrame, shards: int = 24, part: int = PART) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard for every row.

    `size`: UTF-8 bytes of the text plus 8; a null text has none and the crc32
    of no bytes. The law is `key`: doc_id (null: a key of its own) and the
    number of shards decide. Slots count a shard's rows from 0 without gaps:
    rows are dealt by a hash into parts of each shard of about `part` rows,
    numbered there by (doc_id, crc32, size), and moved by the counts of the parts
    before, so no task holds a shard. Rows equal in all three are interchangeable. Other
    columns are not read. An empty table gives an empty result.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    chunks = max(1, docs.count() // (shards * part) + 1)
    rows = docs.select(
        "doc_id",
        (F.octet_length(text) + 8).cast("long").alias("size"),
        F.crc32(text.cast("binary")).cast("long").alias("text_crc32"),
        place(F.col("doc_id"), layout(shards)).alias("shard"),
        place(F.col("doc_id"), grown(layout(shards))).alias("grown_shard"),
        F.pmod(F.xxhash64(F.lit("chunk"), F.col("doc_id"), text), F.lit(chunks)).cast("int").alias("chunk"),
    )
    # a row a part: the window over them is small
    counts = rows.groupBy("shard", "chunk").agg(F.count("*").alias("n"))
    before = counts.select("shard", "chunk", (F.sum("n").over(W.partitionBy("shard").orderBy("chunk").rowsBetween(W.unboundedPreceding, -1))).alias("before"))
    numbered = rows.withColumn("nth", F.row_number().over(W.partitionBy("shard", "chunk").orderBy("doc_id", "text_crc32", "size")) - 1)
    return numbered.join(F.broadcast(before), ["shard", "chunk"]).select(
        "doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", (F.coalesce("before", F.lit(0)) + F.col("nth")).cast("long").alias("slot"), "grown_shard"
    )
