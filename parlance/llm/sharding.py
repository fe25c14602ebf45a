"""Sharding by a hierarchical weighted hash tree: region, rack, shard."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parlance.llm.common import query, read
from parlance.runtime import stored

# Rows of one numbering group, about; a shard of more rows is numbered by several tasks.
GROUP_ROWS = 1 << 18


@dataclass(frozen=True)
class Node:
    """A node of the tree; a leaf has a shard number and a weight, any other weighs what its children weigh."""

    name: str
    children: tuple[Node, ...] = ()
    shard: int | None = None
    own: float = 1.0

    @property
    def weight(self) -> float:
        return self.own if self.shard is not None else sum(c.weight for c in self.children)

    def leaves(self) -> list[Node]:
        return [self] if self.shard is not None else [x for c in self.children for x in c.leaves()]


def tree(shards: int, regions: int = 2, racks: int = 4) -> Node:
    """Shards 0 to ``shards`` - 1 of weight one, in racks and regions of as equal sizes as can be."""
    def cut(numbers: list[int], parts: int) -> list[list[int]]:
        size, more = divmod(len(numbers), parts)
        ends = [i * size + min(i, more) for i in range(parts + 1)]
        return [numbers[a:b] for a, b in zip(ends, ends[1:]) if b > a]

    return Node("root", tuple(
        Node(f"region{r}", tuple(
            Node(f"rack{r}.{k}", tuple(Node(f"shard{s}", shard=s) for s in rack))
            for k, rack in enumerate(cut(region, racks))))
        for r, region in enumerate(cut(list(range(shards)), regions))))


def grown(root: Node, weight: float = 1.0) -> Node:
    """The tree with one more shard, in a region and rack of its own.

    No weight of another subtree changes, so no draw between the others changes, and rows move only into the new
    shard. Put into an old rack it would raise the weights above it, and rows would also move between old shards.
    """
    new = 1 + max((x.shard for x in root.leaves()), default=-1)
    leaf = Node(f"shard{new}", shard=new, own=weight)
    return replace(root, children=(*root.children, Node(f"region+{new}", (Node(f"rack+{new}", (leaf,)),))))


def place(key: Column, root: Node) -> Column:
    """The shard of a key: from the root down, every child draws an exponential time at the rate of its weight from
    the hash of its name and the key, and the first one is entered. A child wins as often as its share of the
    weight; when a weight changes, only rows that it wins or loses move at that level. Null keys are one key.
    """
    text = F.coalesce(key.cast("string"), F.lit("\0null"))

    def down(node: Node) -> Column:
        if node.shard is not None:
            return F.lit(node.shard)
        live = [c for c in node.children if c.weight > 0]
        if not live:
            raise ValueError(f"{node.name} has no child with a weight")
        if len(live) == 1:
            return down(live[0])
        uniform = lambda c: (F.shiftrightunsigned(F.xxhash64(F.lit(c.name), text), 11) + 0.5) / float(1 << 53)
        draws = F.array(*[-F.ln(uniform(c)) / c.weight for c in live])
        # Equal draws go to the first child.
        winner = F.array_position(draws, F.array_min(draws))
        out = down(live[-1])
        for i, c in reversed(list(enumerate(live[:-1], 1))):
            out = F.when(winner == i, down(c)).otherwise(out)
        return out

    return down(root).cast("int")


def assign(docs: DataFrame, root: Node, key: str = "doc_id", text: str = "text", group_rows: int = GROUP_ROWS) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, size, text_crc32, shard, slot``.

    ``size`` is the text's UTF-8 bytes plus 16. ``slot`` numbers the rows of a shard from 0 without gaps, by groups
    of the key's hash and in the order of id, size and checksum inside a group, so that a shard of any size is
    numbered by many tasks: each sorts a group, and the group's counts give where it starts. Repeated rows get slots
    of their own; an empty table gives an empty result.
    """
    body = F.coalesce(F.col(text).cast("binary"), F.lit(b""))
    rows = docs.select(F.col(key).alias("doc_id"), (F.octet_length(body) + 16).cast("bigint").alias("size"),
                       F.crc32(body).alias("text_crc32"))
    shards = max(1, len(root.leaves()))
    groups = max(1, -(-docs.count() // (group_rows * shards)))
    spread = F.pmod(F.xxhash64(F.lit("group"), "doc_id", "size", "text_crc32"), F.lit(groups))
    rows = stored(rows.select("*", place(F.col("doc_id"), root).alias("shard"), spread.alias("group")))
    counts = rows.groupBy("shard", "group").count()
    # At most one row per shard and group, which are few beside the rows.
    before = F.sum("count").over(Window.partitionBy("shard").orderBy("group")) - F.col("count")
    starts = counts.select("shard", "group", before.alias("start"))
    inside = F.row_number().over(Window.partitionBy("shard", "group").orderBy("doc_id", "size", "text_crc32")) - 1
    return rows.withColumn("inside", inside).join(starts, ["shard", "group"]).select(
        "doc_id", "size", "text_crc32", "shard", (F.col("start") + F.col("inside")).cast("bigint").alias("slot"))


@query("op5_weighted_hash_tree")
def _op5(spark, sf_dir):
    root = tree(40)
    return assign(read(spark, sf_dir, "documents"), root).select(
        "doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot",
        place(F.col("doc_id"), grown(root)).alias("grown_shard"))
