"""Sharding by a hierarchical weighted hash tree: region, then rack, then shard. DataFrame functions only."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Rows that one slot-numbering group holds on average.
GROUP_ROWS = 20_000


@dataclass
class Node:
    """A node of the tree. Its name takes part in its draws; the weight of an inner node is the sum of its children's."""

    name: str
    weight: float = 1.0
    shard: int | None = None
    children: list[Node] = field(default_factory=list)

    @property
    def total(self) -> float:
        return sum(c.total for c in self.children) if self.children else self.weight


def tree(shards: int, base: int = 40, racks_of: int = 5, regions_of: int = 4) -> Node:
    """A tree of equal shards: racks of `racks_of` shards, regions of `regions_of` racks, up to `base` shards. Each shard past
    the base opens a region of its own: the weights of the other regions stay, so rows move into the new shard only."""
    root, per = Node("root"), racks_of * regions_of
    for s in range(shards):
        r, k = (s // per, s % per // racks_of) if s < base else (f"+{s}", 0)
        region = f"region{r}"
        if not root.children or root.children[-1].name != region:
            root.children.append(Node(region))
        racks = root.children[-1].children
        if not racks or racks[-1].name != f"{region}/rack{k}":
            racks.append(Node(f"{region}/rack{k}"))
        racks[-1].children.append(Node(f"shard{s}", shard=s))
    return root


def _listed(root: Node) -> list[Node]:
    out = [root]
    for n in out:
        out += n.children
    return out


def place(rows: DataFrame, key: str, root: Node, out: str) -> DataFrame:
    """rows with `out`, the shard of the column `key`: from the root, each level enters the child with the greatest weighted draw.

    A draw is ln(u) / weight, u in (0, 1] from a hash of the key and the child's name: it depends on that child alone, so a
    change of weight moves rows into or out of that child only. Children of no weight get nothing. The tree is a few
    constant arrays in the plan, and a level costs as many draws as its widest node has children.
    """
    nodes = _listed(root)
    at = {id(n): i for i, n in enumerate(nodes)}
    # a leaf is its own child, so that shorter branches wait for longer ones
    live = [[at[id(c)] for c in n.children if c.total > 0] or [i] for i, n in enumerate(nodes)]
    kids = F.array(*[F.array(*[F.lit(c) for c in x]) for x in live])
    names, weights = F.array(*[F.lit(n.name) for n in nodes]), F.array(*[F.lit(float(n.total) or 1.0) for n in nodes])

    def draw(child):
        u = (F.shiftrightunsigned(F.xxhash64(F.col(key), F.get(names, child)), 11) + F.lit(1)).cast("double") / F.lit(float(1 << 53))
        return F.struct((F.log(u) / F.get(weights, child)).alias("draw"), child.alias("child"))

    node, level = F.lit(0), [0]
    while any(n.children for n in (nodes[i] for i in level)):
        node = F.array_max(F.transform(F.get(kids, node), draw))["child"]
        level = [c for n in level for c in live[n] if c != n]
    return rows.withColumn(out, F.get(F.array(*[F.lit(n.shard) for n in nodes]).cast("array<int>"), node))


#: Shards that a tree begins with, if it is not told otherwise.
BASE = 40


def assign(docs: DataFrame, shards: int = 40, id_col: str = "doc_id", text_col: str = "text", base: int | None = None) -> DataFrame:
    """Shards under the law `key`: doc_id and the shard count decide.

    `base` is how many shards there were at first, BASE or all of fewer; each later one takes rows into itself only. Who begins with
    fewer than BASE shards and adds some gives the same base every time.

    Returns one row for each input row: doc_id, size (UTF-8 bytes of the text, null as none, plus 16), text_crc32, law,
    shard, slot (gapless from 0 in each shard, by doc_id within hashed groups), grown_shard (with one more shard). Rows
    with a null doc_id share the shard of the null key; repeated rows share a shard and get slots of their own; an empty
    table gives no rows; other columns are not read. Slots come from counts of small groups, never from one sort of a
    whole shard, and equal texts, however many, are spread by doc_id.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), (F.octet_length(text) + F.lit(16)).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    first = min(shards, BASE) if base is None else base
    rows = place(place(rows, "doc_id", tree(shards, first), "shard"), "doc_id", tree(shards + 1, first), "grown_shard")
    groups = 1 + docs.count() // (GROUP_ROWS * shards)
    rows = rows.withColumn("part", F.pmod(F.xxhash64("doc_id", "text_crc32"), F.lit(groups)))
    return _slots(rows).select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


def _slots(rows: DataFrame) -> DataFrame:
    counts = rows.groupBy("shard", "part").count()
    before = F.coalesce(F.sum("count").over(Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = counts.select("shard", "part", before.alias("first"))
    number = F.row_number().over(Window.partitionBy("shard", "part").orderBy("doc_id", "text_crc32", "size"))
    return rows.withColumn("n", number).join(starts, ["shard", "part"]).withColumn("slot", (F.col("first") + F.col("n") - 1).cast("long"))
