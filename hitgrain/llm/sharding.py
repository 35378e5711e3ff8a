"""Sharding by a hierarchical weighted hash tree.

A tree of regions, racks and shards has a weight at every node, the sum of the weights below it. A row descends it: at each
node every child draws ``-ln(u) / weight``, where ``u`` comes from a hash of the identifier and the child's name, and the
least draw takes the row. A draw depends on nothing but identifier, name and weight, so where weights change rows move
into or out of the changed subtrees only. A shard added as a region of its own (``grown``) takes rows only into itself.

Law ``key``: identifier and tree decide, nothing else. Shards get shares of the identifiers in proportion to their weights.

Scale: a descent makes a few hashes per level and never looks at other rows. Texts are shuffled once, into ranges of (shard,
identifier), each of which becomes files of its shard; a large shard has many ranges, also where one identifier
has a third of all rows, since ties part by the input partition a row came from. Slots come from row numbers within a range and the
counts of the ranges before it (one row per range and shard).

Defined results: a null text is empty. Rows with a null identifier share one shard, and so do rows that share an identifier;
within a shard they have slots of their own. Slots run by identifier, null first, then by text hash. Negative identifiers and
empty tables need no special case. A shard of weight 0 takes nothing. Other columns, whatever their names, stay inside ``row``.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from hitgrain.llm.common import ROW, text_or_empty, wrapped
from hitgrain.session import work_dir

HEAD_BYTES = 8
# Bytes of texts that one range holds, about.
RANGE_BYTES = 32 << 20


@dataclass(frozen=True)
class Node:
    """A region, a rack or a shard; ``shard`` is the number of a leaf, which has no children."""

    name: str
    children: tuple[Node, ...] = ()
    shard: int = -1
    own_weight: float = 1.0

    @property
    def weight(self) -> float:
        return sum(child.weight for child in self.children) if self.children else self.own_weight

    def leaves(self) -> list[Node]:
        return [leaf for child in self.children for leaf in child.leaves()] if self.children else [self]


def hash_tree(regions: int = 2, racks: int = 3, shards: int = 4, weight: float = 1.0) -> Node:
    """``regions`` x ``racks`` x ``shards`` shards of equal weight, numbered from 0."""

    def rack(r: int, k: int) -> Node:
        first = (r * racks + k) * shards
        leaves = tuple(Node(f"r{r}/k{k}/s{first + s}", (), first + s, weight) for s in range(shards))
        return Node(f"r{r}/k{k}", leaves)

    return Node("", tuple(Node(f"r{r}", tuple(rack(r, k) for k in range(racks))) for r in range(regions)))


def grown(tree: Node, weight: float = 1.0) -> Node:
    """The tree with one more shard, in a region of its own."""
    number = 1 + max(leaf.shard for leaf in tree.leaves())
    name = f"r{len(tree.children)}"
    rack = Node(f"{name}/k0", (Node(f"{name}/k0/s{number}", (), number, weight),))
    return replace(tree, children=(*tree.children, Node(name, (rack,))))


def reweighted(tree: Node, weights: dict[int, float]) -> Node:
    """The tree with other weights of some shards."""
    if tree.children:
        return replace(tree, children=tuple(reweighted(child, weights) for child in tree.children))
    return replace(tree, own_weight=weights.get(tree.shard, tree.own_weight))


def draw(key: Column, name: str, weight: float) -> Column:
    """Exponential of rate ``weight``, from a hash of key and name."""
    unit = (F.shiftrightunsigned(F.xxhash64(key, F.lit(name)), 11) + F.lit(0.5)) / F.lit(float(1 << 53))
    return -F.log(unit) / F.lit(weight)


def shard_of(key: Column, tree: Node) -> Column:
    """The shard that ``key`` (a long) descends to. Built-in functions only; branches not taken are not computed."""
    if not tree.children:
        return F.lit(tree.shard)
    open_children = [child for child in tree.children if child.weight > 0]
    if len(open_children) == 1:
        return shard_of(key, open_children[0])
    draws = [F.struct(draw(key, child.name, child.weight).alias("draw"), F.lit(i).alias("i")) for i, child in enumerate(open_children)]
    taken = F.least(*draws)["i"]
    # A map function keeps the drawn number as a variable, so that it is computed once and not once per branch.
    steps = F.transform(F.array(taken), lambda i: _chosen(i, key, open_children))
    return F.get(steps, F.lit(0))


def _chosen(i: Column, key: Column, children: list[Node]) -> Column:
    below = F.when(i == 0, shard_of(key, children[0]))
    for n, child in enumerate(children[1:], 1):
        below = below.when(i == n, shard_of(key, child))
    return below


def assign_shards(docs: DataFrame, tree: Node, text: str = "text", doc_id: str = "doc_id", more: Node | None = None) -> DataFrame:
    """``row`` (the input row), ``doc_id``, ``size``, ``law``, ``shard`` and ``grown_shard`` (the shard in the tree ``more``)."""
    key = F.col(ROW)[doc_id].cast("long")
    size = F.coalesce(F.octet_length(F.col(ROW)[text].cast("string")), F.lit(0)).cast("long") + HEAD_BYTES
    wide = grown(tree) if more is None else more
    return wrapped(docs).select(
        ROW,
        key.alias("doc_id"),
        size.alias("size"),
        F.lit("key").alias("law"),
        shard_of(key, tree).alias("shard"),
        shard_of(key, wide).alias("grown_shard"),
    )


def write_shards(assigned: DataFrame, path: str, text: str = "text", ranges: int | None = None) -> None:
    """One folder per shard below ``path``, its rows in files that ascend by slot.

    ``_place`` numbers the rows of each range in order; it ascends over the ranges too.
    """
    if ranges is None:
        total = assigned.agg(F.sum("size")).first()[0] or 0
        ranges = max(assigned.sparkSession.sparkContext.defaultParallelism, -(-int(total) // RANGE_BYTES))
    order = ["shard", "doc_id", "_tie", "_from"]
    (
        assigned.withColumn("_tie", F.xxhash64(text_or_empty(F.col(ROW)[text])))
        .withColumn("_from", F.spark_partition_id())
        .repartitionByRange(ranges, *order)
        .sortWithinPartitions(*order)
        .withColumn("_range", F.spark_partition_id())
        .withColumn("_place", F.monotonically_increasing_id())
        .drop("_tie", "_from")
        .write.partitionBy("shard")
        .parquet(path)
    )


def read_shards(spark: SparkSession, path: str, schema) -> DataFrame:
    """What ``write_shards`` wrote, with ``slot``: the place in the shard, gapless from 0."""
    stored = spark.read.schema(schema).parquet(path)
    # Rows of a shard stand together in each range that it touches.
    runs = stored.groupBy("shard", "_range").agg(F.count(F.lit(1)).alias("_count"), F.min("_place").alias("_first"))
    before = Window.partitionBy("shard").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    bases = runs.select("shard", "_range", (F.coalesce(F.sum("_count").over(before), F.lit(0)) - F.col("_first")).alias("_base"))
    # One row per range and shard it touches: at most as many as ranges and shards together.
    return (
        stored.join(F.broadcast(bases), ["shard", "_range"])
        .withColumn("slot", F.col("_base") + F.col("_place"))
        .drop("_range", "_place", "_base")
    )


def sharded_documents(
    docs: DataFrame, tree: Node, text: str = "text", doc_id: str = "doc_id", more: Node | None = None, ranges: int | None = None
) -> DataFrame:
    """Write the documents into shards in the shared folder and read them back with their slots."""
    assigned = assign_shards(docs, tree, text, doc_id, more)
    path = work_dir(docs.sparkSession, "shards")
    write_shards(assigned, path, text, ranges)
    schema = assigned.withColumn("_range", F.lit(0)).withColumn("_place", F.lit(0).cast("long")).schema
    return read_shards(docs.sparkSession, path, schema)


def shard_digests(sharded: DataFrame, text: str = "text") -> DataFrame:
    """``doc_id``, ``size``, ``text_crc32``, ``law``, ``shard``, ``slot`` and ``grown_shard``."""
    crc = F.crc32(text_or_empty(F.col(ROW)[text]).cast("binary"))
    return sharded.select("doc_id", "size", crc.alias("text_crc32"), "law", "shard", "slot", "grown_shard")
