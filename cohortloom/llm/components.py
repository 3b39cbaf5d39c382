"""Connected components of an edge table, by alternating large-star and small-star steps.

Every step is one aggregate and one join over edges; each one is written to the
checkpoint folder. Nothing but two numbers a round reaches the driver. Few edges
go to few partitions (see EDGES): a round has some ten exchanges, and each would
else write a file or more for every partition of the session.

A node with very many edges is summed map-side, and its edges meet their new
end in a plain join of two exchanges, which Spark can split where a key has too
many rows: the aggregate's own partitioning is not reused there (see met).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut


#: Edges for which one partition is enough.
EDGES = 1 << 17


def met(rows: DataFrame, key: str, ends: DataFrame) -> DataFrame:
    """rows joined with ends (_key and more) on their key column, and on a hash of it.

    With the hash both sides are dealt anew, whatever partitioning they have, so Spark can split a key with too many rows.
    """
    marked = ends.withColumn("_mark", F.xxhash64("_key"))
    return rows.join(marked, (F.col(key) == F.col("_key")) & (F.xxhash64(key) == F.col("_mark"))).drop("_key", "_mark")


def star(edges: DataFrame, large: bool, parts: int) -> DataFrame:
    """edges (u, v) with u > v, in so many partitions at most. Large: each node's larger neighbours go to its least neighbour (or itself).
    Small: each node and its smaller neighbours go to the least of them."""
    around = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else edges
    least = around.groupBy("u").agg(F.min("v").alias("m")).coalesce(parts)
    ends = least.select(F.col("u").alias("_key"), F.least("u", "m").alias("m") if large else "m")
    joined = met(around.where("v > u") if large else around, "u", ends).select(F.col("v").alias("u"), F.col("m").alias("v")).coalesce(parts)
    moved = joined if large else joined.where("u != v").unionByName(least.select("u", F.col("m").alias("v")))
    return moved.distinct().coalesce(parts)


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for each node that has an edge; root is the least node of its component. edges: columns a, b of long."""
    now = cut(edges.where("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    mark = None
    while True:
        seen = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(seen) == mark or not seen[0]:
            break
        mark, parts = tuple(seen), 1 + seen[0] // EDGES
        now = cut(star(cut(star(now.coalesce(parts), True, parts)), False, parts))
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root"))).distinct()


def labelled(members: DataFrame, root: DataFrame) -> DataFrame:
    """node, component_id, winner of all nodes of members (doc_id, node); root: (node, root) of those that have an edge.

    component_id: the component's smallest doc_id (null if it has none); winner: the node that has it, the least if several do.
    """
    own = cut(members.groupBy("node").agg(F.min("doc_id").alias("least")))
    linked = cut(own.join(root, "node"))
    top = linked.groupBy("root").agg(F.min(F.struct(F.col("least").isNull().alias("none"), "least", F.col("node").alias("winner"))).alias("top"))
    top = top.select(F.col("root").alias("_key"), F.col("top.least").alias("component_id"), "top.winner")
    found = met(linked, "root", top).select(F.col("node").alias("_node"), "component_id", "winner")
    both = own.join(found, F.col("node") == F.col("_node"), "left")
    return both.select("node", F.when(F.col("_node").isNotNull(), F.col("component_id")).otherwise(F.col("least")).alias("component_id"), F.coalesce("winner", "node").alias("winner"))


def with_labels(rows: DataFrame, key: str, labels: DataFrame) -> DataFrame:
    """rows with component_id and winner of the node in column key."""
    return met(rows, key, labels.withColumnRenamed("node", "_key"))


def without_repeats(docs: DataFrame, groups: DataFrame, text_hash: Column) -> DataFrame:
    """docs with one document of each component; columns stay as they are.

    groups: doc_id, hash (of the text), stays. Rows are told by doc_id and text_hash, so an id that occurs with unlike texts loses
    only those that are repeats. Rows without doc_id stay.
    """
    gone = cut(groups.where("NOT stays AND doc_id IS NOT NULL").select(F.col("doc_id").alias("_gone_id"), F.col("hash").alias("_gone_hash")).distinct())
    return docs.join(gone, (docs["doc_id"] == gone["_gone_id"]) & (text_hash == gone["_gone_hash"]), "left_anti")
