"""Connected components of an undirected graph by repeated contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from martwright.llm.common import stored


def _relabel(frame: DataFrame, column: str, parents: DataFrame) -> DataFrame:
    """Replace a node column by its parent; nodes without one stay.

    A hub's rows are on the left of a plain join, which adaptive execution splits.
    """
    to = parents.select(F.col("node").alias("_node"), F.col("parent").alias("_parent"))
    return (
        frame.join(to, frame[column] == F.col("_node"), "left")
        .withColumn(column, F.coalesce("_parent", column))
        .drop("_node", "_parent")
    )


def components(edges: DataFrame) -> DataFrame:
    """``(node, root)`` of every node of the edges ``(a, b)``.

    Each round points every node at the smallest node of its closed neighbourhood,
    jumps those pointers twice, and replaces the edges by the distinct edges between
    the nodes pointed at. All but local minima vanish each round. The root is the
    smallest node of the component. Edges with a NULL end and self-loops are ignored;
    no edges give no rows. Every round is stored in the shared folder.
    """
    left = edges.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    left = stored(left.distinct(), "edges")
    roots = left.select(F.col("a").alias("node"), F.col("a").alias("root")).limit(0)
    first = True
    while not left.isEmpty():
        both = left.union(left.select("b", "a"))
        parents = stored(
            both.groupBy(F.col("a").alias("node")).agg(
                F.least("node", F.min("b")).alias("parent")
            ),
            "parents",
        )
        for _ in range(2):
            parents = _relabel(parents, "parent", parents)
        parents = stored(parents, "parents")
        if first:
            roots = parents.withColumnRenamed("parent", "root")
        else:
            roots = _relabel(roots, "root", parents)
        roots = stored(roots, "roots")
        first = False
        moved = _relabel(_relabel(left, "a", parents), "b", parents).filter("a <> b")
        left = stored(
            moved.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(),
            "edges",
        )
    return roots
