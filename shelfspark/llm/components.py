"""Connected components of an edge table, by contraction.

Every round points each node at its smallest neighbour, shortens the pointers to their roots and
replaces the ends of all edges by roots. Each component at least halves its nodes per round, so
rounds grow with the logarithm of the largest component. All steps are joins and combinable
minima on written tables: no group is ever gathered, and a node with very many edges only makes
a skewed join, which adaptive execution splits.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfspark.llm.scratch import written


def _to_roots(parents: DataFrame) -> DataFrame:
    """Follow ``parent`` until it no longer changes; doubles the step each time."""
    while True:
        up = parents.select(F.col("id").alias("parent"), F.col("parent").alias("root"))
        moved = written(
            parents.join(up, "parent", "left").select(
                "id", F.coalesce("root", "parent").alias("parent"), (F.col("root") != F.col("parent")).alias("moved")
            ),
            "parents",
        )
        parents = moved.select("id", "parent")
        if moved.filter("moved").isEmpty():
            return parents


def components(edges: DataFrame) -> DataFrame:
    """``edges(a, b)`` to ``(id, root)``: one row per node that occurs in an edge between two different
    nodes; ``root`` is the same value for all nodes of a component, and is one of them.

    Edges with a null end and self-loops are ignored; repeated edges count once. No edges: no rows.
    """
    edges = written(
        edges.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges"
    )
    labels = None
    while labels is None or not edges.isEmpty():
        both = edges.union(edges.select("b", "a")).groupBy(F.col("a").alias("id")).agg(F.min("b").alias("near"))
        parents = written(both.select("id", F.least("id", "near").alias("parent")), "parents")
        parents = _to_roots(parents)
        if labels is None:
            labels = parents.select("id", F.col("parent").alias("root"))
        else:
            step = parents.select(F.col("id").alias("root"), "parent")
            labels = written(
                labels.join(step, "root", "left").select("id", F.coalesce("parent", "root").alias("root")), "labels"
            )
        of_a = parents.select(F.col("id").alias("a"), F.col("parent").alias("root_a"))
        of_b = parents.select(F.col("id").alias("b"), F.col("parent").alias("root_b"))
        edges = written(
            edges.join(of_a, "a")
            .join(of_b, "b")
            .filter("root_a <> root_b")
            .select(F.least("root_a", "root_b").alias("a"), F.greatest("root_a", "root_b").alias("b"))
            .distinct(),
            "edges",
        )
    return labels
