"""Connected components of a graph given as a table of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from peerglass.sources.tables import durable


def _mapped(df: DataFrame, column: str, to: DataFrame) -> DataFrame:
    """Replaces a column's values by their root, where they have one."""
    look = to.select(F.col("node").alias("_node"), F.col("root").alias("_root")).hint("merge")
    return (
        df.join(look, F.col(column) == F.col("_node"), "left")
        .withColumn(column, F.coalesce("_root", column))
        .drop("_node", "_root")
    )


def roots(edges: DataFrame) -> DataFrame:
    """(node, root): every node of edges (a, b) that is not the least of its component.

    Each pass points every node at its least neighbour, follows these pointers to
    their end, and replaces nodes by what they point to; edges inside a component
    vanish. Pointers go to lesser nodes, so they form trees. Groups are reduced by
    partial minima, so a node with very many edges is no hot spot. All tables here grow
    with the graph, so none is broadcast, however small its file is.
    """
    found, edges = None, edges.select("a", "b").where("a != b")
    while True:
        step = durable(
            edges.groupBy(F.greatest("a", "b").alias("node")).agg(
                F.min(F.least("a", "b")).alias("root")
            ),
            "component-steps",
        )
        while not step.join(
            step.select(F.col("node").alias("root")).hint("merge"), "root", "left_semi"
        ).isEmpty():
            step = durable(_mapped(step, "root", step), "component-steps")
        found = step if found is None else _mapped(found, "root", step).unionByName(step)
        edges = durable(
            _mapped(_mapped(edges, "a", step), "b", step).where("a != b").distinct(),
            "component-edges",
        )
        if edges.isEmpty():
            return durable(found, "component-roots")
