"""Connected components of links between any two columns of one orderable type."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from landfold.tables import components


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", native: bool = False) -> DataFrame:
    """(node, component) for every node of an edge; component is the smallest node reachable.

    Edges with a null end and loops are ignored, repeated edges count once, no edges give no rows. Nodes without an
    edge are not listed. native: by rounds of joins and aggregates however small the graph, without Python workers.
    """
    ends = edges.select(F.col(a).alias("a"), F.col(b).alias("b"))
    return components(ends.where(F.col("a").isNotNull() & F.col("b").isNotNull()), -1 if native else None)
