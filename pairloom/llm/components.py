"""Connected components of a link table; nothing but counts reaches the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import graph


def connected_components(links: DataFrame) -> DataFrame:
    """(node, root) for every endpoint of ``links`` (a, b; any orientation, repeats and loops allowed); root is the least node
    of the component."""
    found = graph.components(links.select(F.col("a").alias("id1"), F.col("b").alias("id2")))
    return found.select(F.col("id").alias("node"), F.col("component_id").alias("root"))
