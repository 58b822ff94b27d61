"""Connected components for the corpus operators, under their own column names."""

from __future__ import annotations

from pyspark.sql import DataFrame

from lorebank.operators.pairs import components


def connected_components(edges: DataFrame) -> DataFrame:
    """node and component (its smallest node) of every node of ``edges`` (two columns of type long).

    The engine's own components: alternating large-star and small-star steps, each written to the shared
    folder; only a count and a checksum reach the driver.
    """
    return components(edges.toDF("a", "b")).toDF("node", "component")
