"""Connected components of an edge table by alternating large-star and small-star rounds.

Each round is a map-side aggregated minimum per node and one join; the edge
table is written to the shared folder after it, so the lineage stays short
and nothing but a row count and a checksum reaches the driver.  The join
that hands a node's minimum to its edges reads two written tables, so
adaptive execution can split a hub's edges over tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hourglass.session import materialize, release


def _lowest(edges: DataFrame) -> DataFrame:
    return materialize(edges.groupBy("a").agg(F.min("b").alias("low")), "star-low")


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first())


def connected_components(edges: DataFrame) -> DataFrame:
    """``edges`` (a, b: long) to (node, label): label is the smallest node of the component.

    Self-edges and rows with a null are ignored, repeated edges count once;
    no edges give no rows.
    """
    proper = edges.where("a != b")
    edges = materialize(proper.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    mark = _mark(edges)
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = _lowest(both)
        large = materialize(
            both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.least("low", "a").alias("b"))
            .distinct(), "large-star")
        release(low, edges)
        low = _lowest(large)
        hung = large.join(low, "a").where("b != low").select(F.col("b").alias("a"), F.col("low").alias("b"))
        edges = materialize(hung.unionByName(low.select("a", F.col("low").alias("b"))).distinct(), "small-star")
        release(low, large)
        new = _mark(edges)
        if new == mark:
            break
        mark = new
    roots = edges.select(F.col("b").alias("node"), F.col("b").alias("label")).distinct()
    return edges.select(F.col("a").alias("node"), F.col("b").alias("label")).unionByName(roots)
