"""Connected components of an edge table by alternating star operations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stockloom.llm.storage import Scratch


def _directed(edges: DataFrame) -> DataFrame:
    """Distinct edges from the larger node to the smaller."""
    return (
        edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        .where("a > b")
        .distinct()
    )


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """``node, component`` for every node of the edges (``a``, ``b``, long): the smallest node
    that can be reached.

    Each round links the larger neighbours of a node, then the smaller ones, to the least node
    around it; it ends when nothing changes, after a number of rounds that grows with the logarithm
    of the nodes. Rounds are written to the shared folder. Minima are combined before shuffling.
    """
    current = scratch.store(_directed(edges))
    state = _state(current)
    while state[0]:
        both = current.unionByName(current.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.where("a > b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        start = F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b"))
        small = large.join(least, "a").select(start.alias("a"), F.col("m").alias("b")).distinct()
        previous, current = state, scratch.store(small)
        state = _state(current)
        if state == previous:
            break
    roots = current.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return current.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)
