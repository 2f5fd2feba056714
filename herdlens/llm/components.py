"""Connected components of an edge table by contraction; nothing but counts reaches the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from herdlens.llm.common import dropped, written


def components(edges: DataFrame) -> DataFrame:
    """(vertex, root) for every vertex of ``edges`` (a, b); the root is a vertex of the component.

    Each round every vertex moves to the smallest vertex it touches, chains are shortened, and edges are drawn between
    the new places; edges inside one place go. Minima are partial aggregates, so a hub with many edges is no hot group.
    """
    both = edges.select("a", "b").where("a <> b").distinct()
    live = written(both, "edges")
    placed = live.select(F.col("a").alias("vertex")).union(live.select("b")).distinct().select("vertex", F.col("vertex").alias("root"))
    made: list[DataFrame] = []  # what the round before has read last
    while True:
        turned = live.union(live.select(F.col("b").alias("a"), F.col("a").alias("b")))
        move = turned.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("v"), F.least("a", "b").alias("to"))
        move = written(move, "moves")  # a root has many places: its join can be split only if both sides come from a shuffle
        for _ in range(2):
            nxt = move.select(F.col("v").alias("to"), F.col("to").alias("further"))
            further = written(move.join(nxt, "to", "left").select("v", F.coalesce("further", "to").alias("to")), "moves")
            dropped(move)
            move = further
        before = made
        made = [live, move]
        placed = written(
            placed.join(move.withColumnRenamed("v", "root"), "root", "left").select("vertex", F.coalesce("to", "root").alias("root")), "places"
        )
        made.append(placed)
        a = move.select(F.col("v").alias("a"), F.col("to").alias("x"))
        b = move.select(F.col("v").alias("b"), F.col("to").alias("y"))
        live = written(
            live.join(a, "a").join(b, "b").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).where("a <> b").distinct(), "edges"
        )
        dropped(*before)
        if live.isEmpty():
            dropped(live, *made[:2])
            return placed
