"""Connected components of a table of links, without bringing links to the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, written


def connected(links: DataFrame) -> DataFrame:
    """(v, root) for each vertex of ``links`` (a long, b long): equal roots where vertices are connected.

    Each round moves every vertex to the least of itself and its neighbours by a hash of their ids and links what they
    moved to; the hash lets long chains shrink by a constant share a round. A vertex with many links meets no task alone:
    minima are combined before the shuffle, and the joins are with written tables, whose skewed partitions Spark splits.

    Cases: repeated links and links of a vertex with itself change nothing (a vertex with only such links has no row); a link
    with a null end is none; an empty table gives an empty one; roots are vertices, which one of a component isn't stated.
    """
    edges = written(links.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    roots = None
    while not edges.isEmpty():
        both = edges.union(edges.select("b", "a"))
        rank = lambda c: F.struct(F.xxhash64(c).alias("h"), F.col(c).alias("v"))
        moves = written(both.groupBy("a").agg(F.least(F.min(rank("b")), F.first(rank("a"))).getField("v").alias("to")).withColumnRenamed("a", "v"))
        before = (edges, roots)
        if roots is None:
            first = moves
            roots = moves.select("v", F.col("to").alias("root"))
        else:
            after = moves.select(F.col("v").alias("root"), "to")
            roots = written(roots.join(after, "root", "left").select("v", F.coalesce("to", "root").alias("root")))
        one, two = (moves.select(F.col("v").alias(c), F.col("to").alias(f"{c}_to")) for c in "ab")
        moved = edges.join(one, "a").join(two, "b").where("a_to <> b_to")
        edges = written(moved.select(F.least("a_to", "b_to").alias("a"), F.greatest("a_to", "b_to").alias("b")).distinct())
    return edges.select(F.col("a").alias("v"), F.col("b").alias("root")) if roots is None else roots
