"""Connected components of a graph given as a table of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabprobe.llm._common import stored


def connected_components(edges: DataFrame, most_rounds: int = 100) -> DataFrame:
    """(node, root) for every node of ``edges`` (columns ``a``, ``b``); root is the component's smallest node.

    Alternating large-star and small-star rounds (Kiveris et al., "Connected Components in MapReduce and
    Beyond", 2014), each stored in the shared folder; edges and nodes stay on the executors. Loops and
    repeated edges are harmless; edges with a null end are ignored.
    """
    links = stored(edges.dropna(subset=["a", "b"]).filter("a <> b")
                   .select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    state = _state(links)
    for _ in range(most_rounds):
        if state[0] == 0:
            break
        links = stored(_small_star(_large_star(links)), "stars")
        new = _state(links)
        if new == state:
            break
        state = new
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    children = links.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return children.unionByName(links.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def _state(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first())


def _large_star(links: DataFrame) -> DataFrame:
    both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(links: DataFrame) -> DataFrame:
    least = links.groupBy("u").agg(F.min("v").alias("m"))
    moved = links.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return least.select("u", F.col("m").alias("v")).unionByName(moved).distinct()
