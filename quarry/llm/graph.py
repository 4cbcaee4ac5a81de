"""Connected components of an edge table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry import storage
from quarry.llm.common import join_heavy, materialise


def components(edges: DataFrame) -> DataFrame:
    """(a, b) to (node, root): root is the least node of the component. Roots themselves have no row.

    Each round rewrites the edges to point at smaller nodes and is written to the shared folder. The
    edges never outnumber those given. Edges of a hub are not gathered. An empty table gives an empty result.
    """
    out = storage.shared_folder(edges.sparkSession)
    with storage.scope(edges.sparkSession):
        found = _rooted(materialise(edges.filter("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges"))
        return storage.materialise(found.select(F.col("a").alias("node"), F.col("b").alias("root")), f"{out}/roots")


def _rooted(found: DataFrame) -> DataFrame:
    before = None
    while True:
        state = found.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first()
        if state == before:
            return found
        before = state
        both = found.unionByName(found.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n")).select("a", F.least("a", "m").alias("m"), "n")
        large = join_heavy(both, least, "a", "n", 2 * state[0]).filter("b > a AND b != m").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        large = materialise(large, "large")
        least = large.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n"))
        small = join_heavy(large, least, "a", "n", state[0]).filter("b != m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b"))).distinct()
        found = materialise(small, "small")
