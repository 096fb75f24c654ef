"""Connected components of a link table, by alternating star contraction.

Every round hangs neighbours under the smallest node they know (large star, then
small star); both steps are a min-aggregation with map-side combine and a join, so
that a node with very many links is split among tasks. Rounds are written to the
shared folder, each dropped when the next is there; the driver sees one checksum a round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_scratch, kept


def _stars(links: DataFrame, large: bool) -> DataFrame:
    """links: (u, v), each pair once with u > v."""
    if large:
        near = links.union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = near.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        moved = near.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        least = links.groupBy("u").agg(F.min("v").alias("m"))
        moved = links.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        moved = moved.union(least.select("u", F.col("m").alias("v")))
    return moved.where("u > v").distinct()


def connected_components(links: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """``(node, root)`` for every node with a link to another; root is the smallest
    node of its component (a root has a row too).

    Null ends, self links and repeated links are ignored; no links give no rows.
    """
    links = links.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a <> b")
    now, path = kept(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links")
    seen = None
    for _ in range(max_rounds):
        digest = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if (digest["n"], digest["h"]) == seen or not digest["n"]:
            break
        seen = (digest["n"], digest["h"])
        before = path
        now, path = kept(_stars(_stars(now, True), False), "links")
        drop_scratch(now.sparkSession, before)
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = now.select(F.col("v").alias("node")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(roots.select("node", F.col("node").alias("root")))
