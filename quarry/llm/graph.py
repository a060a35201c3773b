"""Connected components of a large set of links: alternating large-star and small-star steps on written tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import Tables

#: Rounds after which something is wrong: each round at least halves the depth of what is left.
MOST_ROUNDS = 60


def _star(tables: Tables, links: DataFrame, name: str, large: bool) -> DataFrame:
    """One step over links (a, b), a > b. Of each node's links goes on what its smallest neighbour, or it itself, makes of them.

    The smallest neighbours are written first: the join then has a plain exchange on either side, so a node with a
    large part of all links (the smallest member of a large group) is split over tasks by adaptive execution.
    """
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else links
    least = tables.keep(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")), f"{name}-least")
    joined = both.join(least, "a")
    if large:
        out = joined.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
    out = tables.keep(out.where("a <> b").distinct(), name)
    tables.drop(f"{name}-least")
    return out


def components(tables: Tables, links: DataFrame) -> DataFrame:
    """(node, component): for each node of a link (columns a and b, any order, repeats welcome) the smallest node it reaches.

    Links of a node with itself or with null say nothing. No links: empty result.
    """
    now = tables.keep(
        links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links-0"
    )
    told = None
    for k in range(1, MOST_ROUNDS):
        mark = now.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.lit(0))).first()
        if mark == told or not mark[0]:
            break
        told = mark
        big = _star(tables, now, f"large-{k}", True)
        then = _star(tables, big, f"links-{k}", False)
        tables.drop(f"large-{k}", f"links-{k - 1}")
        now = then
    else:
        raise RuntimeError("the components of the links did not settle")
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
        now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    )
