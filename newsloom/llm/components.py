"""Connected components of a link table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpoint, shuffles_removed

#: Links that make a vertex a hub, and hubs at most: with more links the bar rises, so the table of hubs has a proven bound.
HUB_LINKS, MOST_HUBS = 500, 100_000


def _with_least(seen: DataFrame, n_links: int) -> DataFrame:
    """seen (u, v) with m, the smallest of u and its neighbours.

    The smallest neighbour comes from an aggregation. Links of hubs meet it by a broadcast of at most MOST_HUBS rows and stay
    where they are, the others by an equality join, so no vertex is a group that one task must hold.
    """
    least = seen.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).withColumn("m", F.least("u", "m"))
    bar = max(HUB_LINKS, 2 * n_links // MOST_HUBS)
    hubs = F.broadcast(least.where(F.col("n") > bar).select("u", "m"))
    of_hubs = seen.join(hubs, "u")
    others = seen.join(hubs.select("u"), "u", "left_anti").join(least.where(F.col("n") <= bar).select("u", "m"), "u")
    return of_hubs.unionByName(others)


def _stars(links: DataFrame, small: bool, n_links: int) -> DataFrame:
    """One star contraction of links (u > v): each u's neighbours are linked to the smallest of them.

    The large star looks at all neighbours and moves the larger ones, the small star only at the smaller ones.
    """
    seen = links if small else links.union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    met = _with_least(seen, n_links)
    if small:
        moved = met.select(F.col("v").alias("u"), F.col("m").alias("v")).union(met.select("u", F.col("m").alias("v")))
    else:
        moved = met.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.where("u <> v").distinct()


def connected_components(links: DataFrame) -> DataFrame:
    """(u, root) for every vertex of links (u, v) but the roots themselves; a root is the smallest vertex of its component.

    Links may be in either direction, repeated or loops; links with a null are ignored. Large and small stars alternate
    until the links no longer change, a number of rounds that grows with the logarithm of the vertices. Each round is
    written to the checkpoint folder; only a count and a checksum come to the driver.
    """
    now = checkpoint(links.where("u is not null and v is not null and u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())

    def state(df: DataFrame) -> tuple:
        with shuffles_removed(df.sparkSession):
            return tuple(df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    was, is_now = None, state(now)
    while was != is_now and is_now[0]:
        large = checkpoint(_stars(now, small=False, n_links=is_now[0]))
        now = checkpoint(_stars(large, small=True, n_links=is_now[0]))
        was, is_now = is_now, state(now)
    return now.select("u", F.col("v").alias("root"))
