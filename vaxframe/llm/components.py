"""Connected components of a table of links, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vaxframe.sources.scratch import stage

MAX_ROUNDS = 60


def _stamp(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root): for every node of a link the smallest node that it reaches. Null ends are ignored; no links give no rows.

    Each round points neighbours at the smallest node they see; minima are combined before they are
    shuffled, so a node with very many links is no bottleneck. Rounds grow with the logarithm of the
    longest chain. Each round's table is written, so a lost executor repeats one round at most.
    """
    edges = stage(
        links.selectExpr(f"greatest({a}, {b}) as u", f"least({a}, {b}) as v", f"{a} as x", f"{b} as y")
        .where("x is not null and y is not null and u <> v").select("u", "v").distinct(), "links")
    stamp = _stamp(edges)
    for _ in range(MAX_ROUNDS):
        if not stamp[0]:
            break
        both = edges.unionByName(edges.selectExpr("v as u", "u as v"))
        low = both.groupBy("u").agg(F.min("v").alias("m")).selectExpr("u", "least(u, m) as m")
        large = both.join(low, "u").where("v > u").selectExpr("v as u", "m as v").distinct()
        floor = large.groupBy("u").agg(F.min("v").alias("m"))
        moved = large.join(floor, "u")
        small = moved.where("v <> m").selectExpr("v as u", "m as v").unionByName(floor.selectExpr("u", "m as v")).distinct()
        edges = stage(small, "links")
        before, stamp = stamp, _stamp(edges)
        if stamp == before:
            break
    else:
        raise RuntimeError("components did not settle")
    return edges.selectExpr("u as node", "v as root").unionByName(edges.selectExpr("v as node", "v as root").distinct())
