"""Connected components of an edge table by alternating large-star and small-star rounds.

Each round is joins and aggregates on node ids, with a number of rounds that grows with the logarithm of the
graph (Kiveris et al., Connected Components in MapReduce and Beyond, SoCC 2014). The minimum over a node's neighbours
is pre-aggregated, and given back to the links by broadcast, all of them where nodes are few, else those of hubs, so
that no task holds all links of one node. A round is one short plan for few nodes and two for many: the driver holds
the plan, the tasks and the states of every round, whatever the size of the tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leadweave.storage import materialise


#: Most nodes of which all least neighbours (two ids a row) are broadcast.
FEW_NODES = 200_000
#: A node of more links is a hub, and of one part in so many of all links; so there are twice HUBS at most.
HUB_LINKS, HUBS = 1000, 10_000


def _least(rows: DataFrame) -> DataFrame:
    """u, m, n, open of rows (u, v): the least of u and its neighbours, how many rows, and whether u has links to move.

    A root has greater neighbours alone, a leaf a single one, a smaller one. If all nodes are such, rows given from both
    ends are stars about their least nodes.
    """
    low, high = F.min("v"), F.max("v")
    settled = (low > F.col("u")) | ((low == high) & (low < F.col("u")))
    return rows.groupBy("u").agg(F.least(low, F.col("u")).alias("m"), F.count("*").alias("n"), (~settled).alias("open"))


def _with_least(rows: DataFrame, least: DataFrame, nodes: int, total: int) -> DataFrame:
    """rows (u, v) of `total` links, each once or from both ends, with m of `least`, which has no more than `nodes` rows."""
    if nodes <= FEW_NODES:
        return rows.join(F.broadcast(least.select("u", "m")), "u")
    bound = max(HUB_LINKS, total // HUBS)
    if total <= bound:  # no node has more links than there are
        return rows.join(least.select("u", "m").hint("merge"), "u")
    hubs = F.broadcast(least.filter(F.col("n") > bound).select("u", "m"))
    others = rows.join(hubs, "u", "left_anti").join(least.filter(F.col("n") <= bound).select("u", "m").hint("merge"), "u")
    return rows.join(hubs, "u").unionByName(others)


def _both_ends(edges: DataFrame) -> DataFrame:
    return edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))


def _large_star(edges: DataFrame, nodes: int, total: int) -> DataFrame:
    """Links from each node to the least neighbour of its smaller neighbours, so u > v."""
    both = _both_ends(edges)
    return _with_least(both, _least(both), nodes, total).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(down: DataFrame, nodes: int, total: int) -> DataFrame:
    """Links of u > v moved to the least v of each u; no more rows than before."""
    least = _least(down)
    moved = _with_least(down, least, nodes, total).filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v")))


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", rounds: int = 64) -> DataFrame:
    """node, component: every node of the edges with the smallest node of its component.

    Edges have no direction; loops and repeated edges don't matter, edges with a null end are left out. Raises if
    `rounds` rounds don't suffice.
    """
    edges = edges.select(F.col(src).alias("u"), F.col(dst).alias("v")).filter("u IS NOT NULL AND v IS NOT NULL")
    given = materialise(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    edges = given.filter("u <> v")
    for _ in range(rounds):
        least = _least(_both_ends(edges))
        nodes, ends, unsettled = least.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0)), F.count_if("open")).first()
        if not unsettled:
            loops = given.filter("u = v").select("u", F.col("v").alias("m"))
            labels = least.select("u", "m") if loops.isEmpty() else least.select("u", "m").unionByName(loops).groupBy("u").agg(F.min("m").alias("m"))
            return materialise(labels.toDF("node", "component"), "components")
        down = _large_star(edges, nodes, ends // 2)
        if nodes > FEW_NODES:  # the plan would hold its joins several times
            down = materialise(down.distinct(), "edges")
        edges = materialise(_small_star(down, nodes, ends // 2), "edges")
    raise RuntimeError(f"components did not settle in {rounds} rounds")


def grow_components(labels: DataFrame, links: DataFrame, src: str = "src", dst: str = "dst") -> tuple[DataFrame, DataFrame]:
    """labels (node, component) after further links, for the labelled nodes and those that the links add; and what moved.

    The links are contracted to the components that their ends have so far, so that only components that join run
    through the rounds. What moved: node and component of these, in terms of the former components.
    """
    of = lambda k: labels.select(F.col("node").alias(k), F.col("component").alias(f"part_{k}")).hint("merge")
    ends = links.select(F.col(src).alias("u"), F.col(dst).alias("v")).filter("u IS NOT NULL AND v IS NOT NULL")
    ends = ends.join(of("u"), "u", "left").join(of("v"), "v", "left").select("u", "v", F.coalesce("part_u", "u").alias("part_u"), F.coalesce("part_v", "v").alias("part_v"))
    ends = materialise(ends, "contracted")
    moved = connected_components(ends.filter("part_u <> part_v"), "part_u", "part_v")
    new = ends.select(F.col("u").alias("node"), F.col("part_u").alias("component")).unionByName(ends.select(F.col("v").alias("node"), F.col("part_v").alias("component")))
    every = labels.select("node", "component").unionByName(new).distinct()
    to = moved.select(F.col("node").alias("component"), F.col("component").alias("new")).hint("merge")
    grown = every.join(to, "component", "left").select("node", F.coalesce("new", "component").alias("component"))
    return materialise(grown, "components"), moved.filter("node <> component")
