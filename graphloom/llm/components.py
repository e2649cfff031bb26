"""Connected components of an edge frame, without ever gathering edges or components on the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import cut


def connected_components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(id, component) for every id of edges(a, b): the smallest id that can be reached.

    Alternating large-star and small-star steps. Both are a minimum by key (aggregated before the shuffle) and a join
    that adaptive execution can split, so a hub with a third of all edges is no unbounded group. Each round is written
    to the shared folder. Self loops and repeated edges do no harm; an empty frame gives an empty result.
    """
    pairs = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct()
    stars = cut(pairs, "pairs")
    for _ in range(most_rounds):
        if settled(stars):
            break
        # large star: every neighbour above u joins the smallest of u and its neighbours
        both = stars.unionByName(stars.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        # small star: u and its smaller neighbours join the smallest of them
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v"))).filter("u <> v").distinct()
        stars = cut(small, "stars")
    else:
        raise RuntimeError("components did not settle")
    return stars.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(stars.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())


def settled(stars: DataFrame) -> bool:
    """Whether every id has one edge down, to an id that has none."""
    down = stars.select(F.col("u").alias("id"), F.lit(1).alias("down"), F.lit(0).alias("up"))
    up = stars.select(F.col("v").alias("id"), F.lit(0).alias("down"), F.lit(1).alias("up"))
    ends = down.unionByName(up).groupBy("id").agg(F.sum("down").alias("down"), F.max("up").alias("up"))
    return ends.filter("down > 1 or (down = 1 and up = 1)").isEmpty()


class Groups:
    """Union-find over the numbers 0..n-1 within one task."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, x: int) -> int:
        up = self.up
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    def join(self, x: int, y: int) -> bool:
        x, y = self.root(x), self.root(y)
        if x == y:
            return False
        self.up[max(x, y)] = min(x, y)
        return True

    def stars(self, members) -> list[tuple[int, int]]:
        """(root, member) for each of the members that is not a root; roots are the smallest numbers."""
        return [(r, x) for x in members if (r := self.root(x)) != x]
