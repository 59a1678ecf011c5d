"""Connected components of a table of links, by alternating small stars and large stars, in Spark."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factweir.llm.common import discard, prepare, written

#: Ids that a task holds while it contracts links; the stars found so far are given out beyond that.
HELD_IDS = 500_000
#: Links for which a task is started.
TASK_LINKS = 250_000


class Forest:
    """Union-find over ids; the smallest id of a tree is its top."""

    def __init__(self) -> None:
        self.up: dict[int, int] = {}

    def top(self, x: int) -> int:
        while (y := self.up.get(x, x)) != x:
            self.up[x] = self.up.get(y, y)
            x = y
        return x

    def join(self, a: int, b: int) -> bool:
        a, b = self.top(a), self.top(b)
        if a != b:
            self.up[max(a, b)] = min(a, b)
        return a != b

    def stars(self) -> pd.DataFrame:
        return pd.DataFrame([(x, self.top(x)) for x in self.up], columns=["hi", "lo"], dtype="int64")


def _contracted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Stars that connect what the links(a, b) of a task connect."""
    forest = Forest()
    for pdf in batches:
        for a, b in zip(pdf["a"].tolist(), pdf["b"].tolist(), strict=True):
            forest.join(a, b)
        if len(forest.up) > HELD_IDS:
            yield forest.stars()
            forest = Forest()
    yield forest.stars()


def _fewer(links: DataFrame, count: int) -> DataFrame:
    """Stars in place of `count` links(a, b), found in tasks of about TASK_LINKS links."""
    return links.coalesce(math.ceil(max(count, 1) / TASK_LINKS)).mapInPandas(_contracted, "hi long, lo long")


def components(links: DataFrame, folder: str) -> DataFrame:
    """links(a, b) to (id, component): the smallest id that each linked id reaches.

    Every link is kept as (hi, lo) with hi > lo. A round moves the links of an id to smaller ones onto the smallest
    of them (small star), then the links to greater ones (large star), then lets each task replace its links by
    stars; all keep what is connected (Kiveris et al., Connected Components in MapReduce and Beyond, 2014), and
    about log(n) squared rounds leave one star for each component, however long its chains are. Tasks get as many
    links in every round, so there are fewer of them as links get fewer. Rounds are written to `folder`, which cuts
    lineage, and the round before is deleted. Ids with no link get no row. Smallest neighbours are aggregated before
    the shuffle and are tables of their own, so that adaptive execution can split a hub's links in the joins.
    """
    spark = links.sparkSession
    prepare(spark)
    links = links.where("a <> b").select("a", "b")
    edges = written(_fewer(links, links.count()).distinct(), f"{folder}/0")
    step, old = 0, f"{folder}/0"

    def smallest(edges: DataFrame) -> DataFrame:
        return written(edges.groupBy("hi").agg(F.min("lo").alias("low")), f"{folder}/low{step}")

    while True:
        step += 1
        low, count = smallest(edges), edges.count()
        forks = low.count() < count
        if not forks and edges.join(low.select(F.col("hi").alias("lo")), "lo", "left_semi").isEmpty():
            roots = edges.select(F.col("lo").alias("id")).distinct()
            return edges.select(F.col("hi").alias("id"), F.col("lo").alias("component")).unionByName(roots.select("id", F.col("id").alias("component")))
        if forks:
            moved = edges.join(low, "hi").where("lo <> low").select(F.col("lo").alias("hi"), F.col("low").alias("lo"))
            edges = written(moved.unionByName(low.select("hi", F.col("low").alias("lo"))).distinct(), f"{folder}/{step}")
            discard(spark, old, f"{folder}/low{step}")
            step, old = step + 1, f"{folder}/{step}"
            low = smallest(edges)
        up = low.select(F.col("hi").alias("lo"), "low")
        stars = edges.join(up, "lo", "left").select(F.col("hi").alias("a"), F.coalesce("low", "lo").alias("b")).distinct()
        edges = written(_fewer(stars, count), f"{folder}/{step}")
        discard(spark, old, f"{folder}/low{step}")
        old = f"{folder}/{step}"


def extended(known: DataFrame, links: DataFrame, folder: str) -> DataFrame:
    """The components (id, component) of the links behind `known` and these links(a, b) together.

    Only links between different components go through the rounds, from component to component.
    """
    for end in ("a", "b"):
        links = links.join(known.select(F.col("id").alias(end), F.col("component").alias("c")), end, "left").withColumn(end, F.coalesce("c", end)).drop("c")
    between = written(links.where("a <> b").select("a", "b"), f"{folder}/between")
    over = written(components(between, folder), f"{folder}/over")
    moved = known.join(over.select(F.col("id").alias("component"), F.col("component").alias("c")), "component", "left")
    return moved.select("id", F.coalesce("c", "component").alias("component")).unionByName(over.join(known, "id", "left_anti"))
