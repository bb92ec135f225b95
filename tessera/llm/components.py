"""Connected components of links between ids, by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import small, written

#: Rounds after which a graph that still has links is an error; each takes away at least a third of the nodes on average.
ROUNDS = 60


def components(links: DataFrame, name: str = "links") -> DataFrame:
    """Of links (a, b), each id that has one with the smallest id it reaches: id, component.

    In each round every node joins the neighbour with the least seeded hash, links between joined nodes fall away, and the
    labels so far follow. A star takes one round, a chain about the logarithm of its length; minima are partially aggregated,
    so a node with very many links is no hot task. Links are written every round and labels every fourth, so lost executors cost
    little and plans stay short.
    Links of an id with itself or with null are left out.
    """
    links = links.where("a <> b").select("a", "b")
    labels = None
    for r in range(ROUNDS):
        both = links.union(links.select("b", "a"))
        rank = lambda c: F.struct(F.xxhash64(F.lit(r), F.col(c)).alias("h"), F.col(c).alias("id"))
        near = both.groupBy(F.col("a").alias("node")).agg(F.min(rank("b")).alias("best"))
        near = small(written(near.select("node", F.least(F.col("best"), rank("node"))["id"].alias("to")), f"{name}-joined"))
        joined = links.join(near.toDF("a", "ta"), "a").join(near.toDF("b", "tb"), "b")
        links = written(joined.where("ta <> tb").select(F.least("ta", "tb").alias("a"), F.greatest("ta", "tb").alias("b")).distinct(), f"{name}-links")
        labels = near.toDF("id", "label") if labels is None else labels.join(near.toDF("label", "to"), "label", "left").select("id", F.coalesce("to", "label").alias("label"))
        if not links.take(1):
            break
        if r % 4 == 3:
            labels = written(labels, f"{name}-labels")
    else:
        raise RuntimeError("the components did not settle")
    labels = written(labels, f"{name}-labels")
    least = labels.groupBy("label").agg(F.min("id").alias("component"))
    return labels.join(least, "label").select("id", "component")
