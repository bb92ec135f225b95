"""Uniform shuffle of rows into shards of exact sizes."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import new_path, opened, sealed, ship, unit

#: Groups of input partitions that the matrix has a row for, at most; it is all the driver holds.
MATRIX_ROWS = 4096
#: Rows of a block of a shard, about; a block is permuted in one task.
BLOCK_ROWS = 500


def communication_matrix(sizes: np.ndarray, shards: np.ndarray, seed: int | list[int]) -> np.ndarray:
    """How many rows of each partition go to each shard: the counts of a uniform random permutation, whose rows sum to ``sizes`` and columns to ``shards``."""
    rng = np.random.default_rng(seed)
    left = shards.astype(np.int64).copy()
    out = np.zeros((len(sizes), len(shards)), np.int64)
    for p, n in enumerate(sizes):
        draw, rest, todo = np.zeros(len(shards), np.int64), int(left.sum()), int(n)
        for s, have in enumerate(left):  # one hypergeometric draw a cell, without the limit of numpy's joint one
            rest -= int(have)
            draw[s] = todo if rest == 0 else _draw(rng, int(have), rest, todo)
            todo -= int(draw[s])
        out[p] = draw
        left -= draw
    return out


def _draw(rng: np.random.Generator, good: int, bad: int, n: int) -> int:
    """A hypergeometric draw. numpy's takes populations under a billion; in larger ones each row is taken by a binomial, and an exact draw takes back the rows too many or adds those missing."""
    if not n or not good:
        return 0
    if good + bad < 1_000_000_000:
        return int(rng.hypergeometric(good, bad, n))
    if n <= 64:  # row by row
        out = 0
        for i in range(n):
            out += int(rng.integers(good + bad - i)) < good - out
        return out
    a, b = int(rng.binomial(good, n / (good + bad))), int(rng.binomial(bad, n / (good + bad)))
    if a + b >= n:
        return a - _draw(rng, a, b, a + b - n)
    return a + _draw(rng, good - a, bad - b, n - a - b)


def even_sizes(n: int, shards: int) -> np.ndarray:
    return np.full(shards, n // shards, np.int64) + (np.arange(shards) < n % shards)


def shuffle_to_shards(df: DataFrame, shards: int = 40, seed: int = 29) -> DataFrame:
    """A uniform shuffle of all rows into ``shards`` shards whose row counts are at most one apart.

    The rows are written once with their number within the partition, so that a task that is run again deals the same
    rows to the same shards. The driver counts the partitions and draws how many rows each sends to each shard
    (hypergeometric; a row for each of 4,096 groups of partitions at most, and each task draws its partition's share of its
    group's row the same way). Each partition permutes its shard labels locally, the rows are exchanged, and each shard is
    permuted again in seeded blocks whose offsets are counted first, so no task gets a whole shard.

    Adds shard and slot (gapless from 0 within the shard), which replace columns of those names. Rows are dealt by place, so nulls, equal rows and hot
    keys need no care; with fewer rows than shards the last shards stay empty. An empty table gives an empty result.
    """
    spark = df.sparkSession
    ship(spark)
    df, names = sealed(df)
    path = new_path(spark, "shard-rows")
    numbered = df.withColumn("at", F.monotonically_increasing_id())
    numbered.write.parquet(path)
    rows = spark.read.schema(numbered.schema).parquet(path)
    counts = sorted((r[0], r[1]) for r in rows.groupBy(F.shiftright("at", 33)).count().collect())  # a row for each task that wrote, whatever the rows
    n = sum(c for _, c in counts)
    if not n:
        return opened(rows, names, {"shard": F.lit(0), "slot": F.lit(0).cast("long")})
    ids, sizes = np.array([p for p, _ in counts]), np.array([c for _, c in counts], np.int64)
    group = np.arange(len(ids)) // -(-len(ids) // MATRIX_ROWS)
    first = np.flatnonzero(np.diff(group, prepend=-1))  # where each group of partitions begins
    matrix = communication_matrix(np.add.reduceat(sizes, first), even_sizes(n, shards), seed)
    shared = spark.sparkContext.broadcast((ids, sizes, first, matrix))

    def labels(place: pd.Series) -> pd.Series:
        ids, sizes, first, matrix = shared.value
        place = place.to_numpy()
        part = np.searchsorted(ids, place >> 33)
        out = np.zeros(len(place), np.int32)
        for p in np.unique(part).tolist():
            if p not in _dealt:
                _dealt.clear()
                g = int(np.searchsorted(first, p, "right")) - 1
                mates = sizes[first[g] : first[g + 1] if g + 1 < len(first) else len(sizes)]
                counts = communication_matrix(mates, matrix[g], [seed, g])[p - first[g]] if len(mates) > 1 else matrix[g]
                _dealt[p] = np.random.default_rng([seed, g, p]).permutation(np.repeat(np.arange(len(counts), dtype=np.int32), counts))
            mine = part == p
            out[mine] = _dealt[p][place[mine] & ((1 << 33) - 1)]
        return pd.Series(out)

    _dealt: dict[int, np.ndarray] = {}
    blocks = max(1, round(n / shards / BLOCK_ROWS))
    dealt = rows.select("*", F.pandas_udf(labels, "int")("at").alias("shard"), unit("at", seed=seed + 1).alias("order"))
    dealt = dealt.withColumn("block", F.floor(F.col("order") * blocks).cast("int"))
    # Offsets of the blocks: one narrow column of the table is read for them.
    count = dealt.groupBy("shard", "block").agg(F.count(F.lit(1)).alias("n_rows"))
    count = count.select("shard", "block", (F.sum("n_rows").over(Window.partitionBy("shard").orderBy("block")) - F.col("n_rows")).alias("start"))
    place = Window.partitionBy("shard", "block").orderBy("order", "at")
    slotted = dealt.withColumn("slot", F.row_number().over(place)).join(count, ["shard", "block"])
    return opened(slotted, names, {"shard": F.col("shard"), "slot": (F.col("start") + F.col("slot") - 1).cast("long")})


def text_size(text: Column) -> Column:
    """UTF-8 bytes of the text (null: none) plus 16."""
    return (F.coalesce(F.octet_length(text), F.lit(0)) + 16).cast("long")
