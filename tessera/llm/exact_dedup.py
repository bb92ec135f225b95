"""Exact deduplication with DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import opened, sealed, small, written

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Parts that the copies of one text are first combined in.
SALTS = 16
#: Groups of several rows that are sent to every task (about 80 bytes each); of more than these only those of so many rows.
BROADCAST_REPEATS, HOT = 500_000, 10_000


def normalised(text: Column) -> Column:
    """The text with A-Z in lower case and all else as it is; null counts as empty."""
    return F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)


def _marked(df: DataFrame, key: str, text: str, salts: int) -> tuple[DataFrame, DataFrame]:
    """The rows with the group's winner and size, and the table of groups of several rows."""
    hashable = [c for c, kind in df.dtypes if "map<" not in kind and "variant" not in kind]
    rows = df.select("*", F.col(key).cast("long").alias("order"), F.xxhash64(*hashable).alias("tie"), normalised(F.col(text)).alias("norm"))
    rows = rows.withColumn("digest", F.unhex(F.sha2("norm", 256)))
    # Aggregates of longs alone, which keep the combining in hash tables: nulls count for neither max nor max_by.
    parts = rows.groupBy("digest", "norm", F.pmod(F.xxhash64("order", "tie"), F.lit(salts)).alias("salt")).agg(F.max("order").alias("w_order"), F.max_by("tie", "order").alias("k_tie"), F.max("tie").alias("n_tie"), F.count(F.lit(1)).alias("w_size"))
    groups = parts.groupBy("digest", "norm").agg(F.max("w_order").alias("w_order"), F.coalesce(F.max_by("k_tie", "w_order"), F.max("n_tie")).alias("w_tie"), F.sum("w_size").alias("w_size"))
    hashes = lambda: (F.xxhash64("norm"), F.octet_length("norm"))
    repeats = groups.where("w_size > 1").select(F.col("digest").alias("r_digest"), *(h.alias(n) for h, n in zip(hashes(), ("r_hash", "r_length"), strict=True)), "w_order", "w_tie", "w_size")
    repeats = written(repeats, "exact-repeats")
    rows = rows.select(*df.columns, "order", "tie", "digest", *(h.alias(n) for h, n in zip(hashes(), ("hash", "length"), strict=True)))
    same = (F.col("digest") == F.col("r_digest")) & (F.col("hash") == F.col("r_hash")) & (F.col("length") == F.col("r_length"))
    if repeats.count() <= BROADCAST_REPEATS:
        return rows.join(F.broadcast(repeats), same, "left"), repeats
    # Groups of very many rows are few; sent to every task, they leave no hot key for the shuffle.
    hot = small(repeats.where(F.col("w_size") >= HOT), BROADCAST_REPEATS)
    met = rows.join(hot, same, "left").withColumnsRenamed({c: f"h_{c}" for c in repeats.columns})
    same = same & F.col("h_r_digest").isNull()
    met = met.join(repeats.where(F.col("w_size") < HOT), same, "left")
    winner = {c: F.coalesce(f"h_{c}", c) for c in ("w_order", "w_tie", "w_size")}
    return met.withColumns(winner).drop(*(f"h_{c}" for c in repeats.columns)), repeats


def exact_dedup(df: DataFrame, key: str = "doc_id", text: str = "text", salts: int = SALTS) -> DataFrame:
    """Mark the one row of each group of equal texts that stays: the one with the largest key.

    Copies are combined three times, each time by digest and whole text: within each map task (partial
    aggregation), within one of ``salts`` parts of the group, and over the parts. So a text with a third of all
    rows is never gathered in one task, and equal digests of different texts stay apart. Only the groups of several rows then
    meet the rows again, by SHA-256, a second hash and the length: sent to every task where they are counted to be few, else
    the largest groups are, and the others go by a shuffle.

    Adds keep_id, group_size, kept and text_sha256, which replace columns of those names. Null texts equal empty ones. A
    null key is smaller than any other; a group that has only null keys has a null keep_id. Rows that repeat the
    winning key are told apart by a hash of all their columns; rows alike in every column are all marked as kept, and
    ``distinct_texts`` leaves one of them. An empty table gives an empty result.
    """
    df, names = sealed(df)
    joined, _ = _marked(df, names[key], names[text], salts)
    return opened(joined, names, {
        "keep_id": F.when(F.col("w_size").isNull(), F.col("order")).otherwise(F.col("w_order")),
        "group_size": F.coalesce(F.col("w_size"), F.lit(1).cast("long")),
        "kept": _kept(),
        "text_sha256": F.lower(F.hex("digest")),
    })


def _kept() -> Column:
    return F.col("w_size").isNull() | (F.col("order").eqNullSafe(F.col("w_order")) & (F.col("tie") == F.col("w_tie")))


def distinct_texts(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The columns of ``df`` of the one row that stays of each group of equal texts (see ``exact_dedup``). Of rows alike in every column one is left."""
    df, names = sealed(df)
    joined, repeats = _marked(df, names[key], names[text], SALTS)
    kept = written(joined.where(_kept()).select(*df.columns, F.col("w_size").isNotNull().alias("several")), "exact-kept")
    if kept.where("several").count() > repeats.count():  # winners alike in every column
        kept = kept.where("not several").unionByName(kept.where("several").dropDuplicates())
    return opened(kept, names)
