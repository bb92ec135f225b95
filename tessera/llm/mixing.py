"""Mixing of sources to target weights with DataFrame functions only."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import opened, sealed, small, unit, written

#: Cells that each source's documents are dealt to; the fractional repetition is a run of cells.
CELLS = 4096
#: Sources that are sent to every task; of more than these the table is joined by a shuffle.
BROADCAST_SOURCES = 10_000


def words(text: Column) -> Column:
    """Number of runs of other than ASCII white space; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit("[^\\x20\\x09-\\x0D]+")), F.lit(0)).cast("long")


def cyclic_weight(rank: Column) -> Column:
    """1, 2, 3, 1, 2, 3, ... for the ranks 1, 2, 3, ..."""
    return (F.pmod(rank - 1, F.lit(3)) + 1).cast("double")


def source_plan(cells: DataFrame, weight: Callable[[Column], Column], epochs: float, total: float) -> DataFrame:
    """Targets of the sources and the cells that get one repetition more. ``cells``: source, cell, cell_size.

    Water-filling: sources in the order of cap over weight; those before the level is reached are clamped at their
    caps (``epochs`` times the size), the rest share what is left by weight. That is where giving out the excess
    again and again ends. Sources are few; this table has one row for each.
    """
    everything = Window.partitionBy()
    sizes = cells.groupBy("source").agg(F.sum("cell_size").alias("source_size"))
    ranked = sizes.withColumn("weight", weight(F.row_number().over(Window.partitionBy().orderBy(F.col("source").asc_nulls_last()))))
    by_level = Window.partitionBy().orderBy(F.col("source_size") / F.col("weight"), F.col("source").asc_nulls_last())
    before = by_level.rowsBetween(Window.unboundedPreceding, -1)
    cap = F.col("source_size") * F.lit(float(epochs))
    level = (
        ranked.withColumn("goal", F.sum("source_size").over(everything) * F.lit(float(total)))
        .withColumn("rest_weight", F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
        .withColumn("rest", F.col("goal") - F.coalesce(F.sum(cap).over(before), F.lit(0.0)))
        .withColumn("fill", F.col("rest") / F.col("rest_weight"))
        .withColumn("free", cap > F.col("fill") * F.col("weight"))
    )
    # the fill at the first source that is not clamped: of those, the one with the most weight left
    level = level.withColumn("level", F.min_by(F.when(F.col("free"), F.col("fill")), F.when(F.col("free"), -F.col("rest_weight"))).over(everything))
    target = F.when(F.col("level").isNull(), cap).otherwise(F.least(cap, F.col("level") * F.col("weight")))
    targets = level.select("source", "source_size", target.alias("target"))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    targets = targets.withColumn("whole", F.floor(rate)).withColumn("wanted", F.col("target") - F.floor(rate) * F.col("source_size"))
    # A source's cells in a fixed order: take those whose end is nearest to what is wanted.
    run = Window.partitionBy("source").orderBy("cell")
    ends = cells.withColumn("end", F.sum("cell_size").over(run)).join(targets, cells["source"].eqNullSafe(targets["source"])).drop(cells["source"])
    near = ends.groupBy("source").agg(F.min(F.struct(F.abs(F.col("end") - F.col("wanted")).alias("off"), "cell", "end", "wanted")).alias("best"))
    last = near.select(F.col("source").alias("cut_source"), F.when(F.col("best.off") < F.col("best.wanted"), F.col("best.cell")).otherwise(F.lit(-1)).alias("last_cell"))
    return targets.join(last, targets["source"].eqNullSafe(last["cut_source"])).select("source", "source_size", "target", "whole", "last_cell")


def mix_sources(df: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", weight: Callable[[Column], Column] = cyclic_weight, epochs: float = 3.0, total: float = 1.0, seed: int = 17) -> DataFrame:
    """How often each row is taken so that the sources' words come to their target shares.

    Sources in code point order, null last, weigh ``weight(rank)`` and share ``total`` times all words; none gets more
    than ``epochs`` times what it has (capped water-filling). A row is taken the whole number of times that its
    source needs, and once more if its seeded cell is among the first ones; those are counted so that the words taken
    miss the target by no more than half a cell of 4,096.
    Rows meet only as sums by source and cell, so a hot source costs no more than any other.

    Adds size, source_size, target, repeats and taken (size times repeats), which replace columns of those names. A null text
    has size 0; a null source is a source. Rows of one key and size share a cell. Sources without words have target 0 and no
    repeats. An empty table gives an empty result.
    """
    df, names = sealed(df)
    rows = df.select("*", words(F.col(names[text])).alias("size"), F.col(names[source]).alias("name"))
    rows = rows.withColumn("cell", F.floor(unit(F.col(names[key]), F.col("size"), seed=seed) * CELLS).cast("int"))
    cells = rows.groupBy(F.col("name").alias("source"), "cell").agg(F.sum("size").alias("cell_size"))
    plan = written(source_plan(written(cells, "mix-cells"), weight, epochs, total), "mix-plan")
    plan = small(plan.withColumnRenamed("source", "plan_name"), BROADCAST_SOURCES)
    joined = rows.join(plan, F.col("name").eqNullSafe(F.col("plan_name")))
    repeats = (F.col("whole") + (F.col("cell") <= F.col("last_cell")).cast("long")).cast("long")
    return opened(joined, names, {"size": F.col("size"), "source_size": F.col("source_size"), "target": F.col("target"), "repeats": repeats, "taken": F.col("size") * repeats})


def repeated(mixed: DataFrame, columns: list[str]) -> DataFrame:
    """The mix itself: each row of ``mix_sources`` as often as it is taken; at most ``epochs`` rows from one."""
    bare, names = sealed(mixed)
    copies = bare.where(F.col(names["repeats"]) > 0).withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col(names["repeats"]))))
    return opened(copies, {c: names[c] for c in columns})
