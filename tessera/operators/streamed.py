"""Ordered folds over keys that are streamed, not gathered."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import groupby, islice

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from tessera.shipping import ship


def folded(rows: DataFrame, schema: str, fold: Callable[[Iterator[tuple]], Iterator[tuple]]) -> DataFrame:
    """``fold`` over the rows of each key in the order of the other columns; the first column is the key, and leads its results too.

    Keys are dealt by one shuffle, sorted by Spark, which spills, and streamed: a task holds a batch of rows and what the fold
    keeps, however many rows a key has, and one batch carries many small keys.
    """
    ship(rows.sparkSession)
    kinds = to_arrow_schema(StructType([rows.schema[0], *rows.sparkSession.createDataFrame([], schema).schema]))

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read = (r for batch in it for r in zip(*(c.to_pylist() for c in batch.columns), strict=True))
        made = ((k, *x) for k, mine in groupby(read, key=lambda r: r[0]) for x in fold(r[1:] for r in mine))
        while out := list(islice(made, 4_000)):
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), kinds, strict=True)], schema=kinds)

    key = rows.schema[0]
    return rows.repartition(rows[f"`{key.name}`"]).sortWithinPartitions(*rows.columns).mapInArrow(run, f"`{key.name}` {key.dataType.simpleString()}, {schema}")
