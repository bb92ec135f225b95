"""Near-duplicate embeddings by small-world graphs of shards."""

from __future__ import annotations

import logging
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import opened, sealed, ship, written
from tessera.llm.components import components
from tessera.llm.hnsw import Graph

#: Vectors of a shard, at most; bytes of a shard, at most; shards at least.
SHARD_ROWS, SHARD_BYTES, SHARDS = 16_384, 64 << 20, 4
#: Width of the first beams and of the widest ones; beyond those a block is searched by brute force. The recall that audits ask for.
BEAM, WIDEST, RECALL = 64, 512, 0.9995
#: Made-up queries that audit a shard when it is built; queries of a block that audit its search, as many with links and as many without.
NEEDLES, AUDITED = 1024, 64

log = logging.getLogger(__name__)


def unit_vectors(column: pa.Array) -> list[bytes | None]:
    """Unit vectors in double precision, as bytes; null for one that is null, empty or zero or holds null or non-finite numbers."""
    out: list[bytes | None] = []
    for x in column:
        v = np.asarray(x.values.to_numpy(zero_copy_only=False), np.float64) if x.is_valid and len(x.values) and not x.values.null_count else np.zeros(1)
        top = np.abs(v).max()
        if not np.isfinite(top) or top == 0:
            out.append(None)
        else:
            v = v / top
            out.append((v / np.sqrt(v @ v)).tobytes())
    return out


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of links, as few as hold the same ids together: each id with the smallest of its component."""
    ids, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    parent = np.arange(len(ids))
    x, y = at[: len(a)], at[len(a) :]
    while True:
        p, q = parent[x], parent[y]
        low, high = np.minimum(p, q), np.maximum(p, q)
        if (low == high).all():
            break
        np.minimum.at(parent, high, low)
        while (parent[parent] != parent).any():
            parent = parent[parent]
    mine = parent != np.arange(len(ids))
    return ids[mine], ids[parent[mine]]


def meetings(parts: Column) -> tuple[Column, Column]:
    """How far ahead of a block the shards are that it is searched in, in a ring of ``parts``, as rows of ``ahead``, and which of those rows count by ``block``: of two parts, one meets the other, and each part meets itself."""
    return F.explode(F.sequence(F.lit(0), F.floor(parts / 2).cast("int"))).alias("ahead"), (F.col("ahead") * 2 < parts) | (F.col("block") * 2 < parts)


def _search(graph: Graph, beam: int, ids: np.ndarray, queries: np.ndarray, own: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray, int, int]:
    """Links of the queries with a shard's vectors, and how many true links an audit saw and how many of those were found.

    The shard's own audit has set the width of the beams (0: none finds enough). Here queries that found links and others are held against
    brute force, links of a vector with itself left out; beams are widened until those pass, and a block whose widest beams
    don't is searched by brute force.
    """
    while True:
        r, c = graph.within(queries, least, beam) if beam else graph.exactly(queries, least)
        other = own[r] != ids[c]
        r, c = r[other], c[other]
        linked = np.unique(r)
        spread = lambda x: x[np.linspace(0, len(x) - 1, min(AUDITED, len(x))).astype(np.int64)]
        some = np.union1d(spread(linked), spread(np.arange(len(own))))
        tr, tc = graph.exactly(queries[some], least)
        truth = int((own[some[tr]] != ids[tc]).sum())
        del tr, tc
        hit = int(np.isin(r, some).sum())
        if not beam or hit >= RECALL * truth:
            return own[r], ids[c], truth, hit
        beam = beam * 2 if beam * 2 <= WIDEST else 0


def embedding_duplicates(df: DataFrame, key: str = "vec_id", vector: str = "embedding", least: float = 0.9) -> DataFrame:
    """Add n_links, component_id and kept to all vectors, in place of columns of those names; vectors are linked where their cosine is ``least`` or more.

    The vectors are dealt to shards by a hash of key and vector and each shard gets a hierarchical small-world graph. The vectors of a shard
    are also a block of queries. Of two shards, one's block is searched in the other, and a link counts at both its ends; each block is searched in its own shard too. Beams are widened until audits pass: of made-up queries at the threshold when a
    shard is built, as true links may be too rare to tell, and of the block's own queries against brute force; they also widen where links fill them. A block
    that no beam serves is searched by brute force. The audits' recall is logged. Each link is measured in double precision. A task returns counts and
    the forest of its links, so a group in which all are linked costs its members, not their pairs. The forests' components
    are the classes. A shard has a bounded size, whatever the table's; the number of searches is that of pairs of
    shards, which is what meeting every shard takes.

    Vectors that are null, empty or zero or hold null or non-finite numbers have no links, and vectors of different lengths
    don't link. A row with a null key has no links and no component and is kept. Rows that repeat a key are one node: each one's links with
    other keys count. An empty table gives an empty result.
    """
    ship(df.sparkSession)

    def unit(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            vectors = unit_vectors(batch.column("v"))
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(vectors, pa.binary()), pa.array([len(v) // 8 if v else 0 for v in vectors], pa.int32())], ["id", "v", "dim"])

    df, names = sealed(df)
    named = df.select(F.col(names[key]).cast("long").alias("id"), F.col(names[vector]).alias("v")).where("id is not null and v is not null")
    units = written(named.mapInArrow(unit, "id long, v binary, dim int").where("v is not null"), "embed-units")
    sizes = {r["dim"]: r["n"] for r in units.groupBy("dim").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row for each length of vector
    rows = {d: max(1, min(SHARD_ROWS, SHARD_BYTES // (12 * d))) for d in sizes}
    shards = {d: max(SHARDS, -(-n // rows[d])) for d, n in sizes.items()}
    parts = F.element_at(F.create_map(*(F.lit(v) for kv in shards.items() for v in kv)), F.col("dim")) if shards else F.lit(1)
    sharded = units.withColumn("shard", F.pmod(F.xxhash64("id", "v", F.lit(1)), parts).cast("int"))

    def build(k: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        graph = Graph.build(np.frombuffer(b"".join(pdf["v"]), np.float64).reshape(len(pdf), -1))
        beam = graph.tuned(least, RECALL, BEAM, WIDEST, NEEDLES)
        return pd.DataFrame({"dim": [k[0]], "shard": [k[1]], "beam": [beam], "ids": [pdf["id"].to_numpy(np.int64).tobytes()], "graph": [graph.to_bytes()]})

    index = written(sharded.groupBy("dim", "shard").applyInPandas(build, "dim int, shard int, beam int, ids binary, graph binary"), "embed-index")

    def search(queries: pd.DataFrame, shard: pd.DataFrame) -> pd.DataFrame:
        if not len(queries) or not len(shard):
            return pd.DataFrame({"id": pd.Series(dtype="Int64"), "n": pd.Series(dtype="int64"), "to": pd.Series(dtype="Int64")})
        own = queries["id"].to_numpy(np.int64)
        ids = np.frombuffer(shard["ids"].iloc[0], np.int64)
        a, b, truth, hit = _search(Graph.from_bytes(shard["graph"].iloc[0]), int(shard["beam"].iloc[0]), ids, np.frombuffer(b"".join(queries["v"]), np.float64).reshape(len(own), -1), own, least)
        nodes, n = np.unique(a, return_counts=True)
        if queries["block"].iloc[0] != shard["shard"].iloc[0]:  # links are found from here only
            there, m = np.unique(b, return_counts=True)
            nodes, n = np.concatenate([nodes, there]), np.concatenate([n, m])
        x, y = forest(a, b)
        out = pd.DataFrame({"id": np.concatenate([nodes, x, [0]]), "n": np.concatenate([n, np.zeros(len(x), np.int64), [truth]]), "to": np.concatenate([nodes, y, [hit]])}).astype({"id": "Int64"})
        out.iloc[-1, 0] = pd.NA  # the audit: links that are there, and those of them that were found
        return out

    ahead, due = meetings(parts)
    asked = sharded.withColumnRenamed("shard", "block").select("*", ahead).where(due).withColumn("shard", F.pmod(F.col("block") + F.col("ahead"), parts))
    held = index.select("*", ahead).withColumn("block", F.pmod(F.col("shard") - F.col("ahead"), parts)).where(due)
    found = asked.groupBy("dim", "shard", "block").cogroup(held.groupBy("dim", "shard", "block")).applyInPandas(search, "id long, n long, to long")
    found = written(found, "embed-found")
    seen = found.where("id is null").agg(F.sum("n"), F.sum("to")).first()
    log.info("audits saw %s links, of which the searches found %s", *(x or 0 for x in seen))
    found = found.where("id is not null")
    counts = found.groupBy("id").agg(F.sum("n").alias("n_links"))
    classes = components(found.where("id <> to").select(F.col("id").alias("a"), F.col("to").alias("b")), "embed")
    known = counts.join(classes, "id", "full").select("id", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("component", "id").alias("component"))
    own = F.col(names[key]).cast("long")
    joined = df.join(known, own == F.col("id"), "left")
    component = F.coalesce(F.col("component"), own)
    return opened(joined, names, {"n_links": F.coalesce(F.col("n_links"), F.lit(0)).cast("long"), "component_id": component, "kept": F.coalesce(own == component, F.lit(True))})
