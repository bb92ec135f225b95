"""A Merkle manifest of a dataset: a tree of digests for each group of rows, one over the groups, and a proof for each row."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import col, ship, small, written

#: Children of a node.
FAN = 8
#: Rows of a range of leaves, about, and ranges at most: a task holds the digests of one range.
RANGE_ROWS, MAX_RANGES = 4096, 20_000
#: Leaves whose proofs go out in one Arrow batch.
BATCH = 2048
PATH = "array<struct<left:string,right:string>>"


def digest(*parts: Column) -> Column:
    """SHA-256 as lower-case hex of the parts put together."""
    return F.sha2(F.concat(*parts), 256)


def field(value: Column) -> Column:
    """A value as a leaf has it: ``-`` if null, else its length in bytes, a colon and itself."""
    text = value.cast("string")
    return F.when(text.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def folded(leaf: Column, proof: Column) -> Column:
    """The root that a leaf and the digests beside its way up give."""
    return F.aggregate(proof, leaf, lambda below, beside: digest(beside["left"], below, beside["right"]))


def siblings(proof: Column) -> Column:
    """All digests of a proof in one string, level by level, left to right."""
    return F.concat_ws("", F.transform(proof, lambda beside: F.concat(beside["left"], beside["right"])))


def _join(hashes: list[str]) -> str:
    return hashlib.sha256("".join(hashes).encode()).hexdigest()


@dataclass
class Segment:
    """The part of a group's tree that stands over leaves ``first`` and on, as far as one range of leaves tells it: for each level the number of its first node, the digests, and which of the nodes have a parent here."""

    first: list[int]
    nodes: list[list[str]]
    inner: list[tuple[int, int]]


def segment(leaves: list[str], first: int, total: int) -> Segment:
    """Every complete subtree over these leaves of a group of ``total``. A parent is complete if all its children are here; the last one of a level may have fewer."""
    out, low, nodes = Segment([], [], []), first, leaves
    while True:
        out.first.append(low)
        out.nodes.append(nodes)
        high = low + len(nodes)
        begin, end = -(-low // FAN), (-(-high // FAN) if high == total else high // FAN)
        if total == 1 or begin >= end:
            out.inner.append((0, 0))
            return out
        out.inner.append((begin * FAN - low, min(end * FAN, high) - low))
        nodes = [_join(nodes[p * FAN - low : (p + 1) * FAN - low]) for p in range(begin, end)]
        low, total = begin, -(-total // FAN)


def _runs(it: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows of each range (column ``part``), one range after the other, from batches sorted by it."""
    held: list[pa.RecordBatch] = []
    for batch in it:
        parts = batch.column("part").to_numpy()
        if not len(parts):
            continue
        at = 0
        for cut in [*(np.flatnonzero(np.diff(parts)) + 1).tolist(), len(parts)]:
            if held and held[0].column("part")[0].as_py() != parts[at]:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(at, cut - at))
            at = cut
    if held:
        yield pa.Table.from_batches(held)


def _segments(table: pa.Table) -> Iterator[tuple[str, int, int, int, list[str], pa.Table]]:
    """Group, first row, place of the first leaf and size of the group, leaves, and the rows of leaves, for each group of a range."""
    kind = table.column("kind").to_numpy()
    leaves = table.filter(pa.array(kind == 2))
    seq, hashes = leaves.column("seq").to_numpy(), leaves.column("leaf").to_pylist()
    for r in table.filter(pa.array(kind == 0)).select(["g", "seq", "n", "place", "total"]).to_pylist():
        at = int(np.searchsorted(seq, r["seq"]))
        yield r["g"], at, r["place"], r["total"], hashes[at : at + r["n"]], leaves


def _boundary(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The nodes of each range without a parent there, by coordinate."""
    for table in _runs(it):
        part = table.column("part")[0].as_py()
        rows: list[tuple] = []
        for g, _, place, total, hashes, _ in _segments(table):
            s = segment(hashes, place, total)
            for level, (first, nodes, (a, b)) in enumerate(zip(s.first, s.nodes, s.inner, strict=True)):
                rows += [(part, g, level, first + i, h) for i, h in enumerate(nodes) if not a <= i < b]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.string(), pa.int32(), pa.int64(), pa.string()), strict=True)], ["part", "g", "level", "place", "hash"])


def _proofs(keep: list[str]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The way up from each leaf: within its range, and on from the range's boundary node above it by the rows of kind 1."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _runs(it):
            above: dict[str, dict[tuple[int, int], list[tuple[str, str]]]] = {}
            for r in table.filter(pa.array(table.column("kind").to_numpy() == 1)).select(["g", "level", "place", "path"]).to_pylist():
                above.setdefault(r["g"], {})[r["level"], r["place"]] = [(x["left"], x["right"]) for x in r["path"]]
            for g, at, place, total, hashes, leaves in _segments(table):
                s, ways = segment(hashes, place, total), []
                for level in reversed(range(len(s.nodes))):
                    first, nodes, (a, b) = s.first[level], s.nodes[level], s.inner[level]
                    here: list[list[tuple[str, str]]] = []
                    for i in range(len(nodes)):
                        if a <= i < b:
                            p = (first + i) // FAN
                            low, high = max(p * FAN - first, 0), min((p + 1) * FAN - first, len(nodes))
                            here.append([("".join(nodes[low:i]), "".join(nodes[i + 1 : high])), *ways[p - s.first[level + 1]]])
                        else:
                            here.append(above[g][level, first + i])
                    ways = here
                    if level == 0:
                        break
                for i in range(0, len(ways), BATCH):
                    some = ways[i : i + BATCH]
                    flat = [x for w in some for x in w]
                    struct = pa.StructArray.from_arrays([pa.array([x[0] for x in flat], pa.string()), pa.array([x[1] for x in flat], pa.string())], ["left", "right"])
                    proof = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, some)]), pa.int32()), struct)
                    rows = leaves.slice(at + i, len(some)).select(keep).combine_chunks().to_batches()[0]
                    yield pa.RecordBatch.from_arrays([*rows.columns, proof], [*keep, "proof"])

    return run


def _forest(leaves: DataFrame, order: list[str], name: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """A tree for each group ``g`` of leaves in ``order``: the leaves with their range and number in it, the ranges' groups with their places, and the groups' depths and sizes.

    The leaves are sorted by ranges over all groups, so a group of a third of all rows has many ranges and a range may have many groups. A leaf's place in its group
    is the count of the group's leaves in the ranges before, and its number in its own range.
    """
    n = leaves.count()
    ranges = min(MAX_RANGES, max(1, -(-n // RANGE_ROWS)))
    leaves = leaves.withColumn("tie", F.monotonically_increasing_id())  # rows alike don't make a range that can't be split
    sorted_rows = leaves.repartitionByRange(ranges, "g", *order, "leaf", "tie").sortWithinPartitions("g", *order, "leaf", "tie").drop("tie")
    rows = written(sorted_rows.withColumn("seq", F.monotonically_increasing_id()).withColumn("part", F.shiftright("seq", 33)), f"merkle-{name}-leaves")
    counts = rows.groupBy("g", "part").agg(F.count(F.lit(1)).alias("n"), F.min("seq").alias("seq"))
    before = Window.partitionBy("g").orderBy("part")
    placed = counts.select("*", (F.sum("n").over(before) - F.col("n")).alias("place"), F.sum("n").over(Window.partitionBy("g")).alias("total"))
    placed = written(placed, f"merkle-{name}-ranges")
    return rows, placed, placed.where("place = 0").select("g", "total", _depth(F.col("total")).alias("depth"))


def _depth(total: Column) -> Column:
    """Levels above the leaves of a group of so many."""
    return sum((F.when(total > F.lit(float(FAN**i)), 1).otherwise(0) for i in range(21)), F.lit(0))


_KEYS = ["part long", "kind int", "g string", "seq long", "n long", "place long", "total long", "level int", "leaf string", f"path {PATH}"]


def _tagged(df: DataFrame, kind: int, carry: list[tuple[str, str]]) -> DataFrame:
    have = set(df.columns)
    columns = [(F.lit(kind) if n == "kind" else F.col(n) if n in have else F.lit(None)).cast(t).alias(n) for n, t in (*(x.split(" ", 1) for x in _KEYS), *carry)]
    return df.select(*columns)


def _by_range(tables: list[DataFrame]) -> DataFrame:
    """The rows of a range together and in order: its groups, what is known above them, then its leaves."""
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t)
    return out.repartition("part").sortWithinPartitions("part", "kind", "seq", "level", "place")


def _levels(rows: DataFrame, placed: DataFrame, groups: DataFrame, name: str) -> tuple[DataFrame, list[DataFrame], DataFrame]:
    """The boundary nodes of all ranges, the nodes above them level by level with their children, and the top node of each group."""
    tagged = _by_range([_tagged(placed, 0, []), _tagged(rows.select("part", "g", "seq", "leaf"), 2, [])])
    ragged = written(tagged.mapInArrow(_boundary, "part long, g string, level int, place long, hash string"), f"merkle-{name}-boundary").join(groups.select("g", "depth"), "g")
    deepest = groups.agg(F.max("depth")).first()[0] or 0
    made: list[DataFrame] = []
    for level in range(deepest):
        nodes = ragged.where((F.col("level") == level) & (F.col("depth") > level)).select("g", "place", "hash", "depth")
        if made:
            nodes = nodes.unionByName(made[-1].where(F.col("depth") > level).select("g", "place", "hash", "depth"))
        parents = nodes.groupBy("g", F.floor(F.col("place") / FAN).cast("long").alias("place"), "depth").agg(F.transform(F.sort_array(F.collect_list(F.struct("place", "hash"))), lambda c: c["hash"]).alias("children"))
        made.append(written(parents.withColumn("hash", digest(F.array_join("children", ""))), f"merkle-{name}-level"))
    tops = [ragged.where("level = depth").select("g", "hash"), *(m.where(F.col("depth") == i + 1).select("g", "hash") for i, m in enumerate(made))]
    top = tops[0]
    for t in tops[1:]:
        top = top.unionByName(t)
    return ragged, made, written(top, f"merkle-{name}-tops")


def _ways(ragged: DataFrame, made: list[DataFrame], roots: DataFrame, name: str) -> DataFrame:
    """What stands beside the way from each boundary node up to the root; ``roots`` has the ways of the groups' own top nodes."""
    ways: list[DataFrame] = []
    above = None
    for level in range(len(made), -1, -1):
        here = roots.where(F.col("depth") == level).select("g", F.lit(0).cast("long").alias("place"), "path")
        if above is not None:
            here = here.unionByName(above)
        if level:
            i = F.col("i")
            beside = F.struct(F.array_join(F.slice("children", F.lit(1), i), "").alias("left"), F.array_join(F.slice("children", i + 2, F.lit(FAN)), "").alias("right"))
            below = made[level - 1].drop("hash", "depth").join(here, ["g", "place"]).select("g", "place", "path", "children", F.posexplode("children").alias("i", "child"))
            above = written(below.select("g", (F.col("place") * FAN + i).alias("place"), F.concat(F.array(beside), F.col("path")).alias("path")), f"merkle-{name}-ways")
        ways.append(ragged.where(F.col("level") == level).join(here, ["g", "place"]).select("part", "g", "level", "place", "path"))
    out = ways[0]
    for w in ways[1:]:
        out = out.unionByName(w)
    return out


def _proven(rows: DataFrame, placed: DataFrame, ways: DataFrame, carry: list[str]) -> DataFrame:
    kinds = dict(rows.dtypes)
    carried = [(c, kinds[c]) for c in carry]
    keep = ["g", "leaf", *carry]
    tagged = _by_range([_tagged(placed, 0, carried), _tagged(ways, 1, carried), _tagged(rows.select("part", "g", "seq", "leaf", *carry), 2, carried)])
    return tagged.mapInArrow(_proofs(keep), ", ".join(["g string", "leaf string", *(f"`{c}` {kinds[c]}" for c in carry), f"proof {PATH}"]))


@dataclass
class Manifest:
    """``leaves``: key, group and carried columns of each row, its leaf, the subroot of its group and its proof from leaf to root; ``groups``: group, rows, depth, subroot; ``root``: None of an empty table."""

    leaves: DataFrame
    groups: DataFrame
    root: str | None


def merkle_manifest(df: DataFrame, columns: list[str], key: str = "doc_id", group: str = "lang", carry: dict[str, Column] | None = None) -> Manifest:
    """Digests of all rows in trees of eight children, and a proof for each row.

    A leaf is the SHA-256 of the named columns (``field``). In each group leaves ascend by key, null first, and then by digest; while a level has several nodes, every eight of them become
    one (the last may have fewer), and the last one left is the subroot. The subroots in order of the group as text, null first, are the leaves of the tree that gives the root.

    The texts are read once, for the leaves; after that only digests, keys and ``carry`` (short expressions of a row, by name) move. Leaves are range-sorted over all groups. Counts of
    each group in each range give each range its offsets, so it builds all subtrees that are complete in it; the ragged nodes at its edges, at most 14 for each level and range, are shuffled
    by coordinate (group, level, place) and give the levels above, one level at a time; the digests beside the way up then go back down to the ranges. A hot group has many ranges, each
    task streams ranges and holds the digests of one, and the driver gets counts, one depth and the root. The tree of subroots is built likewise.

    Keys and groups may be null and may repeat; rows alike in all have equal leaves beside each other. Empty texts differ from null ones (``0:`` and ``-``). A group of one row has its leaf as subroot and a proof only in
    the tree of groups; with one group too, the proof is empty and the root is the leaf. An empty table gives empty tables and no root.
    """
    spark = df.sparkSession
    ship(spark)
    carry = carry or {}
    kinds = dict(df.dtypes)
    grouped = F.when(col(group).isNull(), F.lit("")).otherwise(F.concat(F.lit("="), col(group).cast("string")))
    named = {f"c_{i}": v for i, v in enumerate(carry.values())}
    leaves = df.select(grouped.alias("g"), col(key).alias("k"), col(group).alias("b"), digest(*(field(col(c)) for c in columns)).alias("leaf"), *(v.alias(n) for n, v in named.items()))
    leaves = written(leaves, "merkle-digests")
    rows, placed, groups = _forest(leaves, ["k"], "rows")
    ragged, made, tops = _levels(rows, placed, groups, "rows")
    # The tree over groups: its leaves are the subroots.
    g_rows, g_placed, g_groups = _forest(tops.select(F.lit("").alias("g"), F.col("g").alias("k"), F.col("hash").alias("leaf")), ["k"], "groups")
    g_ragged, g_made, g_top = _levels(g_rows, g_placed, g_groups, "groups")
    root = g_top.first()
    nothing = F.array().cast(PATH)
    g_ways = _ways(g_ragged, g_made, g_groups.select("g", "depth", nothing.alias("path")), "groups")
    above = _proven(g_rows, g_placed, g_ways, ["k"]).select(F.col("k").alias("g"), F.col("leaf").alias("subroot"), F.col("proof").alias("path"))
    above = written(groups.join(above, "g"), "merkle-subroots")
    ways = _ways(ragged, made, above, "rows")
    proven = _proven(rows, placed, ways, ["k", "b", *named])
    proven = proven.join(small(above.select("g", "subroot"), 100_000), "g")
    names = {key: F.col("k"), group: F.col("b")} | {n: F.col(c) for n, c in zip(carry, named, strict=True)} | {"leaf": F.col("leaf"), "subroot": F.col("subroot"), "proof": F.col("proof")}
    label = F.when(F.col("g") != "", F.expr("substring(g, 2)")).cast(kinds[group])
    return Manifest(proven.select(*(v.alias(n) for n, v in names.items())), above.select(label.alias(group), F.col("total").alias("rows"), "depth", "subroot"), root["hash"] if root else None)
