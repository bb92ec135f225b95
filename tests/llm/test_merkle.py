"""The Merkle manifest against a tree built in plain Python."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import merkle
from tessera.llm.merkle import folded, merkle_manifest, segment, siblings

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
COLUMNS = ["doc_id", "source", "lang", "n_chars", "text"]


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row):
    return sha(*("-" if row[c] is None else f"{len(str(row[c]).encode())}:{row[c]}" for c in COLUMNS))


def tree(nodes):
    """Root, and for each leaf the siblings' digests, left and right of it, level by level."""
    ways, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        runs = [nodes[i : i + 8] for i in range(0, len(nodes), 8)]
        for k, i in enumerate(at):
            ways[k].append(("".join(runs[i // 8][: i % 8]), "".join(runs[i // 8][i % 8 + 1 :])))
        at, nodes = [i // 8 for i in at], [sha(*r) for r in runs]
    return nodes[0], ways


def brute(rows):
    groups = {}
    for r in rows:
        groups.setdefault(r["lang"], []).append(((r["doc_id"] is not None, r["doc_id"]), leaf(r), r))
    made = {g: (sorted(v, key=lambda x: (x[0][0], x[0][1] or 0, x[1]))) for g, v in groups.items()}
    order = sorted(made, key=lambda g: (g is not None, (g or "").encode()))
    subs = {g: tree([x[1] for x in made[g]]) for g in order}
    root, above = tree([subs[g][0] for g in order])
    out = []
    for g, up in zip(order, above, strict=True):
        for (_, h, r), way in zip(made[g], subs[g][1], strict=True):
            out.append((r["doc_id"], g, h, subs[g][0], tuple(way + up)))
    return root, out


def check(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA).withColumn("g", F.lit(1)).withColumn("proof", F.lit("x"))
    made = merkle_manifest(df.repartition(3), COLUMNS)
    got = [(r.doc_id, r.lang, r.leaf, r.subroot, tuple((x.left, x.right) for x in r.proof)) for r in made.leaves.collect()]
    root, want = brute([dict(zip(["doc_id", "text", "lang", "source", "n_chars"], r, strict=True)) for r in rows])
    assert made.root == root
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert made.leaves.where(folded(F.col("leaf"), F.col("proof")) != root).count() == 0
    return made


@pytest.mark.parametrize("n", [1, 2, 8, 9, 64, 65, 300])
def test_sizes_of_groups(spark, monkeypatch, n):
    monkeypatch.setattr(merkle, "RANGE_ROWS", 37)
    random.seed(n)
    langs = [None, "", "de", "é", "en"] if n > 8 else ["en"]
    rows = [(i * 7 % 1000, f"text {i}", langs[min(int(random.expovariate(1)), len(langs) - 1)] if n > 8 else "en", "s", i) for i in range(n)]
    made = check(spark, rows)
    assert made.groups.agg(F.sum("rows")).first()[0] == n


def test_nulls_ties_repeats_and_long_texts(spark, monkeypatch):
    monkeypatch.setattr(merkle, "RANGE_ROWS", 10)
    rows = [(None, None, None, None, None)] * 3 + [(1, "", "en", "a", 0)] * 30 + [(1, "x", "en", None, 1), (2, "y" * 3_000_000, "en", "a", 1), (None, "é𝄞", "en", "", None)]
    check(spark, rows)


def test_a_group_for_each_row(spark, monkeypatch):
    monkeypatch.setattr(merkle, "RANGE_ROWS", 10)
    made = check(spark, [(i, "t", f"lang{i:03d}", "s", 1) for i in range(100)])
    assert made.groups.where("depth = 0 and rows = 1").count() == 100


def test_empty(spark):
    made = merkle_manifest(spark.createDataFrame([], SCHEMA), COLUMNS)
    assert made.root is None and made.leaves.count() == 0 and made.groups.count() == 0


def test_carried_columns_and_tampering(spark):
    rows = [(i, f"Text {i}", "en", "s", i) for i in range(20)]
    df = spark.createDataFrame(rows, SCHEMA)
    made = merkle_manifest(df, COLUMNS, carry={"bad leaf": F.sha2(F.lit("other"), 256)})
    out = made.leaves.select((folded(F.col("bad leaf"), F.col("proof")) == made.root).alias("a"), (folded(F.col("leaf"), F.col("proof")) == made.root).alias("b"), F.length(siblings(F.col("proof"))).alias("n")).collect()
    assert not any(r.a for r in out) and all(r.b for r in out)
    assert {r.n for r in out} == {64 * (7 + 2), 64 * (3 + 2)}


def test_segment_agrees_with_the_whole_tree():
    random.seed(3)
    for _ in range(200):
        n = random.randint(1, 700)
        leaves = [str(i) for i in range(n)]
        a = random.randint(0, n - 1)
        b = random.randint(a + 1, n)
        s = segment(leaves[a:b], a, n)
        level, nodes = 0, leaves
        for level, (first, own) in enumerate(zip(s.first, s.nodes, strict=True)):
            assert own == nodes[first : first + len(own)]
            nodes = [sha(*nodes[i : i + 8]) for i in range(0, len(nodes), 8)]
        assert level <= len(np.base_repr(n, 8))


def test_query(spark, sf):
    from tessera.llm.queries import QUERIES

    out = {r.doc_id: r for r in QUERIES["op11_merkle"](spark, sf).collect()}
    rows = [r.asDict() for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    root, want = brute(rows)
    texts = {r["doc_id"]: r for r in rows}
    assert len(out) == len(want)
    for key, _, h, sub, way in want:
        r, fold = out[key], h
        if zlib.crc32(str(key).encode()) % 3 == 0:
            row = dict(texts[key])
            row["text"] = row["text"] and "".join(c.lower() if "A" <= c <= "Z" else c for c in row["text"])
            fold = leaf(row)
        for x, y in way:
            fold = sha(x, fold, y)
        assert (r.leaf, r.subroot, r.root, r.proof_sha256, r.folded_root, r.verified) == (h, sub, root, sha(*(x + y for x, y in way)), fold, fold == root)
