import hashlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from tessera.llm.exact_dedup import distinct_texts, exact_dedup
from tessera.llm.mixing import mix_sources, repeated

UP = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
ROWS = [
    (1, "Hello World", "a"), (2, "hello world", "b"), (3, "", "a"), (4, None, None), (5, "É x", "b"), (6, "é x", "b"), (7, "z" * 300_000, "a"), (8, "Z" * 300_000, "c"),
    (None, "only null key", "c"), (9, "tie", "a"), (9, "tie", "a"), (9, "TIE", "b"), (10, "x y z", None),
]
SCHEMA = "doc_id long, text string, source string"


def _groups(rows):
    groups = defaultdict(list)
    for key, text, *_ in rows:
        groups[(text or "").translate(UP)].append(key)
    return groups


def test_exact_dedup_brute_force(spark):
    groups = _groups(ROWS)
    out = exact_dedup(spark.createDataFrame(ROWS, SCHEMA)).collect()
    assert len(out) == len(ROWS)
    for r in out:
        norm = (r["text"] or "").translate(UP)
        keys = [k for k in groups[norm] if k is not None]
        assert r["keep_id"] == max(keys, default=None)
        assert r["group_size"] == len(groups[norm])
        assert r["text_sha256"] == hashlib.sha256(norm.encode()).hexdigest()
        assert not r["kept"] or r["doc_id"] == r["keep_id"]


def test_one_row_of_each_group_stays(spark):
    kept = distinct_texts(spark.createDataFrame(ROWS, SCHEMA)).collect()
    assert sorted((r["text"] or "").translate(UP) for r in kept) == sorted(_groups(ROWS))
    assert len(kept[0]) == 3


def test_many_groups_of_several_rows(spark, monkeypatch):
    monkeypatch.setattr("tessera.llm.exact_dedup.BROADCAST_REPEATS", 3)
    monkeypatch.setattr("tessera.llm.exact_dedup.HOT", 50)
    rows = [(i, f"text {i % 40}", "a") for i in range(200)] + [(1000 + i, "hot", "b") for i in range(300)] + [(-(1 << 63), "least key", "c"), (None, "least key", "c")]
    out = {r["doc_id"]: r for r in exact_dedup(spark.createDataFrame(rows, SCHEMA).repartition(4)).collect()}
    assert all((out[i]["keep_id"], out[i]["group_size"], out[i]["kept"]) == (160 + i % 40, 5, i >= 160) for i in range(200))
    assert all((out[i]["keep_id"], out[i]["group_size"]) == (1299, 300) for i in range(1000, 1300))
    assert (out[None]["keep_id"], out[None]["kept"], out[-(1 << 63)]["kept"]) == (-(1 << 63), False, True)
    assert distinct_texts(spark.createDataFrame(rows, SCHEMA)).count() == 42


def test_exact_dedup_clashing_names_and_empty_table(spark):
    df = spark.createDataFrame([(1, "a", 5, "q"), (2, "A", 6, "r")], "doc_id long, text string, kept int, t_norm string")
    out = {r["doc_id"]: r for r in exact_dedup(df).collect()}
    assert (out[1]["kept"], out[2]["kept"], out[1]["t_norm"]) == (False, True, "q")
    assert exact_dedup(spark.createDataFrame([], SCHEMA)).collect() == []
    assert distinct_texts(spark.createDataFrame([], SCHEMA)).collect() == []


def test_exact_dedup_runs_no_python(spark):
    plan = distinct_texts(spark.createDataFrame(ROWS, SCHEMA).repartition(2))._jdf.queryExecution().toString() + exact_dedup(spark.createDataFrame(ROWS, SCHEMA).repartition(2))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def _water(sizes, epochs=3.0):
    """Shares given out again and again until no source is over its cap."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: i % 3 + 1 for i, s in enumerate(order)}
    total, done = float(sum(sizes.values())), {}
    free = set(order)
    while True:
        left, w = total - sum(done.values()), sum(weight[s] for s in free)
        over = [s for s in free if left * weight[s] / w > epochs * sizes[s]]
        if not over:
            return done | {s: left * weight[s] / w for s in free}
        for s in over:
            done[s] = epochs * sizes[s]
            free.discard(s)


def test_mix_targets_and_sizes(spark):
    rows = [(i, " ".join(["w"] * (i % 40 + 1)), ["a", "b", "c", None][(i * i) % 7 % 4]) for i in range(4000)] + [(9000 + i, "one two three", "tiny") for i in range(3)]
    sizes, taken = defaultdict(int), defaultdict(int)
    for _, t, s in rows:
        sizes[s] += len(t.split())
    want = _water(sizes)
    out = mix_sources(spark.createDataFrame(rows, SCHEMA).repartition(5)).collect()
    assert len(out) == len(rows)
    for r in out:
        assert r["source_size"] == sizes[r["source"]]
        assert r["target"] == pytest.approx(want[r["source"]])
        assert r["taken"] == r["repeats"] * r["size"] and 0 <= r["repeats"] <= 3
        taken[r["source"]] += r["taken"]
    for s in sizes:
        assert abs(taken[s] - want[s]) <= 60
    again = mix_sources(spark.createDataFrame(rows[::-1], SCHEMA).repartition(3)).collect()
    assert sorted((r["doc_id"], r["taken"]) for r in again) == sorted((r["doc_id"], r["taken"]) for r in out)


def test_mix_edges(spark):
    df = spark.createDataFrame(ROWS, SCHEMA).withColumn("size", F.lit("mine")).withColumn("p_size", F.lit(1))
    out = mix_sources(df).collect()
    assert len(out) == len(ROWS) and {r["size"] for r in out} >= {0, 1, 2}
    assert mix_sources(spark.createDataFrame([], SCHEMA)).collect() == []
    assert all(r["taken"] == 0 for r in mix_sources(spark.createDataFrame([(1, None, "a"), (2, " ", "b")], SCHEMA)).collect())
    mixed = mix_sources(spark.createDataFrame(ROWS, SCHEMA))
    assert repeated(mixed, ["doc_id", "text", "source"]).count() == sum(r["repeats"] for r in mixed.collect())
