"""What a task holds must not grow with the tables."""

import pandas as pd
from pyspark.sql import functions as F

from tessera.functions import ocr
from tessera.operators import sectioning, tables
from tessera.sources import bundles, html
from tessera.storage import spread
from tessera.streaming import stores


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_rows_are_spread_by_their_number(spark):
    one = spark.range(1000, numPartitions=1)
    assert spread(one, 100).rdd.getNumPartitions() == 10 and spread(one, 1000).rdd.getNumPartitions() == 1
    assert spread(one, 100, "id").distinct().count() == 1000


def test_pages_are_parsed_in_several_tasks(spark):
    made = spark.range(html.PAGES * 2 + 1, numPartitions=1).select(F.col("id").alias("page_id"), F.lit("<p>a").alias("html"))
    assert html.elements(made).rdd.getNumPartitions() == 3


def test_lines_are_spread_by_documents(spark):
    docs = spark.range(max(sectioning.PAGES, tables.TEXTS) + 1, numPartitions=1).select(F.col("id").alias("doc_id"), F.lit(1).alias("page_num"), F.lit("1. Aims\nb").alias("text"))
    for made in (sectioning.sections(docs), tables.markdown_tables(docs), tables.scanned_tables(docs)[0]):
        assert "RepartitionByExpression" in _plan(made)


def test_cells_are_made_once(spark):
    made = spark.createDataFrame([(1, "| a | b |\n|---|---|\n| 1 | x |\n| 2 | y |\n| 3 | z |")], "k int, markdown string")
    stats = tables.column_stats(tables.markdown_cells(made, ["k"]), ["k"])
    assert _plan(stats).count("Generate posexplode") == 2 and [tuple(r) for r in stats.collect()] == [(1, "a", 1.0, 3.0, 2.0, 3)]


def test_runs_of_a_key_are_merged(monkeypatch):
    monkeypatch.setattr(stores, "SORTED", 3)
    monkeypatch.setattr(stores, "READ", 2)
    rows = [("k", i * 7 % 20, i) for i in range(20)]
    parts = (pd.DataFrame(rows[i : i + 2]) for i in range(0, 20, 2))
    got = stores._ordered(parts)
    assert not isinstance(got, list) and list(got) == sorted(rows, key=lambda r: r[1:3])


def test_a_bundle_is_read_by_its_list(spark, tmp_path):
    files = spark.createDataFrame([("d", "section", f"{i} x.md", "{}", b"abc") for i in range(3)], bundles.SCHEMA)
    bundles.write_bundle(files, str(tmp_path / "b"))
    back = bundles.read_bundle(spark, str(tmp_path / "b"))
    assert "binaryFile" not in _plan(back) and "Join" not in _plan(back) and {bytes(r.content) for r in back.collect()} == {b"abc"}


def test_lines_of_scans_are_split_once(spark):
    plan = _plan(spark.createDataFrame([("a\nb",)], "v string").select(ocr.clean(F.col("v"))))
    assert plan.count("split(") <= 2
