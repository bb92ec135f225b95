import json
import os

import pytest
from pyspark.sql import functions as F

from tessera.sources import bundles, recorded, results


def _answers(spark):
    hit = lambda n, u="u": {"title": f"t{n}", "url": f"{u}{n}" if u else "", "content": f"c{n}", "publishedDate": None, "score": n / 4}
    rows = []
    for q in range(40):
        rows.append((f"q{q}", "searxng", 1, [200, 429, 500, 400, 204][q % 5], json.dumps({"results": [hit(i, "" if i == 1 else "u") for i in range(q % 7)]})))
        rows.append((f"q{q}", "bocha", 2, 200, json.dumps({"code": [200, 500, 403][q % 3], "data": {"webPages": {"value": [{"name": "é", "url": f"b{i}", "snippet": 7} for i in range(q % 13)]}}})))
        rows.append((f"q{q}", "brave", 3, None if q % 2 else 200, "no json" if q % 4 == 0 else json.dumps({"web": {"results": [{"title": "W", "url": "w"}]}})))
    return spark.createDataFrame(rows, "query string, provider string, priority int, status int, body string")


def test_recorded_answers_give_the_hits_of_the_table(spark, tmp_path):
    answers, path = _answers(spark), f"{tmp_path}/recorded"
    recorded.record(answers, f"file://{path}", 3)
    recorded.register(spark)
    read = lambda **o: spark.read.format("recorded_answers").options(path=path, **o).load()
    rows = lambda df: sorted(map(str, map(tuple, df.select("query", "provider", "rank", "title", "url", "snippet", "published_at", "score").collect())))
    want = results.hits(answers, 5)
    assert rows(read(limit=5)) == rows(want) and want.count()
    assert read().rdd.getNumPartitions() == 3
    assert rows(read(limit=5).where("query = 'q7' and rank <= 2")) == rows(want.where("query = 'q7' and rank <= 2"))
    assert rows(read(limit=5).where("provider = 'brave'")) == rows(want.where("provider = 'brave'"))
    every = read(chain="false", limit=20).where("provider in ('bocha', 'brave')")
    assert {r.provider for r in every.select("provider").distinct().collect()} == {"bocha", "brave"} and every.where("provider = 'brave'").count() > want.where("provider = 'brave'").count()


def test_filters_reach_the_source():
    from pyspark.sql.datasource import EqualTo, In, IsNotNull, LessThanOrEqual

    r = recorded.RecordedReader("x", 10, False)
    left = list(r.pushFilters([EqualTo(("query",), "a"), In(("provider",), ("b", "c")), LessThanOrEqual(("rank",), 3), IsNotNull(("url",))]))
    assert [type(f) for f in left] == [IsNotNull] and r.wanted == {"query": {"a"}, "provider": {"b", "c"}} and r.limit == 3
    assert len(list(recorded.RecordedReader("x", 10, True).pushFilters([EqualTo(("provider",), "b")]))) == 1


def _files(spark):
    s = spark.createDataFrame([(d, i, f"s{i}", f"Title {i}/{d}", f"text {i}") for d in range(5) for i in range(4)] + [(7, 0, "s", None, None)], "doc_id int, idx int, sid string, title string, text string")
    t = spark.createDataFrame([(d, 1, "| a |\n|---|\n| 1 |", 2) for d in range(5)], "doc_id int, idx int, markdown string, page_start int")
    i = spark.createDataFrame([(1, 1, "png", bytearray(b"\x00\xff")), (1, 2, "jpg", None)], "doc_id int, idx int, extension string, original binary")
    o = spark.createDataFrame([(1, 3, '[{"text": "é"}]')], "doc_id int, page_num int, blocks string")
    return bundles.section_files(s).unionByName(bundles.table_files(t)).unionByName(bundles.image_files(i)).unionByName(bundles.ocr_files(o))


def test_files_are_written_and_read_back(spark, tmp_path):
    files, path = _files(spark).repartition(4), f"{tmp_path}/bundle"
    bundles.write_bundle(files, path)
    back = bundles.read_bundle(spark, path)
    rows = lambda df: sorted((r.doc_id, r.kind, r.name or "", bytes(r.content or b"")) for r in df.collect())
    assert rows(back) == rows(files)
    assert back.where(F.sha2("content", 256) != F.col("sha256")).count() == 0 and "Title 0-3" not in os.listdir(f"{path}/data")
    more = spark.createDataFrame([("../x", "table", "../../evil.md", "{}", bytearray(b"e"))], bundles.SCHEMA)
    bundles.write_bundle(more, path, "append")
    assert bundles.read_bundle(spark, path).count() == files.count() + 1 and not os.path.exists(f"{tmp_path}/evil.md")
    assert bundles.read_bundle(spark, path).where("doc_id = '../x'").first().name == "../../evil.md"
    bundles.write_bundle(more, path)
    assert bundles.read_bundle(spark, path).count() == 1


def test_a_failed_task_leaves_no_manifest(spark, tmp_path):
    path = f"{tmp_path}/failed"
    bad = _files(spark).unionByName(spark.createDataFrame([("1", "nothing", "n", "{}", None)], bundles.SCHEMA)).repartition(4)
    with pytest.raises(Exception, match="unknown kind"):
        bundles.write_bundle(bad, path)
    assert not [n for n in os.listdir(path) if n.startswith("manifest")] and bundles.read_bundle(spark, path).count() == 0
    assert not os.path.exists(f"{path}/_staged") or not os.listdir(f"{path}/_staged")
    bundles.write_bundle(_files(spark), path)
    with pytest.raises(Exception, match="unknown kind"):
        bundles.write_bundle(bad, path)
    assert bundles.read_bundle(spark, path).count() == _files(spark).count()
