import io
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from tessera.operators import stateful
from tessera.sources import files, results
from tessera.streaming import captures


def _zip(entries):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, body in entries.items():
            z.writestr(name, body)
    return out.getvalue()


W = 'xmlns:w="w"'
DOCX = {"word/document.xml": f'<w:document {W}><w:body><w:p><w:pPr><w:pStyle w:val="Heading1"/></w:pPr><w:r><w:t>Title</w:t></w:r></w:p><w:p><w:r><w:t>Body text</w:t></w:r></w:p><w:tbl><w:tr><w:tc><w:p><w:r><w:t>a|b</w:t></w:r></w:p></w:tc></w:tr><w:tr><w:tc><w:p><w:r><w:t>1</w:t></w:r></w:p></w:tc></w:tr></w:tbl></w:body></w:document>'}
XLSX = {
    "xl/workbook.xml": '<workbook><sheets><sheet name="One"/></sheets></workbook>', "xl/sharedStrings.xml": "<sst><si><t>name</t></si><si><t>x</t></si></sst>",
    "xl/worksheets/sheet1.xml": '<worksheet><sheetData><row><c r="A1" t="s"><v>0</v></c><c r="C1"><v>5</v></c></row><row><c r="A2" t="s"><v>1</v></c></row></sheetData></worksheet>',
}


def test_files_of_all_kinds(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for name, data in {"a.txt": "﻿hello".encode(), "b.docx": _zip(DOCX), "c.xlsx": _zip(XLSX), "d.docx": b"broken", "e.pdf": b"%PDF", "f.bin": b"?", "My report 7.csv": b"k,v\n1,a|b\n2,\n"}.items():
        (tmp_path / "in" / name).write_bytes(data)
    found = files.files(spark, f"file://{tmp_path}/in")
    assert {r.kind: r.supported for r in found.select("kind", "supported").collect()} == {"txt": True, "docx": True, "xlsx": True, "pdf": True, "bin": False, "csv": True}
    out = {r.path.rpartition("/")[2]: r for r in files.pages(found).collect()}
    assert out["a.txt"].text == "hello"
    assert out["b.docx"].text == "# Title\nBody text\n| a¦b |\n|---|\n| 1 |"
    assert out["c.xlsx"].text == "## One\n| name |  | 5 |\n|---|---|---|\n| x |  |  |"
    assert out["d.docx"].text is None and "BadZipFile" in out["d.docx"].error and out["e.pdf"].error == "no reader for pdf"
    given = files.pages(found, {"pdf": lambda data: ["page one", "page two"]}).where("path like '%pdf'").orderBy("page_num").collect()
    assert [r.text for r in given] == ["page one", "page two"]
    assert "My-report-7" in {r.id for r in files.named(found).select("id").collect()}
    assert files.csv_markdown(spark, f"file://{tmp_path}/in/My report 7.csv").first().text == "| k | v |\n|---|---|\n| 1 | a¦b |\n| 2 |  |"


def test_archives_that_unpack_too_large_are_refused(monkeypatch):
    monkeypatch.setattr(files, "MAX_TOTAL", 10)
    with pytest.raises(ValueError, match="too large"):
        files._docx(_zip(DOCX))


def test_search_answers(spark):
    ok = lambda key, *hits: json.dumps({"results": list(hits)} if key == "results" else {"web": {"results": list(hits)}})
    rows = [
        ("q1", "brave", 1, 503, None), ("q1", "searxng", 2, 200, ok("results", {"title": "T", "url": "u", "content": "c", "score": "0.5"}, {"title": "no url"}, {"title": "B", "url": "v"})),
        ("q2", "tavily", 1, 401, "{}"), ("q2", "searxng", 2, 200, ok("results", {"title": "T", "url": "u"})),
        ("q3", "bocha", 1, 200, '{"code": 429}'), ("q3", "brave", 2, 200, ok("web", {"title": "W", "url": "w", "description": "d"})), ("q4", "brave", 1, 200, ok("web")),
    ]
    out = results.hits(spark.createDataFrame(rows, "query string, provider string, priority int, status int, body string"), 5).orderBy("query", "rank").collect()
    assert [(r.query, r.provider, r.rank, r.title, r.url, r.snippet, r.score) for r in out] == [("q1", "searxng", 1, "T", "u", "c", 0.5), ("q1", "searxng", 2, "B", "v", None, None), ("q3", "brave", 1, "W", "w", "d", None)]


def _stream(spark, tmp_path, df, name, order="ts", parts=4):
    """The rows as a stream of files in order, one for each batch."""
    path = f"{tmp_path}/{name}"
    rows = df.orderBy(order).collect()
    for i in range(parts):
        part = rows[i * len(rows) // parts : (i + 1) * len(rows) // parts]
        spark.createDataFrame(part, df.schema).coalesce(1).write.mode("append").parquet(f"file://{path}")
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"file://{path}")


def _drain(spark, out, tmp_path, name, mode="append"):
    q = out.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", f"file://{tmp_path}/check-{name}").trigger(availableNow=True).start()
    q.awaitTermination(120)
    return spark.table(name)


@pytest.fixture(scope="module")
def events(spark):
    e = spark.read.parquet("/root/testdata/sf0.001/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    return e.select("event_id", "user_id", "event_type", "ts").where("user_id < 20")


def test_streams_follow_the_batch_rules(spark, tmp_path, events):
    stream = _stream(spark, tmp_path, events, "e1")
    got = _drain(spark, captures.throttle(stream, 7200), tmp_path, "throttled")
    want = stateful.throttle(events, 7200)
    assert sorted(map(tuple, got.select("tie", "accepted").collect())) == sorted(map(tuple, want.select("event_id", "accepted").collect()))
    got = _drain(spark, captures.cache_hits(_stream(spark, tmp_path, events, "e2"), 7200), tmp_path, "cached")
    want = stateful.cache_hits(events, 7200)
    assert sorted(map(str, map(tuple, got.select("tie", "hit", "age_seconds").collect()))) == sorted(map(str, map(tuple, want.select("event_id", "hit", "age_seconds").collect())))


def test_stream_sessions_and_windows(spark, tmp_path, events):
    # The last session of the stream stays open until later events move the watermark.
    late = spark.createDataFrame([(10**6, 10**6, "view")], "event_id long, user_id long, event_type string").withColumn("ts", F.lit("2024-12-31 00:00:00").cast("timestamp")).select(events.columns)
    both = events.unionByName(late)
    got = _drain(spark, captures.idle_sessions(_stream(spark, tmp_path, both, "e3"), "8 hours"), tmp_path, "sessions")
    want = stateful.idle_sessions(events, 8 * 3600)
    cut = sorted(map(tuple, got.select("user_id", "started", "ended", "events").collect()))
    assert cut == sorted(map(tuple, want.select("user_id", "started", "ended", "events").collect()))
    n = _drain(spark, captures.windowed_counts(_stream(spark, tmp_path, both, "e4"), "1 day"), tmp_path, "windows")
    assert n.agg(F.sum("n")).first()[0] == events.count()


def test_stream_contents_come_once(spark, tmp_path):
    rows = [(i, t) for i, t in enumerate(["a", "b", "a", "", "", "c", "b", "a"])]
    df = spark.createDataFrame(rows, "i int, text string").withColumn("ts", F.timestamp_seconds(F.col("i") + 1_700_000_000))
    got = _drain(spark, captures.new_contents(_stream(spark, tmp_path, df, "c1"), delay="1 hour"), tmp_path, "contents")
    assert sorted(r.i for r in got.collect()) == [0, 1, 3, 4, 5]


def test_stream_diffs(spark, tmp_path):
    rows = [(1, 1, "s1", "a"), (1, 1, "s2", "b"), (1, 2, "s1", "a"), (1, 2, "s2", "B"), (1, 2, "s3", "c"), (1, 3, "s3", "c"), (2, 1, "s1", "z")]
    df = spark.createDataFrame(rows, "page_id int, version int, sid string, t string")
    got = _drain(spark, captures.snapshot_diffs(_stream(spark, tmp_path, df, "d1", "version", parts=1)), tmp_path, "diffs")
    assert sorted(map(tuple, got.collect()), key=str) == sorted([(1, 1, None, "first"), (1, 2, "s2", "changed"), (1, 2, "s3", "added"), (1, 3, "s1", "removed"), (1, 3, "s2", "removed"), (2, 1, None, "first")], key=str)
