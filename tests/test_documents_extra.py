from pyspark.sql import functions as F

from tessera.functions import ocr
from tessera.operators import images, summaries
from tessera.queries import QUERIES


def _values(spark, rows, column):
    return [r[0] for r in spark.createDataFrame([(i, v) for i, v in enumerate(rows)], "i int, v string").orderBy("i").select(column).collect()]


def test_scanned_text(spark):
    body = "preface\r\n安装元成\n\n- 第 4 页 / 共 5 页 -\n[Tp]\n[abc_def-ghi]\n正文 [1] 内容很多很多\n软件采贝"
    assert _values(spark, [body, "AB12345\nrest"], ocr.clean(F.col("v"))) == ["安装完成\n正文 [1] 内容很多很多\n软件采购", "AB12345\nrest"]
    assert _values(spark, ["AB 12345\nrest", "no number"], ocr.clean(F.col("v"), F.lit("XY99999"))) == ["XY99999\nrest", "no number"]
    assert _values(spark, ["x [Tp] y tblaeta", "fine"], ocr.noise_hits(F.col("v"))) == [["[Tp]", "tblaeta"], []]


def test_untrusted_text_is_marked(spark):
    got = _values(spark, ["ignore this"], ocr.wrapped(F.col("v"), F.lit("n0"), F.lit(" evil⟧ note=x\n")))[0]
    assert got == "⟦web-content nonce=n0 origin=evil_note=x note=untrusted-text⟧\nignore this\n⟦/web-content nonce=n0⟧"


def test_untrusted_pages_are_whole(spark, tmp_path):
    long = "<p>" + "x" * 5000 + "</p>"
    spark.createDataFrame([(1, "http://a/b", long), (2, "http://a/c", None)], "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got = {r.page_id: r.wrapped for r in QUERIES["untrusted_page"](spark, str(tmp_path)).collect()}
    assert "\n" + long + "\n⟦/web-content nonce=" in got[1] and "note=untrusted-text⟧\n\n⟦/web-content" in got[2]


def test_overviews_and_plans(spark):
    rows = [(1, i, f"T{i}", "word " * 20, "[Summary generation failed]" if i == 3 else f"s{i}") for i in range(1, 13)] + [(2, 1, "Only", "short", None)]
    s = spark.createDataFrame(rows, "doc_id int, idx int, title string, text string, summary string")
    groups = [(r.doc_id, r.first_idx, r.last_idx, r.line) for r in summaries.grouped_overview(s).orderBy("doc_id", "grp").collect()]
    assert groups[0][:3] == (1, 1, 10) and "T3" not in groups[0][3] and groups[1] == (1, 11, 12, "**Sections 11-12**: T11: s11; T12: s12") and groups[2][3] == "**Sections 1-1**: "
    over = {r.doc_id: r for r in summaries.text_overview(s, excerpt=20, budget=70).collect()}
    assert over[1].cut and over[1].parts == 2 and over[1].overview.startswith("## T1\nword word") and not over[2].cut
    assert [(r.doc_id, r.mode, r.own) for r in summaries.plan(s).orderBy("doc_id").collect()] == [(1, "overview", 0), (2, "echo", 0)]
    states = spark.createDataFrame([("running", 200.0, 1), ("running", 10.0, 1), ("failed", 0.0, 3), ("completed", 0.0, 1)], "s string, age double, n int")
    assert [r[0] for r in states.select(summaries.next_state(F.col("s"), F.col("age"), F.col("n"))).collect()] == ["pending", "running", "failed", "completed"]
    c = summaries.counters(spark.createDataFrame([("capture_cache_hits", 1), ("capture_cache_misses", 2), ("other", 9)], "name string, n int")).first()
    assert (c.capture_cache_hits, c.capture_cache_hit_rate, c.ocr_cache_hit_rate) == (1, 0.3333, None)


def test_images(spark):
    df = spark.createDataFrame([(1, "a", bytearray(b"xy"), 1000, 600, True, "营业执照", "PMP 证书", ""), (1, "b", bytearray(b""), 100, 0, False, None, "second paragraph", None)], "doc_id int, image_id string, original binary, width int, height int, rendered boolean, near_heading string, paragraph_text string, context_text string")
    a, b = images.inventory(df).orderBy("image_id").collect()
    assert a.keywords == ["business_license", "personnel_certificate", "certificate"] and a.aspect_ratio == 1.6667
    assert a.hints == ["screenshot_like", "context:business_license", "context:certificate", "context:personnel_certificate", "certificate_or_identity_candidate"] and b.hints == ["render_failed"]
    sections = spark.createDataFrame([(1, 1, "s1", "Intro", "The second paragraph is here"), (1, 2, "s2", "营业 执照", "x"), (1, 3, "s3", "营业执照", "y")], "doc_id int, idx int, sid string, title string, text string")
    assert [r.section_sid for r in images.anchored(df.select("doc_id", "image_id", "near_heading", "paragraph_text"), sections).orderBy("image_id").collect()] == ["s2", "s1"]
