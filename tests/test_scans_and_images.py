import io
import json
import zipfile

from pyspark.sql import functions as F

from tessera.functions import ocr, text, urls
from tessera.operators import images, profiles, stateful, tables
from tessera.sources import files, scans


def _values(spark, rows, column):
    return [r[0] for r in spark.createDataFrame([(i, v) for i, v in enumerate(rows)], "i int, v string").select("i", column.alias("x")).orderBy("i").select("x").collect()]


def test_engine_answers_flattened(spark):
    lists = {"rec_texts": [" A ", "", "B"], "rec_scores": [0.9, 0.8], "rec_polys": [[[1, 2], [5, 2], [5, 9], [1, 9]], [[0, 0]], [[7.5, 1], [3, -4]]]}
    pairs = [[[[[0, 0], [4, 0], [4, 2], [0, 2]], ["x", 0.5]], [[[1, 1], [2, 3]], "y"], ["bad"]]]
    rows = [(1, 1, json.dumps(lists)), (2, 1, json.dumps([lists])), (3, 1, json.dumps(pairs)), (4, 1, "no json"), (5, 1, None), (6, 1, json.dumps({"rec_texts": ["t"], "boxes": [[9, 8, 1, 2]]}))]
    out = scans.flattened(spark.createDataFrame(rows, "doc_id int, page int, result string"))
    got = [tuple(r) for r in out.orderBy("doc_id", "ord").collect()]
    ab = [(1, 0, "A", 1.0, 2.0, 5.0, 9.0, 0.9), (1, 1, "B", 3.0, -4.0, 7.5, 1.0, 0.0)]
    assert got == [(1, *x) for x in ab] + [(2, *x) for x in ab] + [(3, 1, 0, "x", 0.0, 0.0, 4.0, 2.0, 0.5), (3, 1, 1, "y", 1.0, 1.0, 2.0, 3.0, 0.0), (6, 1, 0, "t", 1.0, 2.0, 9.0, 8.0, 0.0)]
    assert {r.doc_id: r.text for r in scans.page_text(out).collect()}[3] == "x\ny"


def test_files_beside_documents(spark):
    layout = json.dumps({"coordinate_system": "px", "version": 1, "pages": [{"page": 1, "width": 10, "height": 20, "blocks": [{"block_id": "b", "text": "t", "bbox": [1, 2, 3, 4], "confidence": 0.5}]}, {"page": 2}]})
    listed = json.dumps([{"table_id": "table-01", "page": 1, "row_count": 2, "bbox": [0, 0, 1, 1], "json_file": "tables/a.json"}, {"table_id": "table-02", "json_file": "../x.json"}])
    df = spark.createDataFrame([(1, layout, listed), (2, None, None)], "doc_id int, layout string, tables string")
    assert [tuple(r) for r in scans.layout_pages(df).orderBy("page").collect()] == [(1, 1, 10, 20, 1), (1, 2, 0, 0, 0)]
    assert [tuple(r) for r in scans.layout_blocks(df, 1).collect()] == [(1, 1, "b", "t", 1.0, 2.0, 3.0, 4.0, 0.5)] and not scans.layout_blocks(df, 2).collect()
    assert [(r.table_id, r.json_file, r.bbox_available) for r in scans.table_entries(df).orderBy("table_id").collect()] == [("table-01", "tables/a.json", True), ("table-02", None, False)]
    assert [tuple(r) for r in scans.discovered(df).orderBy("doc_id").collect()] == [(1, True, "px", 2, 1, 2), (2, False, "", 0, 0, 0)]
    assert _values(spark, [layout, '{"a": "\\"blocks\\": ["}', '{"x": {"ocr_blocks": []}}', '{"blocks": 3}', None], scans.leaks_geometry(F.col("v"))) == [True, False, True, False, False]
    assert _values(spark, ["tables/../tables/a.json", "/tables/a.json", "tables/a.txt", "tables/b/a.json", "x/a.json", None], scans.inside_tables(F.col("v"))) == [False, False, False, True, False, False]


def test_tables_in_scanned_text(spark):
    body = "intro\n| a | b |\n|---|---|\n| 1 | 2 |\n| x | y |\ntext\n| only | head |\n|---|---|\nrest\n1 first row of a price table 100 ¥ 20%\n序号 名称 数量 税率\n1 软件产品平台服务一年期授权许可 3 套 6%\n合计 300\nend\n2"
    found, rest = tables.scanned_tables(spark.createDataFrame([(1, 1, body), (1, 2, ""), (2, 1, None)], "doc_id int, page_num int, text string"))
    got = [tuple(r) for r in found.orderBy("idx").collect()]
    assert got == [(1, 1, 1, "| a | b |\n|---|---|\n| 1 | 2 |\n| x | y |"), (1, 1, 2, "序号 名称 数量 税率\n1 软件产品平台服务一年期授权许可 3 套 6%\n合计 300")]
    assert {(r.doc_id, r.page_num): r.text for r in rest.collect()} == {(1, 1): "intro\ntext\n| only | head |\nrest\n1 first row of a price table 100 ¥ 20%\nend", (1, 2): "", (2, 1): ""}


def test_stamps_and_watermarks(spark):
    body = "合同签订地点：北京\n甲\n定作\n定作\n乙\n丙\n丁\n定作\n戊\n定作\n第 1 页 / 共 2 页\n己"
    assert _values(spark, [body], ocr.clean(F.col("v"))) == ["合同签订地点：北京\n甲\n乙\n丙\n丁\n定作\n戊\n己"]
    assert _values(spark, ["万翼签\n翼签 万翼\na  \ntingyun.com\n价 30 月/个\n万", "签"], ocr.without_noise(F.col("v"))) == ["a\n价 30 元/个\n万", "签"]


def test_addresses_in_all_spellings(spark):
    cases = {"http://[::1]/": "private address", "http://[0:0:0:0:0:0:0:1]/": "private address", "http://[::ffff:7f00:1]/": "private address", "http://[::ffff:127.0.0.1]/": "private address", "http://[0:0:0:0:0:ffff:10.0.0.1]/": "private address",
             "http://[::ffff:8.8.8.8]/": None, "http://[2606:4700::1111]/": None, "http://[FE80::1%25eth0]/": "private address", "http://[fd00::]/": "private address", "http://[64:ff9b::a00:1]/": "private address", "http://[::]/": "private address",
             "http://[1::2::3]/": "no host", "http://[12345::]/": "no host", "http://[ff02::1]/": "private address", "http://[2002:7f00:1::]/": "private address", "http://[::127.0.0.1]/": "private address"}
    assert _values(spark, list(cases), urls.violation(F.col("v"))) == list(cases.values())


def _document(paragraphs, rels):
    ns = 'xmlns:w="w" xmlns:a="a" xmlns:r="r" xmlns:v="v"'
    body = "".join(f'<w:p><w:pPr>{f"""<w:pStyle w:val="{style}"/>""" if style else ""}</w:pPr><w:r><w:t>{words}</w:t></w:r>{extra}</w:p>' for words, style, extra in paragraphs)
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f"<w:document {ns}><w:body>{body}</w:body></w:document>")
        z.writestr("word/_rels/document.xml.rels", "<Relationships>" + "".join(f'<Relationship Id="{i}" Type="{t}" Target="{g}"{m}/>' for i, t, g, m in rels) + "</Relationships>")
        z.writestr("word/media/one.png", b"\x89PNG")
    return out.getvalue()


def test_images_of_word_documents(spark, tmp_path):
    blip = lambda i: f'<w:drawing><a:blip r:embed="{i}"/></w:drawing>'
    paragraphs = [("Cover", "", ""), ("Licences", "Heading 2", ""), ("before", "", ""), ("shown here", "", blip("r1") + blip("r1") + blip("r3")), ("", "", '<v:imagedata r:id="r2"/>'), ("1. Next", "", ""), ("after", "", blip("missing"))]
    (tmp_path / "a.docx").write_bytes(_document(paragraphs, [("r1", "x/image", "media/one.png", ""), ("r2", "x/image", "/word/media/two.png", ""), ("r3", "x/image", "http://e.example/i.png", ' TargetMode="External"')]))
    (tmp_path / "b.docx").write_bytes(b"broken")
    found = files.files(spark, f"file://{tmp_path}")
    p = files.docx_paragraphs(found)
    got = [(r.image_no, r.target, r.paragraph, r.near_heading, r.paragraph_text) for r in files.docx_images(p).orderBy("image_no").collect()]
    assert got == [(1, "word/media/one.png", 3, "Licences", "shown here"), (2, "word/media/two.png", 4, "Licences", "")]
    assert files.docx_images(p).orderBy("image_no").first().context_text == "Cover\nLicences\nbefore\nshown here\n1. Next\nafter" and [r.images for r in files.docx_image_count(p).collect()] == [2]
    assert [(r.target, bytes(r.content)) for r in files.docx_media(found).collect()] == [("word/media/one.png", b"\x89PNG")]


def test_average_hash(spark):
    pixels = [[0] * 32 + [255] * 32, [7] * 64, [255, 0] * 32, []]
    got = [r[0] for r in spark.createDataFrame([(i, p) for i, p in enumerate(pixels)], "i int, p array<int>").orderBy("i").select(images.average_hash(F.col("p"))).collect()]
    assert got == ["00000000ffffffff", "f" * 16, "a" * 16, ""]


def test_average_hash_makes_the_pixels_once(spark):
    pixels = F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: F.col("id") * (i + 4242))
    plan = spark.range(3, numPartitions=1).select(images.average_hash(pixels).alias("h"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("4242") == 1


def test_profiles_from_json(spark):
    config = {"profile": "contract", "classification": {"required_terms": ["合同", " "]}, "quality_policy": {"sparse_text_chars": -5}, "section_policy": {"toc_max_level": 0, "formal_chinese_min_headings": 6},
              "fields": [{"id": "no", "pattern": "No: (\\S+)", "page_scope": [1, "x", True]}, "bad", {"aliases": ["甲方"]}], "groups": [{"start_alias": "甲方", "end_alias": "乙方"}, {"id": "all", "replace_mode": "replace_entire_page"}]}
    p = profiles.load_profile(json.dumps(config))
    assert (p.name, p.required_terms, p.limits["sparse_text_chars"], p.limits["toc_max_level"], p.limits["formal_chinese_min_headings"], p.limits["usable_text_chars"]) == ("contract", ("合同",), 0, 1, 6, 120)
    assert [(f.field, f.pages, f.aliases) for f in p.fields] == [("no", (1,), ()), ("field_2", (), ("甲方",))]
    new = lambda s, b="NEW": profiles.replaced_segment(F.col("v"), s, F.lit(b))
    assert _values(spark, ["a 甲方 x 乙方 y", "nothing", "甲方 to the end"], new(p.segments[0])) == ["a\n\nNEW\n\n乙方 y", "nothing", "NEW"]
    assert _values(spark, ["a"], new(p.segments[1])) == ["NEW"] and _values(spark, ["k two one z"], new(profiles.Segment("s", aliases=("one", "two")))) == ["k\n\nNEW"]


def test_templates_and_paths(spark):
    assert _values(spark, ["zh-CN", "EN", None], text.template(F.col("v"), "front_matter_title")) == ["前言/目录", "Preface / TOC", "Preface / TOC"]
    assert _values(spark, ["zh"], text.template(F.col("v"), "table_truncated", total=F.lit(9), shown=F.lit(2))) == ["[... 9 rows total, showing first 2 ...]"]
    assert _values(spark, ["/home/u/x", "/tmp/x"], text.masked_path(F.col("v"), "/home/u")) == ["~/x", "/tmp/x"]


def test_chains_stores_and_breakers(spark):
    ts = F.timestamp_seconds("s")
    calls = spark.createDataFrame([(1, "w", 0, ["a", "b"]), (2, "w", 5, ["b"]), (3, "w", 6, ["c"]), (4, "w", 10, ["a"]), (5, "w", 12, ["c", "a"]), (6, "v", 1, ["a"])], "event_id int, service string, s int, providers array<string>").withColumn("ts", ts)
    assert {r.event_id: r.accepted for r in stateful.chain_throttle(calls, 10).collect()} == {1: True, 2: False, 3: True, 4: True, 5: False, 6: True}
    seen = spark.createDataFrame([(1, "w", 0, "a"), (2, "w", 1, "b"), (3, "w", 2, "a"), (4, "w", 3, "c"), (5, "w", 4, "b"), (6, "w", 100, "c")], "event_id int, service string, s int, user_id string").withColumn("ts", ts)
    got = {r.event_id: (r.found, r.evicted) for r in stateful.bounded_sessions(seen, 2, 50).collect()}
    assert got == {1: ("new", None), 2: ("new", None), 3: ("hit", None), 4: ("new", "b"), 5: ("new", "a"), 6: ("expired", None)}
    tried = spark.createDataFrame([(1, 1, 0, True), (2, 1, 5, True), (3, 1, 10, False), (4, 1, 11, True), (5, 1, 20, False), (6, 2, 1, False)], "event_id int, user_id int, s int, failed boolean").withColumn("ts", ts)
    assert {r.event_id: r.made for r in stateful.circuit_breaker(tried, 10).collect()} == {1: True, 2: False, 3: True, 4: True, 5: False, 6: True}
