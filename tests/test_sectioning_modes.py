from pyspark.sql import functions as F

from tessera.operators import sectioning

PAGES = "doc_id int, page_num int, text string"


def _titles(df, *columns):
    return [tuple(r) for r in df.orderBy("doc_id", "idx").select("doc_id", "title", *columns).collect()]


def test_scanned_documents_keep_top_clauses_only(spark):
    body = "1. Scope\nbody\n1.2.3 deep clause\n101.5 kilo notes\nmore\nGF FUTURES\n2、Terms\nlast words"
    rows = [(1, 1, body, True), (2, 1, body, False)]
    out = sectioning.sections(spark.createDataFrame(rows, PAGES + ", is_ocr boolean"))
    assert _titles(out.where("doc_id = 1")) == [(1, "1. Scope"), (1, "2、Terms")]
    assert "GF FUTURES" in [t for _, t in _titles(out.where("doc_id = 2"))]
    short = spark.createDataFrame([(1, 1, "A", 1, "long enough to stay alone", 1, 1), (1, 2, "B", 1, "tiny", 2, 2)], "doc_id int, idx int, title string, level int, text string, page_start int, page_end int")
    assert [(r.title, r.text, r.page_end) for r in sectioning.merge_short_scanned(short).collect()] == [("A", "long enough to stay alone\nB\ntiny", 2)]


def test_formal_contracts_are_split_at_chinese_clauses(spark):
    clauses = "".join(f"第{n}章 条款\n1. 内容甲乙\n正文\n2. 内容丙丁\n正文\n" for n in "一二三四")
    df = spark.createDataFrame([(1, 1, clauses)], PAGES)
    assert [t for _, t in _titles(sectioning.sections(df, formal=True))] == [f"第{n}章 条款" for n in "一二三四"]
    assert len(_titles(sectioning.sections(df))) > 4 and len(_titles(sectioning.sections(df, formal=True, formal_least=5))) > 4


def test_headings_without_body_pages_and_empty_documents(spark):
    rows = [(1, 1, "第一章 总则\n第二章 定义\n第三章 义务\n正文"), (2, 1, "plain words"), (2, 2, "and more"), (3, 1, ""), (3, 2, None), (4, 1, "only one page")]
    out = sectioning.sections(spark.createDataFrame(rows, PAGES))
    got = _titles(out, "text", "page_start", "page_end")
    assert got[:2] == [(1, "第一章 总则", "第二章 定义", 1, 1), (1, "第三章 义务", "正文", 1, 1)]
    assert got[2:] == [(2, "Page 1", "plain words", 1, 1), (2, "Page 2", "and more", 2, 2), (3, "Full document", "", 1, 2), (4, "Preface", "only one page", 1, 1)]
    assert sectioning.sections(spark.createDataFrame([], PAGES)).collect() == []


def test_contents_at_the_front_of_one_page(spark):
    df = spark.createDataFrame([(1, 1, "目录\n第一章 总则\n第二章 细则\n第一章 总则\n内容一\n第二章 细则\n内容二")], PAGES)
    assert _titles(sectioning.sections(df), "text") == [(1, "Preface / TOC", "目录\n第一章 总则\n第二章 细则"), (1, "第一章 总则", "内容一"), (1, "第二章 细则", "内容二")]


def test_parents_take_their_first_child(spark):
    df = spark.createDataFrame([(1, 1, "1. Scope", 1, "1.1 Aims\nbody", 1, 1), (1, 2, "2. Terms", 1, "1.1 Aims\nbody", 1, 1)], "doc_id int, idx int, title string, level int, text string, page_start int, page_end int")
    assert _titles(sectioning.promote_children(df), "level", "text") == [(1, "1.1 Aims", 2, "1. Scope\n1.1 Aims\nbody"), (1, "2. Terms", 1, "1.1 Aims\nbody")]


TOC = "doc_id int, ord int, level int, title string, page int"


def test_toc_preparation(spark):
    toc = spark.createDataFrame([(1, 1, 1, "1. Intro", 1), (1, 2, 2, "1.1 Scope", 1), (1, 3, 2, "1.1  Scope", 1), (1, 4, 1, "2 Terms", 2), (1, 5, 2, "2.1 Price", 3), (1, 6, 3, "2.1.1 deep", 3), (1, 7, 2, " ", 4)], TOC)
    assert [(r.title, r.page, r.parent) for r in sectioning.toc_prepared(toc).orderBy("ord").collect()] == [("1.1 Scope", 1, "1. Intro"), ("2.1 Price", 3, "2 Terms")]
    assert [r.title for r in sectioning.toc_prepared(toc, 1).orderBy("ord").collect()] == ["1. Intro", "2 Terms"]
    assert [r.title for r in sectioning.toc_compacted(toc).orderBy("ord").collect()] == ["1.1 Scope", "2 Terms", "2.1 Price", " "]


def test_sections_by_contents(spark):
    pages = [(1, 1, "cover"), (1, 2, "head\n1.1 Scope\nall of it"), (1, 3, "goes on\n2.1 Price\nten"), (1, 4, "end"), (2, 1, "第一章 甲\nx\n第二章 乙\ny")]
    toc = spark.createDataFrame([(1, 1, 1, "1. Intro", 2), (1, 2, 2, "1.1 Scope", 2), (1, 3, 1, "2. Terms", 3), (1, 4, 2, "2.1 Price", 3), (2, 1, 1, "only", 1)], TOC)
    out = _titles(sectioning.sections_from_toc(spark.createDataFrame(pages, PAGES), toc), "level", "text", "page_start", "page_end")
    assert out == [
        (1, "Preface / TOC", 1, "cover\nhead", 1, 2), (1, "1.1 Scope", 2, "1. Intro\n1.1 Scope\nall of it\ngoes on", 2, 3), (1, "2.1 Price", 2, "2. Terms\n2.1 Price\nten\nend", 3, 4),
        (2, "第一章 甲", 1, "x", 1, 1), (2, "第二章 乙", 1, "y", 1, 1),
    ]
    assert sectioning.sections_from_toc(spark.createDataFrame(pages, PAGES).where(F.lit(False)), toc).collect() == []
