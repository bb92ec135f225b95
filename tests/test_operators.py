import random
import re
from collections import defaultdict

from pyspark.sql import functions as F

from tessera.operators import chunks, layout, library, pages, profiles, quality, search, sectioning, stateful, tables
from tessera.plans import corpus
from tessera.sources import html


def _rows(df, *order):
    return [tuple(r) for r in (df.orderBy(*order) if order else df).collect()]


def test_library_search_weights_and_filters(spark):
    lib = spark.createDataFrame([
        (1, "tax.pdf", "about tax", ["tax-law", "x"], {"k": "Tax", "n": None}, "pdf", "Contract"), (2, "none.txt", "", [], {}, "txt", None), (3, "x", "TAX", None, None, "pdf", "bid"),
    ], "doc_id int, filename string, digest string, tags array<string>, metadata map<string,string>, file_type string, content_type string")
    assert _rows(search.search_library(lib, "tax").select("doc_id", "score", "total")) == [(1, 5.5, 2), (3, 1.0, 2)]
    assert _rows(search.search_library(lib, limit=1).select("doc_id", "score", "total")) == [(1, 1.0, 3)]
    assert [r.doc_id for r in library.filter_documents(lib, content_type="GENERAL").collect()] == [2]
    assert [r.doc_id for r in library.filter_documents(lib, file_type="pdf", tags="nope, x").collect()] == [1]
    assert sorted(r.doc_id for r in library.filter_documents(lib, metadata={"n": "null"}).collect()) == [1, 2, 3]


def test_upsert_delete_and_stale_writers(spark):
    old = spark.createDataFrame([("a", 1, "x"), ("b", 1, "y")], "id string, version int, v string")
    new = spark.createDataFrame([("b", 2, "z"), ("c", 1, "w")], "id string, version int, v string")
    assert _rows(library.upsert(old, new), "id") == [("a", 1, "x"), ("b", 2, "z"), ("c", 1, "w")]
    assert _rows(library.delete(old, new), "id") == [("a", 1, "x")]
    lib = spark.createDataFrame([("a", "g1", "old"), ("b", "g2", "old")], "id string, generation string, summary string")
    late = spark.createDataFrame([("a", "g1", "new"), ("b", "g1", "new")], "id string, generation string, summary string")
    assert _rows(library.guarded_update(lib, late, ["summary"]), "id") == [("a", "g1", "new"), ("b", "g2", "old")]


def test_cached_captures(spark):
    c = spark.createDataFrame([("a", "u", 100), ("b", "u", 160), ("c", "u", 160), ("d", None, 10), ("e", "v", 500)], "id string, url string, s int").withColumn("created_at", F.timestamp_seconds("s"))
    q = spark.createDataFrame([(1, "u", 120), (2, "u", 165), (2, "u", 165), (3, "u", 300), (4, "u", 90), (5, None, 20), (6, "v", 499), (7, "v", 560), (8, "v", 561)], "q int, url string, s int").withColumn("ts", F.timestamp_seconds("s"))
    out = [(r.q, r.hit, r.age_seconds) for r in library.cache_lookup(q, c, ["url"], 60).orderBy("q").collect()]
    assert out == [(1, "a", 20.0), (2, "b", 5.0), (2, "b", 5.0), (3, None, None), (4, None, None), (5, "d", 10.0), (6, None, None), (7, "e", 60.0), (8, None, None)]


def test_ids_of_new_documents(spark):
    new = spark.createDataFrame([(i, f"r{i % 3}.pdf") for i in range(10)], "n int, filename string")
    ids = [r.id for r in library.numbered_ids(new, spark.createDataFrame([("DOC-012",), ("x",)], "id string"), ["n"]).orderBy("n").collect()]
    assert ids == [f"DOC-{i:03d}" for i in range(13, 23)]
    many = spark.range(5000).withColumn("n", (F.col("id") * 37) % 5000).drop("id").withColumn("other", F.lit("x")).repartition(7)
    assert [int(r.id[4:]) for r in library.numbered_ids(many, spark.createDataFrame([], "id string"), ["n"]).orderBy("n").collect()] == list(range(1, 5001))
    taken = spark.createDataFrame([("r0",), ("r0-4",)], "id string")
    got = [r.id for r in library.filename_ids(new, taken, order="n").orderBy("n").collect()]
    assert got == ["r0-5", "r1", "r2", "r0-6", "r1-2", "r2-2", "r0-7", "r1-3", "r2-3", "r0-8"]


def test_table_blocks(spark):
    docs = [
        (1, "intro\n| a | b |\n|---|:-:|\n| 1 | 2 |\ntail\n```\n| x |\n|---|\n| 1 |\n```\n    | i |\n    |---|\n    | 1 |"),
        (2, "| a |\n|---|\n| 1 |\n| b |\n|---|\n| 2 |\n| 3 |"), (3, "|  | - |  |\n| x | y | z |\n| 1 | 2 | 3 |"), (4, "|---|"), (5, None), (6, "~~~\n```\n| a |\n|---|\n| 1 |\n~~~\n| a |\n|---|\n| 1 |"),
    ]
    got = _rows(tables.markdown_tables(spark.createDataFrame(docs, "doc_id int, text string")).select("doc_id", "idx", "first_line", "last_line"), "doc_id", "idx")
    assert got == [(1, 1, 1, 3), (2, 1, 0, 2), (2, 2, 3, 6), (6, 1, 6, 8)]
    size = spark.createDataFrame([("| a | b |\n|---|---|\n| 1 | 2 | 3 |",), ("| | |\n| x |",)], "m string").select(tables.dimensions(F.col("m"))).collect()
    assert [tuple(r[0]) for r in size] == [(2, 3, 1), (2, 2, 0)]


def test_column_stats_need_mostly_numbers(spark):
    md = "| name | price | date |\n|---|---|---|\n| a | $1,200.50 | 2024-01-15 |\n| b | 3% | 2 |\n| c | x | 3 |"
    cells = tables.markdown_cells(spark.createDataFrame([(1, md)], "t int, markdown string"), ["t"])
    assert _rows(tables.column_stats(cells, ["t"]).select("column", "min", "max", "avg", "count")) == []
    more = md + "\n| d | 5 | 4 |"
    cells = tables.markdown_cells(spark.createDataFrame([(1, more)], "t int, markdown string"), ["t"])
    assert _rows(tables.column_stats(cells, ["t"]).select("column", "min", "max", "avg", "count"), "column") == [("date", 2.0, 4.0, 3.0, 3), ("price", 3.0, 1200.5, 402.83, 3)]


def test_running_headers_go_and_body_stays(spark):
    rows = [(1, i, f"ACME Co\n\nbody {i}\nsame\n{i}") for i in range(1, 6)] + [(2, i, f"ACME Co\nbody\n{i}") for i in range(1, 4)]
    out = {(r.doc_id, r.page_num): r.text for r in quality.strip_running_lines(spark.createDataFrame(rows, "doc_id int, page_num int, text string")).collect()}
    assert out[(1, 3)] == "\nbody 3" and out[(2, 1)] == "ACME Co\nbody\n1"


def test_quality_and_plan(spark):
    s = spark.createDataFrame([(1, 1, 10, 1, True, False), (1, 2, 10, 1, True, True), (1, 3, 900, 0, False, False), (2, 1, 900, 0, False, False)], "doc_id int, page_num int, text_len int, image_count int, scan_like boolean, blank_like boolean")
    a = quality.assess(s)
    assert _rows(a.select("doc_id", "quality"), "doc_id") == [(1, "scan_only"), (2, "text")]
    plan = lambda **k: _rows(quality.plan_ocr(a, **k).select("local_ocr_pages", "llm_ocr_pages"), "doc_id")
    assert plan() == [([1], []), ([], [])] and plan(mode="full") == [([], [1, 3]), ([], [1])]
    assert plan(force=True) == [([], [1]), ([], [1])] and plan(local=False) == [([], [1]), ([], [])] and plan(explicit=[2]) == [([1], [2]), ([], [2])]


def test_sections_by_markdown_numbers_and_chapters(spark):
    docs = [(1, 1, "before\n# One\ntext a\n## deeper\ntext b\n# Two\ntext c"), (2, 1, "第一章 总则\n内容。\n第二章 细则\n更多内容\n2024年1月\n12345 678-90"), (2, 2, "3.1 Scope\nbody"), (3, 1, "no headings here at all, only prose."), (4, 1, None)]
    got = _rows(sectioning.sections(spark.createDataFrame(docs, "doc_id int, page_num int, text string")).select("doc_id", "idx", "title", "level", "text", "page_start", "page_end"), "doc_id", "idx")
    assert got[:3] == [(1, 1, "Preface", 1, "before", 1, 1), (1, 2, "One", 1, "text a\n## deeper\ntext b", 1, 1), (1, 3, "Two", 1, "text c", 1, 1)]
    assert [(g[2], g[3], g[5]) for g in got if g[0] == 2] == [("第一章 总则", 1, 1), ("第二章 细则", 1, 1), ("3.1 Scope", 2, 2)]
    assert [g[2] for g in got if g[0] == 3] == ["Preface"] and [g[2] for g in got if g[0] == 4] == ["Full document"]


def test_short_sections_and_stubs_join_the_one_before(spark):
    s = spark.createDataFrame([(1, 1, "A", 1, "x" * 100, 1, 1), (1, 2, "B", 2, "short", 1, 2), (1, 3, "C", 2, "", 2, 2), (1, 4, "D", 1, "tiny", 3, 3)], "doc_id int, idx int, title string, level int, text string, page_start int, page_end int")
    assert _rows(sectioning.merge_short(s).select("idx", "title", "text", "page_end"), "idx") == [(1, "A", "x" * 100 + "\nB\nshort\nC", 2), (2, "D", "tiny", 3)]
    assert [r.title for r in sectioning.merge_stubs(s).orderBy("idx").collect()] == ["A", "B", "D"]


def test_toc(spark):
    toc = spark.createDataFrame([(1, 1, 1, "1. Intro", 1), (1, 2, 2, "Scope", 2), (1, 3, 2, "S cope", 2), (1, 4, 3, "deep", 3), (1, 5, 1, "2. End", 6)], "doc_id int, ord int, level int, title string, page int")
    assert _rows(sectioning.toc_boundaries(toc).select("title", "parent", "page_start", "page_end"), "idx") == [("1. Intro", None, 1, 1), ("Scope", "1. Intro", 2, 5), ("2. End", None, 6, None)]


def _chunk_brute(secs, most, threshold, overlap):
    tokens = lambda t: len(t) // 4
    out, parts, sids, used = [], [], [], 0
    for sid, body in secs:
        n = tokens(body)
        if n > most:
            if sids:
                out.append((sids, "\n\n".join(parts).strip()))
            parts, sids, used = [], [], 0
            cur, cn = [], 0
            for p in [x.strip() for x in re.split(r"\n{2,}", body) if x.strip()]:
                if cur and cn + tokens(p) > most:
                    whole = "\n\n".join(cur).strip()
                    out.append(([sid], whole))
                    cur = [whole[-overlap * 4 :]] if overlap else []
                    cn = tokens(cur[0]) if cur else 0
                cur.append(p)
                cn += tokens(p)
            out.append(([sid], "\n\n".join(cur).strip()))
            continue
        if sids and not (used + n <= most and (used < threshold or n < threshold)):
            out.append((sids, "\n\n".join(parts).strip()))
            parts, sids, used = [], [], 0
        parts.append(body)
        sids.append(sid)
        used += n
    if sids:
        out.append((sids, "\n\n".join(parts).strip()))
    return out


def test_chunks_brute_force(spark):
    rng = random.Random(1)
    body = lambda: "\n\n".join("w" * rng.choice([8, 40, 90, 300]) for _ in range(rng.choice([1, 1, 2, 6])))
    docs = {d: [(f"s{d}-{i}", body()) for i in range(rng.randint(1, 9))] for d in range(25)}
    df = spark.createDataFrame([(d, i, s, f"T{i}", i, i, b) for d, x in docs.items() for i, (s, b) in enumerate(x)], "doc_id int, idx int, sid string, title string, page_start int, page_end int, text string")
    for overlap in (0, 5):
        got = defaultdict(list)
        for r in chunks.chunk(df, 100, threshold=30, overlap=overlap).orderBy("doc_id", "idx").collect():
            got[r.doc_id].append((r.sids, r.text))
            assert r.char_count == len(r.text) and r.chunk_id == f"chunk-{r.idx:04d}"
        assert dict(got) == {d: _chunk_brute(x, 100, 30, overlap) for d, x in docs.items()}


def test_layout_table_and_spanning_header(spark):
    block = lambda i, t, x, y, w=90: ("d", 1, f"b{i}", t, float(x), float(y), float(x + w), float(y + 20), 0.9)
    rows = [block(0, "Wide", 100, 0, 400)] + [block(10 * r + c, f"r{r}c{c}", 100 + 150 * c, 40 * r) for r in range(1, 4) for c in range(3)]
    df = spark.createDataFrame(rows, "doc_id string, page int, block_id string, text string, x0 double, y0 double, x1 double, y1 double, confidence double")
    out = layout.layout_markdown(layout.layout_tables(df)).collect()
    assert [(r.row_count, r.column_count, r.x0, r.y0, r.x1, r.y1) for r in out] == [(4, 3, 100.0, 0.0, 500.0, 140.0)]
    assert out[0].markdown.split("\n")[2] == "| r1c0 | r1c1 | r1c2 |"
    assert layout.layout_tables(df.limit(3)).collect() == []
    boxes = spark.createDataFrame([("d", 1, 90.0, 30.0, 600.0, 200.0)], "doc_id string, page int, x0 double, y0 double, x1 double, y1 double")
    assert [r.text for r in layout.text_outside_tables(df, boxes).collect()] == ["Wide"]
    nms = spark.createDataFrame([("i", 1, 0.0, 0.0, 10.0, 10.0, 0.9), ("i", 2, 1.0, 1.0, 11.0, 11.0, 0.8), ("i", 3, 50.0, 50.0, 60.0, 60.0, 0.7)], "image_id string, box_id int, x1 double, y1 double, x2 double, y2 double, score double")
    assert _rows(layout.suppress_boxes(nms).select("box_id", "place"), "place") == [(1, 0), (3, 1)]


PAGE = """<html><head><title>My  Page</title><script>var t="</p><p>no";</script></head><body><nav class="nav"><a href="/x">Home</a></nav><div class="content"><h1>Top</h1>
<p><b>First paragraph that is long enough<p>Second paragraph that is long enough, with, commas, and more words so that it scores well in the end<ul><li>An item that is long enough one<li>An item that is long enough two</ul>
<p hidden>Hidden paragraph that is long enough</p><p>First paragraph that is long enough</p><h2>Prices</h2><table><tr><th>n<th>v<tr><td>a|b<td>1<tr><td>c<td>2<tr><td>d<td>3</table>
<form toolname="find" tooldescription="Find it"><input name="q" required placeholder="Query"><input type="checkbox" name="c" aria-label="Exact"><select name="s"><option>1</select><button>Go</button><button>Go</button></form></div></body></html>"""


def test_pages_distilled(spark):
    df = spark.createDataFrame([(1, "http://a.example/", PAGE), (2, "http://127.0.0.1/", None)], "page_id int, url string, html string")
    e = html.elements(df)
    blocks = [(r.tag, r.text) for r in pages.blocks(e).orderBy("idx").collect()]
    assert [b[0] for b in blocks] == ["h1", "p", "p", "li", "li", "h2"] and blocks[1][1] == "First paragraph that is long enough"
    t = pages.page_tables(e).collect()
    assert [(r.rows, r.cols, r.has_header, r.heading) for r in t] == [(4, 2, True, "Prices")] and t[0].markdown.split("\n") == ["| n | v |", "| --- | --- |", "| a¦b | 1 |", "| c | 2 |", "| d | 3 |"]
    assert _rows(pages.page_table_stats(e).select("column", "min", "max", "avg", "count")) == [("v", 1.0, 3.0, 2.0, 3)]
    acts = [(r.role, r.name, r.nth) for r in pages.actions(e).orderBy("pos").collect()]
    assert acts == [("link", "Home", 0), ("textbox", "Query", 0), ("checkbox", "Exact", 0), ("combobox", "", 0), ("button", "Go", 0), ("button", "Go", 1)]
    tools = pages.declared_tools(e).collect()
    assert [(r.name, r.fields, r.required) for r in tools] == [("find", ["c", "q", "s"], ["q"])]
    assert pages.article(e).first().text.startswith("Top")
    got = corpus.capture(df)
    lib = {r.page_id: r for r in got["library"].collect()}
    assert lib[1].title == "My Page" and lib[1].refused is None and lib[2].refused == "private address"
    assert [r.type for r in got["sections"].orderBy("idx").collect()] == ["text", "table"]


def test_section_budget_and_repeated_ids(spark):
    b = [(1, i, "p", f"{i} " + "x" * 200) for i in range(100)] + [(2, 0, "h1", "Same"), (2, 1, "p", "words of some length"), (2, 2, "h1", "Same"), (2, 3, "p", "words of some length")]
    df = spark.createDataFrame(b, "page_id int, idx int, tag string, text string")
    s = pages.sections(df, budget=9000).orderBy("page_id", "idx").collect()
    one = [r for r in s if r.page_id == 1]
    assert sum(len(r.t) for r in one) <= 9000 + 220 and [r.idx for r in one] == list(range(len(one))) and all(r.t for r in one)
    two = [r.sid for r in s if r.page_id == 2]
    assert two[1] == two[0] + "_1"


def test_stateful_rules(spark):
    e = spark.createDataFrame([(1, 10, 0), (1, 11, 50), (1, 12, 60), (1, 13, 61), (1, 14, 130), (2, 15, 5)], "user_id int, event_id int, s int").withColumn("ts", F.timestamp_seconds("s"))
    assert _rows(stateful.throttle(e, 60).select("event_id", "accepted"), "event_id") == [(10, True), (11, False), (12, True), (13, False), (14, True), (15, True)]
    assert _rows(stateful.cache_hits(e, 60).select("event_id", "hit", "age_seconds"), "event_id") == [(10, False, None), (11, True, 50.0), (12, True, 60.0), (13, False, None), (14, False, None), (15, False, None)]
    assert _rows(stateful.idle_sessions(e, 50).select("user_id", "events"), "user_id", "session") == [(1, 4), (1, 1), (2, 1)]
    a = spark.createDataFrame([("q", 1, "unavailable", None), ("q", 2, "ok", "r"), ("z", 1, "rejected", None), ("z", 2, "ok", "s"), ("n", 1, "rate_limited", None)], "q string, priority int, status string, result string")
    assert _rows(stateful.first_answer(a, "q"), "q") == [("n", "unavailable", None, 1), ("q", "ok", "r", 2), ("z", "rejected", None, 1)]


def test_profile_rules(spark):
    p = spark.createDataFrame([(1, 1, "Contract No: ab"), (1, 2, "Contract No: X-2024"), (2, 1, "Contract No: Y-1999")], "doc_id int, page_num int, text string")
    rules = [profiles.FieldRule("no", r"Contract No: (\S+)", aliases=("Contract",), valid=r"[0-9]"), profiles.FieldRule("late", r"No: (\S+)", pages=(2,))]
    assert _rows(profiles.extract_fields(p, rules), "doc_id", "field") == [(1, "late", "X-2024", 2), (1, "no", "X-2024", 2), (2, "no", "Y-1999", 1)]
    names = spark.createDataFrame([(1, "北京天地科技有限公司"), (1, "北京天池科技有限公司"), (1, "上海有限公司"), (1, "大北京天地科技有限公司")], "doc_id int, name string")
    assert {r.name: r.unified for r in profiles.unified_companies(names).collect()}["北京天池科技有限公司"] == "大北京天地科技有限公司"


def test_documents_parsed_and_stored(spark, tmp_path):
    docs = spark.createDataFrame([(d, p, f"# Part {p}\nsome body of page {p} of {d}\n| a | b |\n|---|---|\n| 1 | {p} |") for d in (1, 2) for p in (1, 2)], "doc_id int, page_num int, text string")
    got = corpus.parse(docs)
    assert _rows(got["tables"].select("doc_id", "page_num", "idx"), "doc_id", "page_num") == [(1, 1, 1), (1, 2, 1), (2, 1, 1), (2, 2, 1)]
    corpus.save(got, f"file://{tmp_path}/lib")
    lib = corpus.load(spark, f"file://{tmp_path}/lib", "library")
    assert _rows(lib.select("doc_id", "pages"), "doc_id") == [(1, 2), (2, 2)]
    assert corpus.full_text(corpus.load(spark, f"file://{tmp_path}/lib", "sections")).first().text.startswith("## Part 1\n\nsome body")
    meta = spark.createDataFrame([('{"a": 1, "b": [1, 2], "c": {"x": 1}, "d": null}',)], "m string").select(corpus.indexed_metadata(F.col("m"))).first()[0]
    assert meta["a"] == "1" and "c" not in meta and meta["d"] is None


def test_references_need_their_semicolon(spark):
    cut = spark.createDataFrame([(1, "<title>a &amp; b&amp</title><h1>x&lt;y &lt &copy; &#65; &#65 &nosuch; R&D</h1><a href='/p?a=1&amp;b=2&amp'>k</a>")], "page_id int, html string")
    got = {r.tag: r for r in html.elements(cut).collect()}
    assert (got["title"].text, got["h1"].text) == ("a & b&amp", "x<y &lt \u00a9 A &#65 &nosuch; R&D")
    assert got["a"].attrs["href"] == "/p?a=1&b=2&amp"


def test_numbers_are_no_headings_beside_markdown_ones(spark):
    docs = spark.createDataFrame([(1, 1, "## Part 1\nbody here.\n4881297747170635 Die schung.\n44.144.126.223 Th anatble\nThlytily\nmore.\n## Part 2\nend."), (2, 1, "1. Aims\nbody here.\n2. Terms\nend.")], "doc_id int, page_num int, text string")
    assert [(r.doc_id, r.title) for r in sectioning.sections(docs).orderBy("doc_id", "idx").collect()] == [(1, "Part 1"), (1, "Part 2"), (2, "1. Aims"), (2, "2. Terms")]
