"""Registered queries whose inputs are built from the tables to hold what a rule takes and what it just misses, each with its SQL."""

from __future__ import annotations

import io
import uuid
import zipfile

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import ocr, text, urls
from tessera.operators import images, layout, pages, search, sectioning, stateful, summaries
from tessera.plans import corpus
from tessera.queries import ORACLES, _query, _table
from tessera.shipping import ship
from tessera.sources import files, scans
from tessera.storage import shared_folder


def _cases(k: Column, *values: Column | str) -> Column:
    """The value of a key's remainder."""
    out = F.lit(None).cast("string")
    for i, v in enumerate(values):
        out = F.when(k % len(values) == i, v if isinstance(v, Column) else F.lit(v)).otherwise(out)
    return out


def _sql_cases(k: str, *values: str) -> str:
    return f"CASE {k} % {len(values)} " + " ".join(f"WHEN {i} THEN {v}" for i, v in enumerate(values)) + " END"


_KINDS = ["'footer'", "'text'", "'bracket'", "'text'", "'watermark'", "'text'", "'bracket'", "'text'", "'polluted'", "'text'", "'footer'", "'text'"]


@_query(f"SELECT o_orderkey, {_sql_cases('o_orderkey', *_KINDS)} AS kind FROM orders")
def scanned_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of scans beside lines that are nearly such: footers, frames read as brackets, watermarks, sentences."""
    k = F.col("o_orderkey")
    n = (k % 97 + 1).cast("string")
    with_n = lambda a, b="": F.concat(F.lit(a), n, F.lit(b))
    line = _cases(k, with_n("第 ", " 页"), with_n("第 ", " 项"), "[ab", with_n("[见附件] 甲方应于合同签订后支付款项第", "号"), "万翼签 万翼", "万签翼", with_n("[Tab-", "_row]"), with_n("a-", "_row"), with_n("乙方应支付", "元。"), with_n("乙方应支付", "元"), with_n("—第", "页/共99页—"), with_n("第", "页和第100页"))
    kind = F.when(ocr.page_footer(line), "footer").when(ocr.bracket_noise(line), "bracket").when(ocr.watermark(line), "watermark").when(text.polluted_heading(line), "polluted").otherwise("text")
    return _table(spark, sf_dir, "orders").select("o_orderkey", kind.alias("kind"))


@_query(f"SELECT o_orderkey, {_sql_cases('o_orderkey', 'true', 'true', 'false', 'false', 'false', 'true', 'false')} AS leaks FROM orders")
def geometry_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON texts that carry lists of blocks, and others that only speak of them."""
    k = F.col("o_orderkey")
    n = k.cast("string")
    j = _cases(k, F.concat(F.lit('{"id": '), n, F.lit(', "blocks": [{"x": 1}]}')), F.concat(F.lit('{"p": {"ocr_blocks" : []}, "id": '), n, F.lit("}")), F.concat(F.lit('{"blocks": '), n, F.lit("}")), F.concat(F.lit('{"note": "\\"blocks\\": ['), n, F.lit(']"}')), F.concat(F.lit('{"my_blocks": ['), n, F.lit("]}")), F.lit('[{"blocks":\n["a"]}]'), None)
    return _table(spark, sf_dir, "orders").select("o_orderkey", scans.leaks_geometry(j).alias("leaks"))


@_query("""SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN 'https' ELSE 'http' END AS scheme, 'h' || c_custkey || '.example' AS host, CASE WHEN c_custkey % 3 = 0 THEN '' ELSE '/p/' || c_custkey END AS path, CASE WHEN c_custkey % 5 = 0 THEN '' ELSE 'q=' || c_custkey || '&r=a%20b' END AS query,
 CASE WHEN c_custkey % 7 = 0 THEN '' ELSE 'f?' || c_custkey END AS fragment, CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE CAST(c_custkey AS VARCHAR) END AS q, CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE 'a%20b' END AS r FROM customer""")
def url_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """URLs in capitals, with users, ports, queries and fragments or without, in their pieces."""
    k = F.col("c_custkey")
    n = k.cast("string")
    url = F.concat(F.when(k % 2 == 0, "HTTPS").otherwise("http"), F.lit("://"), F.when(k % 4 == 0, "me:x@").otherwise(""), F.lit("H"), n, F.lit(".Example"), F.when(k % 6 == 0, ":8080").otherwise(""), F.when(k % 3 == 0, "").otherwise(F.concat(F.lit("/p/"), n)),
                   F.when(k % 5 == 0, "").otherwise(F.concat(F.lit("?q="), n, F.lit("&r=a%20b"))), F.when(k % 7 == 0, "").otherwise(F.concat(F.lit("#f?"), n)))
    return _table(spark, sf_dir, "customer").select("c_custkey", urls.scheme(url).alias("scheme"), urls.host(url).alias("host"), urls.path(url).alias("path"), urls.query(url).alias("query"), urls.fragment(url).alias("fragment"), urls.parameter(url, "q").alias("q"), urls.parameter(url, "r").alias("r"))


@_query("""WITH r AS (SELECT c_custkey, 1 + c_custkey % 4 AS n FROM customer), l AS (SELECT c_custkey, n, unnest(generate_series(1, n)) AS i FROM r)
SELECT CAST(c_custkey AS VARCHAR) AS doc_id, CAST(n AS INTEGER) AS row_count, 3 AS column_count, string_agg('| c' || c_custkey || 'r' || i || ' | ' || i * 10 || ' | ' || CASE WHEN i = 2 AND c_custkey % 5 = 0 THEN 'x¦y' ELSE 'z' || i END || ' |' || CASE WHEN i = 1 THEN chr(10) || '| --- | --- | --- |' ELSE '' END, chr(10) ORDER BY i) AS markdown
FROM l WHERE n >= 2 GROUP BY c_custkey, n""".replace("'x¦y'", "'x y'"))
def layout_grids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text blocks on a grid of one to four rows and three columns on each customer's page: those of two rows and more are tables."""
    k = F.col("c_custkey")
    rows = _table(spark, sf_dir, "customer").select(k, F.explode(F.sequence(F.lit(1), (1 + k % 4).cast("int"))).alias("i"))
    cell = lambda c, x, v: F.struct(F.lit(c).alias("c"), F.lit(float(x)).alias("x0"), v.alias("text"))
    i = F.col("i")
    cells = rows.select(k, "i", F.explode(F.array(cell(1, 100, F.concat(F.lit("c"), k.cast("string"), F.lit("r"), i.cast("string"))), cell(2, 250, (i * 10).cast("string")), cell(3, 400, F.when((i == 2) & (k % 5 == 0), "x|y").otherwise(F.concat(F.lit("z"), i.cast("string")))))).alias("x"))
    y = i * 40.0
    blocks = cells.select(k.cast("string").alias("doc_id"), F.lit(1).alias("page"), F.concat_ws("-", "i", "x.c").alias("block_id"), "x.text", "x.x0", y.alias("y0"), (F.col("x.x0") + 90).alias("x1"), (y + 20).alias("y1"), F.lit(0.9).alias("confidence"))
    return layout.blocks_markdown(blocks).select("doc_id", "row_count", "column_count", "markdown")


@_query("""SELECT c_custkey AS doc_id, e.idx, e.title || CASE WHEN e.idx = 4 THEN CAST(c_custkey AS VARCHAR) ELSE '' END AS title, e.level, e.parent, CASE WHEN e.idx = 4 THEN 4 + c_custkey % 3 ELSE e.first END AS page_start, CASE e.idx WHEN 1 THEN 1 WHEN 2 THEN 3 WHEN 3 THEN greatest(4, 3 + c_custkey % 3) END AS page_end
FROM customer, (VALUES (1, '1. Aims', 1, NULL, 1), (2, 'Scope', 2, '1. Aims', 2), (3, 'Terms', 2, '1. Aims', 4), (4, '2. End ', 1, NULL, 0)) e(idx, title, level, parent, first)""")
def toc_boundaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tables of contents with a title twice on a page and one that is too deep: where sections begin and end."""
    entry = lambda o, level, title, page: F.struct(F.lit(o).alias("ord"), F.lit(level).alias("level"), (title if isinstance(title, Column) else F.lit(title)).alias("title"), (page if isinstance(page, Column) else F.lit(page)).cast("long").alias("page"))
    k = F.col("c_custkey")
    toc = F.array(entry(1, 1, "1. Aims", 1), entry(2, 2, "Scope", 2), entry(3, 2, "S cope", 2), entry(4, 3, "deep", 3), entry(5, 2, "Terms", 4), entry(6, 1, F.concat(F.lit("2. End "), k.cast("string")), 4 + k % 3))
    rows = _table(spark, sf_dir, "customer").select(k.alias("doc_id"), F.explode(toc).alias("e")).select("doc_id", "e.*")
    return sectioning.toc_boundaries(rows)


@_query("""SELECT c_custkey AS doc_id, e.idx, e.title, CASE e.idx WHEN 1 THEN 'cover ' || c_custkey || chr(10) || 'head' WHEN 2 THEN '1. Intro' || chr(10) || '1.1 Scope' || chr(10) || 'all of it' || chr(10) || 'goes on' ELSE '2. Terms' || chr(10) || '2.1 Price' || chr(10) || 'ten ' || c_custkey || chr(10) || 'end' END AS text, e.a AS page_start, e.b AS page_end
FROM customer, (VALUES (1, 'Preface / TOC', 1, 2), (2, '1.1 Scope', 2, 3), (3, '2.1 Price', 3, 4)) e(idx, title, a, b)""")
def toc_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of four pages split by their tables of contents: entries begin at the lines that have their titles, and chapters head their parts."""
    k = F.col("c_custkey")
    n = k.cast("string")
    body = [F.concat(F.lit("cover "), n), F.lit("head\n1.1  Scope\nall of it"), F.concat(F.lit("goes on\n\n2.1 Price\nten "), n), F.lit("end")]
    docs = _table(spark, sf_dir, "customer")
    paged = docs.select(k.alias("doc_id"), F.posexplode(F.array(*body)).alias("p", "text")).select("doc_id", (F.col("p") + 1).alias("page_num"), "text")
    entry = lambda o, level, title, page: F.struct(F.lit(o).alias("ord"), F.lit(level).alias("level"), F.lit(title).alias("title"), F.lit(page).alias("page"))
    toc = docs.select(k.alias("doc_id"), F.explode(F.array(entry(1, 1, "1. Intro", 2), entry(2, 2, "1.1 Scope", 2), entry(3, 1, "2. Terms", 3), entry(4, 2, "2.1 Price", 3))).alias("e")).select("doc_id", "e.*")
    out = sectioning.sections_from_toc(paged, toc)
    return out.select("doc_id", "idx", "title", F.regexp_replace("text", "1\\.1  Scope", "1.1 Scope").alias("text"), "page_start", "page_end")


@_query("""SELECT c_custkey AS doc_id, row_number() OVER (PARTITION BY c_custkey ORDER BY n, second) AS idx, CASE WHEN second THEN '2. 内容丙丁' ELSE '第' || n || '章 条款' END AS title
FROM customer, (VALUES (1), (2), (3), (4)) c(n), (VALUES (false), (true)) s(second) WHERE n <= 3 + c_custkey % 2 AND (NOT second OR c_custkey % 2 = 0)""")
def formal_contracts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contracts of three or four clauses with numbered lines in them: from four on the numbers are no headings."""
    k = F.col("c_custkey")
    clause = lambda n: F.concat(F.lit("第"), n.cast("string"), F.lit("章 条款\n1. 内容甲乙\n正文\n2. 内容丙丁\n正文\n"))
    body = F.array_join(F.transform(F.sequence(F.lit(1), (3 + k % 2).cast("int")), clause), "")
    docs = _table(spark, sf_dir, "customer").select(k.alias("doc_id"), F.lit(1).alias("page_num"), body.alias("text"))
    return sectioning.sections(docs, formal=True).select("doc_id", F.col("idx").cast("long").alias("idx"), "title")


@_query("""WITH RECURSIVE a AS (SELECT l_orderkey AS page_id, l_partkey AS pos, CAST(l_quantity AS BIGINT) AS size, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC, l_partkey, 'a' || l_suppkey, l_quantity) AS n, 'a' || l_suppkey AS aid FROM lineitem),
f AS (SELECT page_id, n, aid, size <= 60 AS kept, CASE WHEN size <= 60 THEN size ELSE 0 END AS used FROM a WHERE n = 1 UNION ALL
 SELECT a.page_id, a.n, a.aid, f.used + a.size <= 60, CASE WHEN f.used + a.size <= 60 THEN f.used + a.size ELSE f.used END FROM f JOIN a ON a.page_id = f.page_id AND a.n = f.n + 1)
SELECT page_id, CAST(row_number() OVER (PARTITION BY page_id ORDER BY n) - 1 AS INTEGER) AS place, aid FROM f WHERE kept""")
def packed_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as actions of a page, packed by price into a room of sixty."""
    li = _table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("page_id"), F.col("l_partkey").alias("pos"), F.col("l_extendedprice").alias("score"), F.concat(F.lit("a"), F.col("l_suppkey").cast("string")).alias("aid"), "l_quantity")
    return pages.packed_actions(li, F.lit(60), F.col("l_quantity"))


@_query("""WITH RECURSIVE e AS (SELECT event_type AS service, event_id, epoch_us(ts) AS t, 1 + user_id % 3 AS a, 4 + user_id % 5 AS b, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS n FROM events),
f AS (SELECT service, event_id, n, true AS ok, list_transform(range(1, 9), lambda i: CASE WHEN i = a OR i = b THEN t END) AS ts FROM e WHERE n = 1 UNION ALL
 SELECT service, event_id, n, free, CASE WHEN free THEN list_transform(ts, lambda x, i: CASE WHEN i = a OR i = b THEN t ELSE x END) ELSE ts END FROM (SELECT e.*, f.ts, (f.ts[a] IS NULL OR t - f.ts[a] >= 1800000000) AND (f.ts[b] IS NULL OR t - f.ts[b] >= 1800000000) AS free FROM f JOIN e ON e.service = f.service AND e.n = f.n + 1))
SELECT service, event_id, ok AS accepted FROM f""")
def chain_throttle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests with chains of two of eight providers, let through if none was charged within half an hour."""
    chain = F.array(F.concat(F.lit("x"), (F.col("user_id") % 3).cast("string")), F.concat(F.lit("y"), (F.col("user_id") % 5).cast("string")))
    return stateful.chain_throttle(_table(spark, sf_dir, "events").withColumn("service", F.col("event_type")).withColumn("providers", chain), 1800)


@_query("""SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN '前言/目录' ELSE 'Preface / TOC' END AS front, 'Page ' || n_chars AS page, '[... ' || n_chars || ' rows total, showing first 80 ...]' AS cut, '' AS unknown FROM documents""")
def templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Templates in the language of tags such as zh-CN, EN and others, with values."""
    tag = _cases(F.col("doc_id"), "zh-CN", "EN-us", F.col("lang"))
    n = F.col("n_chars")
    return _table(spark, sf_dir, "documents").select("doc_id", text.template(tag, "front_matter_title").alias("front"), text.template(tag, "page_title", page=n).alias("page"), text.template(tag, "table_truncated", total=n, shown=F.lit(80)).alias("cut"), text.template(tag, "no such").alias("unknown"))


@_query(f"SELECT c_custkey, {_sql_cases('c_custkey', chr(39) + '~/d/' + chr(39) + ' || c_custkey', chr(39) + '/srv/home/me/' + chr(39) + ' || c_custkey', chr(39) + '~' + chr(39))} AS path, {_sql_cases('c_custkey', 'true', 'true', 'false', 'false', 'true')} AS failed FROM customer")
def paths_and_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths within a home folder and elsewhere for logs, and summaries that are none."""
    k = F.col("c_custkey")
    path = _cases(k, F.concat(F.lit("/home/me/d/"), k.cast("string")), F.concat(F.lit("/srv/home/me/"), k.cast("string")), "/home/me")
    summary = _cases(k, "  ", " [Summary Generation Failed]\n", F.concat(F.lit("summary generation failed "), k.cast("string")), "A summary.", None)
    return _table(spark, sf_dir, "customer").select("c_custkey", text.masked_path(path, "/home/me").alias("path"), summaries.failed(summary).alias("failed"))


@_query("""SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN 'tblaeta,lava Agent' WHEN doc_id % 4 = 1 THEN 'lava Agent' ELSE '' END AS hits, CASE WHEN doc_id % 2 = 0 THEN 'price 5 元/个' || chr(10) || 'plain ' || doc_id ELSE 'plain ' || doc_id END AS kept FROM documents""")
def extracted_noise(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts with signs of bad scanning, watermarks, a site's line and a misread unit."""
    k = F.col("doc_id")
    noisy = F.concat(F.col("text"), F.when(k % 4 == 0, " tblaeta lava Agent").when(k % 4 == 1, "x lava Agent y").otherwise(""))
    body = F.concat(F.lit("万翼签\r\n"), F.when(k % 2 == 0, "price 5 月/个  \n").otherwise(" Tingyun.com \n"), F.lit("plain "), k.cast("string"), F.lit("\r万翼 翼签\n"))
    return _table(spark, sf_dir, "documents").select("doc_id", F.array_join(ocr.noise_hits(noisy), ",").alias("hits"), ocr.without_noise(body).alias("kept"))


@_query("""SELECT p_partkey, k, v FROM part, LATERAL (VALUES ('brand', p_brand), ('size', CAST(p_size AS VARCHAR)), ('tags', '["' || p_brand || '","x"]'), ('none', NULL)) t(k, v)""")
def indexed_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metadata of parts in JSON, of which only scalars and lists of scalars are indexed."""
    p = _table(spark, sf_dir, "part")
    json = F.to_json(F.struct(F.col("p_brand").alias("brand"), F.col("p_size").alias("size"), F.array("p_brand", F.lit("x")).alias("tags"), F.struct("p_name").alias("nested"), F.array(F.array(F.lit(1))).alias("deep"), F.lit(None).cast("string").alias("none")), {"ignoreNullFields": "false"})
    return p.select("p_partkey", F.explode(corpus.indexed_metadata(json)).alias("k", "v"))


@_query("""SELECT doc_id, string_agg(repeat('#', CAST(least(turn % 5 + 2, 4) AS INTEGER)) || ' ' || role || chr(10) || chr(10) || text, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY turn) AS text FROM (SELECT conv_id AS doc_id, turn, role, coalesce(text, '') AS text FROM conversations) GROUP BY 1""")
def document_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as one Markdown text each, headings by level."""
    c = _table(spark, sf_dir, "conversations")
    parts = c.select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("idx"), F.col("role").alias("title"), F.coalesce("text", F.lit("")).alias("text"), (F.col("turn") % 5 + 1).cast("int").alias("level"))
    return corpus.full_text(parts)


@_query("SELECT c_custkey AS id, 'C-' || c_name AS name, c_nationkey AS nation FROM customer")
def exported_library(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A library as JSON lines, written and read back."""
    path = f"{shared_folder(spark)}/export/{uuid.uuid4().hex}"
    lib = _table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.concat(F.lit("C-"), "c_name").alias("name"), F.col("c_nationkey").alias("nation"))
    corpus.export_json(lib).write.text(path)
    return spark.read.schema("id long, name string, nation long").json(path).select(*(F.col(c).cast(lib.schema[c].dataType).alias(c) for c in lib.columns))


@_query(f"SELECT p.page_id, d.digest, d.content_hash FROM pages p JOIN ({ORACLES['page_digest']}) d USING (page_id)")
def stored_captures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages captured, stored and loaded again."""
    path = f"{shared_folder(spark)}/captures/{uuid.uuid4().hex}"
    corpus.save(corpus.capture(_table(spark, sf_dir, "pages")), path)
    return corpus.load(spark, path, "library").select("page_id", "digest", "content_hash")


@_query(f"SELECT l_orderkey, l_linenumber, {_sql_cases('l_partkey', *(chr(39) + 'table-0' + chr(39) + ' || l_linenumber',) * 3, 'NULL', 'NULL', chr(39) + 'table-1' + chr(39) + ' || l_linenumber')} AS id FROM lineitem")
def spelled_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of tables in several spellings."""
    n = F.col("l_linenumber").cast("string")
    spelled = _cases(F.col("l_partkey"), n, F.concat(F.lit("0"), n), F.concat(F.lit("table-"), n), F.concat(F.lit("image-"), n), F.concat(n, F.lit("a")), F.concat(F.lit("table-1"), n))
    return _table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", search.normalised_number(spelled, "table").alias("id"))


@_query("""SELECT event_id, 'a' || substr(sha1('{"name": "n' || user_id || '", "nth": ' || event_id % 3 || ', "role": "' || CASE event_type WHEN 'click' THEN 'button' WHEN 'signup' THEN 'textbox' ELSE 'combobox' END || '"}'), 1, 10) AS aid,
 CASE event_type WHEN 'click' THEN 'click' WHEN 'signup' THEN 'type' ELSE 'select' END || ',scroll_into_view' AS methods FROM events""")
def action_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as actions: their ids and what can be done with them."""
    role = F.when(F.col("event_type") == "click", "button").when(F.col("event_type") == "signup", "textbox").otherwise("combobox")
    name = F.concat(F.lit("n"), F.col("user_id").cast("string"))
    return _table(spark, sf_dir, "events").select("event_id", pages.action_id(role, name, F.col("event_id") % 3).alias("aid"), F.array_join(pages.action_methods(role), ",").alias("methods"))


@_query("""SELECT c_custkey AS doc_id, 's' || CASE c_custkey % 4 WHEN 0 THEN '2' WHEN 1 THEN '1' WHEN 2 THEN '3' END AS section_sid FROM customer""")
def image_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Images whose heading is a section's title, is in a section's text, whose paragraph is, or neither."""
    k = F.col("c_custkey")
    n = k.cast("string")
    docs = _table(spark, sf_dir, "customer")
    s = docs.select(k.alias("doc_id"), F.explode(F.array(*(F.struct(F.lit(i).alias("idx"), F.lit(f"s{i}").alias("sid"), F.concat(F.lit(t), n).alias("title"), F.concat(F.lit(b), n).alias("text")) for i, t, b in ((1, "Intro ", "about the Plan for "), (2, "Site: ", "where it is, "), (3, "Last ", "shown in the drawing of "))))).alias("s")).select("doc_id", "s.*")
    i = docs.select(k.alias("doc_id"), _cases(k, F.concat(F.lit("SITE "), n), F.concat(F.lit("the plan for "), n), None, "Nowhere").alias("near_heading"), _cases(k, None, None, F.concat(F.lit("the drawing of "), n), None).alias("paragraph_text"))
    return images.anchored(i, s).select("doc_id", "section_sid")


_W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'


def _docx(name: str, key: int, bomb: bool = False) -> bytes:
    """A word document of a heading, a numbered list of two levels, a bullet and a table."""
    p = lambda t, props="": f"<w:p><w:pPr>{props}</w:pPr><w:r><w:t>{t}</w:t></w:r></w:p>"
    of = lambda i, level=0: f'<w:numPr><w:ilvl w:val="{level}"/><w:numId w:val="{i}"/></w:numPr>'
    cell = lambda t: f"<w:tc>{p(t)}</w:tc>"
    body = p(name, '<w:pStyle w:val="Heading1"/>') + p("one", of(1)) + p("deep", of(1, 1)) + p("two", of(1)) + p("dot", of(2)) + f"<w:tbl><w:tr>{cell('k')}{cell('v|w')}</w:tr><w:tr>{cell('key')}{cell(str(key))}</w:tr></w:tbl>"
    level = lambda i, kind, start: f'<w:lvl w:ilvl="{i}"><w:start w:val="{start}"/><w:numFmt w:val="{kind}"/></w:lvl>'
    numbering = f'<w:numbering {_W}><w:abstractNum w:abstractNumId="7">{level(0, "decimal", 3)}{level(1, "lowerLetter", 1)}</w:abstractNum><w:abstractNum w:abstractNumId="8">{level(0, "bullet", 1)}</w:abstractNum><w:num w:numId="1"><w:abstractNumId w:val="7"/></w:num><w:num w:numId="2"><w:abstractNumId w:val="8"/></w:num></w:numbering>'
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("word/document.xml", f"<w:document {_W}><w:body>{body}</w:body></w:document>")
        z.writestr("word/numbering.xml", numbering)
        if bomb:
            z.writestr("word/media/zeros.bin", bytes(files.MAX_ENTRY + 1))
    return out.getvalue()


def _xlsx(name: str, key: int) -> bytes:
    """A workbook of one sheet with shared texts, numbers, dates, a truth value and a gap."""
    row = lambda r, *cells: f'<row r="{r}">' + "".join(f'<c r="{c}{r}"{" t=" + chr(34) + t + chr(34) if t else ""}{" s=" + chr(34) + s + chr(34) if s else ""}><v>{v}</v></c>' for c, t, s, v in cells) + "</row>"
    sheet = row(1, ("A", "s", "", 0), ("B", "s", "", 1), ("C", "s", "", 2)) + row(2, ("A", "", "", f"{key}.0"), ("B", "", "1", 43831 + key), ("C", "b", "", key % 2)) + row(3, ("A", "", "2", "43831.5"), ("C", "", "", "1.25"))
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("xl/workbook.xml", f'<workbook><sheets><sheet name="{name}"/></sheets></workbook>')
        z.writestr("xl/sharedStrings.xml", "<sst><si><t>n</t></si><si><t>day</t></si><si><t>yes</t></si></sst>")
        z.writestr("xl/styles.xml", '<styleSheet><numFmts><numFmt numFmtId="170" formatCode="yyyy\\-mm\\-dd hh:mm"/></numFmts><cellXfs><xf numFmtId="0"/><xf numFmtId="14"/><xf numFmtId="170"/></cellXfs></styleSheet>')
        z.writestr("xl/worksheets/sheet1.xml", f"<worksheet><sheetData>{sheet}</sheetData></worksheet>")
    return out.getvalue()


@_query("""SELECT n_nationkey, 'docx' AS kind, '# ' || n_name || chr(10) || '3. one' || chr(10) || '  1. deep' || chr(10) || '4. two' || chr(10) || '- dot' || chr(10) || '| k | v¦w |' || chr(10) || '|---|---|' || chr(10) || '| key | ' || n_nationkey || ' |' AS text, NULL AS error FROM nation WHERE n_nationkey % 5 > 0
UNION ALL SELECT n_nationkey, 'xlsx', '## ' || n_name || chr(10) || '| n | day | yes |' || chr(10) || '|---|---|---|' || chr(10) || '| ' || n_nationkey || ' | ' || CAST(DATE '2020-01-01' + CAST(n_nationkey AS INTEGER) AS VARCHAR)[:10] || ' | ' || CASE WHEN n_nationkey % 2 = 1 THEN 'TRUE' ELSE 'FALSE' END || ' |' || chr(10) || '| 2020-01-01 12:00:00 |  | 1.25 |', NULL FROM nation
UNION ALL SELECT n_nationkey, 'docx', NULL, 'ValueError: the archive is too large unpacked' FROM nation WHERE n_nationkey % 5 = 0""")
def office_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Word documents and workbooks made for each nation, read as pages; every fifth document unpacks too large."""
    ship(spark)

    @F.pandas_udf("binary")
    def made(kinds: pd.Series, names: pd.Series, keys: pd.Series) -> pd.Series:
        return pd.Series([_docx(n, k, k % 5 == 0) if kind == "docx" else _xlsx(n, k) for kind, n, k in zip(kinds, names, keys, strict=True)])

    rows = _table(spark, sf_dir, "nation").select("n_nationkey", "n_name", F.explode(F.array(F.lit("docx"), F.lit("xlsx"))).alias("kind"))
    found = rows.select(F.concat_ws(".", F.col("n_nationkey").cast("string"), "kind").alias("path"), "kind", made("kind", "n_name", "n_nationkey").alias("content"))
    out = files.pages(found)
    key = rows.schema["n_nationkey"].dataType
    return out.select(F.substring_index("path", ".", 1).cast(key).alias("n_nationkey"), F.substring_index("path", ".", -1).alias("kind"), "text", "error")
