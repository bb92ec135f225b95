"""Registered queries over the index, boxes, names, state stores, sources and sinks, converters and page signals, each with its SQL where SQL can express it."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import amounts, text
from tessera.operators import grid, layout, pages, profiles, sectioning, signals
from tessera.operators.index import TextIndex
from tessera.queries import ORACLES, _query, _table
from tessera.queries_documents import _answers
from tessera.sources import bundles, html, markdown, recorded
from tessera.storage import shared_folder, spread, stored
from tessera.streaming import progress, stores


def _folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}/{uuid.uuid4().hex}"


_WORDS_SQL = r"list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '')"


@_query(rf"""WITH s AS (SELECT doc_id, CASE WHEN lang IN ('en', 'fr') OR quality = 1 THEN text WHEN lang = 'es' THEN NULL ELSE 'of the ' || text END AS text FROM documents LEFT JOIN labels USING (doc_id)),
t AS (SELECT doc_id, {_WORDS_SQL} AS w FROM s WHERE text IS NOT NULL), p AS (SELECT doc_id, unnest(w) AS x, generate_subscripts(w, 1) - 1 AS pos FROM t),
h AS (SELECT a.doc_id, a.pos FROM p a JOIN p b ON a.doc_id = b.doc_id AND b.pos = a.pos + 1 WHERE a.x = 'of' AND b.x = 'the')
SELECT CAST(doc_id AS VARCHAR) AS doc_id, count(*) AS hits, CAST(min(pos) AS BIGINT) AS first_start FROM h GROUP BY 1""")
def text_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A phrase in an index after four changes and a merge: all documents in an older form, those of two languages as they are now, one language taken out, and documents of good quality put in again."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    index = TextIndex(spark, _folder(spark, "index"), fanout=2)
    index.upsert(docs.withColumn("text", F.concat(F.lit("of the "), "text")))
    index.upsert(docs.where(F.col("lang").isin("en", "fr")))
    index.delete(docs.where("lang = 'es'"))
    index.merge()
    index.upsert(docs.join(_table(spark, sf_dir, "labels").where("quality = 1").select("doc_id"), "doc_id", "left_semi"))
    return index.phrase_search("of the")


_BOX_SQL = """b AS (SELECT l_orderkey AS page, l_linenumber AS box, CAST(l_partkey % 50 AS DOUBLE) AS x0, CAST(l_suppkey % 40 AS DOUBLE) AS y0, x0 + l_quantity * 4 AS x1, y0 + l_quantity * 3 AS y1 FROM lineitem),
p AS (SELECT l_orderkey AS page, l_linenumber AS point, CAST(l_partkey * 7 % 180 AS DOUBLE) AS x, CAST(l_suppkey * 11 % 140 AS DOUBLE) AS y FROM lineitem)"""


def _boxes(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    li = _table(spark, sf_dir, "lineitem")
    x0, y0 = (F.col("l_partkey") % 50).cast("double"), (F.col("l_suppkey") % 40).cast("double")
    boxes = li.select(F.col("l_orderkey").alias("page"), F.col("l_linenumber").alias("box"), x0.alias("x0"), y0.alias("y0"), (x0 + F.col("l_quantity") * 4).alias("x1"), (y0 + F.col("l_quantity") * 3).alias("y1"))
    points = li.select(F.col("l_orderkey").alias("page"), F.col("l_linenumber").alias("point"), (F.col("l_partkey") * 7 % 180).cast("double").alias("x"), (F.col("l_suppkey") * 11 % 140).cast("double").alias("y"))
    return points, boxes


@_query(f"WITH {_BOX_SQL} SELECT page, point, (SELECT arg_max(box, ROW(-(x1 - x0) * (y1 - y0), box)) FROM b WHERE b.page = p.page AND x BETWEEN x0 AND x1 AND y BETWEEN y0 AND y1) AS found FROM p")
def smallest_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as boxes and as points of a page: the smallest box at each point."""
    points, boxes = _boxes(spark, sf_dir)
    return grid.smallest_box(points, boxes, ["page"], "point", "box").select("page", "point", "found")


@_query(f"""WITH {_BOX_SQL}, q AS (SELECT page, box, CASE box % 4 WHEN 0 THEN 'button' WHEN 1 THEN 'a' WHEN 2 THEN 'input' ELSE 'div' END AS tag, x0, y0, x1, y1 FROM b),
m AS (SELECT p.page, p.point, q.box, tag, row_number() OVER (PARTITION BY p.page, p.point ORDER BY (x1 - x0) * (y1 - y0), q.box DESC) AS n FROM p JOIN q ON p.page = q.page AND x BETWEEN x0 AND x1 AND y BETWEEN y0 AND y1)
SELECT page, point, CAST(box AS INTEGER) AS pos, CASE tag WHEN 'a' THEN 'link' WHEN 'input' THEN 'checkbox' ELSE tag END AS role, 'n' || box AS name FROM m WHERE n = 1""")
def elements_at_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as elements of a page, none within another: what is clicked at each point."""
    points, boxes = _boxes(spark, sf_dir)
    tag = F.when(F.col("box") % 4 == 0, "button").when(F.col("box") % 4 == 1, "a").when(F.col("box") % 4 == 2, "input").otherwise("div")
    attrs = F.create_map(F.lit("type"), F.lit("checkbox"), F.lit("title"), F.concat(F.lit("n"), F.col("box").cast("string")))
    e = boxes.select("page", F.col("box").cast("int").alias("pos"), F.col("box").cast("int").alias("last"), tag.alias("tag"), attrs.alias("attrs"), F.lit(None).cast("string").alias("text"), "x0", "y0", "x1", "y1")
    return grid.elements_at(points, e, "page", "point")


@_query("""WITH b AS (SELECT l_orderkey, l_linenumber, l_partkey % 100 AS x, l_suppkey % 80 AS y FROM lineitem), t AS (SELECT o_orderkey, o_custkey % 60 AS x0, o_custkey % 50 AS y0 FROM orders)
SELECT l_orderkey AS doc_id, l_linenumber AS block_id FROM b ANTI JOIN t ON l_orderkey = o_orderkey AND x + 5 BETWEEN x0 AND x0 + 40 AND y + 5 BETWEEN y0 AND y0 + 30""")
def blocks_outside_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as text blocks and orders as tables: the blocks whose middle is in no table of the page."""
    li, o = _table(spark, sf_dir, "lineitem"), _table(spark, sf_dir, "orders")
    x, y, u, v = (c.cast("double") for c in (F.col("l_partkey") % 100, F.col("l_suppkey") % 80, F.col("o_custkey") % 60, F.col("o_custkey") % 50))
    blocks = li.select(F.col("l_orderkey").alias("doc_id"), F.lit(1).alias("page"), F.col("l_linenumber").alias("block_id"), x.alias("x0"), y.alias("y0"), (x + 10).alias("x1"), (y + 10).alias("y1"))
    tables = o.select(F.col("o_orderkey").alias("doc_id"), F.lit(1).alias("page"), u.alias("x0"), v.alias("y0"), (u + 40).alias("x1"), (v + 30).alias("y1"))
    return layout.text_outside_tables(blocks, tables).select("doc_id", "block_id")


@_query()
def company_spellings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers of a nation as companies in one text, whose names differ in few characters: each text with its spellings unified. (Tested against the standard library's matcher.)"""
    c = _table(spark, sf_dir, "customer")
    digits = F.translate(F.col("c_custkey").cast("string"), "0123456789", "天地玄黄宇宙洪荒日月")
    name = F.concat(F.lit("北京"), digits, F.lit("科技"), F.when(F.col("c_custkey") % 3 == 0, "股份有限公司").otherwise("有限公司"))
    listed = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("c_custkey", name.alias("n")))), lambda x: x["n"]), "、")
    # Some forty names a text: all those of customers next to each other.
    docs = c.groupBy((F.floor(F.col("c_custkey") / 40)).alias("doc_id")).agg(listed.alias("text"))
    return profiles.with_unified_companies(docs)


_WORDS = "'壹贰叁肆伍陆柒捌玖'"


@_query(f"""SELECT l_orderkey, l_linenumber, '共 ¥' || n || '（大写：人民币' || CASE WHEN n < 10 THEN substr({_WORDS}, n, 1) ELSE substr({_WORDS}, n // 10, 1) || '拾' || CASE WHEN n % 10 > 0 THEN substr({_WORDS}, n % 10, 1) ELSE '' END END || '元整） 付清' AS body
FROM (SELECT l_orderkey, l_linenumber, CAST(l_quantity AS INT) AS n FROM lineitem)""")
def amount_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quantities as amounts in running text with wrong words, put right."""
    n = F.col("l_quantity").cast("int").cast("string")
    body = F.concat(F.lit("共 ¥"), n, F.lit(" ( 大写: 人民币 壹仟元整 ) 付清"))
    return _table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", amounts.consistent_phrases(body).alias("body"))


def _drained(spark: SparkSession, out: DataFrame, name: str) -> DataFrame:
    folder = _folder(spark, name)
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass", None)
    stores.use_rocksdb(spark)
    try:
        query = out.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
        query.awaitTermination()
    finally:
        if before:
            spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
        else:
            spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    return spark.read.schema(out.schema).parquet(f"{folder}/out")


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.readStream.schema(_table(spark, sf_dir, "events").schema).option("pathGlobFilter", "events*").parquet(sf_dir).withColumn("ts", F.col("ts").cast("timestamp"))


@_query(ORACLES["url_cache_ttl"])
def stream_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``url_cache_ttl`` as a stream whose state has a time to live."""
    out = _drained(spark, stores.cache_hits(_events(spark, sf_dir), 43_200), "store-cache")
    return out.select(F.col("key").alias("user_id"), F.col("tie").alias("event_id"), "hit", "age_seconds")


@_query(ORACLES["circuit_breaker"])
def stream_breaker(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``circuit_breaker`` as a stream."""
    calls = _events(spark, sf_dir).withColumn("failed", F.col("event_type") == "error")
    return _drained(spark, stores.circuit_breaker(calls, 86_400), "store-breaker").select(F.col("key").alias("user_id"), F.col("tie").alias("event_id"), "made")


@_query(ORACLES["bounded_sessions"])
def stream_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``bounded_sessions`` as a stream with a map of sessions for each service."""
    rows = _events(spark, sf_dir).withColumn("service", F.col("event_type"))
    out = _drained(spark, stores.bounded_sessions(rows, 8, 43_200), "store-sessions")
    return out.select(F.col("key").alias("service"), F.col("tie").alias("event_id"), "found", F.col("evicted").cast("bigint").alias("evicted"))


@_query(ORACLES["provider_hits"])
def recorded_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``provider_hits`` through the data source, from recordings of the answers."""
    path = _folder(spark, "recorded")
    recorded.record(_answers(spark, sf_dir), path)
    recorded.register(spark)
    return spark.read.format("recorded_answers").option("path", path).load().select(F.col("query").cast("bigint").alias("query"), "provider", "rank", "title", "url", "score")


@_query("""SELECT CAST(conv_id AS VARCHAR) AS doc_id, 'section' AS kind, lpad(CAST(turn AS VARCHAR), 3, '0') || '-' || role || '.md' AS name, strlen('# ' || role || chr(10) || chr(10) || coalesce(text, '') || chr(10)) AS bytes, sha256('# ' || role || chr(10) || chr(10) || coalesce(text, '') || chr(10)) AS sha256 FROM conversations
UNION ALL SELECT CAST(conv_id AS VARCHAR), 'table', 'table-01.md', strlen(m), sha256(m) FROM (SELECT conv_id, '| turn |' || chr(10) || '|---|' || string_agg(chr(10) || '| ' || turn || ' |', '' ORDER BY turn) || chr(10) AS m FROM conversations GROUP BY 1)""")
def document_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as documents whose sections and tables are written as files, and read back by the manifest."""
    c = _table(spark, sf_dir, "conversations")
    parts = c.select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("idx"), F.lit("s").alias("sid"), F.col("role").alias("title"), "text")
    rows = F.array_join(F.transform(F.array_sort(F.collect_list("turn")), lambda t: F.concat(F.lit("\n| "), t.cast("string"), F.lit(" |"))), "")
    tables = c.groupBy(F.col("conv_id").alias("doc_id")).agg(F.lit(1).alias("idx"), F.concat(F.lit("| turn |\n|---|"), rows).alias("markdown"))
    path = _folder(spark, "bundle")
    bundles.write_bundle(bundles.section_files(parts).unionByName(bundles.table_files(tables)), path)
    back = bundles.read_bundle(spark, path)
    return back.select("doc_id", "kind", "name", F.octet_length("content").cast("long").alias("bytes"), F.sha2("content", 256).alias("sha256"))


@_query()
def page_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as Markdown. (Tested against written-out cases, lists read back and broken markup.)"""
    return spread(_table(spark, sf_dir, "pages"), 1_000).select("page_id", markdown.from_html(F.col("html")).alias("markdown"))


@_query("""SELECT r_regionkey AS doc, '# ' || r_name || chr(10) || chr(10) || string_agg('- **' || n_name || '**' || chr(10) || '  1. key ' || n_nationkey || chr(10) || '  2. [site](/n/' || n_nationkey || ')', chr(10) ORDER BY n_nationkey)
 || chr(10) || chr(10) || '| name | key |' || chr(10) || '| --- | --- |' || chr(10) || string_agg('| *' || n_name || '* | ' || n_nationkey || ' |', chr(10) ORDER BY n_nationkey) AS markdown FROM region JOIN (SELECT n_nationkey, n_regionkey, replace(n_name, '_', '\\_') AS n_name FROM nation) ON n_regionkey = r_regionkey GROUP BY r_regionkey, r_name""")
def region_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page for each region with nested lists, links, emphasis and a table of its nations, as Markdown."""
    n, r = _table(spark, sf_dir, "nation"), _table(spark, sf_dir, "region")
    item = F.format_string("<li><b>%s </b><ol><li>key %d</li><li><a href='/n/%d'>site</a></ol>", "n_name", "n_nationkey", "n_nationkey")
    row = F.format_string("<tr><td><em>%s</em><td>%d", "n_name", "n_nationkey")
    of = lambda v: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n_nationkey", v.alias("h")))), lambda x: x["h"]), "")
    page = n.join(r, n.n_regionkey == r.r_regionkey).groupBy("r_regionkey", "r_name").agg(of(item).alias("items"), of(row).alias("rows"))
    html_text = F.concat(F.lit("<html><body><h1>"), "r_name", F.lit("</h1><ul>"), "items", F.lit("</ul><table><tr><th>name<th>key"), "rows", F.lit("</table>"))
    return page.select(F.col("r_regionkey").alias("doc"), markdown.from_html(html_text).alias("markdown"))


@_query("""WITH p AS (SELECT c_custkey AS page, c_custkey % 256 AS g, CASE WHEN c_custkey % 3 = 0 THEN 1 ELSE 40 END AS n, c_custkey * 37 % 300 AS chars, c_custkey % 2 AS images FROM customer)
SELECT page, round(CASE WHEN g < 245 THEN n / (n + 2000.0) ELSE 0 END, 9) AS no_white, round(CASE WHEN g < 180 THEN n / (n + 2000.0) ELSE 0 END, 9) AS dark,
 (CASE WHEN g < 180 THEN n / (n + 2000.0) ELSE 0 END) < 0.00002 AND (CASE WHEN g < 245 THEN n / (n + 2000.0) ELSE 0 END) < 0.001 AS blank, chars < 50 OR (images > 0 AND chars < 150) AS needs_ocr,
 greatest(1, floor((page % 4000) * 2.0)) * greatest(1, floor(1500 * 2.0)) > 4000000 AS capped, greatest(1, floor((page % 4000) * 2.0)) * greatest(1, floor(1500 * 2.0)) > 4000000 AND sqrt(4000000.0 / greatest(1.0, (page % 4000) * 1500.0)) < 1 AS skipped FROM p""")
def page_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as pages of grey pixels with some text: what is blank, what needs OCR, and what is too large to render."""
    k = F.col("c_custkey")
    n = F.when(k % 3 == 0, 1).otherwise(40)
    pixels = F.unhex(F.concat(F.repeat(F.lpad(F.hex(k % 256), 2, "0"), n), F.repeat(F.lit("FF"), F.lit(2000))))
    body = F.repeat(F.lit("x"), (k * 37 % 300).cast("int"))
    p = _table(spark, sf_dir, "customer").select(k.alias("page"), signals.grey_shares(pixels).alias("s"), signals.needs_ocr(body, k % 2, 50).alias("needs_ocr"), signals.render_scale((k % 4000).cast("double"), F.lit(1500.0), 2.0, 4_000_000, 1.0).alias("r"))
    return p.select("page", F.round("s.no_white", 9).alias("no_white"), F.round("s.dark", 9).alias("dark"), F.col("s.blank").alias("blank"), "needs_ocr", F.col("r.capped").alias("capped"), F.col("r.skip").alias("skipped"))


@_query("SELECT count(*) AS rows, CAST(sum(length(html)) AS BIGINT) AS input_chars, CAST(sum(length(substr(html, 1, CAST(page_id % 7 AS INTEGER) * 10))) AS BIGINT) AS output_chars, count(*) FILTER (page_id % 7 = 0 OR html = '') AS empty FROM pages")
def job_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counters that a job over pages gives on its way, as a row."""
    made = _table(spark, sf_dir, "pages").withColumn("text", F.substring("html", F.lit(1), (F.col("page_id") % 7 * 10).cast("int")))
    counted, seen = progress.observed(made, progress.text_counters(), f"pages-{uuid.uuid4().hex}")
    counted.write.parquet(_folder(spark, "counted"))
    return spark.createDataFrame([seen.get], "rows long, input_chars long, output_chars long, empty long")


@_query("""WITH p AS (SELECT p_partkey AS part, unnest([1, 2, 3, 4, 5, 6]) AS line FROM part)
SELECT part, line, CASE line WHEN 4 THEN 1 WHEN 5 THEN 2 ELSE 0 END AS level FROM p""")
def heading_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of price lists beside numbered headings: rows of tables, in bars or plain, and their sums are no headings."""
    k = F.col("p_partkey").cast("string")
    lines = F.array(F.concat(F.lit("1. 软件 | 套 | "), k), F.concat(k, F.lit(" 基础软件产品及其实施服务 数量 3 套 100 元")), F.concat(F.lit("2. 合计金额 "), k), F.lit("3. 服务范围"), F.lit("3.1 范围说明"), F.concat(F.lit("| 4. 表 | "), k, F.lit(" |")))
    split = spread(_table(spark, sf_dir, "part"), 20_000).select(F.col("p_partkey").alias("part"), F.posexplode(lines).alias("n", "t"))
    return sectioning.with_levels(split).select("part", (F.col("n") + 1).alias("line"), "level")


def _nested(name: Column, inner: Column) -> Column:
    return F.concat(F.lit("<tr><td>"), name, F.lit("<td>x<table>"), inner, F.lit("</table></td></tr><tr><td>after "), name, F.lit("</td><td>y</td></tr>"))


@_query("""WITH n AS (SELECT n_regionkey AS page_id, n_nationkey, n_name, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS i FROM nation)
SELECT page_id, CAST(1 AS BIGINT) AS table_no, 2 * (i - 1) + d AS row, CAST(0 AS BIGINT) AS col, CASE d WHEN 0 THEN n_name ELSE 'after ' || n_name END AS value FROM n, (VALUES (0), (1)) v(d)
UNION ALL SELECT page_id, i + 1, d, 0, CASE d WHEN 0 THEN 'in ' || n_nationkey ELSE 'second' END FROM n, (VALUES (0), (1)) v(d)""")
def nested_table_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table for each region that has a table within a cell for each nation: the first cell of every row, by its own table."""
    inner = F.concat(F.lit("<tr><td>in "), F.col("n_nationkey").cast("string"), F.lit("</td></tr><tr><td>second</td></tr>"))
    rows = _table(spark, sf_dir, "nation").withColumn("h", _nested(F.col("n_name"), inner))
    made = rows.groupBy(F.col("n_regionkey").alias("page_id")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n_nationkey", "h"))), lambda x: x["h"]), "").alias("b"))
    cells = pages.table_cells(html.parsed(made.select("page_id", F.concat(F.lit("<table>"), "b", F.lit("</table>")).alias("html"))))
    return cells.where("col = 0").select("page_id", F.col("table_no").cast("long").alias("table_no"), F.col("row").cast("long").alias("row"), F.col("col").cast("long").alias("col"), "value")


@_query("""SELECT c_custkey AS page_id, 'find' || c_custkey AS name, 'in' || c_nationkey || ',q' AS fields, CASE WHEN c_custkey % 2 = 0 THEN 'q' ELSE '' END AS required FROM customer""")
def declared_tools(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers' pages with a form that declares a tool, fields before and after it, and a form that declares none."""
    k, n = F.col("c_custkey").cast("string"), F.col("c_nationkey").cast("string")
    need = F.when(F.col("c_custkey") % 2 == 0, " required").otherwise("")
    page = F.concat(F.lit("<input name=before><form toolname='find"), k, F.lit("'><input name=q"), need, F.lit("><div><select name='in"), n, F.lit("'></select></div></form><input name=other required><form><input name=plain></form>"))
    found = pages.declared_tools(html.elements(_table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("page_id"), page.alias("html"))))
    return found.select("page_id", "name", F.array_join("fields", ",").alias("fields"), F.array_join("required", ",").alias("required"))


@_query(r"""WITH l AS (SELECT conv_id AS doc_id, turn, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS n, regexp_replace(unnest(string_split(coalesce(text, ''), chr(10))), '^\s+|\s+$', '', 'g') AS t FROM conversations)
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY turn) AS idx, 'Turn ' || turn AS title, string_agg(t, chr(10) ORDER BY n) || chr(10) || '## sub' || chr(10) || 'end.' AS text, turn + 1 AS page_start, turn + 1 AS page_end FROM l WHERE t <> '' GROUP BY doc_id, turn""")
def split_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as documents of several pages, each with a heading, text, a deeper heading and a last line: sections with their texts and pages."""
    c = _table(spark, sf_dir, "conversations").where(text.strip(F.coalesce("text", F.lit(""))) != "")
    body = F.concat(F.lit("# Turn "), F.col("turn").cast("string"), F.lit("\n\n"), "text", F.lit("\n## sub\nend.\n"))
    found = sectioning.sections(stored(c.select(F.col("conv_id").alias("doc_id"), (F.col("turn") + 1).alias("page_num"), body.alias("text")), "turn-pages"))
    return found.select("doc_id", F.col("idx").cast("long").alias("idx"), "title", "text", "page_start", "page_end")
