"""More registered queries: names, pages, scanned text, states, files beside documents, streams, each with its SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions import arrays, ocr, text, urls
from tessera.operators import images, layout, library, pages, profiles, quality, sectioning, stateful, summaries, tables
from tessera.queries import _query, _table
from tessera.sources import files, results, scans
from tessera.storage import shared_folder, spread
from tessera.streaming import captures


@_query("SELECT o_orderkey, CAST(o_orderkey % 9 + 1 AS INT) AS page_start, CAST(CASE WHEN o_orderkey % 3 = 0 THEN o_orderkey % 9 + 1 ELSE o_orderkey % 9 + 1 + o_orderkey % 5 END AS INT) AS page_end FROM orders")
def page_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Page ranges as texts, read back."""
    k = F.col("o_orderkey")
    first, last = (k % 9 + 1).cast("string"), (k % 9 + 1 + k % 5).cast("string")
    spec = F.when(k % 3 == 0, F.concat(F.lit("p."), first)).when(k % 3 == 1, F.concat(F.lit("p."), first, F.lit("-"), last)).otherwise(F.concat(first, F.lit("-"), last))
    return _table(spark, sf_dir, "orders").select("o_orderkey", text.page_start(spec).alias("page_start"), text.page_end(spec).alias("page_end"))


@_query(r"""WITH n AS (SELECT p_partkey, '## ' || p_name || ': <' || p_type || '>  "v' || p_partkey || '"/*' AS t FROM part)
SELECT p_partkey, substr(regexp_replace(regexp_replace(t, '[\\/:*?"<>|]', '', 'g'), '\s+', '-', 'g'), 1, 40) AS safe, lower(regexp_replace(t, '[\s.．、:：)）\-_]+', '', 'g')) AS key, regexp_replace(t, '^##\s*', '') AS plain, 2 AS level FROM n""")
def heading_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part names as headings: safe for files, as keys, without signs, with their level."""
    t = F.concat(F.lit("## "), "p_name", F.lit(": <"), "p_type", F.lit('>  "v'), F.col("p_partkey").cast("string"), F.lit('"/*'))
    return _table(spark, sf_dir, "part").select("p_partkey", text.safe_name(t, 40).alias("safe"), text.heading_key(t).alias("key"), text.plain_heading(t).alias("plain"), text.markdown_level(t).alias("level"))


@_query(r"""WITH n AS (SELECT p_partkey, regexp_replace(regexp_replace(p_name || '_v' || (p_partkey % 7), '[\s._]+', '-', 'g'), '[^A-Za-z0-9-]', '', 'g') AS id FROM part), c AS (SELECT p_partkey, regexp_replace(substr(regexp_replace(regexp_replace(id, '-{2,}', '-', 'g'), '^-+|-+$', '', 'g'), 1, 80), '-+$', '') AS id FROM n)
SELECT p_partkey, id, length(id) BETWEEN 1 AND 80 AND regexp_matches(id, '^[A-Za-z0-9]([A-Za-z0-9-]*[A-Za-z0-9])?$') AND regexp_matches(id, '[0-9]') AS valid FROM c""")
def document_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids that file names give, and whether they are valid ones."""
    made = _table(spark, sf_dir, "part").select("p_partkey", text.document_id(F.concat("p_name", F.lit("_v"), (F.col("p_partkey") % 7).cast("string"), F.lit(".pdf"))).alias("id"))
    return made.withColumn("valid", text.valid_document_id(F.col("id")))


@_query("SELECT o_custkey, median(o_totalprice) AS middle FROM orders GROUP BY 1")
def medians(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.collect_list("o_totalprice").alias("v")).select("o_custkey", arrays.median(F.col("v")).alias("middle"))


@_query("""SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN 'footer' WHEN 1 THEN 'bracket' WHEN 2 THEN 'watermark' WHEN 3 THEN 'text' ELSE 'polluted' END AS kind FROM orders""")
def scanned_line_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What made-up lines of scans are: footers, frames read as brackets, watermarks, running text."""
    k = F.col("o_orderkey")
    n = (k % 97 + 1).cast("string")
    line = F.when(k % 5 == 0, F.concat(F.lit("- 第 "), n, F.lit(" 页 / 共 "), n, F.lit(" 页 -"))).when(k % 5 == 1, F.concat(F.lit("[Tab"), n, F.lit("x_row"))).when(k % 5 == 2, F.lit("万翼 签万翼")).when(k % 5 == 3, F.concat(F.lit("条款 "), n)).otherwise(F.concat(F.lit("本合同自签订之日起生效"), n, F.lit("。")))
    kind = F.when(ocr.page_footer(line), "footer").when(ocr.bracket_noise(line), "bracket").when(ocr.watermark(line), "watermark").when(text.polluted_heading(line), "polluted").otherwise("text")
    return _table(spark, sf_dir, "orders").select("o_orderkey", kind.alias("kind"))


@_query(r"""WITH l AS (SELECT doc_id, generate_subscripts(string_split(text, chr(10)), 1) AS n, regexp_replace(unnest(string_split(text, chr(10))), '^\s+|\s+$', '', 'g') AS t FROM documents),
b AS (SELECT *, regexp_replace(t, '\s+', '', 'g') AS s FROM l WHERE t <> ''), c AS (SELECT *, length(regexp_replace(s, '[^A-Za-z0-9_\-\[\]]', '', 'g')) AS plain, length(regexp_replace(s, '[^\x{4E00}-\x{9FFF}]', '', 'g')) AS han FROM b),
k AS (SELECT * FROM c WHERE NOT ((contains(s, '[') OR contains(s, ']')) AND ((length(s) <= 5 AND regexp_matches(s, '^\[[A-Za-z0-9_]+\]?$')) OR (plain >= 6 AND plain >= 2 * han) OR regexp_matches(s, '^[A-Za-z0-9_\-\[\]]{5,}$'))))
SELECT doc_id, coalesce(string_agg(t, chr(10) ORDER BY n), '') AS text FROM documents LEFT JOIN k USING (doc_id) GROUP BY 1""".replace("coalesce(string_agg(t, chr(10) ORDER BY n), '') AS text FROM documents LEFT JOIN k", "coalesce(string_agg(t, chr(10) ORDER BY n), '') AS text FROM (SELECT doc_id FROM documents) LEFT JOIN k"))
def scanned_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(_table(spark, sf_dir, "documents").select("doc_id", "text"), 5_000).select("doc_id", ocr.clean(F.col("text")).alias("text"))


@_query("""SELECT event_id, CASE WHEN event_type = 'view' AND value > 180 THEN CASE WHEN event_id % 5 < 3 THEN 'pending' ELSE 'failed' END WHEN event_type = 'view' THEN 'running' WHEN event_type = 'error' THEN CASE WHEN event_id % 5 < 3 THEN 'pending' ELSE 'failed' END ELSE 'done' END AS state FROM events""")
def summary_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What becomes of summaries by state, age and attempts."""
    e = F.col("event_type")
    state = F.when(e == "view", "running").when(e == "error", "failed").otherwise("done")
    return _table(spark, sf_dir, "events").select("event_id", summaries.next_state(state, F.col("value"), F.col("event_id") % 5).alias("state"))


@_query("""WITH b AS (SELECT l_orderkey AS doc_id, l_linenumber AS block_id, CAST(l_partkey % 500 AS DOUBLE) AS x, CAST(l_linenumber * 40 AS DOUBLE) AS y, l_suppkey AS s FROM lineitem), t AS (SELECT o_orderkey AS doc_id, CAST(o_custkey % 300 AS DOUBLE) AS x0, CAST(o_custkey % 100 AS DOUBLE) AS y0 FROM orders)
SELECT doc_id, block_id, s FROM b ANTI JOIN t ON b.doc_id = t.doc_id AND b.x + 10 BETWEEN t.x0 AND t.x0 + 150 AND b.y + 5 BETWEEN t.y0 AND t.y0 + 120""")
def text_outside_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    x, y = (F.col("l_partkey") % 500).cast("double"), (F.col("l_linenumber") * 40).cast("double")
    b = _table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.lit(1).alias("page"), F.col("l_linenumber").alias("block_id"), F.col("l_suppkey").alias("s"), x.alias("x0"), y.alias("y0"), (x + 20).alias("x1"), (y + 10).alias("y1"))
    tx, ty = (F.col("o_custkey") % 300).cast("double"), (F.col("o_custkey") % 100).cast("double")
    t = _table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc_id"), F.lit(1).alias("page"), tx.alias("x0"), ty.alias("y0"), (tx + 150).alias("x1"), (ty + 120).alias("y1"))
    return layout.text_outside_tables(b, t).select("doc_id", "block_id", "s")


@_query("""WITH p AS (SELECT c_custkey, list_transform(generate_series(0, 63), lambda i: (c_custkey * (i + 7)) % 256) AS v FROM customer), m AS (SELECT c_custkey, v, list_sum(v) / 64.0 AS mean FROM p),
h AS (SELECT c_custkey, list_transform(generate_series(0, 15), lambda j: list_sum(list_transform(generate_series(0, 3), lambda k: CASE WHEN v[j * 4 + k + 1] >= mean THEN 8 >> k ELSE 0 END))) AS d FROM m)
SELECT c_custkey, array_to_string(list_transform(d, lambda x: substr('0123456789abcdef', CAST(x + 1 AS INT), 1)), '') AS ahash FROM h""")
def image_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Average hashes of made-up images of 64 grey values."""
    pixels = F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: ((F.col("c_custkey") * (i + 7)) % 256).cast("int"))
    return spread(_table(spark, sf_dir, "customer").select("c_custkey"), 20_000).select("c_custkey", images.average_hash(pixels).alias("ahash"))


@_query("""SELECT l_orderkey AS doc_id, CAST(1 AS INT) AS page, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_shipdate, l_discount, l_tax) - 1 AS ord, CAST(l_partkey AS VARCHAR) AS text, CAST(l_suppkey AS DOUBLE) AS x0, CAST(l_linenumber * 10 AS DOUBLE) AS y0, CAST(l_suppkey + 90 AS DOUBLE) AS x1, CAST(l_linenumber * 10 + 8 AS DOUBLE) AS y1, l_discount AS confidence FROM lineitem""")
def engine_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as an engine's JSON answers in both of its forms, flattened to blocks."""
    x, y = F.col("l_suppkey"), F.col("l_linenumber") * 10
    points = F.array(F.array(x, y), F.array(x + 90, y), F.array(x + 90, y + 8), F.array(x, y + 8))
    item = F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_shipdate", "l_discount", "l_tax", points.alias("box"))
    listed = _table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(item)).alias("b"))
    each = lambda f: F.transform("b", f)
    lists = F.to_json(F.struct(each(lambda x: x["l_partkey"].cast("string")).alias("rec_texts"), each(lambda x: x["l_discount"]).alias("rec_scores"), each(lambda x: x["box"]).alias("rec_polys")))
    pair = lambda x: F.concat(F.lit("["), F.to_json(x["box"]), F.lit(',["'), x["l_partkey"].cast("string"), F.lit('",'), x["l_discount"].cast("string"), F.lit("]]"))
    pairs = F.concat(F.lit("[["), F.array_join(each(pair), ","), F.lit("]]"))
    answers = listed.select(F.col("l_orderkey").alias("doc_id"), F.lit(1).alias("page"), F.when(F.col("l_orderkey") % 2 == 0, lists).otherwise(pairs).alias("result"))
    return scans.flattened(answers).withColumn("ord", F.col("ord").cast("bigint"))


_SIDECAR = "SELECT o_custkey AS doc_id, o_orderkey AS k, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS page, o_orderkey % 4 AS n FROM orders"


def _sidecars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as documents: an order is a page of a few blocks, and each of its blocks a table too."""
    k = F.col("o_orderkey")
    blocks = F.transform(F.slice(F.array(*map(F.lit, (1, 2, 3))), F.lit(1), (k % 4).cast("int")), lambda i: F.struct(F.concat_ws("-", k, i).alias("block_id"), i.cast("string").alias("text"), F.array(i * 1.0, i * 2.0, i * 3.0, i * 4.0).alias("bbox"), F.lit(0.5).alias("confidence")))
    numbered = _table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey")).alias("page"), blocks.alias("blocks"))
    page = F.struct("page", F.lit(600).alias("width"), F.lit(800).alias("height"), "blocks")
    table = F.struct(F.format_string("table-%02d", "page").alias("table_id"), "page", F.size("blocks").alias("row_count"), F.concat(F.when(F.col("page") % 3 == 0, "../").otherwise("tables/"), F.col("page").cast("string"), F.lit(".json")).alias("json_file"))
    made = numbered.groupBy(F.col("o_custkey").alias("doc_id")).agg(F.array_sort(F.collect_list(page)).alias("pages"), F.array_sort(F.collect_list(table)).alias("t"))
    return made.select("doc_id", F.to_json(F.struct(F.lit("px").alias("coordinate_system"), F.lit(1).alias("version"), "pages")).alias("layout"), F.to_json("t").alias("tables"))


@_query(f"SELECT doc_id, true AS has_layout, 'px' AS coordinate_system, count(*) AS pages, CAST(sum(n) AS BIGINT) AS blocks, count(*) AS tables FROM ({_SIDECAR}) GROUP BY 1")
def discovered_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scans.discovered(_sidecars(spark, sf_dir))
    return found.select("doc_id", "has_layout", "coordinate_system", *(F.col(c).cast("bigint").alias(c) for c in ("pages", "blocks", "tables")))


@_query(f"SELECT doc_id, page, 600 AS width, 800 AS height, CAST(n AS INT) AS block_count FROM ({_SIDECAR})")
def layout_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scans.layout_pages(_sidecars(spark, sf_dir)).withColumn("page", F.col("page").cast("bigint"))


@_query(f"SELECT doc_id, page, k || '-' || i AS block_id, CAST(i AS VARCHAR) AS text, i * 1.0::DOUBLE AS x0, i * 2.0::DOUBLE AS y0, i * 3.0::DOUBLE AS x1, i * 4.0::DOUBLE AS y1 FROM (SELECT *, unnest(generate_series(1, n)) AS i FROM ({_SIDECAR}) WHERE page = 2)")
def layout_page_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The blocks of every document's second page."""
    return scans.layout_blocks(_sidecars(spark, sf_dir), 2).drop("confidence").withColumn("page", F.col("page").cast("bigint"))


@_query(f"SELECT doc_id, 'table-' || lpad(CAST(page AS VARCHAR), CAST(greatest(2, length(CAST(page AS VARCHAR))) AS INT), '0') AS table_id, CASE WHEN page % 3 <> 0 THEN 'tables/' || page || '.json' END AS json_file, CAST(n AS INT) AS row_count FROM ({_SIDECAR})")
def table_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scans.table_entries(_sidecars(spark, sf_dir)).select("doc_id", "table_id", "json_file", "row_count")


@_query(f"SELECT doc_id, max(n) >= 0 AS leaks, false AS table_leaks FROM ({_SIDECAR}) GROUP BY 1")
def geometry_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sidecars(spark, sf_dir).select("doc_id", scans.leaks_geometry(F.col("layout")).alias("leaks"), scans.leaks_geometry(F.col("tables")).alias("table_leaks"))


@_query("""WITH RECURSIVE e AS (SELECT user_id, event_id, epoch_us(ts) AS t, event_type = 'error' AS bad, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
f AS (SELECT user_id, event_id, n, true AS made, CASE WHEN bad THEN t + 86400000000 END AS until FROM e WHERE n = 1 UNION ALL
 SELECT e.user_id, e.event_id, e.n, until IS NULL OR e.t >= until, CASE WHEN (until IS NULL OR e.t >= until) AND bad THEN e.t + 86400000000 ELSE until END FROM f JOIN e ON e.user_id = f.user_id AND e.n = f.n + 1)
SELECT user_id, event_id, made FROM f""")
def circuit_breaker(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which of each user's calls are made when an error keeps the next day's from being made."""
    return stateful.circuit_breaker(_table(spark, sf_dir, "events").withColumn("failed", F.col("event_type") == "error"), 86_400)


@_query("""WITH RECURSIVE e AS (SELECT event_type AS service, event_id, user_id AS k, epoch_us(ts) AS t, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS n FROM events),
f AS (SELECT service, event_id, n, [k] AS ks, [t] AS ts, 'new' AS found, CAST(NULL AS BIGINT) AS evicted FROM e WHERE n = 1 UNION ALL
 SELECT service, event_id, n, list_append(CASE WHEN gone THEN ks2[2:] ELSE ks2 END, k), list_append(CASE WHEN gone THEN ts2[2:] ELSE ts2 END, t), CASE WHEN p IS NULL OR p = 0 THEN 'new' WHEN hit THEN 'hit' ELSE 'expired' END, CASE WHEN gone THEN ks2[1] END
 FROM (SELECT *, NOT hit AND len(ks2) >= 8 AS gone FROM (SELECT e.*, p, coalesce(p > 0 AND e.t - f.ts[p] <= 43200000000, false) AS hit, CASE WHEN p > 0 THEN list_concat(ks[:p - 1], ks[p + 1:]) ELSE ks END AS ks2, CASE WHEN p > 0 THEN list_concat(ts[:p - 1], ts[p + 1:]) ELSE ts END AS ts2
  FROM (SELECT f.*, list_position(f.ks, e2.k) AS p FROM f JOIN e e2 ON e2.service = f.service AND e2.n = f.n + 1) f JOIN e ON e.service = f.service AND e.n = f.n + 1)))
SELECT service, event_id, found, evicted FROM f""")
def bounded_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stores of eight sessions, one for each type of event: what is found and what has to go."""
    e = _table(spark, sf_dir, "events").withColumn("service", F.col("event_type"))
    return stateful.bounded_sessions(e, 8, 43_200)


@_query("""SELECT window_start, event_type, count(*) AS n FROM (SELECT CAST(time_bucket(INTERVAL 6 HOURS, ts) AS TIMESTAMP) AS window_start, event_type FROM events) GROUP BY 1, 2""")
def stream_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts by windows of six hours, as a stream over the events that ends where they do."""
    folder = f"{shared_folder(spark)}/streams/{uuid.uuid4().hex}"
    events = spark.readStream.schema(_table(spark, sf_dir, "events").schema).option("pathGlobFilter", "events*").parquet(sf_dir).withColumn("ts", F.col("ts").cast("timestamp"))
    counted = captures.windowed_counts(events, "6 hours").select(F.col("window.start").cast("timestamp_ntz").alias("window_start"), "event_type", "n")
    query = counted.writeStream.outputMode("complete").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).foreachBatch(lambda df, _: df.write.mode("overwrite").parquet(f"{folder}/counts")).start()
    query.awaitTermination()
    return spark.read.parquet(f"{folder}/counts")


@_query("""SELECT c_custkey, CASE WHEN c_custkey % 4 = 3 THEN NULL WHEN c_custkey % 4 = 2 THEN CASE WHEN c_custkey % 256 IN (0, 10, 127) OR c_custkey % 256 >= 224 THEN 'private address' END ELSE 'private address' END AS violation FROM customer""")
def address_spellings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """IPv6 addresses in several spellings: local, private, mapped and public ones."""
    k = F.col("c_custkey")
    n = F.lower(F.hex(k % 65536))
    mapped = F.concat(F.lit("0:0:0:0:0:ffff:"), (k % 256).cast("string"), F.lit(".1.2.3"))
    host = F.when(k % 4 == 0, F.concat(F.lit("fd00::"), n)).when(k % 4 == 1, "0:0:0:0:0:0:0:1").when(k % 4 == 2, mapped).otherwise(F.concat(F.lit("2606:4700::"), n))
    return _table(spark, sf_dir, "customer").select("c_custkey", urls.violation(F.concat(F.lit("https://["), host, F.lit("]:443/x"))).alias("violation"))


@_query("""WITH g AS (SELECT o_orderkey, '{"content_hash": "' || sha256(o_orderstatus) || '", "filename": "f' || o_custkey || '", "metadata": {"a": "' || o_orderkey % 3 || '", "b": null}, "source": "s\\"x", "tags": ["' || o_orderpriority || '", "z"]}' AS j FROM orders) SELECT o_orderkey, sha256(j) AS generation FROM g""".replace("\\\\", "\\"))
def generations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of orders as documents, which change when what they are made from does."""
    meta = F.create_map(F.lit("b"), F.lit(None).cast("string"), F.lit("a"), (F.col("o_orderkey") % 3).cast("string"))
    token = library.generation(F.sha2("o_orderstatus", 256), F.concat(F.lit("f"), F.col("o_custkey").cast("string")), F.array(F.lit("z"), F.col("o_orderpriority")), meta, F.lit('s"x'))
    return _table(spark, sf_dir, "orders").select("o_orderkey", token.alias("generation"))


@_query("SELECT o_orderkey AS id, CASE WHEN o_orderkey % 2 = 0 AND o_orderkey % 3 = 0 THEN 'new' ELSE o_orderstatus END AS status FROM orders")
def guarded_updates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Changes to every second order, of which every third was made against the generation that is there."""
    o = _table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status"), F.lit("g1").alias("generation"))
    changes = o.where("id % 2 = 0").select("id", F.lit("new").alias("status"), F.when(F.col("id") % 3 == 0, "g1").otherwise("g0").alias("generation"))
    return library.guarded_update(o, changes, ["status"]).select("id", "status")


@_query("""SELECT o_orderkey AS query, CASE WHEN o_orderkey % 3 = 0 THEN 'brave' ELSE 'tavily' END AS provider, CAST(i AS INT) AS rank, 'T' || o_custkey || '-' || i AS title, 'http://e.example/' || o_orderkey || '/' || i AS url, 0.5::DOUBLE / i AS score FROM (SELECT *, unnest(generate_series(1, o_orderkey % 4)) AS i FROM orders WHERE o_orderkey % 5 <> 0)""".replace("0.5::DOUBLE / i AS score", "CASE WHEN o_orderkey % 3 <> 0 THEN 0.5::DOUBLE END AS score"))
def provider_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers of two providers in their own JSON: the first one's where it has no trouble, and none where it says that it has nothing for us."""
    return results.hits(_answers(spark, sf_dir)).select("query", "provider", "rank", "title", "url", "score")


def _answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = _table(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    some = lambda **extra: F.transform(F.slice(F.array(*map(F.lit, (1, 2, 3))), F.lit(1), (k % 4).cast("int")), lambda i: F.struct(F.concat(F.lit("T"), F.col("o_custkey").cast("string"), F.lit("-"), i.cast("string")).alias("title"), F.concat(F.lit("http://e.example/"), k.cast("string"), F.lit("/"), i.cast("string")).alias("url"), *(v.alias(n) for n, v in extra.items())))
    first = o.select(k.alias("query"), F.lit("tavily").alias("provider"), F.lit(1).alias("priority"), F.when(k % 5 == 0, 401).when(k % 3 == 0, 503).otherwise(200).alias("status"), F.to_json(F.struct(some(score=F.lit(0.5)).alias("results"))).alias("body"))
    second = o.select(k.alias("query"), F.lit("brave").alias("provider"), F.lit(2).alias("priority"), F.lit(200).alias("status"), F.to_json(F.struct(F.struct(some().alias("results")).alias("web"))).alias("body"))
    return first.unionByName(second)


@_query("""SELECT '| n_nationkey | n_name |' || chr(10) || '|---|---|' || chr(10) || string_agg('| ' || n_nationkey || ' | ' || n_name || ' |', chr(10) ORDER BY n_nationkey) AS text FROM nation""")
def csv_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations written as a CSV file and read back as a Markdown table."""
    folder = f"{shared_folder(spark)}/files/{uuid.uuid4().hex}"
    _table(spark, sf_dir, "nation").select("n_nationkey", "n_name").coalesce(1).sortWithinPartitions("n_nationkey").write.csv(folder, header=True)
    return files.csv_markdown(spark, folder).select("text")


@_query("""WITH t AS (SELECT conv_id AS doc_id, turn AS ord, CASE WHEN turn % 3 = 0 THEN 1 ELSE 2 END AS level, CASE WHEN turn % 3 = 0 THEN (turn // 3 + 1) || '. Chapter' ELSE (turn // 3 + 1) || '.' || (turn % 3) || ' Part' END AS title, turn // 2 + 1 AS page FROM conversations)
SELECT doc_id, ord, title, page, CASE WHEN EXISTS (SELECT 1 FROM t c WHERE c.doc_id = t.doc_id AND c.level = 1 AND c.ord = ord // 3 * 3) THEN (ord // 3 + 1) || '. Chapter' END AS parent FROM t WHERE level = 2""".replace("c.ord = ord // 3 * 3", "c.ord = t.ord // 3 * 3"))
def toc_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as entries of tables of contents: the parts with their chapters."""
    n = F.col("turn")
    chapter = F.floor(n / 3) + 1
    title = F.when(n % 3 == 0, F.concat(chapter.cast("string"), F.lit(". Chapter"))).otherwise(F.concat(chapter.cast("string"), F.lit("."), (n % 3).cast("string"), F.lit(" Part")))
    toc = _table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc_id"), n.alias("ord"), F.when(n % 3 == 0, 1).otherwise(2).alias("level"), title.alias("title"), (F.floor(n / 2) + 1).alias("page"))
    return sectioning.toc_prepared(toc).select("doc_id", "ord", "title", "page", "parent")


@_query(r"""WITH s AS (SELECT conv_id AS doc_id, turn, role, regexp_replace(coalesce(text, ''), '^\s+|\s+$', '', 'g') AS body, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM conversations),
m AS (SELECT *, n > 1 AND length(body) < 60 AS j FROM s), r AS (SELECT *, sum((NOT j)::INT) OVER (PARTITION BY doc_id ORDER BY turn) AS run FROM m)
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY run) AS idx, arg_min(role, turn) AS title, string_agg(CASE WHEN j THEN role || CASE WHEN body <> '' THEN chr(10) || body ELSE '' END ELSE CASE WHEN body <> '' THEN body END END, chr(10) ORDER BY turn) AS text FROM r GROUP BY doc_id, run""")
def merged_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as scanned sections: short ones become text of the one before."""
    t = _table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("idx"), F.col("role").alias("title"), F.lit(2).alias("level"), text.strip(F.coalesce("text", F.lit(""))).alias("text"), F.lit(1).alias("page_start"), F.lit(1).alias("page_end"))
    found = sectioning.merge_short_scanned(t, short=60)
    return found.select("doc_id", F.col("idx").cast("bigint").alias("idx"), "title", F.when(F.col("text") != "", F.col("text")).alias("text"))


@_query("""WITH a AS (SELECT event_id, user_id, event_type AS role, CAST(value AS VARCHAR) AS name, row_number() OVER (PARTITION BY user_id, event_type, CAST(value AS VARCHAR) ORDER BY event_id) - 1 AS nth, event_id % 3 <> 0 AS one, event_id % 4 <> 0 AS two FROM events)
SELECT user_id, role, name, nth, CASE WHEN one AND two THEN 'both' WHEN one THEN 'dom' ELSE 'a11y' END AS found, CASE WHEN two THEN 0.9 ELSE 0.8 END AS confidence FROM a WHERE one OR two""".replace("CASE WHEN two THEN 0.9 ELSE 0.8 END", "CAST(CASE WHEN two THEN 0.9 ELSE 0.8 END AS DOUBLE)"))
def merged_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as actions that two sources found, some of them both."""
    order = Window.partitionBy("user_id", "event_type", F.col("value").cast("string")).orderBy("event_id")
    e = _table(spark, sf_dir, "events").select("event_id", F.col("user_id").alias("page_id"), F.col("event_type").alias("role"), F.col("value").cast("string").alias("name"), (F.row_number().over(order) - 1).alias("nth"))
    side = lambda n, source, confidence: e.where(F.col("event_id") % n != 0).select("page_id", "role", "name", "nth", F.col("event_id").cast("int").alias("pos"), F.lit(source).alias("css"), F.lit("a").alias("aid"), F.lit(confidence).alias("confidence"), F.lit(source).alias("source"))
    both = pages.merged_actions(side(3, "dom", 0.8), side(4, "a11y", 0.9))
    return both.select(F.col("page_id").alias("user_id"), "role", "name", F.col("nth").cast("bigint").alias("nth"), F.when((F.col("source") == "dom") & (F.col("confidence") > 0.85), "both").otherwise(F.col("source")).alias("found"), "confidence")


@_query("""SELECT p_partkey, p_size * 40 AS width, p_size * 30 AS height, CASE WHEN p_partkey % 7 = 0 THEN 'render_failed' WHEN p_size * p_size * 1200 < 20000 THEN 'small_image' WHEN p_size * 40 >= 900 AND p_size * 30 >= 500 THEN 'screenshot_like' ELSE '' END || CASE WHEN p_partkey % 2 = 0 THEN '|context:certificate|certificate_or_identity_candidate' ELSE '' END AS hints FROM part""")
def image_hints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as images of their size, every second one near a word for certificates."""
    w, h = (F.col("p_size") * 40).cast("int"), (F.col("p_size") * 30).cast("int")
    keywords = images.context_keywords(F.when(F.col("p_partkey") % 2 == 0, "认证").otherwise(""))
    found = images.hints(w, h, F.col("p_partkey") % 7 != 0, keywords)
    joined = F.array_join(found, "|")
    marked = F.when((F.col("p_partkey") % 2 == 0) & ~F.get(found, F.lit(0)).isin("render_failed", "small_image", "screenshot_like"), F.concat(F.lit("|"), joined)).otherwise(joined)
    return _table(spark, sf_dir, "part").select("p_partkey", w.cast("bigint").alias("width"), h.cast("bigint").alias("height"), marked.alias("hints"))


@_query("SELECT doc_id, contains(text, 'the') OR contains(text, 'der') AS classified, contains(text, 'the')::INT + contains(text, 'der')::INT AS terms, length(text) > 0 AND contains(text, ' ') AND (contains(text, 'the') OR contains(text, 'der')) AS ok FROM documents")
def classified_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that have a profile's terms, and whether they pass checks."""
    terms = ["the", "der"]
    d = _table(spark, sf_dir, "documents").select("doc_id", profiles.classified(F.col("text"), terms).alias("classified"), F.size(profiles.matched_terms(F.col("text"), terms)).alias("terms"), "text")
    return quality.validate(d, {"_some": F.length("text") > 0, "_words": F.contains("text", F.lit(" ")), "_kind": F.col("classified")}).select("doc_id", "classified", "terms", "ok")


@_query(r"""SELECT doc_id, CASE WHEN strpos(text, 'the') > 0 THEN regexp_replace(regexp_replace(substr(text, 1, strpos(text, 'the') - 1), '\s+$', '') || chr(10) || chr(10) || 'BETTER' || chr(10) || chr(10)
 || CASE WHEN strpos(substr(text, strpos(text, 'the') + 3), 'and') > 0 THEN substr(text, strpos(text, 'the') + 2 + strpos(substr(text, strpos(text, 'the') + 3), 'and')) ELSE '' END, '^\s+|\s+$', '', 'g') ELSE text END AS text FROM documents""")
def replaced_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with what lies between two words read better."""
    return _table(spark, sf_dir, "documents").select("doc_id", profiles.replaced_segment(F.col("text"), profiles.Segment("s", "the", "and"), F.lit("BETTER")).alias("text"))


@_query(r"""WITH p AS (SELECT o_custkey AS doc_id, 'text before' || chr(10) || string_agg('| ' || o_orderkey || ' | x |' || chr(10) || '|---|---|' || chr(10) || '| ' || o_orderpriority || ' | y |', chr(10) || 'between' || chr(10) ORDER BY o_orderkey) AS body FROM orders GROUP BY 1)
SELECT o_custkey AS doc_id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS idx, '| ' || o_orderkey || ' | x |' || chr(10) || '|---|---|' || chr(10) || '| ' || o_orderpriority || ' | y |' AS markdown, count(*) OVER (PARTITION BY o_custkey) AS separators FROM orders""")
def scanned_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tables in scanned pages that are made of a customer's orders with text between them, and the separators counted in the text."""
    part = F.concat(F.lit("| "), F.col("o_orderkey").cast("string"), F.lit(" | x |\n|---|---|\n| "), "o_orderpriority", F.lit(" | y |"))
    listed = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("o_orderkey", part.alias("p")))), lambda x: x["p"]), "\nbetween\n")
    p = _table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("doc_id")).agg(F.concat(F.lit("text before\n"), listed).alias("text")).withColumn("page_num", F.lit(1))
    counted = p.select("doc_id", tables.table_count(F.col("text")).cast("bigint").alias("separators"))
    return tables.scanned_tables(p)[0].join(counted, "doc_id").select("doc_id", F.col("idx").cast("bigint").alias("idx"), "markdown", "separators")
