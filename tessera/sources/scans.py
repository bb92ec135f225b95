"""What OCR engines and parsers leave beside a document: blocks of text with their places, tables, and what may be told of them without the geometry."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import text

#: Fixed value: an engine's answer as one object of parallel lists, under either of its names for them.
_LISTS = "struct<rec_texts:array<string>,rec_scores:array<double>,scores:array<double>,rec_boxes:array<string>,rec_polys:array<string>,dt_polys:array<string>,boxes:array<string>>"
_BLOCK = "array<struct<text:string,box:string,confidence:double>>"


def box(geometry: Column) -> Column:
    """The extent (x0, y0, x1, y1) of a box or polygon in JSON; zeros where there is none."""
    numbers = F.transform(F.regexp_extract_all(geometry, F.lit(r"-?[0-9]+(?:\.[0-9]+)?(?:[eE][-+]?[0-9]+)?"), F.lit(0)), lambda x: x.cast("double"))
    side = lambda odd: F.filter(numbers, lambda _, i: i % 2 == odd)
    low = lambda a: F.coalesce(F.array_min(a), F.lit(0.0))
    high = lambda a: F.coalesce(F.array_max(a), F.lit(0.0))
    return F.struct(low(side(0)).alias("x0"), low(side(1)).alias("y0"), high(side(0)).alias("x1"), high(side(1)).alias("y1"))


def _from_lists(value: Column) -> Column:
    """Blocks of an object of parallel lists."""
    some = lambda *a: F.coalesce(*(F.when(F.size(x) > 0, x) for x in a))
    parsed = F.from_json(value, _LISTS)
    scores, boxes = some(parsed["rec_scores"], parsed["scores"]), some(parsed["rec_boxes"], parsed["rec_polys"], parsed["dt_polys"], parsed["boxes"])
    return F.transform(parsed["rec_texts"], lambda t, i: F.struct(t.alias("text"), F.get(boxes, i).alias("box"), F.get(scores, i).alias("confidence")))


def _from_pairs(value: Column) -> Column:
    """Blocks of a list of [box, [text, score]] or [box, text]."""
    pairs = F.filter(F.from_json(value, "array<array<string>>"), lambda p: F.size(p) >= 2)
    payload = lambda p: F.from_json(p[1], "array<string>")
    listed = lambda p: F.startswith(p[1], F.lit("["))
    return F.transform(pairs, lambda p: F.struct(F.when(listed(p), payload(p)[0]).otherwise(p[1]).alias("text"), p[0].alias("box"), F.when(listed(p), F.get(payload(p), F.lit(1)).cast("double")).alias("confidence")))


def flattened(answers: DataFrame, key: str = "doc_id", page: str = "page", result: str = "result") -> DataFrame:
    """Engines' answers as blocks: key, page, ord (from 0), text, x0, y0, x1, y1, confidence.

    ``result`` is JSON: an object of parallel lists, a list of those, or lists of [box, [text, score]]. Blank texts are left out; missing
    scores and places are zeros. A text that is no such JSON has no blocks.
    """
    whole = F.trim(F.col(result))
    parts = F.when(F.startswith(whole, F.lit("{")), F.array(whole)).otherwise(F.coalesce(F.from_json(whole, "array<string>"), F.array().cast("array<string>")))
    of = lambda x: F.coalesce(F.when(F.startswith(x, F.lit("{")), _from_lists(x)).otherwise(_from_pairs(x)), F.array().cast(_BLOCK)).cast(_BLOCK)
    solid = F.filter(F.flatten(F.transform(parts, of)), lambda b: text.strip(F.coalesce(b["text"], F.lit(""))) != "")
    rows = answers.select(key, page, F.posexplode(solid).alias("ord", "b"))
    return rows.select(key, page, "ord", text.strip(F.col("b.text")).alias("text"), box(F.coalesce("b.box", F.lit(""))).alias("_box"), F.coalesce("b.confidence", F.lit(0.0)).alias("confidence")).select(key, page, "ord", "text", "_box.*", "confidence")


def page_text(blocks: DataFrame, key: str = "doc_id", page: str = "page") -> DataFrame:
    """The text of each page: its blocks' texts in order, a line each."""
    return blocks.groupBy(key, page).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "text"))), lambda x: x["text"]), "\n").alias("text"))


_LAYOUT = "struct<coordinate_system:string,version:int,pages:array<struct<page:int,width:int,height:int,blocks:array<struct<block_id:string,text:string,bbox:array<double>,confidence:double>>>>>"
_TABLES = "array<struct<table_id:string,page:int,row_count:int,column_count:int,source:string,file:string,json_file:string,bbox:array<double>>>"


def layout_pages(sidecars: DataFrame, key: str = "doc_id", body: str = "layout") -> DataFrame:
    """Pages of layout files (JSON) without their geometry: key, page, width, height, block_count."""
    pages = sidecars.select(key, F.explode(F.from_json(body, _LAYOUT)["pages"]).alias("p"))
    zero = lambda c: F.coalesce(c, F.lit(0))
    return pages.select(key, zero(F.col("p.page")).alias("page"), zero(F.col("p.width")).alias("width"), zero(F.col("p.height")).alias("height"), zero(F.size("p.blocks")).alias("block_count")).withColumn("block_count", F.greatest("block_count", F.lit(0)))


def layout_blocks(sidecars: DataFrame, page: int | None = None, key: str = "doc_id", body: str = "layout") -> DataFrame:
    """Blocks of layout files, of one page or of all: key, page, block_id, text, x0, y0, x1, y1, confidence."""
    pages = sidecars.select(key, F.explode(F.from_json(body, _LAYOUT)["pages"]).alias("p"))
    mine = pages.where(F.col("p.page") == page) if page is not None else pages
    b = mine.select(key, F.col("p.page").alias("page"), F.explode("p.blocks").alias("b"))
    return b.select(key, "page", "b.block_id", "b.text", *(F.get("b.bbox", F.lit(i)).alias(n) for i, n in enumerate(("x0", "y0", "x1", "y1"))), "b.confidence")


def table_entries(sidecars: DataFrame, key: str = "doc_id", body: str = "tables") -> DataFrame:
    """Tables of table files (JSON lists): key, table_id, page, row_count, column_count, source, file, json_file (null where the path may not be read), bbox_available."""
    rows = sidecars.select(key, F.explode(F.from_json(body, _TABLES)).alias("t")).where("t is not null")
    return rows.select(key, "t.table_id", "t.page", "t.row_count", "t.column_count", "t.source", "t.file", F.when(inside_tables(F.col("t.json_file")), F.col("t.json_file")).alias("json_file"), (F.coalesce(F.size("t.bbox"), F.lit(0)) > 0).alias("bbox_available"))


def inside_tables(path: Column) -> Column:
    """Whether a relative path names a JSON file in the tables folder and cannot leave it."""
    steps = F.filter(F.split(path, "/"), lambda s: (s != "") & (s != "."))
    return F.coalesce(~F.startswith(path, F.lit("/")) & F.endswith(path, F.lit(".json")) & ~F.array_contains(steps, "..") & (F.get(steps, F.lit(0)) == "tables") & (F.size(steps) > 1), F.lit(False))


def discovered(documents: DataFrame, key: str = "doc_id", layout: str = "layout", tables: str = "tables") -> DataFrame:
    """What lies beside each document, in few numbers: key, has_layout, coordinate_system, pages, blocks, tables. Null files are missing ones."""
    parsed = documents.select(key, F.from_json(layout, _LAYOUT).alias("l"), F.from_json(tables, _TABLES).alias("t"))
    count = F.aggregate(F.coalesce("l.pages", F.array().cast(_LAYOUT.partition("pages:")[2][:-1])), F.lit(0), lambda n, p: n + F.greatest(F.coalesce(F.size(p["blocks"]), F.lit(0)), F.lit(0)))
    size = lambda c: F.greatest(F.coalesce(F.size(c), F.lit(0)), F.lit(0))
    return parsed.select(key, F.col("l").isNotNull().alias("has_layout"), F.coalesce("l.coordinate_system", F.lit("")).alias("coordinate_system"), size("l.pages").alias("pages"), count.alias("blocks"), size("t").alias("tables"))


def leaks_geometry(json: Column) -> Column:
    """Whether a JSON text, which should be small, carries lists of blocks under any key of theirs."""
    return F.coalesce(json.rlike(r'(?<!\\)"(?:ocr_)?blocks"\s*:\s*\['), F.lit(False))
