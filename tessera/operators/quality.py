"""Pages of documents: running headers, text quality, which pages need OCR, checks of what was written."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import text
from tessera.storage import stored

#: Documents of fewer pages keep all lines; lines at each edge that may be running ones; share of pages they must be on.
MIN_PAGES, EDGE_LINES, PAGE_SHARE = 4, 2, 0.5


def _edge_key(line: Column, page: Column, pages: Column, footer: bool) -> Column:
    """A line without white space; a number at the foot that follows the page's own is one sign for all pages."""
    bare = F.regexp_replace(line, r"(?U)\s+", "")
    if not footer:
        return bare
    value = F.when(bare.rlike("^[0-9]{1,9}$"), bare.cast("long"))
    return F.when(value.between(F.lit(1), pages) & (F.abs(value - page) <= 2), F.lit("\u0001page")).otherwise(bare)


def edge_lines(pages: DataFrame, key: str = "doc_id") -> DataFrame:
    """The non-blank lines of each page with their place from the top and from the foot: key, page_num, line, text, top, foot, pages."""
    counted = pages.withColumn("pages", F.count(F.lit(1)).over(Window.partitionBy(key)))
    rows = counted.select(key, "page_num", "pages", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("line", "text"))
    page = Window.partitionBy(key, "page_num")
    solid = rows.withColumn("_text", text.strip(F.col("text"))).where("_text <> ''")
    return solid.select(key, "page_num", "pages", "line", "text", "_text", F.row_number().over(page.orderBy("line")).alias("top"), F.row_number().over(page.orderBy(F.col("line").desc())).alias("foot"))


def _edges(pages: DataFrame, key: str, header: int = EDGE_LINES, footer: int = EDGE_LINES) -> DataFrame:
    """The lines at the edges of pages of documents that are long enough: a row for each edge a line is near."""
    lines = edge_lines(pages, key).where(F.col("pages") >= MIN_PAGES)
    sides = F.explode(F.array(*(F.struct(F.lit(e).alias("edge"), F.col(e).alias("place")) for e in ("top", "foot")))).alias("e")
    near = lines.select(key, "page_num", "pages", "line", "_text", sides).select(key, "page_num", "pages", "line", "_text", "e.*").where(F.col("place") <= F.when(F.col("edge") == "top", header).otherwise(footer))
    of = lambda footer: _edge_key(F.col("_text"), F.col("page_num"), F.col("pages"), footer)
    return near.withColumn("line_key", F.when(F.col("edge") == "foot", of(True)).otherwise(of(False))).drop("_text")


def _running(edges: DataFrame, key: str) -> DataFrame:
    both = edges.groupBy(key, "edge", "line_key").agg(F.count_distinct("page_num").alias("on_pages"), F.max("pages").alias("pages"))
    return both.where((F.col("line_key") != "") & (F.col("on_pages") >= F.greatest(F.lit(2), F.ceil(F.col("pages") * PAGE_SHARE)))).select(key, "edge", "line_key", "on_pages")


def running_lines(pages: DataFrame, key: str = "doc_id") -> DataFrame:
    """Lines that come at the same edge of at least half of a document's pages: key, edge, line_key, on_pages."""
    return _running(_edges(pages, key), key)


def strip_running_lines(pages: DataFrame, key: str = "doc_id", header: int = EDGE_LINES, footer: int = EDGE_LINES) -> DataFrame:
    """The pages without running headers and footers: from each edge up to two lines, or as many as are known to be ``header`` and ``footer``, and none beyond the first that does not run. The edges' lines, four a page, are stored, so pages are split once."""
    near = stored(_edges(pages, key, header, footer), "page-edges")
    hit = near.join(_running(near, key).select(key, "edge", "line_key", F.lit(True).alias("_runs")), [key, "edge", "line_key"], "left")
    outer = Window.partitionBy(key, "page_num", "edge").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    drops = hit.withColumn("_all", F.min(F.coalesce("_runs", F.lit(False)).cast("int")).over(outer)).where("_all = 1")
    gone = drops.groupBy(key, "page_num").agg(F.collect_set("line").alias("_gone"))
    kept = F.array_join(F.filter(F.transform(F.split(F.coalesce("text", F.lit("")), "\n"), lambda v, i: F.when(~F.array_contains("_gone", i), v)), lambda v: v.isNotNull()), "\n")
    return pages.join(gone, [key, "page_num"], "left").withColumn("text", F.when(F.col("_gone").isNull(), F.col("text")).otherwise(kept)).drop("_gone")


def assess(signals: DataFrame, key: str = "doc_id", sparse: int = 80, usable: int = 200, scan_share: float = 0.6, mixed_share: float = 0.3) -> DataFrame:
    """Quality of each document from its pages: shares, kind (scan_only, mixed, text) and the pages of each sort.

    ``signals``: key, page_num, text_len, image_count, scan_like, blank_like. One aggregation by document.
    """
    pages = lambda c: F.array_sort(F.collect_list(F.when(c, F.col("page_num"))))
    out = signals.groupBy(key).agg(
        F.count(F.lit(1)).alias("pages"), F.avg(F.col("scan_like").cast("int")).alias("scan_ratio"), F.avg((F.col("text_len") < sparse).cast("int")).alias("mixed_ratio"),
        pages(F.col("text_len") < sparse).alias("sparse_pages"), pages(F.col("text_len") >= usable).alias("usable_pages"), pages(F.col("image_count") > 0).alias("image_pages"),
        pages(F.col("scan_like")).alias("scan_like_pages"), pages(F.col("blank_like")).alias("blank_pages"), F.array_sort(F.collect_list("page_num")).alias("all_pages"),
    )
    return out.withColumn("quality", F.when(F.col("scan_ratio") >= scan_share, "scan_only").when(F.col("mixed_ratio") >= mixed_share, "mixed").otherwise("text"))


def plan_ocr(assessed: DataFrame, mode: str = "accurate", force: bool = False, explicit: list[int] | None = None, local: bool = True) -> DataFrame:
    """Adds local_ocr_pages and llm_ocr_pages, by set algebra on the page lists of ``assess``.

    Explicit pages go to the model; a forced run sends scanned, else sparse, else image, else all pages that are not blank; fast and accurate
    runs read problem pages of scanned and mixed documents locally; a full run sends all pages that are not blank. Without
    a local engine its pages go to the model too.
    """
    if mode not in ("fast", "accurate", "full"):
        raise ValueError("mode is one of fast, accurate, full")
    col = F.col
    problem = F.array_except(F.array_union("scan_like_pages", "sparse_pages"), "blank_pages")
    none = F.array().cast("array<int>")
    weak = F.when(col("quality").isin("scan_only", "mixed"), problem).otherwise(none)
    solid = F.array_except("all_pages", "blank_pages")
    some = lambda name: F.when(F.size(name) > 0, F.col(name))
    if explicit:
        model, own = F.array(*map(F.lit, explicit)), weak if mode != "full" else none
    elif force:
        wanted = F.array_except(F.coalesce(some("scan_like_pages"), some("sparse_pages"), some("image_pages"), none), "blank_pages")
        model, own = F.when(F.size(wanted) > 0, wanted).otherwise(solid), none
    elif mode == "full":
        model, own = solid, none
    else:
        model, own = none, weak
    kind = "array<int>"
    if not local:
        model, own = F.array_union(model.cast(kind), own.cast(kind)), none
    return assessed.withColumn("llm_ocr_pages", F.array_sort(model.cast(kind))).withColumn("local_ocr_pages", F.array_sort(F.array_except(own.cast(kind), model.cast(kind))))


def parse_seconds(planned: DataFrame, local_page: float = 1.8, model_page: float = 6.0, concurrency: int = 2) -> DataFrame:
    """Adds the seconds that the planned OCR takes: local pages one after another, the model's some at once."""
    return planned.withColumn("parse_seconds", F.size("local_ocr_pages") * local_page + F.ceil(F.size("llm_ocr_pages") / concurrency) * model_page)


def validate(documents: DataFrame, checks: dict[str, Column]) -> DataFrame:
    """Adds each check and ok, true where all hold; a check without an answer does not."""
    out = documents
    for name, check in checks.items():
        out = out.withColumn(name, F.coalesce(check, F.lit(False)))
    ok = F.lit(True)
    for name in checks:
        ok = ok & F.col(name)
    return out.withColumn("ok", ok)


def ratio(part: Column, whole: Column) -> Column:
    """A share in four places; null where there is nothing to share."""
    return F.round(part / F.when(whole != 0, whole), 4)
