"""What summaries are made from, and their states: overviews by budget, groups, plans, retries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import text

#: Sections above which an overview has groups; sections of a group; characters of an overview.
MANY, GROUP, BUDGET = 60, 10, 32_000
#: Characters that a document and a section have at least to be summarised; sections above which none is on its own.
DOCUMENT_FLOOR, SECTION_FLOOR, DETAIL = 200, 40, 10
FAILED = ("", "[summary generation failed]", "summary generation failed")


def failed(summary: Column) -> Column:
    return F.lower(text.strip(F.coalesce(summary, F.lit("")))).isin(*FAILED)


def grouped_overview(sections: DataFrame, key: str = "doc_id") -> DataFrame:
    """Titles and summaries in groups of ten sections: key, grp, first_idx, last_idx, line."""
    one = F.concat("title", F.lit(": "), F.substring("summary", 1, 150))
    numbered = sections.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy("idx")))
    rows = numbered.withColumn("grp", F.floor((F.col("_n") - 1) / GROUP)).withColumn("_one", F.when(~failed(F.col("summary")), one))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("_one").isNotNull(), F.struct("idx", "_one")))), lambda x: x["_one"]), "; ")
    made = rows.groupBy(key, "grp").agg(F.min("idx").alias("first_idx"), F.max("idx").alias("last_idx"), body.alias("_body"))
    return made.select(key, "grp", "first_idx", "last_idx", F.concat(F.lit("**Sections "), F.col("first_idx").cast("string"), F.lit("-"), F.col("last_idx").cast("string"), F.lit("**: "), "_body").alias("line"))


def text_overview(sections: DataFrame, excerpt: int = 200, budget: int = BUDGET, key: str = "doc_id") -> DataFrame:
    """Each document's titles and the beginnings of its sections, up to the budget and one section at least: key, parts, cut, overview. The budget is a running sum over the sections."""
    part = F.concat(F.lit("## "), "title", F.lit("\n"), text.section_preview(F.col("text"), excerpt))
    order = Window.partitionBy(key).orderBy("idx")
    rows = sections.withColumn("_part", part).withColumn("_used", F.sum(F.length("_part")).over(order)).withColumn("_n", F.row_number().over(order))
    over = F.max(((F.col("_used") > budget) & (F.col("_n") > 1)).cast("int")).over(order)
    rows = rows.withColumn("_over", over)
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("_over") == 0, F.struct("idx", "_part")))), lambda x: x["_part"]), "\n\n")
    return rows.groupBy(key).agg(F.sum((F.col("_over") == 0).cast("int")).alias("parts"), (F.max("_over") == 1).alias("cut"), body.alias("overview"))


def plan(sections: DataFrame, key: str = "doc_id") -> DataFrame:
    """How each document is summarised: key, sections, chars, mode (echo: too short, overview: many sections, detail: section by section), own (sections that are summarised on their own)."""
    size = F.length(text.collapse(F.col("text")))
    sums = sections.groupBy(key).agg(F.count(F.lit(1)).alias("sections"), F.sum(size).alias("chars"), F.sum((size >= SECTION_FLOOR).cast("int")).alias("_long"))
    mode = F.when(F.col("chars") < DOCUMENT_FLOOR, "echo").when(F.col("sections") > DETAIL, "overview").otherwise("detail")
    return sums.select(key, "sections", "chars", mode.alias("mode"), F.when(mode == "detail", F.col("_long")).otherwise(0).alias("own"))


def next_state(state: Column, age_seconds: Column, attempts: Column, most: int = 3, timeout: float = 180.0) -> Column:
    """What becomes of a summary: a run that takes too long has failed, and failed ones are pending again while attempts are left."""
    now = F.when((state == "running") & (age_seconds > timeout), "failed").otherwise(state)
    return F.when((now == "failed") & (attempts < most), "pending").otherwise(now)


def counters(events: DataFrame, name: str = "name", n: str = "n") -> DataFrame:
    """One row of sums by counter, with the three ratios; null where there is nothing to share."""
    names = ("distill_input_chars", "distill_output_chars", "capture_cache_hits", "capture_cache_misses", "ocr_pages", "ocr_cache_hits")
    sums = events.agg(*(F.coalesce(F.sum(F.when(F.col(name) == c, F.col(n))), F.lit(0)).alias(c) for c in names))
    share = lambda a, b: F.round(a / F.when(b != 0, b), 4)
    c = F.col
    return sums.withColumns({"distill_output_over_input": share(c("distill_output_chars"), c("distill_input_chars")), "capture_cache_hit_rate": share(c("capture_cache_hits"), c("capture_cache_hits") + c("capture_cache_misses")), "ocr_cache_hit_rate": share(c("ocr_cache_hits"), c("ocr_pages"))})
