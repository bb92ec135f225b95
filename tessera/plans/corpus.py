"""Whole plans: pages to captures, files to a stored library, and reading it back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import text, urls
from tessera.operators import pages as web
from tessera.operators import quality, sectioning, tables
from tessera.sources import html
from tessera.storage import stored


def capture(pages: DataFrame, key: str = "page_id", url: str = "url") -> dict[str, DataFrame]:
    """Pages distilled to the tables of a capture: library (URL, title, digest, content hash, why it is refused), sections, tables, actions, tools."""
    elements = html.parsed(pages, key)
    titles = web.titles(elements, key)
    page_tables = stored(web.page_tables(elements, key=key), "page-tables")
    parts = stored(web.sections(web.blocks(elements, key), page_tables, key=key), "page-sections")
    entry = pages.select(key, F.col(url).alias("source_url"), urls.violation(F.col(url)).alias("refused")).join(titles, key, "left").join(web.digest(titles, parts, key=key), key, "left").join(web.content_hash(titles, parts, key=key), key, "left")
    return {"library": entry, "sections": parts, "tables": page_tables, "actions": web.actions(elements, key), "tools": web.declared_tools(elements, key)}


def parse(pages: DataFrame, key: str = "doc_id") -> dict[str, DataFrame]:
    """Pages of documents (key, page_num, text) parsed to sections, Markdown tables and one library row each; running headers and footers go first."""
    clean = stored(quality.strip_running_lines(pages, key), "clean-pages")
    merged = sectioning.merge_short(sectioning.merge_stubs(sectioning.sections(clean, key), key), key)
    parts = stored(sectioning.with_ids(sectioning.promote_children(merged), key), "sections")
    paged = clean.withColumn("_page", F.struct(key, "page_num"))
    found = tables.markdown_tables(paged.select("_page", "text"), "_page").select(f"_page.{key}", "_page.page_num", "idx", "markdown", tables.dimensions(F.col("markdown")).alias("size"))
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("idx", "text"))), lambda x: x["text"]), "\n")
    library = parts.groupBy(key).agg(F.count(F.lit(1)).alias("sections"), text.text_hash(whole).alias("content_hash"), F.substring(whole, 1, 200).alias("digest"), F.max("page_end").alias("pages"))
    return {"library": library, "sections": parts, "tables": found}


def full_text(sections: DataFrame, key: str = "doc_id") -> DataFrame:
    """Each document as one Markdown text: sections under headings, one level deeper than theirs and four at most, with rules between them."""
    signs = F.repeat(F.lit("#"), F.least(F.col("level") + 1, F.lit(4)))
    part = F.concat(signs, F.lit(" "), "title", F.lit("\n\n"), "text")
    return sections.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("idx", part.alias("p")))), lambda x: x["p"]), "\n\n---\n\n").alias("text"))


def save(tables_of: dict[str, DataFrame], path: str, partition: str | None = None) -> None:
    """Store each table as Parquet; partitioned by a column (content_type, say) where it has it."""
    for name, table in tables_of.items():
        writer = table.write.mode("overwrite")
        (writer.partitionBy(partition) if partition in table.columns else writer).parquet(f"{path}/{name}")


def load(spark: SparkSession, path: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{path}/{name}")


def export_json(library: DataFrame) -> DataFrame:
    """Each library row as a JSON text."""
    return library.select(F.to_json(F.struct(*library.columns)).alias("entry"))


def indexed_metadata(metadata: Column) -> Column:
    """Of a JSON object the scalars, and the first 20 items of scalar lists, as a map of texts."""
    entries = F.from_json(metadata, "map<string,string>")
    nested = lambda v: F.startswith(v, F.lit("{")) | (F.startswith(v, F.lit("[")) & v.rlike(r"[\[,]\s*[{\[]"))
    cut = lambda v: F.when(F.startswith(v, F.lit("[")), F.to_json(F.slice(F.from_json(v, "array<string>"), 1, 20))).otherwise(v)
    return F.transform_values(F.map_filter(entries, lambda _, v: v.isNull() | ~nested(v)), lambda _, v: cut(v))
