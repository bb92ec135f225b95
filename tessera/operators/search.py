"""Searches of the library: weighted keywords, full text and sections with snippets, phrases, lookups."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import text
from tessera.operators.library import LIMITS


def clamp(limit: int, low: int = LIMITS[0], high: int = LIMITS[1]) -> int:
    return max(low, min(limit, high))


def _page(hits: DataFrame, limit: int, order: list[str]) -> DataFrame:
    """The best hits and, beside them, how many there are. The count is a partial aggregate; the page is a top-k, so no sort of all hits."""
    total = hits.agg(F.count(F.lit(1)).alias("total"))
    return hits.orderBy(F.col("score").desc(), *order).limit(clamp(limit)).crossJoin(F.broadcast(total))


def _has(name: str, columns: list[str]) -> bool:
    return name in columns


def library_score(query: str, columns: list[str]) -> Column:
    """2 for the file name, 1 each for the digest and the source's file name, 1.5 for each tag and 1 for each metadata value that has the query; letters' case does not matter."""
    part = lambda c, w: F.when(text.contains(F.col(c), query), w).otherwise(0.0) if _has(c, columns) else F.lit(0.0)
    score = part("filename", 2.0) + part("digest", 1.0) + part("source_filename", 1.0)
    if _has("tags", columns):
        score = score + F.coalesce(F.size(F.filter("tags", lambda t: text.contains(t, query))) * 1.5, F.lit(0.0))
    if _has("metadata", columns):
        # a missing value reads as the text None, which a query may be part of
        score = score + F.coalesce(F.size(F.filter(F.map_values("metadata"), lambda v: text.contains(F.coalesce(v, F.lit("None")), query))) * 1.0, F.lit(0.0))
    return score


def search_library(library: DataFrame, query: str | None = None, limit: int = 20, order: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Documents by weighted keyword score, best first, ties in the library's order, with the number of all matches. Without a query all score 1."""
    scored = library.withColumn("score", library_score(query, library.columns) if query else F.lit(1.0)).where("score > 0")
    return _page(scored, limit, list(order))


def search_text(documents: DataFrame, sections: DataFrame, query: str, scope: str = "all", limit: int = 20) -> DataFrame:
    """Hits in full texts (score 1) and in sections (2 for the title and 1.5 for the text), best first, with snippets and the number of all hits.

    ``documents``: doc_id, text. ``sections``: doc_id, idx, sid, title, text.
    """
    query = query.strip()
    if not query or scope not in ("all", "full", "section"):
        raise ValueError("a query and a scope of all, full or section are needed")
    hits = []
    if scope in ("all", "full"):
        full = documents.where(text.contains(F.col("text"), query))
        hits.append(full.select("doc_id", F.lit(-1).alias("idx"), F.lit(None).cast("string").alias("sid"), F.lit(None).cast("string").alias("section_title"), F.lit(1.0).alias("score"), text.snippet(F.col("text"), query).alias("snippet")))
    if scope in ("all", "section"):
        hits.append(_section_hits(sections, query, False).select("doc_id", "idx", "sid", F.col("title").alias("section_title"), "score", "snippet"))
    both = hits[0] if len(hits) == 1 else hits[0].unionByName(hits[1])
    return _page(both, limit, ["doc_id", "idx"])


def _section_hits(sections: DataFrame, query: str, case_sensitive: bool) -> DataFrame:
    in_title, in_text = text.contains(F.col("title"), query, case_sensitive), text.contains(F.col("text"), query, case_sensitive)
    score = F.when(in_title, 2.0).otherwise(0.0) + F.when(in_text, 1.5).otherwise(0.0)
    return sections.withColumn("score", score).where("score > 0").withColumn("snippet", text.snippet(F.when(in_text, F.col("text")).otherwise(F.col("title")), query))


def search_sections(sections: DataFrame, doc_id: object, query: str, case_sensitive: bool = False, limit: int = 20) -> DataFrame:
    """Sections of one document that have the query in title or text, best first, with the number of all. The document is a filter that reaches the scan."""
    hits = _section_hits(sections.where(F.col("doc_id") == doc_id), query.strip(), case_sensitive)
    return _page(hits, limit, ["idx"])


def search_sections_by_document(sections: DataFrame, query: str, case_sensitive: bool = False, limit: int = 20) -> DataFrame:
    """``search_sections`` for every document at once: its best sections by place, and the number of its hits."""
    hits = _section_hits(sections, query.strip(), case_sensitive)
    document = Window.partitionBy("doc_id")
    placed = hits.withColumn("place", F.row_number().over(document.orderBy(F.col("score").desc(), "idx"))).withColumn("total", F.count(F.lit(1)).over(document))
    return placed.where(F.col("place") <= clamp(limit))


def postings(documents: DataFrame, key: str = "doc_id", body: str = "text") -> DataFrame:
    """The words of all documents with their places: the table that phrase searches join. Build it once, partitioned by token where it is stored."""
    return documents.select(key, F.posexplode(text.word_tokens(F.col(body))).alias("pos", "token"))


def phrase_words(phrase: str) -> list[str]:
    return [w for w in re.split(r"[\W_]+", phrase.lower()) if w]


def phrase_search(index: DataFrame, phrase: str, key: str = "doc_id") -> DataFrame:
    """Documents that have the words of the phrase next to each other, and how often.

    Each word's postings are shifted to where the phrase would begin, and a place at which all words meet is a hit; one
    aggregation, whatever the phrase's length.
    """
    words = phrase_words(phrase)
    offset = F.create_map(*(F.lit(v) for w in dict.fromkeys(words) for v in (w, ",".join(str(i) for i, x in enumerate(words) if x == w))))
    starts = index.where(F.col("token").isin(words)).select(key, F.col("pos"), F.explode(F.transform(F.split(F.element_at(offset, F.col("token")), ","), lambda i: i.cast("int"))).alias("at"))
    met = starts.groupBy(key, (F.col("pos") - F.col("at")).alias("start")).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") == len(words))
    return met.groupBy(key).agg(F.count(F.lit(1)).alias("hits"), F.min("start").alias("first_start"))


def batch_lookup(sections: DataFrame, wanted: DataFrame, keys: list[str]) -> DataFrame:
    """The wanted rows that exist, in the order they are asked for; ``wanted`` has the keys and a position, of which the first counts."""
    first = wanted.groupBy(*keys).agg(F.min("position").alias("position"))
    return first.join(sections, keys).orderBy("position")


def batch_missing(sections: DataFrame, wanted: DataFrame, keys: list[str]) -> DataFrame:
    return wanted.groupBy(*keys).agg(F.min("position").alias("position")).join(sections, keys, "left_anti").orderBy("position")


def normalised_number(identifier: Column, prefix: str, width: int = 2) -> Column:
    """An id such as table-01 from 1, 01 or table-1; null for anything else."""
    n = F.regexp_extract(identifier, rf"^(?:{prefix}-)?([0-9]+)$", 1)
    return F.when(n != "", F.concat(F.lit(f"{prefix}-"), F.lpad(n.cast("int").cast("string"), width, "0")))
