"""Answers of web search providers as one table of hits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.stateful import error_class

# Where each provider's answer has its hits, and what it names their fields (title, url, snippet, date, score).
PROVIDERS = {
    "searxng": ("$.results", ("title", "url", "content", "publishedDate", "score")),
    "tavily": ("$.results", ("title", "url", "content", "published_date", "score")),
    "bocha": ("$.data.webPages.value", ("name", "url", "snippet", "datePublished", None)),
    "brave": ("$.web.results", ("title", "url", "description", "page_age", None)),
}
RESULTS = (1, 20)


def _hits(body: Column, place: str, names: tuple) -> Column:
    fields = [n for n in names if n]
    items = F.from_json(F.get_json_object(body, place), "array<struct<" + ",".join(f"`{n}`:string" for n in fields) + ">>")
    value = lambda x, n: x[n] if n else F.lit(None).cast("string")
    made = lambda x: F.struct(*(value(x, n).alias(k) for n, k in zip(names, ("title", "url", "snippet", "published_at", "score"), strict=True)))
    return F.transform(items, made)


def outcome(provider: Column, status: Column, body: Column) -> Column:
    """What an answer means: ok, empty, rejected, rate_limited or unavailable. One provider reports errors in a body that came well."""
    inner = F.get_json_object(body, "$.code").cast("int")
    return F.when((provider == "bocha") & inner.isNotNull() & (inner != 200), error_class(inner)).otherwise(error_class(status))


def hits(answers: DataFrame, most: int = 10) -> DataFrame:
    """Hits of each query's first provider, in priority, whose answer decides: query, provider, rank, title, url, snippet, published_at, score.

    ``answers``: query, provider, priority, status, body (JSON). A rejected or empty answer ends the chain; others fall through to the
    next. Hits without URL are left out, and the rest are numbered up to the limit.
    """
    most = max(RESULTS[0], min(most, RESULTS[1]))
    parsed = F.lit(None).cast("array<struct<title:string,url:string,snippet:string,published_at:string,score:string>>")
    for provider, (place, names) in PROVIDERS.items():
        parsed = F.when(F.col("provider") == provider, _hits(F.col("body"), place, names)).otherwise(parsed)
    judged = answers.withColumn("outcome", outcome(F.col("provider"), F.col("status"), F.col("body"))).withColumn("hits", F.coalesce(parsed, F.array().cast("array<struct<title:string,url:string,snippet:string,published_at:string,score:string>>")))
    final = F.col("outcome").isin("ok", "rejected", "empty")
    first = judged.where(final).withColumn("_place", F.row_number().over(Window.partitionBy("query").orderBy("priority"))).where("_place = 1 and outcome = 'ok'")
    good = F.slice(F.filter("hits", lambda h: F.coalesce(h["url"], F.lit("")) != ""), 1, most)
    rows = first.select("query", "provider", F.posexplode(good).alias("rank", "h"))
    return rows.select("query", "provider", (F.col("rank") + 1).alias("rank"), "h.title", "h.url", "h.snippet", "h.published_at", F.expr("try_cast(h.score as double)").alias("score"))


def locale(language: Column, bare: bool) -> Column:
    """A language tag as a provider takes it: whole, or without its region."""
    return F.regexp_extract(language, "^([A-Za-z]+)", 1) if bare else language
