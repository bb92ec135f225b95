"""Documents split into sections by their headings, with windows over their lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import text
from tessera.operators import tables
from tessera.storage import spread

# Lines that are headings, and the level of each kind.
HEADINGS = (
    (r"^第[一二三四五六七八九十\d]+[章节部分篇]\s*[、:：]?\s*.+", 1),
    (r"^[（(]?[一二三四五六七八九十]+[）)]?[、.．]\s*.+", 1),
    (r"^\d{1,2}\s*[-－]\s*\d{1,2}\s*(?![-\d])\S.{1,}", 2),
    (r"^\d+(\.\d+)*[.、．)\s]\s*.{2,}", 2),
    (r"^(?=.{8,60}$)[A-Z][A-Za-z0-9/&()'-]*(?: [A-Z][A-Za-z0-9/&()'-]*){0,5}$", 2),
    (r"^[A-Z][A-Z\s]{5,}$", 2),
    (r"^(摘要|目录|引言|绪论|前言|导论|背景|概述|总结|结论|致谢|参考文献|附录|附件)$", 2),
)
# Lines that look like numbered headings and are none.
NOT_HEADINGS = (
    r"^[0-9][0-9\s-]{5,}[0-9]$",
    r"^\d{4}年\d{1,2}月",
    r"^\d+(?:[,.，]\d+)*(?:\.\d+)?(?:元|月|年|日|个|%|％|探针)",
    r"^[￥¥]\d+",
    r"^\|.*\|$",
)
#: Sections shorter than this are short; documents with this share of them have theirs joined.
SHORT, SHORT_SHARE = 80, 0.35
#: Pages of a task: the windows over their lines hold so much at once, however large the table is.
PAGES = 5_000
CHAPTER = r"^第[一二三四五六七八九十\d]+[章节部分篇]\s*[、:：]?\s*\S"


# The characters that may stand between a heading's number and its title, and how long a title is at most before it reads as running text:
# after a number of two parts (with a stop inside, and at all), after a number and an ideographic comma, after any other mark.
_MARKS = ".、．)）"
TITLE_WITH_STOP, TITLE_OF_TWO, TITLE_AFTER_COMMA, TITLE_OF_ONE = 12, 48, 12, 24


def numbered_level(t: Column) -> Column:
    """Level of a line without markup by a number such as 1. or 1.2: 1 or 2, -1 where the line is too long or too deep for a heading, 0 without a number."""
    title = lambda number: F.regexp_extract(t, rf"^{number}\s*(.{{2,}})$", 1)
    pair, single = title(rf"\d{{1,2}}\.\d{{1,2}}[{_MARKS}\s]*"), title(rf"\d{{1,2}}[{_MARKS}]")
    stopped = pair.rlike("[。；;]$") | (pair.rlike("[，。；;]") & (F.length(pair) > TITLE_WITH_STOP))
    comma = t.rlike(r"^\d{1,2}、")
    most = F.when(comma, TITLE_AFTER_COMMA).otherwise(TITLE_OF_ONE)
    of_pair = F.when(stopped | (F.length(pair) > TITLE_OF_TWO), -1).otherwise(2)
    of_single = F.when(F.length(single) > most, -1).when(comma, 2).otherwise(1)
    return F.when(t.rlike(rf"^\d{{1,2}}(\.\d{{1,2}}){{2,}}([{_MARKS}\s]|$)"), -1).when(pair != "", of_pair).when(single != "", of_single).otherwise(0)


def with_levels(lines: DataFrame, line: str = "t") -> DataFrame:
    """Adds level: that of a line as a heading, 0 for running text and for rows of tables. The steps are columns of their own, so that no expression is evaluated twice."""
    t = F.col("_plain")
    never = (t == "") | (F.length(t) > 100) | t.rlike("|".join(f"(?:{p})" for p in NOT_HEADINGS)) | text.polluted_heading(t) | tables.priced_row(t) | tables.barred_row(t)
    first = "|".join(f"(?:{p})" for p, level in HEADINGS if level == 1)
    second = "|".join(f"(?:{p})" for p, level in HEADINGS if level == 2)
    out = lines.withColumn("_plain", text.plain_heading(F.col(line))).withColumn("_number", numbered_level(t)).withColumn("_never", never)
    named = F.when(t.rlike(first), 1).when(t.rlike(second), 2).otherwise(0)
    return out.withColumn("level", F.when(F.col("_never") | (F.col("_number") < 0), 0).when(F.col("_number") > 0, F.col("_number")).otherwise(named)).drop("_number", "_never")


# What scanned pages of one publisher carry in their margins, which is no heading; words that head a table of contents.
CHROME = ("GF FUTURES", "GFF", "FUTURES", "TINGYUN.COM", "UTURE", "LF", "FUTURE", "GFFUTURES", "GFFUTURE", "GF FUTURE")
CONTENTS = ("目录", "目次")
# Clauses by Chinese and by Arabic numbers, as they are counted to tell which of them a contract is divided by.
FORMAL = rf"(?:{HEADINGS[0][0]})|(?:{HEADINGS[1][0]})"
ARABIC = r"^\d{1,2}(?:\.\d{1,2})?[.、．)）\s]\s*.{2,}"
#: Share of scanned pages from which a document counts as scanned; first pages that are looked at for clauses; characters of a line that is looked at; clauses that show a formal contract.
SCANNED_SHARE, FORMAL_PAGES, FORMAL_CHARS, FORMAL_LEAST = 0.8, 5, 120, 4


def _formal(lines: DataFrame, key: str, least: int) -> DataFrame:
    """Adds _formal: whether the document's first pages have Chinese clause headings enough, and as many Arabic ones, which then are not headings."""
    page = F.size(F.collect_set(F.when(F.col("_solid"), F.col("page_num"))).over(Window.partitionBy(key).orderBy("page_num")))
    first = (page <= FORMAL_PAGES) & F.col("_solid") & (F.length("_plain") <= FORMAL_CHARS)
    of = lambda c: F.sum((F.col("_first") & c).cast("int")).over(Window.partitionBy(key))
    counted = lines.withColumn("_first", first)
    formal, arabic = of(F.col("_plain").rlike(FORMAL)), of(F.col("_plain").rlike(ARABIC))
    return counted.withColumn("_formal", (formal >= least) & (arabic >= formal)).drop("_first")


def _contents_end(lines: DataFrame, key: str) -> DataFrame:
    """Adds _front: whether a line of a one-page document is before the second place of the heading that comes first after the words "table of contents"."""
    document = Window.partitionBy(key)
    name = text.heading_key(F.col("_plain"))
    step = lines.withColumn("_name", name).withColumn("_toc", F.min(F.when(F.col("_name").isin(*CONTENTS), F.col("_at"))).over(document))
    step = step.withColumn("_entry", F.min(F.when((F.col("_at") > F.col("_toc")) & (F.col("level") > 0), F.col("_at"))).over(document))
    step = step.withColumn("_entry_name", F.max(F.when(F.col("_at") == F.col("_entry"), F.col("_name"))).over(document))
    step = step.withColumn("_body", F.min(F.when((F.col("_at") > F.col("_entry")) & (F.col("_name") == F.col("_entry_name")), F.col("_at"))).over(document))
    return step.withColumn("_front", F.coalesce((F.col("_pages") == 1) & (F.col("_at") < F.col("_body")), F.lit(False))).drop("_name", "_toc", "_entry", "_entry_name", "_body")


def sections(pages: DataFrame, key: str = "doc_id", first_title: str = "Preface", formal: bool = False, formal_least: int = FORMAL_LEAST) -> DataFrame:
    """Sections of documents given as pages (key, page_num, text and perhaps is_ocr): key, idx, title, level, text, page_start, page_end.

    Where Markdown headings occur, those of the shallowest level in the document split it, and deeper ones and lines that begin with a number or
    look like a name are text; in other documents numbered and named headings do. In documents of which four fifths of the pages are scanned (``is_ocr``) Markdown and margins count for
    nothing, and clauses below the top level are text. With ``formal``, contracts by Chinese clauses are not split at Arabic numbers. A heading right
    after a heading is text, as nothing is under the first. What comes before the first heading is a section of its own, and so is the table of contents
    of a one-page document. A document of one section on several pages is split by page; one without any text is one section
    "Full document". Headings, parts and page spans are windows over the lines of a document, so no document passes through Python.
    """
    scanned = F.coalesce(F.col("is_ocr").cast("boolean"), F.lit(False)) if "is_ocr" in pages.columns else F.lit(False)
    document = Window.partitionBy(key)
    rows = spread(pages.select(key, "page_num", "text", scanned.alias("_ocr")), PAGES, key)
    counted = rows.withColumns({"_pages": F.count(F.lit(1)).over(document), "_scan": F.avg(F.col("_ocr").cast("double")).over(document) >= SCANNED_SHARE, "_last": F.max("page_num").over(document)})
    split = counted.select(key, "page_num", "_pages", "_scan", "_last", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("line", "raw"))
    order = Window.partitionBy(key).orderBy("page_num", "line")
    # Empty lines stay, at level 0 and outside all counts: a document split by page has them in its text.
    lines = split.withColumn("t", text.strip(F.col("raw"))).withColumn("_solid", F.col("t") != "").withColumn("_at", F.row_number().over(order))
    levelled = _contents_end(with_levels(lines), key)
    if formal:
        levelled = _formal(levelled, key, formal_least)
        levelled = levelled.withColumn("level", F.when(F.col("_formal") & ~F.col("_scan") & F.col("_plain").rlike(ARABIC), 0).otherwise(F.col("level"))).drop("_formal")
    margin = F.upper(text.collapse(F.col("_plain"))).isin(*CHROME) | ((numbered_level(F.col("_plain")) == 0) & F.col("_plain").rlike(r"^\d+\.\d+"))
    unscanned = F.when(F.col("_scan") & margin, 0).otherwise(F.col("level"))
    signs = levelled.withColumn("level", unscanned).withColumn("md", F.when(~F.col("_scan") & ~F.col("_front"), text.markdown_level(F.col("t"))))
    least = signs.withColumn("_least", F.min("md").over(document))
    marked = F.when(F.col("md").isNotNull(), F.when((F.col("md") == F.col("_least")) & ~text.polluted_heading(F.col("_plain")), F.col("md")).otherwise(0)).when(F.col("_least").isNotNull(), 0).otherwise(F.col("level"))
    headed = least.withColumn("level", F.when(F.col("_front"), 0).otherwise(marked))
    # Of headings one after another every second one is text: nothing is under the one before it.
    heading = F.col("level") > 0
    runs = headed.withColumn("_run", F.sum((~heading & F.col("_solid")).cast("int")).over(order)).withColumn("_nth", F.sum(heading.cast("int")).over(Window.partitionBy(key, "_run").orderBy("page_num", "line")))
    once = runs.withColumn("level", F.when(heading & (F.col("_nth") % 2 == 0), 0).otherwise(F.col("level")))
    grouped = once.withColumn("_group", F.when(F.col("_front"), -1).otherwise(F.sum(heading.cast("int")).over(order)))
    solid = lambda c: F.when(F.col("_solid"), c)
    placed = grouped.withColumns({"_lowest": F.min(solid(F.col("_group"))).over(document), "_highest": F.max(solid(F.col("_group"))).over(document), "_to": F.max(solid(F.col("page_num"))).over(document)})
    blank = F.col("_lowest").isNull()
    by_page = F.coalesce((F.col("_lowest") == F.col("_highest")) & (F.col("_pages") > 1) & (F.col("_to") > 1), F.lit(False))
    kinds = placed.withColumns({"_blank": blank, "_by_page": by_page}).withColumn("_group", F.when(by_page, F.col("page_num").cast("long")).when(blank, 0).otherwise(F.col("_group")))
    head = lambda c: F.max(F.when(F.col("level") > 0, c))
    body = F.when(F.col("_by_page"), F.struct("_at", F.col("raw").alias("t"))).when(F.col("_solid") & (F.col("level") == 0), F.struct("_at", "t"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(body)), lambda x: x["t"]), "\n")
    made = kinds.groupBy(key, "_group").agg(
        F.coalesce(head(F.col("_plain")), F.when(F.max("_front"), "Preface / TOC").otherwise(first_title)).alias("title"), F.coalesce(head(F.col("level")), F.lit(1)).alias("level"), joined.alias("text"),
        F.min(solid(F.col("page_num"))).alias("page_start"), F.max(solid(F.col("page_num"))).alias("page_end"), F.max("_last").alias("_last"), F.max("_by_page").alias("_by_page"), F.max("_blank").alias("_blank"),
    )
    first_page = F.lit(1).cast(pages.schema["page_num"].dataType)
    whole = made.where(F.col("_blank") | F.col("page_start").isNotNull()).select(
        key, "_group", F.when(F.col("_blank"), "Full document").when(F.col("_by_page"), F.concat(F.lit("Page "), F.col("page_start").cast("string"))).otherwise(F.col("title")).alias("title"),
        F.when(F.col("_blank") | F.col("_by_page"), 1).otherwise(F.col("level")).alias("level"), F.when(F.col("_blank"), "").when(F.col("_by_page"), text.strip(F.col("text"))).otherwise(F.col("text")).alias("text"),
        F.when(F.col("_blank"), first_page).otherwise(F.col("page_start")).alias("page_start"), F.when(F.col("_blank"), F.col("_last")).otherwise(F.col("page_end")).alias("page_end"),
    )
    return _numbered(whole, key, "_group")


def _numbered(made: DataFrame, key: str, order: str) -> DataFrame:
    return made.select(key, F.row_number().over(Window.partitionBy(key).orderBy(order)).alias("idx"), "title", "level", "text", "page_start", "page_end")


def _joined(parts: DataFrame, into_previous: Column, key: str) -> DataFrame:
    """Sections for which the condition holds become text of the nearest one before for which it does not, title first."""
    order = Window.partitionBy(key).orderBy("idx")
    marked = parts.withColumn("_join", into_previous & (F.row_number().over(order) > 1))
    runs = marked.withColumn("_run", F.sum((~F.col("_join")).cast("int")).over(order))
    piece = F.when(F.col("_join"), F.concat_ws("\n", F.when(text.strip(F.col("title")) != "", text.strip(F.col("title"))), F.when(text.strip(F.col("text")) != "", text.strip(F.col("text"))))).otherwise(text.rstrip(F.col("text")))
    body = F.array_join(F.filter(F.transform(F.array_sort(F.collect_list(F.struct("idx", piece.alias("p")))), lambda x: x["p"]), lambda p: p != ""), "\n")
    made = runs.groupBy(key, "_run").agg(F.min_by("title", "idx").alias("title"), F.min_by("level", "idx").alias("level"), body.alias("text"), F.min("page_start").alias("page_start"), F.max("page_end").alias("page_end"))
    return _numbered(made, key, "_run")


def merge_short(parts: DataFrame, key: str = "doc_id", short: int = SHORT) -> DataFrame:
    """In documents of which 35 % of the sections or more are short, short sections below level 1 become text of the one before."""
    size = F.length(text.strip(F.col("text")))
    share = F.avg((size < short).cast("int")).over(Window.partitionBy(key))
    marked = parts.withColumn("_short", (size < short) & (F.col("level") > 1) & (share >= SHORT_SHARE))
    return _joined(marked, F.col("_short"), key)


def merge_short_scanned(parts: DataFrame, key: str = "doc_id", short: int = 20) -> DataFrame:
    """Of scanned documents: sections of fewer characters become text of the one before, whatever their level."""
    return _joined(parts, F.length(text.strip(F.col("text"))) < short, key)


def _prefix(t: Column) -> Column:
    return F.regexp_extract(t, r"^(\d{1,2})", 1)


def promote_children(parts: DataFrame) -> DataFrame:
    """Top-level numbered sections whose first line is a numbered heading of theirs take its title and level, with their own title as first line."""
    first = F.regexp_extract("text", r"^\s*([^\n]*)", 1)
    leading = parts.withColumn("_first", text.strip(first))
    child = (numbered_level(text.plain_heading(F.col("title"))) == 1) & (numbered_level(text.plain_heading(F.col("_first"))) == 2) & (_prefix(F.col("title")) == _prefix(F.col("_first")))
    out = leading.withColumn("_child", child).withColumn("text", F.when(F.col("_child"), text.strip(F.concat("title", F.lit("\n"), "text"))).otherwise(F.col("text")))
    return out.withColumns({"title": F.when(F.col("_child"), F.col("_first")).otherwise(F.col("title")), "level": F.when(F.col("_child"), 2).otherwise(F.col("level"))}).drop("_first", "_child")


def merge_stubs(parts: DataFrame, key: str = "doc_id", most: int = 30) -> DataFrame:
    """Sections without text, or with a single line that is another chapter's title, become text of the one before."""
    body = text.strip(F.col("text"))
    stub = (F.length(body) <= most) & ((body == "") | (~F.contains(body, F.lit("\n")) & body.rlike(CHAPTER)))
    return _joined(parts, stub, key)


def with_ids(parts: DataFrame, key: str = "doc_id") -> DataFrame:
    """Adds sid, char_count, token_estimate and text_hash."""
    return parts.withColumns({"sid": text.section_id(F.col("title"), F.col("text")), "char_count": F.length("text"), "token_estimate": text.token_estimate(F.col("text")), "text_hash": text.text_hash(F.col("text"))})


def toc_boundaries(toc: DataFrame, deepest: int = 2, key: str = "doc_id") -> DataFrame:
    """Entries of a table of contents up to a level, each page and title once, with the chapter above and the page before the next entry (null for the last).

    ``toc``: key, ord, level, title, page. Result: key, idx, title, level, parent, page_start, page_end.
    """
    order = Window.partitionBy(key).orderBy("ord")
    kept = toc.where(F.col("level") <= deepest).withColumn("_key", text.heading_key(F.col("title")))
    once = kept.withColumn("_nth", F.row_number().over(Window.partitionBy(key, "page", "_key").orderBy("ord"))).where("_nth = 1")
    above = F.last(F.when(F.col("level") == 1, F.col("title")), ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0))
    following = F.lead("page").over(order)
    return once.select(key, F.row_number().over(order).alias("idx"), "title", "level", F.when(F.col("level") > 1, above).alias("parent"), F.col("page").alias("page_start"), F.when(following.isNotNull(), F.greatest(F.col("page"), following - 1)).alias("page_end"))


def toc_prepared(toc: DataFrame, deepest: int = 2, key: str = "doc_id") -> DataFrame:
    """Entries of a table of contents that sections begin at: key, ord, level, title, page, parent.

    Chapters (level 1) are no boundaries where deeper entries are kept: each is the parent of the entries that have its number. Of entries of one page
    and title the first counts. ``toc``: key, ord, level, title, page.
    """
    named = toc.withColumn("title", text.strip(F.col("title"))).where("title <> ''")
    chapter = F.when(F.lit(deepest > 1) & (F.col("level") == 1), F.regexp_extract("title", r"^(\d{1,2})(?:[.、．)]|\s)", 1)).otherwise(F.regexp_extract("title", r"^(\d{1,2})\.\d{1,2}", 1))
    order = Window.partitionBy(key, "_chapter").orderBy("ord").rowsBetween(Window.unboundedPreceding, 0)
    parent = F.last(F.when(F.lit(deepest > 1) & (F.col("level") == 1), F.col("title")), ignorenulls=True).over(order)
    placed = named.withColumn("_chapter", F.when(chapter != "", chapter)).withColumn("parent", F.when(F.col("_chapter").isNotNull(), parent))
    kept = placed.where((F.col("level") <= deepest) & ((F.col("level") > 1) | F.lit(deepest == 1))).withColumn("_key", text.heading_key(F.col("title")))
    nth = F.row_number().over(Window.partitionBy(key, "page", "_key").orderBy("ord"))
    return kept.withColumn("_nth", nth).where("_nth = 1").select(key, "ord", "level", "title", "page", "parent")


def toc_compacted(toc: DataFrame, deepest: int = 2, key: str = "doc_id") -> DataFrame:
    """One entry for each page: a chapter gives way to its first part on the same page, and of others the first counts."""
    following = F.lead(F.struct("level", "page")).over(Window.partitionBy(key).orderBy("ord"))
    shown = toc.withColumn("_next", following).where(F.col("level") <= deepest)
    kept = shown.where(~F.coalesce((F.col("level") == 1) & (F.col("_next.level") == 2) & (F.col("_next.page") == F.col("page")), F.lit(False)))
    nth = F.row_number().over(Window.partitionBy(key, "page").orderBy("ord"))
    return kept.withColumn("_nth", nth).where("_nth = 1").select(key, "ord", "level", "title", "page", F.lit(None).cast("string").alias("parent"))


def boundaries(toc: DataFrame, deepest: int = 2, key: str = "doc_id") -> DataFrame:
    """The entries that a document is split at: the prepared ones if there are two or more; else one a page where entries crowd a page, and else all up to the level. Documents with fewer than two have none."""
    document = Window.partitionBy(key)
    counted = lambda df: df.withColumn("_n", F.count(F.lit(1)).over(document)).where("_n >= 2").drop("_n")
    first = counted(toc_prepared(toc, deepest, key))
    rest = toc.join(first.select(key).distinct(), key, "left_anti")
    crowded = rest.where("level <= 2").groupBy(key, "page").count().where("count > 1").select(key).distinct()
    dense = counted(toc_compacted(rest.join(crowded, key, "left_semi"), deepest, key))
    plain = counted(rest.join(crowded, key, "left_anti").where(F.col("level") <= deepest).select(key, "ord", "level", "title", "page", F.lit(None).cast("string").alias("parent")))
    return first.unionByName(dense).unionByName(plain)


def sections_from_toc(pages: DataFrame, toc: DataFrame, deepest: int = 2, key: str = "doc_id") -> DataFrame:
    """Sections of paged documents by their tables of contents: key, idx, title, level, text, page_start, page_end; documents without a usable one are split by ``sections``.

    An entry begins at the first line of its page that has its title, or at the page's top; lines belong to the last entry that begins
    before them. Lines meet entries by page and title only, and the rest is a window over both in order.
    """
    at = boundaries(toc, deepest, key).select(key, "ord", "level", F.col("title").alias("entry"), F.col("page").alias("page_num"), "parent", text.heading_key(F.col("title")).alias("_wanted"))
    split = spread(pages.select(key, "page_num", "text"), PAGES).join(at.select(key).distinct(), key, "left_semi").select(key, "page_num", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("line", "raw"))
    lines = split.select(key, "page_num", "line", text.strip(F.col("raw")).alias("t")).where("t <> ''")
    named = lines.withColumn("_name", text.heading_key(F.col("t"))).where("_name <> ''")
    fits = (F.col("_name") == F.col("_wanted")) | F.startswith(F.col("_name"), F.col("_wanted")) | F.startswith(F.col("_wanted"), F.col("_name"))
    start = named.join(at, [key, "page_num"]).where(fits).groupBy(key, "ord").agg(F.min("line").alias("_line"))
    begins = at.join(start, [key, "ord"], "left").select(key, "page_num", F.coalesce("_line", F.lit(0)).alias("line"), F.lit(0).alias("_kind"), "ord", F.struct("ord", "level", "entry", "parent").alias("_entry"), F.lit(None).cast("string").alias("t"))
    body = lines.select(key, "page_num", "line", F.lit(1).alias("_kind"), F.lit(0).alias("ord"), F.lit(None).cast(begins.schema["_entry"].dataType).alias("_entry"), "t")
    order = Window.partitionBy(key).orderBy("page_num", "line", "_kind", "ord")
    held = begins.withColumn("ord", F.col("ord").cast("long")).unionByName(body.withColumn("ord", F.col("ord").cast("long")))
    # As many tasks as the pages need, by the document, which the windows and groups after it keep.
    tasks = -(-pages.count() // PAGES)
    held = held.repartition(tasks, key) if tasks > 1 else held
    held = held.withColumn("_in", F.last("_entry", ignorenulls=True).over(order)).where("_kind = 1")
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page_num", "line", "t"))), lambda x: x["t"]), "\n")
    made = held.groupBy(key, F.coalesce(F.col("_in.ord").cast("long"), F.lit(-1)).alias("_group")).agg(F.first("_in").alias("_in"), joined.alias("text"), F.min("page_num").alias("page_start"), F.max("page_num").alias("page_end"))
    told = F.contains(text.heading_key(F.substring("text", 1, 200)), text.heading_key(F.coalesce(F.col("_in.parent"), F.lit(""))))
    full = F.when(F.col("_in.parent").isNotNull() & ~told, F.concat(F.col("_in.parent"), F.lit("\n"), F.col("text"))).otherwise(F.col("text"))
    cut = made.select(key, "_group", F.coalesce("_in.entry", F.lit("Preface / TOC")).alias("title"), F.least(F.coalesce("_in.level", F.lit(1)), F.lit(3)).alias("level"), full.alias("text"), "page_start", "page_end")
    several = cut.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(key))).where("_n >= 2").drop("_n")
    rest = sections(pages.join(several.select(key).distinct(), key, "left_anti"), key)
    return _numbered(several, key, "_group").unionByName(rest)
