"""Tables in texts: Markdown blocks, their size, numbers by column, pages, continuation."""

from __future__ import annotations

import re
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import text
from tessera.shipping import ship
from tessera.storage import spread

#: A separator row: every cell is dashes, with a colon at either end perhaps.
SEPARATOR = r"^\|(\s*:?-+:?\s*\|)+$"
#: A row that some cell of which has no dash also separates when only the size is asked for.
LOOSE_SEPARATOR = r"^\|[\s\-:|]+\|$"
ROW = r"^\|.*\|$"
#: Texts of a task: the windows over their lines hold so much at once, however large the table is.
TEXTS = 2_000
_FENCE = re.compile("^(`{3}|~{3})")


def _outside_code(body: str) -> list[bool]:
    """For each line whether it is outside fenced and indented code. Only the kind of fence that opened a block closes it."""
    out, fence = [], None
    for line in body.split("\n"):
        mark = _FENCE.match(line.strip())
        indented = fence is None and line.startswith(("    ", "\t"))
        if mark and not indented:
            fence = mark[1] if fence is None else None if mark[1] == fence else fence
        out.append(not indented and not mark and fence is None)
    return out


def lines(documents: DataFrame, key: str = "doc_id", body: str = "text") -> DataFrame:
    """A row for each line: key, line (from 0), raw, text (without white space at the ends), plain (outside code)."""
    ship(documents.sparkSession)

    def plain(bodies: pd.Series) -> pd.Series:
        return bodies.map(_outside_code)

    clean = documents.select(key, F.regexp_replace(F.coalesce(body, F.lit("")), "\r\n|\r", "\n").alias("_body"))
    fenced = F.when(F.col("_body").rlike("(?m)^\\s*(```|~~~)|^( {4}|\t)"), F.pandas_udf(plain, "array<boolean>")("_body"))
    # Flags and lines are zipped before they become rows, or each line would carry all its document's flags.
    both = clean.withColumn("_lines", F.split("_body", "\n")).withColumn("_plain", fenced)
    zipped = F.arrays_zip(F.col("_lines").alias("raw"), F.coalesce("_plain", F.array_repeat(F.lit(True), F.size("_lines"))).alias("plain"))
    split = both.select(key, F.posexplode(zipped).alias("line", "x")).select(key, "line", "x.raw", "x.plain")
    return split.select(key, "line", "raw", text.strip(F.col("raw")).alias("text"), "plain")


def markdown_tables(documents: DataFrame, key: str = "doc_id", body: str = "text") -> DataFrame:
    """Markdown tables: key, idx (from 1), first_line, last_line, markdown.

    A table is a run of lines in bars, outside code, around a separator, of three lines or more. Where a second separator
    follows in the run, the next table begins with the row before it. Runs and tables are windows over the lines of a document.
    """
    doc = Window.partitionBy(key).orderBy("line")
    row = F.col("plain") & F.col("text").rlike(ROW)
    marked = lines(spread(documents.select(key, body), TEXTS, key), key, body).withColumn("_row", row).withColumn("_sep", row & F.col("text").rlike(SEPARATOR))
    marked = marked.withColumn("_anchor", F.col("_sep") & ~F.coalesce(F.lag("_sep").over(doc), F.lit(False)))
    marked = marked.withColumn("_run", F.sum((~F.col("_row")).cast("int")).over(doc)).where("_row")
    run = Window.partitionBy(key, "_run").orderBy("line")
    ahead = F.sum(F.col("_anchor").cast("int")).over(run.rowsBetween(Window.unboundedPreceding, 1))
    blocks = marked.withColumn("_block", F.greatest(ahead, F.lit(1))).groupBy(key, "_run", "_block").agg(
        F.min("line").alias("first_line"), F.max("line").alias("last_line"), F.max("_anchor").alias("_table"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", "raw"))), lambda x: x["raw"]), "\n").alias("markdown"),
    )
    kept = blocks.where(F.col("_table") & (F.col("last_line") - F.col("first_line") >= 2))
    return kept.select(key, F.row_number().over(Window.partitionBy(key).orderBy("first_line")).alias("idx"), "first_line", "last_line", "markdown")


def _rows(markdown: Column) -> Column:
    return F.filter(F.transform(F.split(markdown, "\n"), text.strip), lambda line: F.startswith(line, F.lit("|")) & F.endswith(line, F.lit("|")))


def cells(row: Column) -> Column:
    """Texts of the cells of a row in bars."""
    return F.transform(F.split(F.regexp_replace(row, r"^\|+|\|+$", ""), r"\|", -1), text.strip)


def dimensions(markdown: Column) -> Column:
    """row_count (without separators), column_count and header_rows (1 where the second row separates) of a Markdown table, as a struct."""
    rows = _rows(markdown)
    loose = lambda r: F.contains(r, F.lit("-")) & r.rlike(LOOSE_SEPARATOR)
    content = F.filter(rows, lambda r: ~loose(r))
    width = F.coalesce(F.array_max(F.transform(content, lambda r: F.size(cells(r)))), F.lit(0))
    header = F.when(F.size(rows) > 1, loose(F.get(rows, F.lit(1))).cast("int")).otherwise(0)
    return F.struct(F.size(content).alias("row_count"), width.alias("column_count"), header.alias("header_rows"))


def table_count(body: Column) -> Column:
    """Number of separator rows in a text."""
    return F.regexp_count(body, F.lit(r"(?m)^\|[\s\-:|]+\|$"))


def render(rows: DataFrame, by: list[str], order: list[str], columns: dict[str, Column]) -> DataFrame:
    """A Markdown table for each group: a header of the columns' names, a separator, and the group's rows in order."""
    line = F.concat(F.lit("| "), F.concat_ws(" | ", *(F.replace(F.coalesce(c.cast("string"), F.lit("")), F.lit("|"), F.lit("¦")) for c in columns.values())), F.lit(" |"))
    head = "| " + " | ".join(columns) + " |\n|" + "---|" * len(columns)
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*order, line.alias("_line")))), lambda x: x["_line"]), "\n")
    return rows.groupBy(*by).agg(F.concat(F.lit(head + "\n"), body).alias("markdown"))


def markdown_cells(tables: DataFrame, by: list[str]) -> DataFrame:
    """A row for each cell of Markdown tables: the keys, row (the header is 0), col (from 0), value."""
    rows = F.filter(_rows(F.col("markdown")), lambda r: ~(F.contains(r, F.lit("-")) & r.rlike(LOOSE_SEPARATOR)))
    wide = tables.select(*by, F.posexplode(rows).alias("row", "_row"))
    return wide.select(*by, "row", F.posexplode(cells(F.col("_row"))).alias("col", "value"))


def number(cell: Column) -> Column:
    """The number in a cell without currency signs, percent signs, commas and blanks; null where anything else is left."""
    bare = F.regexp_replace(F.coalesce(cell, F.lit("")), r"(?U)[,$%¥€£\s]", "")
    return F.when(bare.rlike(r"^-?([0-9]+\.?[0-9]*|\.[0-9]+)$"), bare.cast("double"))


def column_stats(table_cells: DataFrame, by: list[str]) -> DataFrame:
    """Least, greatest and mean (two places, halves up) of columns that are mostly numbers, over all rows below the header.

    Only tables of more than three rows, and columns of which more than half of all rows, the header's counted, are numbers. Of columns of one name
    the last counts.
    """
    # One pass: names and sizes come with the sums, as cells are often made from texts.
    value = table_cells.withColumn("_number", F.when(F.col("row") > 0, number(F.col("value"))))
    head = F.col("row") == 0
    sums = value.groupBy(*by, "col").agg(F.min("_number").alias("min"), F.max("_number").alias("max"), F.avg("_number").alias("_avg"), F.count("_number").alias("count"), F.max("row").alias("_row"), F.max(F.when(head, F.col("value"))).alias("column"), F.max(head).alias("_named"))
    sized = sums.withColumn("_rows", F.max("_row").over(Window.partitionBy(*by)) + 1)
    kept = sized.where((F.col("_rows") > 3) & (F.col("count") > F.col("_rows") * 0.5) & F.col("_named"))
    last = kept.withColumn("_last", F.max("col").over(Window.partitionBy(*by, "column"))).where("col = _last")
    return last.select(*by, "column", "min", "max", (F.floor(F.round(F.col("_avg") * 100, 4) + 0.5) / 100).alias("avg"), "count")


def sections_with_tables(sections: DataFrame, tables: DataFrame, key: str = "doc_id") -> DataFrame:
    """Each section with the ids of the tables whose pages overlap its own, in order. No references where a document has several sections and all of one span.

    Sections and tables meet by document, a key they share, and the overlap is a condition of that join.
    """
    spans = sections.where("page_start is not null and page_end is not null").groupBy(key).agg(F.count_distinct(F.struct("page_start", "page_end")).alias("_spans"))
    counted = sections.groupBy(key).agg(F.count(F.lit(1)).alias("_sections")).join(spans, key, "left")
    marked = sections.join(counted, key).withColumn("_flat", (F.col("_spans") == 1) & (F.col("_sections") > 1))
    right = tables.select(F.col(key).alias("_key"), "table_id", F.col("page_start").alias("_start"), F.col("page_end").alias("_end"))
    overlap = (F.col(key) == F.col("_key")) & ~F.coalesce("_flat", F.lit(False)) & (F.col("_start") <= F.col("page_end")) & (F.col("_end") >= F.col("page_start"))
    joined = marked.join(right, overlap, "left")
    return joined.groupBy(*sections.columns).agg(F.array_sort(F.collect_list("table_id")).alias("table_refs"))


def _same_header(left: Column, right: Column) -> Column:
    """Whether two first rows agree: as many cells, and two or more comparable ones of which at least 67 % are equal."""
    norm = lambda a: F.transform(a, lambda c: F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), r"(?U)\s+", ""))
    pairs = F.filter(F.arrays_zip(norm(left).alias("a"), norm(right).alias("b")), lambda p: (p["a"] != "") & (p["b"] != ""))
    equal = F.size(F.filter(pairs, lambda p: p["a"] == p["b"]))
    return (F.size(left) >= 2) & (F.size(left) == F.size(right)) & (F.size(pairs) >= 2) & (equal >= 2) & (equal / F.size(pairs) >= 0.67)


def continuation(tables: DataFrame, key: str = "doc_id") -> DataFrame:
    """Tables with continued_from and continued_to: the next table of the document goes on with one where it is on the next page, has as many columns (two or more), the same sides, and the same header or the place at the page's end and start.

    ``tables``: key, table_id, idx, page_start, page_end, column_count, bbox (x0, y0, x1, y1), page_height, header (array).
    """
    order = Window.partitionBy(key).orderBy("page_start", "idx")
    following = F.lead(F.struct("table_id", "page_start", "column_count", "bbox", "page_height", "header")).over(order)
    t, n = F.col, lambda c: F.col("_next")[c]
    width = lambda b: b["x1"] - b["x0"]
    a, b = t("bbox"), n("bbox")
    tolerance = F.greatest(F.lit(24.0), F.greatest(F.lit(1.0), F.least(width(a), width(b))) * 0.15)
    shared = F.greatest(F.lit(0.0), F.least(a["x1"], b["x1"]) - F.greatest(a["x0"], b["x0"]))
    ratio = F.when((width(a) > 0) & (width(b) > 0), shared / F.least(width(a), width(b))).otherwise(0.0)
    edge = (t("page_height") > 0) & (a["y1"] >= t("page_height") * 0.72) & (n("page_height") > 0) & (b["y0"] <= n("page_height") * 0.28)
    goes_on = (
        (n("page_start") == t("page_end") + 1) & (t("column_count") >= 2) & (t("column_count") == n("column_count"))
        & (F.abs(a["x0"] - b["x0"]) <= tolerance) & (F.abs(a["x1"] - b["x1"]) <= tolerance) & (ratio >= 0.75)
        & (_same_header(t("header"), n("header")) | edge)
    )
    linked = tables.withColumn("_next", following).withColumn("continued_to", F.when(F.coalesce(goes_on, F.lit(False)), F.col("_next")["table_id"]))
    before = F.lag(F.struct("table_id", "continued_to")).over(order)
    return linked.withColumn("_before", before).withColumn("continued_from", F.when(F.col("_before")["continued_to"] == F.col("table_id"), F.col("_before")["table_id"])).drop("_next", "_before")


# Words of which three head a priced table, those that end one, units that its rows have, and rows without a number.
PRICE_HEADS = ("序号", "名称", "售卖模式", "内容描述", "计价单位", "数量", "税率", "含税单价", "含税金额", "服务类型/服务项", "服务描述")
PRICE_FEET = ("小计", "合计", "大写人民币")
PRICE_UNITS = ("¥", "%", "套", "次", "年", "项", "个", "台", "PV")
PRICE_ROWS = ("软件产品", "服务中心")
#: Words that a head has at least; characters that a row has at least.
HEAD_WORDS, ROW_CHARS = 3, 20


def _has(line: Column, words: tuple[str, ...]) -> Column:
    return reduce(lambda a, w: a + F.contains(line, F.lit(w)).cast("int"), words, F.lit(0))


def priced_head(t: Column) -> Column:
    """Whether a line heads a priced table."""
    return (_has(t, PRICE_HEADS) >= HEAD_WORDS) | F.startswith(t, F.lit("序号 "))


def priced_row(t: Column) -> Column:
    """Whether a line without white space at its ends is a row, head or foot of a priced table in running text."""
    return priced_head(t) | (_has(t, PRICE_FEET) > 0) | (t.rlike(r"^[0-9]+\s+") & (F.length(t) >= ROW_CHARS) & (_has(t, PRICE_UNITS) > 0)) | t.isin(*PRICE_ROWS)


def barred_row(t: Column) -> Column:
    """Whether a line has cells in bars: two bars or more and something besides."""
    return (F.regexp_count(t, F.lit(r"\|")) >= 2) & (text.strip(F.regexp_replace(t, r"\|", "")) != "")


def scanned_tables(pages: DataFrame, key: str = "doc_id", page: str = "page_num") -> tuple[DataFrame, DataFrame]:
    """The tables in scanned pages' texts, and the pages without them: (key, page, idx, markdown) and (key, page, text).

    A table is a run of rows in bars from a row that a separator follows, of three lines or more, or a run of priced rows from a head on. The page's
    own number is no line at its foot. Runs are windows over the lines of a page.
    """
    total = F.count(F.lit(1)).over(Window.partitionBy(key))
    split = spread(pages.select(key, page, "text"), TEXTS, key).withColumn("_pages", total).select(key, page, "_pages", F.posexplode(F.split(F.regexp_replace(F.coalesce("text", F.lit("")), "\r\n|\r", "\n"), "\n")).alias("_raw_line", "_raw"))
    of_page = Window.partitionBy(key, page)
    order = of_page.orderBy("line")
    rows = split.withColumn("t", text.strip(F.col("_raw"))).where("t <> ''").withColumn("line", F.row_number().over(of_page.orderBy("_raw_line")))
    number = F.when(F.col("t").rlike("^[0-9]{1,9}$"), F.col("t").cast("long"))
    foot = number.between(F.greatest(F.lit(1), F.col(page) - 1), F.least(F.col(page) + 1, F.col("_pages"))) & (F.col("line") >= 3)
    tail = F.min(F.coalesce(foot, F.lit(False)).cast("int")).over(of_page.orderBy(F.col("line").desc()))
    rows = rows.withColumn("_tail", tail).where("_tail = 0")
    t = F.col("t")
    rule = t.rlike(r"^\|?(?:\s*:?-+:?\s*\|)+\s*:?-+:?\s*\|?$")
    marked = rows.withColumns({"_head": priced_head(t), "_priced": priced_row(t), "_bars": barred_row(t), "_rule": rule})
    marked = marked.withColumn("_begins", F.col("_bars") & F.coalesce(F.lead("_rule").over(order), F.lit(False)))
    run = lambda c: F.sum((~F.col(c)).cast("int")).over(order)
    marked = marked.withColumns({"_bar_run": run("_bars"), "_price_run": run("_priced")})
    since = lambda c, r: F.max(F.col(c).cast("int")).over(Window.partitionBy(key, page, r).orderBy("line")) == 1
    inside = marked.withColumns({"_md": F.col("_bars") & since("_begins", "_bar_run"), "_plain": F.col("_priced") & since("_head", "_price_run")})
    named = inside.withColumn("_table", F.when(F.col("_md"), F.concat(F.lit("m"), F.col("_bar_run").cast("string"))).when(F.col("_plain"), F.concat(F.lit("p"), F.col("_price_run").cast("string"))))
    size = F.count(F.lit(1)).over(Window.partitionBy(key, page, "_table"))
    whole = named.withColumn("_size", size).withColumn("_kept", F.col("_table").isNotNull() & (~F.col("_md") | (F.col("_size") > 2)))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", "t"))), lambda x: x["t"]), "\n")
    found = whole.where("_kept").groupBy(key, page, "_table").agg(F.min("line").alias("_at"), joined.alias("markdown"))
    found = found.select(key, page, F.row_number().over(Window.partitionBy(key, page).orderBy("_at")).alias("idx"), "markdown")
    body = whole.where(~F.col("_kept") & ~(F.col("_rule") & F.col("_table").isNotNull())).groupBy(key, page).agg(joined.alias("text"))
    rest = pages.select(key, page).join(body, [key, page], "left").select(key, page, F.coalesce("text", F.lit("")).alias("text"))
    return found, rest
