"""Layout of scanned pages: tables from the places of text blocks, overlapping boxes, text outside tables."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators import grid
from tessera.shipping import ship
from tessera.storage import stored

CELL = "row int, col int, colspan int, text string, x0 double, y0 double, x1 double, y1 double, confidence double, blocks string"


def overlap_ratio(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    """Share of the narrower of two extents that they have in common."""
    least = F.least(a1 - a0, b1 - b0)
    return F.when(least > 0, F.greatest(F.lit(0.0), F.least(a1, b1) - F.greatest(a0, b0)) / least).otherwise(0.0)


# How near blocks must be to share a line or a column, and how far a table reaches beyond its rows; in points, and in shares of a block's usual width and height.
_COLUMN_GAP, _COLUMN_SHARE, _LINE_GAP, _LINE_SHARE, _REACH_SHARE = 12.0, 0.35, 8.0, 0.75, 1.5


def _median(values: np.ndarray) -> np.ndarray:
    """Of each row."""
    n = values.shape[1]
    values = np.sort(values, axis=1)
    return (values[:, (n - 1) // 2] + values[:, n // 2]) / 2


def _first_near(found: np.ndarray, count: np.ndarray, x: np.ndarray, tolerance: np.ndarray) -> np.ndarray:
    """Of each page's values found so far, the first that is near enough to the page's next one; their number if none is."""
    near = np.abs(found[:, : count.max() + 1] - x[:, None]) <= tolerance[:, None]
    return np.where(near.any(axis=1), near.argmax(axis=1), count)


def _lines(x0: np.ndarray, middle: np.ndarray, tolerance: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The line of each block, and each line's number of blocks: from the top, each block goes to the first line whose running middle is near enough. All pages step together."""
    line, held, centres = np.zeros(x0.shape, np.int64), np.zeros(x0.shape, np.int64), np.full(x0.shape, np.inf)
    pages, count = np.arange(len(x0)), np.zeros(len(x0), np.int64)
    for i in np.lexsort((x0, middle), axis=1).T:
        x = middle[pages, i]
        k = _first_near(centres, count, x, tolerance)
        held[pages, k] += 1
        before = np.where(k == count, x, centres[pages, k])
        centres[pages, k] = before + (x - before) / held[pages, k]
        line[pages, i] = k
        count = np.maximum(count, k + 1)
    return line, held


def _columns(left: np.ndarray, tolerance: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Left sides (infinite ones are none) in columns, and their number: each moves the first column that is near enough half way, or begins one. All pages step together."""
    columns = np.full(left.shape, np.inf)
    pages, count = np.arange(len(left)), np.zeros(len(left), np.int64)
    for x in np.sort(left, axis=1).T:
        some = np.flatnonzero(x < np.inf)
        if not len(some):
            break
        k = _first_near(columns[some], count[some], x[some], tolerance[some])
        columns[pages[some], k] = np.where(k == count[some], x[some], (columns[pages[some], k] + x[some]) / 2)
        count[some] = np.maximum(count[some], k + 1)
    return columns[:, : max(1, count.max())], count


def _reach(columns: np.ndarray, wide: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """How many of the columns lie between two sides, one at least."""
    return np.maximum(1, sum((left - wide <= c) & (c < right) for c in columns))


def _cells(x0: np.ndarray, y0: np.ndarray, x1: np.ndarray, y1: np.ndarray) -> tuple[np.ndarray, ...]:
    """Cells of the tables that the blocks of pages form, a page in each row: row, column, columns spanned, box, and for each block in a cell (page by page and in the cells' order) its place and whether it begins one."""
    m, n = x0.shape
    middle, tall = (y0 + y1) / 2, _median(y1 - y0)
    wide = np.maximum(_COLUMN_GAP, _median(x1 - x0) * _COLUMN_SHARE)
    line, held = _lines(x0, middle, np.maximum(_LINE_GAP, tall * _LINE_SHARE))
    anchor = np.take_along_axis(held, line, 1) > 1
    columns, count = _columns(np.where(anchor, x0, np.inf), wide)
    # A single block that reaches over columns, inside or next to the table, is a row too.
    gap = np.maximum(_LINE_GAP, tall * _REACH_SHARE)
    top, foot = np.where(anchor, y0, np.inf).min(axis=1) - gap, np.where(anchor, y1, -np.inf).max(axis=1) + gap
    across = _reach(columns.T[:, :, None], wide[:, None], x0, x1) > 1
    used = (anchor | ((top[:, None] <= middle) & (middle <= foot[:, None]) & across)) & (((held > 1).sum(axis=1) > 1) & (count > 1))[:, None]
    # Rows from the top by their highest block; of equal ones those of several blocks first.
    pages, high = np.arange(m)[:, None], np.full((m, n), np.inf)
    np.minimum.at(high, (pages, line), np.where(used, y0, np.inf))
    row = np.empty((m, n), np.int64)
    np.put_along_axis(row, np.lexsort((held == 1, high), axis=1), np.arange(n)[None, :], 1)
    nearest, column = np.full((m, n), np.inf), np.zeros((m, n), np.int64)
    for c, x in enumerate(columns.T):
        away = np.abs(x0 - x[:, None])
        column, nearest = np.where(away < nearest, c, column), np.minimum(away, nearest)
    at = np.flatnonzero(used)
    page, row, column = at // n, np.take_along_axis(row, line, 1).ravel()[at], column.ravel()[at]
    order = np.lexsort((middle.ravel()[at], x0.ravel()[at], y0.ravel()[at], column, row, page))
    at, page, row, column = at[order], page[order], row[order], column[order]
    begins = np.append(True, (np.diff(page) != 0) | (np.diff(row) != 0) | (np.diff(column) != 0))[: len(at)]
    first = np.flatnonzero(begins)
    box = [f.reduceat(v.ravel()[at], first) if len(at) else np.zeros(0) for f, v in ((np.minimum, x0), (np.minimum, y0), (np.maximum, x1), (np.maximum, y1))]
    page = page[first]
    return row[first] + 1, column[first] + 1, _reach(columns[page].T, wide[page], box[0], box[2]), *box, at, begins


_CELL = [pa.field(n, {"string": pa.string(), "int": pa.int32(), "double": pa.float64()}[t]) for n, t in (c.split() for c in CELL.split(", "))]
#: All white space.
_SPACE = "".join(c for c in map(chr, range(0x3001)) if c.isspace())
#: Blocks that are read together, and the pages that they end.
_BLOCKS = 40_000


def _tables(blocks: pa.Table) -> pa.RecordBatch:
    """The cells of whole pages; pages of as many blocks are looked at side by side."""
    raw, ids = blocks["text"], blocks["block_id"]
    texts = pc.utf8_trim(raw, _SPACE)
    x0, y0, x1, y1, confidence = (blocks[c].to_numpy() for c in ("x0", "y0", "x1", "y1", "confidence"))
    solid = np.flatnonzero((x1 > x0) & (y1 > y0) & (pc.binary_length(texts).fill_null(0).to_numpy() > 0))
    page_of = np.cumsum(_begins(blocks))
    page = page_of[solid]
    start = np.flatnonzero(np.diff(page, prepend=-1))
    size = np.diff(np.append(start, len(page)))
    made = []
    for n in np.unique(size[size >= 4]):
        at = solid[start[size == n][:, None] + np.arange(n)]
        *cells, member, begins = _cells(x0[at], y0[at], x1[at], y1[at])
        made.append((*cells, at.ravel()[member], begins))
    row, column, span, *box, member, begins = (np.concatenate(x) for x in zip(*made, strict=True)) if made else (np.zeros(0, np.int64) for _ in range(9))
    first = np.flatnonzero(begins)
    head, length = member[first], np.diff(np.append(first, len(member)))
    mean, joined = confidence[head], length > 1
    doc, page, text, named = (c.take(pa.array(head, pa.int64())).combine_chunks() for c in (blocks["doc_id"], blocks["page"], texts, ids))
    if joined.any():
        some = pa.array(member[np.repeat(joined, length)], pa.int64())
        lists = [np.split(np.array(c.take(some).to_pylist(), object), np.cumsum(length[joined])[:-1]) for c in (raw, ids)]
        text, named = (pc.replace_with_mask(c, joined, pa.array([mark.join(x).strip(strip) for x in l], pa.string())) for c, mark, l, strip in ((text, "\n", lists[0], _SPACE), (named, ",", lists[1], "")))
        mean[joined] = [sum(c.tolist()) / len(c) for c in np.split(confidence[some], np.cumsum(length[joined])[:-1])]
    columns = (row, column, span, text, *box, mean, named)
    cells = pa.StructArray.from_arrays([c if isinstance(c, pa.Array) else pa.array(c.astype(f.type.to_pandas_dtype()), f.type, from_pandas=True) for c, f in zip(columns, _CELL, strict=True)], fields=_CELL)
    table = np.flatnonzero(np.diff(page_of[head], prepend=-1))
    return pa.RecordBatch.from_arrays([doc.take(pa.array(table)), page.take(pa.array(table)), pa.array(np.ones(len(table), np.int32)), pa.ListArray.from_arrays(pa.array(np.append(table, len(head)), pa.int32()), cells)], ["doc_id", "page", "table_idx", "cells"])


def _begins(blocks: pa.Table) -> np.ndarray:
    """Which blocks are the first of their page."""
    codes = (blocks[c].combine_chunks().dictionary_encode("encode").indices.to_numpy() for c in ("doc_id", "page"))
    changed = [np.diff(c, prepend=-1) != 0 for c in codes]
    return changed[0] | changed[1]


def _page_tables(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held, rows, most = [], 0, _BLOCKS
    for batch in it:
        held.append(batch)
        rows += batch.num_rows
        if rows >= most:
            blocks = pa.Table.from_batches(held).combine_chunks()
            last = int(np.flatnonzero(_begins(blocks))[-1])  # this page may go on
            if last:
                yield _tables(blocks.slice(0, last))
            held = blocks.slice(last).to_batches()
            rows -= last
            most = max(_BLOCKS, 2 * rows)
    if rows:
        yield _tables(pa.Table.from_batches(held).combine_chunks())


def _listed(blocks: DataFrame) -> DataFrame:
    """A row for each table with all its cells."""
    ship(blocks.sparkSession)
    rows = blocks.select(F.col("doc_id").cast("string").alias("doc_id"), F.col("page").cast("int").alias("page"), F.col("block_id").cast("string").alias("block_id"), "text", *(F.col(c).cast("double").alias(c) for c in ("x0", "y0", "x1", "y1", "confidence")))
    kind = ",".join(c.replace(" ", ":", 1) for c in CELL.split(", "))
    return rows.repartition("doc_id", "page").sortWithinPartitions(*rows.columns).mapInArrow(_page_tables, f"doc_id string, page int, table_idx int, cells array<struct<{kind}>>")


def layout_tables(blocks: DataFrame) -> DataFrame:
    """Cells of the table that the blocks of a page form, if they do: two rows or more of two columns or more.

    ``blocks``: doc_id, page, block_id, text, x0, y0, x1, y1, confidence. Lines and columns are found by moving middles, an
    ordered rule, so each page's few blocks are read together: pages are dealt by one shuffle, sorted, and streamed. Pages of as many blocks step
    side by side. Blocks without text or extent are left out.
    """
    return _listed(blocks).select("doc_id", "page", "table_idx", F.inline("cells"))


def layout_markdown(cells: DataFrame) -> DataFrame:
    """Tables of ``layout_tables`` as Markdown with their size and box, the first row as header. One aggregation by table."""
    by = ["doc_id", "page", "table_idx"]
    return _markdown(cells.groupBy(*by).agg(F.collect_list(F.struct(*(c for c in cells.columns if c not in by))).alias("cells")))


def blocks_markdown(blocks: DataFrame) -> DataFrame:
    """What ``layout_markdown`` gives of the tables that blocks form, without a shuffle of their cells."""
    return _markdown(_listed(blocks))


def _markdown(listed: DataFrame) -> DataFrame:
    of = lambda c: F.transform("cells", lambda x: x[c])
    mean = F.aggregate(of("confidence"), F.lit(0.0), lambda s, x: s + x) / F.size("cells")
    place = lambda r, c: r.cast("long") * (1 << 20) + c
    texts = F.map_from_entries(F.transform("cells", lambda x: F.struct(place(x["row"], x["col"]), F.regexp_replace(x["text"], "[|\n]", " "))))
    size = listed.select(*(c for c in listed.columns if c != "cells"), F.array_max(of("row")).alias("row_count"), F.array_max(of("col")).alias("column_count"), *(F.array_min(of(c)).alias(c) for c in ("x0", "y0")), *(F.array_max(of(c)).alias(c) for c in ("x1", "y1")), F.bround(mean, 4).alias("confidence"), texts.alias("_m"))
    text_at = lambda r, c: F.coalesce(F.element_at("_m", place(r, c)), F.lit(""))
    line = lambda r: F.concat(F.lit("| "), F.array_join(F.transform(F.sequence(F.lit(1), "column_count"), lambda c: text_at(r, c)), " | "), F.lit(" |"))
    rule = F.concat(F.lit("| "), F.array_join(F.array_repeat(F.lit("---"), F.col("column_count")), " | "), F.lit(" |"))
    rest = F.when(F.col("row_count") > 1, F.transform(F.sequence(F.lit(2), F.greatest("row_count", F.lit(2))), line)).otherwise(F.array().cast("array<string>"))
    return size.withColumn("markdown", F.array_join(F.concat(F.array(line(F.lit(1)), rule), rest), "\n")).drop("_m")


def text_outside_tables(blocks: DataFrame, boxes: DataFrame) -> DataFrame:
    """Blocks whose middle is in none of their page's table boxes (doc_id, page, x0, y0, x1, y1)."""
    key = blocks.select("*", ((F.col("x0") + F.col("x1")) / 2).alias("_x"), ((F.col("y0") + F.col("y1")) / 2).alias("_y"), F.monotonically_increasing_id().alias("_n"))
    key = stored(key, "layout-blocks")  # the numbers are the same whenever they are read
    inside = grid.boxes_at(key.select("doc_id", "page", "_n", "_x", "_y"), boxes, ["doc_id", "page"], at=("_x", "_y")).select("_n").distinct()
    return key.join(inside, "_n", "left_anti").select(*blocks.columns)


#: Fixed value: sides count whole pixels, both ends included.
_PIXEL = 1


def _shared(a: Column, b: Column) -> Column:
    """Share of the union of two boxes that they have in common; NaN where a side is unknown or there is no union."""
    side = lambda low, high: high - low + _PIXEL
    area = lambda x: side(x["x1"], x["x2"]) * side(x["y1"], x["y2"])
    both = F.greatest(side(F.greatest(a["x1"], b["x1"]), F.least(a["x2"], b["x2"])), F.lit(0.0)) * F.greatest(side(F.greatest(a["y1"], b["y1"]), F.least(a["y2"], b["y2"])), F.lit(0.0))
    return F.coalesce(F.try_divide(both, area(a) + area(b) - both), F.lit(float("nan")))


def suppress_boxes(boxes: DataFrame, least: float = 0.5, most: int = 100) -> DataFrame:
    """Of overlapping boxes of an image (image_id, box_id, x1, y1, x2, y2, score) those that no better one covers to that share of their union, 100 at most, best first, with their place.

    Each image's boxes are folded best first, in the JVM: one stays unless it shares too much with one that stayed before.
    """
    columns = [c for c in boxes.columns if c != "image_id"]
    box = F.struct(*(F.coalesce(F.col(c).cast("double"), F.lit(float("nan"))).alias(c) for c in ("x1", "y1", "x2", "y2")))
    listed = boxes.groupBy("image_id").agg(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("_order"), *columns, box.alias("_box")))).alias("_boxes"))
    nothing = F.array().cast(listed.schema["_boxes"].dataType)
    stays = lambda kept, b: (F.size(kept) < most) & ~F.exists(kept, lambda k: _shared(k["_box"], b["_box"]) > least)
    picked = listed.select("image_id", F.posexplode(F.aggregate("_boxes", nothing, lambda kept, b: F.when(stays(kept, b), F.concat(kept, F.array(b))).otherwise(kept))).alias("place", "_b"))
    return picked.select("image_id", *(f"_b.{c}" for c in columns), "place")
