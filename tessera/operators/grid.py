"""Points and boxes that meet in the plane, by cells of grids: an equality join, never all pairs of a page."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Cells of level n have sides of 2 to the n; boxes of sides beyond the range go to the nearest level (small ones into larger cells, large ones over more cells).
LEVELS = (0, 24)


def _cell(v: Column, level: Column) -> Column:
    return F.floor(v / F.pow(F.lit(2.0), level)).cast("long")


def boxes_at(points: DataFrame, boxes: DataFrame, by: list[str], corners: tuple[str, str, str, str] = ("x0", "y0", "x1", "y1"), at: tuple[str, str] = ("x", "y")) -> DataFrame:
    """Every box that each point is in, edges included: the points' columns and the boxes' in a struct ``box``. Points in none have no row.

    A box lies in the grid whose cells are at least as large as its longer side, so it touches four of them at most; a point is in one cell of each grid that any box of its group (``by``) uses. So boxes give four
    rows each and points as many as there are sizes of boxes, whatever their number, and both meet by cell. Boxes with null, non-finite or reversed sides hold no point, and points with null or non-finite
    places are in none. A dense cell is split by the adaptive join.
    """
    x0, y0, x1, y1 = (F.col(c).cast("double") for c in corners)
    finite = lambda *cs: F.coalesce(F.greatest(*(F.abs(c) for c in cs)) < F.lit(1e15), F.lit(False))  # noqa: E731  (NaN is greatest of all)
    side = F.greatest(x1 - x0, y1 - y0, F.lit(1.0))
    level = F.least(F.greatest(F.ceil(F.log2(side)), F.lit(LEVELS[0])), F.lit(LEVELS[1])).cast("int")
    names = [f"_by_{i}" for i in range(len(by))]
    good = boxes.where(finite(x0, y0, x1, y1) & x0.isNotNull() & y0.isNotNull() & x1.isNotNull() & y1.isNotNull() & (x0 <= x1) & (y0 <= y1))
    sized = good.select(*(F.col(b).alias(n) for b, n in zip(by, names, strict=True)), F.struct(*boxes.columns).alias("box"), x0.alias("_x0"), y0.alias("_y0"), x1.alias("_x1"), y1.alias("_y1"), level.alias("_level"))
    cells = sized.withColumn("_cx", F.explode(F.sequence(_cell(F.col("_x0"), F.col("_level")), _cell(F.col("_x1"), F.col("_level"))))).withColumn("_cy", F.explode(F.sequence(_cell(F.col("_y0"), F.col("_level")), _cell(F.col("_y1"), F.col("_level")))))
    used = sized.groupBy(*names).agg(F.collect_set("_level").alias("_levels"))  # of few values
    x, y = (F.col(c).cast("double") for c in at)
    placed = points.where(finite(x, y) & x.isNotNull() & y.isNotNull()).select(*(F.col(b).alias(n) for b, n in zip(by, names, strict=True)), F.struct(*points.columns).alias("_point"), x.alias("_x"), y.alias("_y"))
    spread = placed.join(used, names).withColumn("_level", F.explode("_levels")).withColumns({"_cx": _cell(F.col("_x"), F.col("_level")), "_cy": _cell(F.col("_y"), F.col("_level"))}).drop("_levels")
    met = spread.join(cells, [*names, "_level", "_cx", "_cy"]).where(F.col("_x").between(F.col("_x0"), F.col("_x1")) & F.col("_y").between(F.col("_y0"), F.col("_y1")))
    return met.select("_point.*", "box")


def smallest_box(points: DataFrame, boxes: DataFrame, by: list[str], point: str, box: str, **places: tuple) -> DataFrame:
    """Each point with the smallest box that it is in (of equal ones the last by id): the points' columns and the box's id as ``found``, null where it is in none. ``point`` and ``box`` name the ids."""
    corners = places.get("corners", ("x0", "y0", "x1", "y1"))
    x0, y0, x1, y1 = (F.col(f"box.{c}").cast("double") for c in corners)
    met = boxes_at(points, boxes, by, **places)
    same = [*by, point, *places.get("at", ("x", "y"))]  # an id may stand for several points
    best = met.groupBy(*same).agg(F.max_by(F.col(f"box.{box}"), F.struct(-(x1 - x0) * (y1 - y0), F.col(f"box.{box}"))).alias("found"))
    return points.join(best, same, "left")


# What a click on an element is meant for: the nearest of these around it.
INTERACTIVE_TAGS, INTERACTIVE_ROLES = ("button", "input", "textarea", "select"), ("button", "link", "textbox", "combobox")


def elements_at(points: DataFrame, elements: DataFrame, by: str = "page_id", point: str = "point_id") -> DataFrame:
    """The element that each point of a page means: page, point, pos, role, name.

    ``elements`` has pos, last, tag, attrs, text and its box (x0, y0, x1, y1); ``points`` have an id, x and y. The topmost element is the smallest box at the point (of equal ones the last of the page), and the interactive one nearest
    around it, if there is any, takes its place. That one is found among the boxes at the point too, as it lies around.
    """
    a = F.col("box.attrs")
    interactive = F.col("box.tag").isin(*INTERACTIVE_TAGS) | ((F.col("box.tag") == "a") & a["href"].isNotNull()) | F.coalesce(a["role"].isin(*INTERACTIVE_ROLES), F.lit(False))
    area = (F.col("box.x1") - F.col("box.x0")) * (F.col("box.y1") - F.col("box.y0"))
    met = boxes_at(points, elements, [by]).withColumn("_acts", interactive)
    order = Window.partitionBy(by, point).orderBy(area, F.col("box.pos").desc())
    ranked = met.withColumn("_place", F.row_number().over(order)).withColumn("_top", F.first("box.pos").over(order))
    # Around the topmost: begins no later and ends no sooner; the nearest is the one that begins last.
    around = (F.col("box.pos") <= F.col("_top")) & (F.col("box.last") >= F.col("_top")) & F.col("_acts")
    named = F.coalesce(*(F.nullif(F.trim(x), F.lit("")) for x in (a["aria-label"], a["title"], a["placeholder"], F.col("box.text"))), F.lit(""))
    found = F.struct("box.pos", "box.tag", a["role"].alias("role"), a["type"].alias("type"), named.alias("name"))
    picked = ranked.groupBy(by, point).agg(F.max_by(F.when(around, found), F.when(around, F.col("box.pos"))).alias("acts"), F.max(F.when(F.col("_place") == 1, found)).alias("top"))
    e = F.coalesce("acts", "top")
    tag, kind = e["tag"], F.lower(F.coalesce(e["type"], F.lit("")))
    role = F.coalesce(F.nullif(F.lower(F.trim(e["role"])), F.lit("")), F.when(tag == "a", "link").when((tag == "input") & kind.isin("button", "submit", "reset"), "button").when((tag == "input") & kind.isin("checkbox", "radio"), kind).when(tag.isin("input", "textarea"), "textbox").when(tag == "select", "combobox").otherwise(tag))
    return picked.select(by, point, e["pos"].alias("pos"), role.alias("role"), F.substring(e["name"], 1, 200).alias("name"))
