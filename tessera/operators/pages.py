"""Web pages distilled: blocks, sections, tables, actions, content scores, differences between visits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import arrays, text
from tessera.operators import tables as md

BLOCKS = ("h1", "h2", "h3", "p", "li", "blockquote", "pre", "code")
HEADINGS = ("h1", "h2", "h3")
#: Characters a block has at least, and a container's own text; blocks of a page that go into sections; blocks below which containers count; paragraphs of a section.
MIN_BLOCK, MIN_OWN, MAX_BLOCKS, FEW_BLOCKS, SECTION_BLOCKS = 20, 80, 1501, 10, 41


def blocks(elements: DataFrame, key: str = "page_id") -> DataFrame:
    """All headings, paragraphs, items and quotes of each page in order, each text once: key, idx, tag, text.

    On pages with fewer than ten of them, longer texts that stand directly in containers follow as paragraphs.
    """
    shown = elements.where(~F.col("hidden") & (F.col("chars") > 0))
    # An element is a block or a container, so it gives one text at most and elements are made once.
    main = F.col("tag").isin(*BLOCKS)
    direct = text.collapse(F.array_join(F.transform("own", lambda x: x["text"]), ""))
    held = shown.where(main | F.col("tag").isin("div", "section", "td"))
    both = held.select(key, F.when(main, 0).otherwise(1).alias("part"), "pos", F.when(main, F.col("tag")).otherwise("p").alias("tag"), F.when(main, F.col("text")).otherwise(direct).alias("text"))
    long = F.when(F.col("part") == 0, F.col("tag").isin(*HEADINGS) | (F.length("text") >= MIN_BLOCK)).otherwise(F.length("text") > MIN_OWN)
    first = Window.partitionBy(key, "text").orderBy("part", "pos")
    once = both.where(long).withColumn("_nth", F.row_number().over(first)).where("_nth = 1")
    counted = once.withColumn("_main", F.sum((F.col("part") == 0).cast("int")).over(Window.partitionBy(key)))
    kept = counted.where((F.col("part") == 0) | (F.col("_main") < FEW_BLOCKS))
    return kept.select(key, (F.row_number().over(Window.partitionBy(key).orderBy("part", "pos")) - 1).alias("idx"), "tag", "text")


def raw_sections(page_blocks: DataFrame, most: int = 60, max_chars: int = 4000, key: str = "page_id") -> DataFrame:
    """Paragraphs under their headings, of the first 1,501 blocks of a page: key, part, h, t. A heading without paragraphs is dropped; after 41 paragraphs a part without heading begins."""
    order = Window.partitionBy(key).orderBy("idx")
    heading = F.col("tag").isin(*HEADINGS)
    grouped = page_blocks.where(F.col("idx") < MAX_BLOCKS).withColumn("_group", F.sum(heading.cast("int")).over(order))
    titled = grouped.withColumn("_h", F.first(F.when(heading, F.substring("text", 1, 120)), ignorenulls=True).over(Window.partitionBy(key, "_group")))
    body = titled.where(~heading).withColumn("_sub", F.floor((F.row_number().over(Window.partitionBy(key, "_group").orderBy("idx")) - 1) / SECTION_BLOCKS))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("idx", "text"))), lambda x: x["text"]), "\n\n")
    parts = body.groupBy(key, "_group", "_sub").agg(F.min("idx").alias("_at"), F.first("_h").alias("_h"), joined.alias("_t"))
    clipped = parts.withColumn("t", text.clip(text.normalize(F.col("_t")), max_chars)).withColumn("part", F.row_number().over(Window.partitionBy(key).orderBy("_at")) - 1)
    return clipped.where(F.col("part") < most).select(key, "part", F.when(F.col("_sub") == 0, F.col("_h")).alias("h"), "t")


def sections(page_blocks: DataFrame, page_tables: DataFrame | None = None, most: int = 60, max_chars: int = 4000, budget: int = 12_000, key: str = "page_id") -> DataFrame:
    """Sections with stable ids within the text budget: key, idx, sid, h, t, type.

    Tables follow as sections of their own. The budget is spent in order: a section that is longer than what is left is
    clipped to that, 220 characters at least, and none follows once it is spent. A page has few sections, so this is a fold
    over its array. An id that comes again gets the number of ids before it. A section without heading takes its first sentence.
    """
    found = raw_sections(page_blocks, most, max_chars, key).withColumn("type", F.lit("text"))
    if page_tables is not None:
        place = F.lit(1_000_000) + F.col("table_no")
        named = F.concat(F.lit("[Table] "), F.coalesce("heading", text.smart_truncate(text.strip(F.replace(F.split("markdown", "\n")[0], F.lit("|"), F.lit(" "))), 60)))
        found = found.unionByName(page_tables.select(key, place.alias("part"), named.alias("h"), text.clip(F.col("markdown"), max_chars).alias("t"), F.lit("table").alias("type")))
    listed = found.groupBy(key).agg(F.slice(F.array_sort(F.collect_list(F.struct("part", "h", "t", "type"))), 1, most).alias("s"))
    kind = "array<struct<h:string,t:string,type:string>>"
    start = F.struct(F.lit(0).alias("used"), F.array().cast(kind).alias("out"))

    def step(state: Column, s: Column) -> Column:
        left = F.lit(budget) - state["used"]
        body = F.when(F.length(s["t"]) > left, text.clip(s["t"], F.greatest(F.lit(220), left))).otherwise(s["t"])
        return F.when(left <= 0, state).otherwise(F.struct((state["used"] + F.length(body)).cast("int").alias("used"), F.concat(state["out"], F.array(F.struct(s["h"].alias("h"), body.alias("t"), s["type"].alias("type")))).alias("out")))

    spent = listed.select(key, F.posexplode(F.aggregate("s", start, step)["out"]).alias("idx", "s")).select(key, "idx", "s.*")
    ids = spent.withColumn("_sid", text.web_section_id(F.col("h"), F.col("t")))
    same = Window.partitionBy(key, "_sid").orderBy("idx")
    marked = ids.withColumn("_again", F.row_number().over(same) > 1)
    sid = F.when(F.col("_again"), F.concat("_sid", F.lit("_"), F.col("idx").cast("string"))).otherwise(F.col("_sid"))
    sentence = text.strip(F.split("t", "[.!?。！？\n]")[0])
    h = F.when(F.coalesce("h", F.lit("")) != "", F.col("h")).when(F.length(sentence) > 10, text.smart_truncate(sentence, 80))
    return marked.select(key, "idx", sid.alias("sid"), h.alias("h"), "t", "type")


def content_hash(titles: DataFrame, page_sections: DataFrame, key: str = "page_id") -> DataFrame:
    """Hash of each page's title and section texts; the URL is no part of it."""
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("idx", "t"))), lambda x: x["t"]), "\n\n")
    return page_sections.groupBy(key).agg(body.alias("_body")).join(titles, key, "right").select(key, text.text_hash(F.concat(F.coalesce("title", F.lit("")), F.lit("\n"), F.coalesce("_body", F.lit("")))).alias("content_hash"))


def digest(titles: DataFrame, page_sections: DataFrame, most: int = 600, key: str = "page_id") -> DataFrame:
    """A page's title and the beginnings of its text sections, up to 600 characters."""
    line = F.concat(F.lit("## "), F.coalesce("h", F.lit("")), F.lit("\n"), F.substring("t", 1, 120))
    ordered = Window.partitionBy(key).orderBy("idx")
    lines = page_sections.where("type = 'text'").withColumn("_line", line)
    before = F.coalesce(F.sum(F.length("_line") + 2).over(ordered.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("idx", "_line"))), lambda x: x["_line"]), "\n\n")
    short = lines.withColumn("_before", before).where(F.col("_before") < most).groupBy(key).agg(body.alias("_body"))
    return titles.join(short, key, "left").select(key, F.substring(F.concat_ws("\n\n", F.concat(F.lit("# "), F.coalesce("title", F.lit(""))), "_body"), 1, most).alias("digest"))


def titles(elements: DataFrame, key: str = "page_id") -> DataFrame:
    first = elements.where("tag = 'title'").groupBy(key).agg(F.min_by("text", "pos").alias("title"))
    return first.select(key, F.when(F.col("title") != "", F.col("title")).alias("title"))


def innermost(elements: DataFrame, holder: Column, key: str = "page_id") -> DataFrame:
    """Adds _in: the place of the innermost holder that an element is in, its own for a holder, null outside all.

    Elements nest, so an element is in the last holder that begins before it at the depth that it has itself: holders begun less holders ended.
    """
    marked = elements.withColumn("_holds", holder)
    ends = marked.where("_holds").select(key, F.col("last").alias("pos"), F.lit(1).alias("_kind"), F.lit(-1).alias("_step"))
    steps = marked.withColumns({"_kind": F.lit(0), "_step": F.col("_holds").cast("int")}).unionByName(ends, allowMissingColumns=True)
    deep = steps.withColumn("_depth", F.sum("_step").over(Window.partitionBy(key).orderBy("pos", "_kind"))).where("_kind = 0")
    begun = F.last(F.when(F.col("_holds"), F.col("pos")), ignorenulls=True).over(Window.partitionBy(key, "_depth").orderBy("pos"))
    return deep.withColumn("_in", F.when(F.col("_depth") > 0, begun)).drop("_holds", "_kind", "_step", "_depth")


def table_cells(elements: DataFrame, most: int = 20, key: str = "page_id") -> DataFrame:
    """Cells of the visible tables of each page, rows padded to the table's width: key, table_no, row, col, value, head (the row has header cells).

    Tables are numbered as they begin. A row is of the innermost table around it alone: what a table within a cell says is part of that cell's text, but its rows are no rows of the outer table.
    """
    parts = elements.where(~F.col("hidden"))
    held = innermost(parts.where("tag in ('table', 'tr')").select(key, "pos", "last", "tag"), F.col("tag") == "table", key)
    numbers = parts.where("tag = 'table'").select(key, F.col("pos").alias("_in"), F.row_number().over(Window.partitionBy(key).orderBy("pos")).alias("table_no"))
    owner = held.where("tag = 'tr'").join(numbers.where(F.col("table_no") <= most), [key, "_in"]).select(key, F.col("pos").alias("row_pos"), "table_no")
    cells = parts.where("tag in ('td', 'th')").select(key, "pos", F.col("parent").alias("row_pos"), "tag", F.replace("text", F.lit("|"), F.lit("¦")).alias("value"))
    at = cells.join(owner, [key, "row_pos"])
    at = at.withColumn("row", F.dense_rank().over(Window.partitionBy(key, "table_no").orderBy("row_pos")) - 1).withColumn("col", F.row_number().over(Window.partitionBy(key, "row_pos").orderBy("pos")) - 1)
    lines = at.groupBy(key, "table_no", "row").agg(F.array_sort(F.collect_list(F.struct("col", "value"))).alias("c"), F.max((F.col("tag") == "th").cast("int")).alias("head"))
    wide = lines.withColumn("_width", F.max(F.size("c")).over(Window.partitionBy(key, "table_no")))
    padded = wide.select(key, "table_no", "row", "head", F.posexplode(F.transform(F.sequence(F.lit(0), F.col("_width") - 1), lambda i: F.coalesce(F.get("c", i)["value"], F.lit("")))).alias("col", "value"))
    return padded.withColumn("head", F.col("head") == 1)


def page_tables(elements: DataFrame, max_rows: int = 80, key: str = "page_id") -> DataFrame:
    """Tables of each page as Markdown: key, table_no, rows, cols, has_header, truncated, heading, markdown.

    The header is the first row if it has header cells, or if all its cells have 1 to 29 characters and other rows follow;
    else columns are numbered. At most 80 rows are shown, with a note.
    """
    cells = table_cells(elements, key=key)
    size = cells.groupBy(key, "table_no").agg((F.max("row") + 1).alias("rows"), (F.max("col") + 1).alias("cols"), F.max(F.when(F.col("row") == 0, F.col("head"))).alias("_th"), F.min(F.when(F.col("row") == 0, F.length("value").between(1, 29))).alias("_short"))
    lines = cells.where(F.col("row") < max_rows).groupBy(key, "table_no", "row").agg(F.concat(F.lit("| "), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("col", "value"))), lambda x: x["value"]), " | "), F.lit(" |")).alias("line"))
    body = lines.groupBy(key, "table_no").agg(F.transform(F.array_sort(F.collect_list(F.struct("row", "line"))), lambda x: x["line"]).alias("lines"))
    joined = size.join(body, [key, "table_no"]).withColumn("has_header", F.col("_th") | (F.col("_short") & (F.least("rows", F.lit(max_rows)) > 1)))
    numbered = F.concat(F.lit("| "), F.array_join(F.transform(F.sequence(F.lit(1), "cols"), lambda i: F.concat(F.lit("Col_"), i.cast("string"))), " | "), F.lit(" |"))
    rule = F.concat(F.lit("| "), F.array_join(F.array_repeat(F.lit("---"), F.col("cols")), " | "), F.lit(" |"))
    head = F.when(F.col("has_header"), F.col("lines")[0]).otherwise(numbered)
    rest = F.when(F.col("has_header"), F.slice("lines", 2, max_rows)).otherwise(F.col("lines"))
    note = F.when(F.col("rows") > max_rows, F.concat(F.lit("\n\n[... "), F.col("rows").cast("string"), F.lit(f" rows total, showing first {max_rows} ...]"))).otherwise("")
    made = joined.select(key, "table_no", "rows", "cols", "has_header", (F.col("rows") > max_rows).alias("truncated"), F.concat(F.array_join(F.concat(F.array(head, rule), rest), "\n"), note).alias("markdown"))
    return made.join(_table_headings(elements, key), [key, "table_no"], "left")


def _table_headings(elements: DataFrame, key: str) -> DataFrame:
    """Caption of each table, or the nearest heading among its three siblings before."""
    parts = elements.where(~F.col("hidden"))
    tables = parts.where("tag = 'table'").select(key, F.col("pos").alias("t_pos"), F.col("parent").alias("t_parent"), F.row_number().over(Window.partitionBy(key).orderBy("pos")).alias("table_no"))
    captions = parts.where("tag = 'caption' and text <> ''").select(key, F.col("parent").alias("t_pos"), F.col("text").alias("caption"))
    siblings = elements.select(key, F.col("parent").alias("t_parent"), F.col("pos").alias("s_pos"), "tag", "text")
    before = tables.join(siblings, [key, "t_parent"]).where("s_pos < t_pos").withColumn("_back", F.row_number().over(Window.partitionBy(key, "table_no").orderBy(F.col("s_pos").desc())))
    heads = before.where("_back <= 3 and tag in ('h1','h2','h3','h4','h5','h6')").groupBy(key, "table_no").agg(F.min_by(F.substring("text", 1, 120), "_back").alias("near"))
    return tables.join(captions, [key, "t_pos"], "left").join(heads, [key, "table_no"], "left").select(key, "table_no", F.coalesce("caption", F.when(F.col("near") != "", F.col("near"))).alias("heading"))


def page_table_stats(elements: DataFrame, key: str = "page_id") -> DataFrame:
    return md.column_stats(table_cells(elements, key=key), [key, "table_no"])


ROLES = ("button", "link", "checkbox", "radio", "textbox", "combobox")


def action_methods(role: Column) -> Column:
    """What can be done with an element of a role."""
    own = F.when(role.isin("button", "link", "checkbox", "radio"), F.array(F.lit("click"))).when(role == "textbox", F.array(F.lit("type"))).when(role == "combobox", F.array(F.lit("select"))).otherwise(F.array().cast("array<string>"))
    return F.concat(own, F.array(F.lit("scroll_into_view")))


def action_id(role: Column, name: Column, nth: Column) -> Column:
    """Id of an action from what identifies it on its page."""
    return F.concat(F.lit("a"), F.substring(F.sha1(arrays.python_json({"name": arrays.json_string(name), "nth": nth.cast("string"), "role": arrays.json_string(role)})), 1, 10))


def actions(elements: DataFrame, key: str = "page_id") -> DataFrame:
    """Links, buttons and fields of each page: key, pos, role, name, nth (place among those of the same role and name), css, aid, methods, confidence, source."""
    a = F.col("attrs")
    role = (
        F.when(a["role"].isin(*ROLES), a["role"])
        .when((F.col("tag") == "a") & a["href"].isNotNull(), "link")
        .when((F.col("tag") == "button") | ((F.col("tag") == "input") & a["type"].isin("button", "submit", "reset")), "button")
        .when((F.col("tag") == "input") & a["type"].isin("checkbox", "radio"), a["type"])
        .when((F.col("tag") == "textarea") | ((F.col("tag") == "input") & ~F.coalesce(a["type"], F.lit("text")).isin("hidden", "image", "file")), "textbox")
        .when(F.col("tag") == "select", "combobox")
    )
    given = lambda c: F.when(text.strip(c) != "", text.strip(c))
    name = F.substring(F.coalesce(given(a["aria-label"]), given(a["title"]), given(a["placeholder"]), given(F.when(F.col("tag") != "select", F.col("text"))), given(a["value"]), F.lit("")), 1, 200)
    css = F.when(given(a["id"]).isNotNull(), F.concat(F.lit("#"), a["id"])).when(given(a["data-test"]).isNotNull(), F.concat(F.lit('[data-test="'), a["data-test"], F.lit('"]')))
    found = elements.where(~F.col("hidden")).select(key, "pos", role.alias("role"), name.alias("name"), css.alias("css")).where("role is not null")
    nth = F.row_number().over(Window.partitionBy(key, "role", "name").orderBy("pos")) - 1
    return found.withColumn("nth", nth).select(key, "pos", "role", "name", "nth", "css", action_id(F.col("role"), F.col("name"), F.col("nth")).alias("aid"), action_methods(F.col("role")).alias("methods"), F.lit(0.8).alias("confidence"), F.lit("dom").alias("source"))


def merged_actions(first: DataFrame, second: DataFrame, key: str = "page_id") -> DataFrame:
    """Two sources' actions as one: those of the same role, name and place are joined, with the first's id, either's selector and the greater confidence."""
    other = second.select(key, "role", "name", "nth", F.col("pos").alias("_pos"), F.col("css").alias("_css"), F.col("aid").alias("_aid"), F.col("confidence").alias("_confidence"), F.col("source").alias("_source"))
    joined = first.join(other, [key, "role", "name", "nth"], "full")
    order = Window.partitionBy(key).orderBy(F.col("pos").isNull(), F.coalesce("pos", "_pos"))
    return joined.select(key, "role", "name", "nth", F.coalesce("css", "_css").alias("css"), F.coalesce("aid", "_aid").alias("aid"), F.greatest("confidence", "_confidence").alias("confidence"), F.coalesce("source", "_source").alias("source"), (F.row_number().over(order) - 1).alias("pos"))


# What an action's source and role add to its confidence when actions are ranked.
SOURCE_WEIGHT = {"dom": 0.03, "a11y": 0.02, "vision": 0.01}
ROLE_WEIGHT = {"textbox": 0.03, "button": 0.02, "combobox": 0.02, "link": 0.015, "checkbox": 0.01, "radio": 0.01}


def action_rank(role: Column, name: Column, source: Column, confidence: Column, by_role: Column) -> Column:
    add = lambda c, weights: F.coalesce(F.element_at(F.create_map(*(F.lit(v) for kv in weights.items() for v in kv)), c), F.lit(0.0))
    named = F.when(text.strip(F.coalesce(name, F.lit(""))) != "", 0.02).otherwise(0.0)
    return confidence + add(source, SOURCE_WEIGHT) + add(role, ROLE_WEIGHT) + named + F.when(by_role, 0.01).otherwise(0.0)


def packed_actions(ranked: DataFrame, room: Column, size: Column, key: str = "page_id") -> DataFrame:
    """The actions that fit a page's room, best first; one that does not fit is skipped and smaller ones after it may still go in. A fold over the page's few actions."""
    listed = ranked.withColumn("_size", size.cast("long")).withColumn("_room", room.cast("long")).groupBy(key).agg(F.first("_room").alias("_room"), F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), "pos", "aid", "_size"))).alias("a"))
    start = F.struct(F.lit(0).cast("long").alias("used"), F.array().cast("array<string>").alias("aids"))
    step = lambda s, x: F.when(s["used"] + x["_size"] <= F.col("_room"), F.struct((s["used"] + x["_size"]).alias("used"), F.concat(s["aids"], F.array(x["aid"])).alias("aids"))).otherwise(s)
    return listed.select(key, F.posexplode(F.aggregate("a", start, step)["aids"]).alias("place", "aid"))


def sections_diff(old: DataFrame, new: DataFrame, key: str = "page_id") -> DataFrame:
    """Sections added, removed or changed between two visits: key, sid, change. Unchanged ones are left out."""
    a = old.select(key, "sid", text.text_hash(F.col("t")).alias("_old"))
    b = new.select(key, "sid", text.text_hash(F.col("t")).alias("_new"))
    change = F.when(F.col("_old").isNull(), "added").when(F.col("_new").isNull(), "removed").when(F.col("_old") != F.col("_new"), "changed")
    return a.join(b, [key, "sid"], "full").select(key, "sid", change.alias("change")).where("change is not null")


def declared_tools(elements: DataFrame, key: str = "page_id") -> DataFrame:
    """Tools that forms declare: key, pos, name, description, and the names of the form's fields with those that are required."""
    a = F.col("attrs")
    rows = elements.where("tag in ('form', 'input', 'select', 'textarea')").select(key, "pos", "last", "tag", a["toolname"].alias("name"), a["tooldescription"].alias("description"), a["name"].alias("field"), a["required"].isNotNull().alias("required"))
    form = F.when(F.col("tag") == "form", F.struct(F.col("pos").alias("form_pos"), "name", "description"))
    placed = innermost(rows, F.col("tag") == "form", key).withColumn("_form", F.max(form).over(Window.partitionBy(key, "_in"))).where("_in is not null and _form.name is not null")
    field = F.when((F.col("tag") != "form"), F.col("field"))
    return placed.groupBy(key, "_form.form_pos", "_form.name", "_form.description").agg(F.array_sort(F.collect_set(field)).alias("fields"), F.array_sort(F.collect_set(F.when(F.col("required"), field))).alias("required"))


# Class and id words that speak for and against a container being the article.
GOOD = "article|body|content|entry|main|page|post|text|blog|story"
BAD = "hidden|banner|combx|comment|contact|foot|masthead|media|meta|outbrain|promo|related|scroll|share|sidebar|sponsor|shopping|tags|widget|nav|ad-|^ad$"


def content_scores(elements: DataFrame, key: str = "page_id") -> DataFrame:
    """How likely each container is the article: key, pos, tag, score, best first.

    Each paragraph of 25 characters or more gives 1 point, one for each comma and one for each 100 characters (3 at most) to
    its parent, half to the one above; a container's tag and its class words add to that, and the share of its text in links takes away.
    """
    shown = elements.where(~F.col("hidden"))
    words = F.lower(F.concat_ws(" ", F.col("attrs")["class"], F.col("attrs")["id"]))
    parts = shown.where("tag in ('p', 'pre', 'td', 'blockquote') and length(text) >= 25").select(key, "parent", (1 + F.regexp_count("text", F.lit("[,，、]")) + F.least(F.floor(F.length("text") / 100), F.lit(3))).cast("double").alias("points"))
    holders = shown.select(key, "pos", "parent", "tag", (F.when(words.rlike(GOOD), 25).otherwise(0) - F.when(words.rlike(BAD), 25).otherwise(0)).alias("class_points"), "chars", "link_chars")
    up = holders.select(key, F.col("pos").alias("parent"), F.col("parent").alias("above"))
    twice = parts.join(up, [key, "parent"]).select(key, F.explode(F.array(F.struct(F.col("parent").alias("pos"), F.col("points").alias("p")), F.struct(F.col("above").alias("pos"), (F.col("points") / 2).alias("p")))).alias("x")).select(key, "x.pos", "x.p")
    sums = twice.where("pos >= 0").groupBy(key, "pos").agg(F.sum("p").alias("points"))
    tag = F.when(F.col("tag") == "div", 5).when(F.col("tag").isin("pre", "td", "blockquote"), 3).when(F.col("tag").isin("form", "li"), -3).when(F.col("tag").rlike("^h[1-6]$"), -5).otherwise(0)
    density = F.when(F.col("chars") > 0, F.least(F.col("link_chars") / F.col("chars"), F.lit(1.0))).otherwise(0.0)
    return sums.join(holders, [key, "pos"]).select(key, "pos", "tag", F.round((F.col("points") + tag + F.col("class_points")) * (1 - density), 4).alias("score"))


def candidates(elements: DataFrame, most: int = 5, key: str = "page_id") -> DataFrame:
    """The best containers of each page by ``content_scores``, with their place from 1."""
    order = Window.partitionBy(key).orderBy(F.col("score").desc(), "pos")
    return content_scores(elements, key).withColumn("place", F.row_number().over(order)).where(F.col("place") <= most)


#: Share of the best container's score that a sibling needs to be joined to it, and the least such score; characters of a paragraph that is joined for its own sake.
SIBLING_SHARE, SIBLING_LEAST, SIBLING_CHARS = 0.2, 10.0, 80


def article(elements: DataFrame, key: str = "page_id") -> DataFrame:
    """The text of each page's best container by ``content_scores``, together with those of its siblings that score a fifth as much or are long paragraphs with few links."""
    scores = content_scores(elements, key)
    best = scores.groupBy(key).agg(F.max_by("pos", F.struct("score", -F.col("pos"))).alias("best"), F.max("score").alias("score"))
    shown = elements.where(~F.col("hidden")).select(key, "pos", "last", "parent", "tag", "chars", "link_chars", "own")
    top = best.join(shown.select(key, F.col("pos").alias("best"), F.col("parent").alias("best_parent"), F.col("last").alias("best_last")), [key, "best"])
    siblings = shown.join(scores.select(key, "pos", F.col("score").alias("own_score")), [key, "pos"], "left").join(top, key)
    enough = F.col("own_score") >= F.greatest(F.lit(SIBLING_LEAST), F.col("score") * SIBLING_SHARE)
    prose = (F.col("tag") == "p") & (F.col("chars") > SIBLING_CHARS) & (F.col("link_chars") < F.col("chars") * 0.25)
    chosen = siblings.where((F.col("pos") == F.col("best")) | ((F.col("parent") == F.col("best_parent")) & (F.col("parent") >= 0) & (enough | prose)))
    # The chosen ones do not overlap, so a piece of text is of the last one that begins before it, if that has not ended.
    begins = chosen.select(key, "pos", F.lit(0).alias("_kind"), F.col("last").alias("_last"), F.lit(None).cast("array<struct<at:int,text:string>>").alias("own"), "score")
    parts = shown.select(key, "pos", F.lit(1).alias("_kind"), F.lit(None).cast("int").alias("_last"), "own", F.lit(None).cast("double").alias("score"))
    before = Window.partitionBy(key).orderBy("pos", "_kind")
    held = begins.unionByName(parts).withColumn("_in", F.last(F.when(F.col("_kind") == 0, F.struct("_last", "score")), ignorenulls=True).over(before))
    pieces = held.where((F.col("_kind") == 1) & (F.col("pos") <= F.col("_in._last"))).select(key, F.col("_in.score").alias("score"), F.explode("own").alias("x"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("x.at", "x.text"))), lambda x: x["text"]), "")
    return pieces.groupBy(key).agg(F.max("score").alias("score"), text.collapse(joined).alias("text"))
