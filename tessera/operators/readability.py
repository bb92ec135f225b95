"""The article of each page, found by its paragraphs and cleaned of what is not text, with its metadata."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import text
from tessera.storage import spread, stored

# Class and id words that make an element unlikely, those that save it, those that speak for and against it, and those of bylines and share boxes.
UNLIKELY = r"(?i)-ad-|ai2html|banner|breadcrumbs|combx|comment|community|cover-wrap|disqus|extra|footer|gdpr|header|legends|menu|related|remark|replies|rss|shoutbox|sidebar|skyscraper|social|sponsor|supplemental|ad-break|agegate|pagination|pager|popup|yom-remote"
MAYBE = r"(?i)and|article|body|column|content|main|mathjax|shadow"
POSITIVE = r"(?i)article|body|content|entry|hentry|h-entry|main|page|pagination|post|text|blog|story"
NEGATIVE = r"(?i)-ad-|hidden|^hid$| hid$| hid |^hid |banner|combx|comment|com-|contact|footer|gdpr|masthead|media|meta|outbrain|promo|related|scroll|share|shoutbox|sidebar|skyscraper|sponsor|shopping|tags|widget"
BYLINE = r"(?i)byline|author|dateline|writtenby|p-author"
SHARE = r"(?i)(\b|_)(share|sharedaddy)(\b|_)"
VIDEO = r"(?i)//(www\.)?((dailymotion|youtube|youtube-nocookie|player\.vimeo|v\.qq|bilibili|live\.bilibili)\.com|(archive|upload\.wikimedia)\.org|player\.twitch\.tv)"
AD_WORDS = r"(?iu)^(ad(vertising|vertisement)?|pub(licité)?|werb(ung)?|广告|реклама|anuncio)$|^((loading|正在加载|загрузка|chargement|cargando)(…|\.\.\.)?)$"
ROLES = ("menu", "menubar", "complementary", "navigation", "alert", "alertdialog", "dialog")
COMMAS = "[,،﹐︐︑⹁⸴⸲，]"
# Elements that are scored, those that make a div no paragraph, those whose text counts as content, and what an element's name adds to its score.
SCORED = ("section", "h2", "h3", "h4", "h5", "h6", "p", "td", "pre")
BLOCKS = ("blockquote", "dl", "div", "img", "ol", "p", "pre", "table", "ul")
TEXTISH = ("span", "li", "td", *BLOCKS)
TAG_POINTS = {5: ("div",), 3: ("pre", "td", "blockquote"), -3: ("address", "ol", "ul", "dl", "dd", "dt", "li", "form"), -5: ("h1", "h2", "h3", "h4", "h5", "h6", "th")}
ARTICLE_TYPES = r"^Article|AdvertiserContentArticle|NewsArticle|AnalysisNewsArticle|AskPublicNewsArticle|BackgroundNewsArticle|OpinionNewsArticle|ReportageNewsArticle|ReviewNewsArticle|Report|SatiricalArticle|ScholarlyArticle|MedicalScholarlyArticle|SocialMediaPosting|BlogPosting|LiveBlogPosting|DiscussionForumPosting|TechArticle|APIReference$"
# Characters of an article that needs no other try, of a paragraph that is scored, best containers looked at, share of the best score of those that vote, and votes that lift the choice.
ENOUGH, PARAGRAPH, BEST, CLOSE, VOTES = 500, 25, 5, 0.75, 3
SIMILAR = 0.75
#: The tries: whether unlikely elements go, class words count, and what looks like no content is cleaned.
TRIES = ((True, True, True), (False, True, True), (False, False, True), (False, False, False))
HEADINGS = ("h1", "h2", "h3", "h4", "h5", "h6")
#: Elements of a task: those of a page stay together.
ELEMENTS = 25_000


def _dealt(df: DataFrame, name: str, key: str) -> DataFrame:
    """``df`` stored and dealt by pages over tasks of about so many elements: windows and sums over a page need no other shuffle, and what a task sorts does not grow with the table."""
    return spread(stored(df, f"article-{name}"), ELEMENTS, key)


def _is(*tags: str) -> Column:
    return F.col("tag").isin(*tags)


def _covered(condition: Column, key: str, strict: bool = False) -> Column:
    """Whether an element for which the condition holds is this one (unless ``strict``) or around it: the furthest end of those that began is not behind us."""
    before = Window.partitionBy(key).orderBy("pos").rowsBetween(Window.unboundedPreceding, -1 if strict else 0)
    return F.coalesce(F.max(F.when(condition, F.col("last"))).over(before) >= F.col("pos"), F.lit(False))


def subtree_sums(rows: DataFrame, values: dict[str, str], key: str, children: dict[str, str] | None = None) -> DataFrame:
    """Adds sums over each element and all within it: running sums over the page in order, taken where the element ends less where it begins. ``children``: aggregates over the rows (``row``) of an element's children (``kind`` 2), by name. Both are SQL.

    Each element gives a record where it begins, one where it ends and one to its parent, so the rows are read once, whatever is measured.
    """
    k = f"`{key}`"
    own = [f"coalesce(cast({v} AS double), 0.0D) AS _v_{n}" for n, v in values.items()]
    row = ", ".join(f"`{c}`" for c in rows.columns if c != key)
    mark = "explode(array(struct(pos AS of, pos AS at, 0 AS kind), struct(pos AS of, last AS at, 1 AS kind), struct(parent AS of, pos AS at, 2 AS kind))) AS m"
    marks = rows.selectExpr(k, f"struct({row}) AS row", *own, mark).selectExpr(k, "m.*", "row", *(f"_v_{n}" for n in values))
    order = f"OVER (PARTITION BY {k} ORDER BY at, kind ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    run = marks.selectExpr(k, "of", "kind", "row", *(f"_v_{n}" for n in values), *(f"sum(CASE WHEN kind = 0 THEN _v_{n} ELSE 0.0D END) {order} AS _s_{n}" for n in values))
    total = [f"max(CASE WHEN kind = 1 THEN _s_{n} END) - max(CASE WHEN kind = 0 THEN _s_{n} - _v_{n} END) AS {n}" for n in values]
    below = children or {}
    out = run.groupBy(key, "of").agg(*map(F.expr, ["first(CASE WHEN kind = 0 THEN row END, true) AS row", *total, *(f"{v} AS {n}" for n, v in below.items())]))
    return out.where("row is not null").select(key, "row.*", *values, *below)


def _in(*tags: str) -> str:
    return f"tag IN ({', '.join(repr(t) for t in tags)})"


def _chars(solid: str = "solid", words: str = "words") -> Column:
    """Characters of a text with single blanks between its words."""
    return F.col(solid) + F.greatest(F.col(words) - 1, F.lit(0))


def _prepared(elements: DataFrame, key: str) -> DataFrame:
    """What the tries look at of each element; no texts but short ones."""
    a = F.col("attrs")
    own = F.array_join(F.transform("own", lambda x: x["text"]), "")
    names = {"cls": F.coalesce(a["class"], F.lit("")), "ident": F.coalesce(a["id"], F.lit(""))}
    points = F.lit(0)
    for n, tags in TAG_POINTS.items():
        points = F.when(_is(*tags), n).otherwise(points)
    weight = lambda c: F.when(c != "", F.when(c.rlike(POSITIVE), 25).otherwise(0) - F.when(c.rlike(NEGATIVE), 25).otherwise(0)).otherwise(0)
    role = F.coalesce(a["role"], F.lit(""))
    out = elements.select(key, "pos", "last", "parent", "tag", "hidden", "up", own.alias("_own"), *(v.alias(n) for n, v in names.items()), role.alias("role"),
                          (F.coalesce(a["aria-modal"] == "true", F.lit(False)) & (role == "dialog")).alias("modal"), F.coalesce((a["rel"] == "author") | F.contains(a["itemprop"], F.lit("author")), F.lit(False)).alias("authored"),
                          F.when(F.coalesce(a["href"], F.lit("")).rlike("^#.+"), 0.3).otherwise(1.0).alias("link_part"), F.array_join(F.map_values("attrs"), " ").rlike(VIDEO).alias("video"),
                          F.when(a["role"] == "presentation", -1).when(a["datatable"] == "0", -1).when(F.coalesce(a["summary"], F.lit("")) != "", 1).otherwise(0).alias("said_data"))
    out = out.withColumns({"match": F.concat_ws(" ", "cls", "ident"), "class_weight": weight(F.col("cls")) + weight(F.col("ident")), "tag_points": points})
    short = text.collapse(F.col("_own"))
    return out.withColumns({
        "solid_own": F.length(F.regexp_replace("_own", r"(?U)\s+", "")), "words_own": F.regexp_count("_own", F.lit(r"(?U)\S+")), "commas_own": F.regexp_count("_own", F.lit(COMMAS)), "ascii_own": F.regexp_count("_own", F.lit(",")),
        "short": F.when(F.length(short) <= 120, short), "stops": F.col("_own").rlike(r"\.( |$)"),
    }).drop("_own")


def _similar(title: Column, heading: Column) -> Column:
    """How much of a heading's words a title has, by characters."""
    words = lambda c: F.filter(F.split(F.lower(c), r"\W+"), lambda w: w != "")
    size = lambda a: F.length(F.array_join(a, " "))
    theirs = F.filter(words(heading), lambda w: ~F.array_contains(words(title), w))
    return F.when((F.size(words(title)) > 0) & (F.size(words(heading)) > 0), 1 - size(theirs) / size(words(heading))).otherwise(0.0)


_COUNTS = ("solid", "words", "commas", "ascii", "blocks", "n_p", "n_img", "n_li", "n_input", "n_embed", "n_video", "n_table", "n_head_cells", "n_caption", "n_tr", "n_cells", "children", "child_p")
_SHARES = ("link_chars", "head_chars", "list_chars", "textish_chars", "n_data", "grand")


def _measured(rows: DataFrame, key: str) -> DataFrame:
    """Adds what stands within each element: characters, commas, links' share, counts of elements, the number of children and the most that one of them has, whether it is a table of data and how many of these it holds.

    A table holds data by what it says, by a caption or head cells; not if it holds tables or has one row or column; else by its size, for which columns are its cells for each row, rounded up.
    """
    framed = _in("object", "embed", "iframe")
    first = subtree_sums(rows.drop(*_COUNTS, *_SHARES, "data"), {
        "solid": "solid_own", "words": "words_own", "commas": "commas_own", "ascii": "ascii_own", "blocks": _in(*BLOCKS), "n_p": _in("p"), "n_img": _in("img"), "n_li": _in("li"), "n_input": _in("input"), "n_embed": framed, "n_video": f"{framed} AND video",
        "n_table": _in("table"), "n_head_cells": _in("col", "colgroup", "tfoot", "thead", "th"), "n_caption": f"{_in('caption')} AND words_own > 0", "n_tr": _in("tr"), "n_cells": _in("td", "th"),
    }, key, {"children": "sum(cast(kind = 2 AS int))", "child_p": "sum(cast(kind = 2 AND row.tag = 'p' AS int))"})
    columns = "ceil(n_cells / nullif(n_tr, 0))"
    size = f"coalesce(CASE WHEN {columns} <= 1 OR n_tr <= 1 THEN false ELSE n_tr >= 10 OR {columns} > 4 OR n_tr * {columns} > 10 END, false)"
    data = f"tag = 'table' AND CASE WHEN said_data <> 0 THEN said_data > 0 WHEN n_caption > 0 OR n_head_cells > 0 THEN true WHEN n_table > 1 THEN false ELSE {size} END AS data"
    chars = "solid + greatest(words - 1, 0)"
    of = lambda *tags, part="1": f"CASE WHEN {_in(*tags)} THEN ({chars}) * {part} END"
    shares = {"link_chars": of("a", part="link_part"), "head_chars": of(*HEADINGS), "list_chars": of("ul", "ol"), "textish_chars": of(*TEXTISH), "n_data": "data"}
    return subtree_sums(first.selectExpr("*", data), shares, key, {"grand": "max(CASE WHEN kind = 2 THEN row.children END)"})


def _density() -> Column:
    return F.when(_chars() > 0, F.col("link_chars") / _chars()).otherwise(0.0)


def _remaining(rows: DataFrame, condition: Column, key: str) -> DataFrame:
    return rows.withColumn("_gone", _covered(condition, key)).where("not _gone").drop("_gone")


def _scores(rows: DataFrame, weigh: bool, key: str) -> DataFrame:
    """Adds score: points of the paragraphs within, whole from children's, half from grandchildren's and less beyond, with the element's own and less its share of links; null where no paragraph is near. And para: whether it is a paragraph or a div that stands for one."""
    para = _is("p") | (_is("div") & (F.col("blocks") == 1))  # itself is the one block
    rows = rows.withColumns({"para": para, "wraps": _is("div") & (F.col("words_own") == 0) & (F.col("children") == 1) & (F.col("child_p") == 1) & (_density() < 0.25)})
    points = lambda chars, commas: 2 + commas + F.least(F.floor(chars / 100), F.lit(3))
    whole = rows.where((_is(*SCORED) | F.col("para")) & (_chars() >= PARAGRAPH)).select(key, "pos", "parent", "up", points(_chars(), F.col("commas")).alias("points"))
    # Text that stands in a div beside blocks is a paragraph of the div.
    loose = rows.where(_is("div") & ~F.col("para") & (_chars("solid_own", "words_own") >= PARAGRAPH)).select(key, "pos", F.col("pos").alias("parent"), F.concat(F.array("pos"), "up").alias("up"), points(_chars("solid_own", "words_own"), F.col("commas_own")).alias("points"))
    wrappers = rows.where("wraps").select(key, F.col("pos").alias("parent"), F.lit(True).alias("skip"))
    given = whole.unionByName(loose).join(wrappers, [key, "parent"], "left").withColumn("up", F.when(F.col("skip"), F.slice("up", 2, 5)).otherwise(F.slice("up", 1, 5)))
    level = F.col("level")
    shares = given.select(key, F.posexplode("up").alias("level", "pos"), "points").select(key, "pos", (F.col("points") / F.when(level == 0, 1).when(level == 1, 2).otherwise(level * 3)).alias("share"))
    sums = shares.groupBy(key, "pos").agg(F.sum("share").alias("given"))
    base = F.col("tag_points") + (F.col("class_weight") if weigh else F.lit(0))
    return spread(rows, ELEMENTS, key, "pos").join(sums, [key, "pos"], "left").withColumns({"score": F.when(_is("html"), None).otherwise((F.col("given") + base) * (1 - _density())), "base": base.cast("double")}).drop("given")


def _top(scored: DataFrame, key: str) -> DataFrame:
    """The container of each page's article: pos, score and where it stands; no row for pages without one or whose best is the body.

    The best five vote: where three of the others score three quarters as much, the nearest element around the best that holds three of them takes its place. Then the choice moves up while scores do not fall below a
    third, to the first that scores more, and last to containers that hold nothing else.
    """
    order = Window.partitionBy(key).orderBy(F.col("score").desc(), "pos")
    ranked = scored.where("score is not null").withColumn("place", F.row_number().over(order)).where(F.col("place") <= BEST)
    info = F.struct("pos", "last", "parent", "score", "tag", "cls")
    best = ranked.groupBy(key).agg(F.max(F.when(F.col("place") == 1, info)).alias("top"), F.collect_list(F.when(F.col("place") > 1, F.struct("pos", "score"))).alias("others"))
    best = best.where("top.tag <> 'body'").withColumn("others", F.filter("others", lambda o: o["score"] / F.col("top.score") >= CLOSE))
    around = scored.select(key, "pos", "last", "parent", "tag", "cls", "children", F.col("score").alias("s"), "base").where(~_is("html", "body"))
    held = around.join(best, key).where((F.col("pos") < F.col("top.pos")) & (F.col("last") >= F.col("top.last")))
    votes = F.size(F.filter("others", lambda o: (o["pos"] > F.col("pos")) & (o["pos"] <= F.col("last"))))
    line = F.transform(F.sort_array(F.collect_list(F.struct(F.col("pos").alias("k"), F.struct("pos", "last", "parent", "tag", "cls", "s", "base", "children", votes.alias("votes")).alias("v"))), False), lambda x: x["v"])
    lines = best.join(held.groupBy(key).agg(line.alias("line")), key, "left")
    nothing = F.array().cast(lines.schema["line"].dataType)
    lines = lines.withColumn("line", F.coalesce("line", nothing)).withColumn("n", F.size("line"))
    at = F.when(F.size("others") >= VOTES, F.array_position(F.transform("line", lambda x: x["votes"] >= VOTES), True).cast("int") - 1).otherwise(-1)
    lines = lines.withColumn("from", F.greatest(at, F.lit(-1)))
    score_at = lambda i: F.when(i < 0, F.col("top.score")).otherwise(F.coalesce(F.get("line", i)["s"], F.get("line", i)["base"]))
    start = F.struct(F.lit(0).alias("i"), F.col("from").alias("best"), score_at(F.col("from")).alias("last"), F.lit(False).alias("stop"))

    def climb(state: Column, x: Column) -> Column:
        free = (state["i"] > F.col("from")) & ~state["stop"] & x["s"].isNotNull()
        low, more = free & (x["s"] < score_at(F.col("from")) / 3), free & (x["s"] >= score_at(F.col("from")) / 3) & (x["s"] > state["last"])
        return F.struct((state["i"] + 1).alias("i"), F.when(more, state["i"]).otherwise(state["best"]).alias("best"), F.when(free, x["s"]).otherwise(state["last"]).alias("last"), (state["stop"] | low | more).alias("stop"))

    lines = lines.withColumn("to", F.aggregate("line", start, climb, lambda s: s["best"]))
    alone = lambda state, x: F.struct((state["i"] + 1).alias("i"), F.when((state["i"] == state["best"] + 1) & (x["children"] == 1), state["i"]).otherwise(state["best"]).alias("best"))
    lines = lines.withColumn("to", F.aggregate("line", F.struct(F.lit(0).alias("i"), F.col("to").alias("best")), alone, lambda s: s["best"]))
    to = F.get("line", F.col("to"))
    own = lambda c: F.when(F.col("to") < 0, F.col("top")[c]).otherwise(to[c])
    return lines.select(key, own("pos").alias("top_pos"), own("parent").alias("top_parent"), own("cls").alias("top_cls"), score_at(F.col("to")).alias("top_score"))


def _chosen(scored: DataFrame, top: DataFrame, key: str) -> DataFrame:
    """The elements of the articles: the containers and those of their siblings that score a fifth as much or read as prose, with all within them; whole pages where there is no container."""
    rows = scored.join(top, key, "left")
    prose = F.col("para") & (((_chars() > 80) & (_density() < 0.25)) | ((_chars() < 80) & (_chars() > 0) & (_density() == 0) & F.col("stops")))
    bonus = F.when((F.col("cls") == F.col("top_cls")) & (F.col("cls") != ""), F.col("top_score") * 0.2).otherwise(0.0)
    enough = F.coalesce(F.col("score") + bonus >= F.greatest(F.lit(10.0), F.col("top_score") * 0.2), F.lit(False))
    begins = (F.col("pos") == F.col("top_pos")) | ((F.col("parent") == F.col("top_parent")) & (enough | prose))
    root = F.col("top_pos").isNull()
    return rows.withColumn("begins", F.coalesce(begins, F.lit(False))).withColumn("_in", root | _covered(F.col("begins"), key)).where("_in").drop("_in", "para", "wraps", "score", "base")


def _no_content(rows: DataFrame, tags: tuple[str, ...], weigh: bool, key: str) -> DataFrame:
    """Rows without those of the named elements that look like no content: bad class words, or few commas and too many links, images, items, fields or frames for their paragraphs."""
    marked = _measured(rows, key).withColumns({"in_data": _covered(F.col("data"), key, True), "in_code": _covered(_is("code"), key, True), "in_figure": _covered(_is("figure"), key, True)})
    c, chars, links = F.col, _chars(), _density()
    weight = c("class_weight") if weigh else F.lit(0)
    is_list = _is("ul", "ol") | ((chars > 0) & (c("list_chars") / chars > 0.9))
    inner = lambda n, tag: c(n) - _is(tag).cast("int")
    odd = (
        (~c("in_figure") & (c("n_img") > 1) & (inner("n_p", "p") / c("n_img") < 0.5)) | (~is_list & (inner("n_li", "li") - 100 > inner("n_p", "p"))) | (c("n_input") > F.floor(inner("n_p", "p") / 3))
        | (~is_list & ~c("in_figure") & (F.when(chars > 0, c("head_chars") / chars).otherwise(0.0) < 0.9) & (chars < 25) & ((c("n_img") == 0) | (c("n_img") > 2)) & (links > 0))
        | (~is_list & (weight < 25) & (links > 0.2)) | ((weight >= 25) & (links > 0.5)) | ((c("n_embed") == 1) & (chars < 75)) | (c("n_embed") > 1)
        | ((c("n_img") == 0) & (c("textish_chars") - F.when(_is(*TEXTISH), chars).otherwise(0) <= 0))
    )
    pictures = is_list & (F.coalesce(c("grand"), F.lit(0)) <= 1) & (c("n_img") == inner("n_li", "li"))
    suspect = F.when(c("words") == c("words_own"), F.coalesce(c("short").rlike(AD_WORDS), F.lit(False))).otherwise(False)
    remove = F.when(c("data") | c("in_data") | c("in_code") | (c("n_data") > 0), False).when(weight < 0, True).when(c("ascii") >= 10, False).when(c("n_video") > 0, False).when(suspect, True).otherwise(odd & ~pictures)
    return _remaining(marked, _is(*tags) & remove, key).drop("in_data", "in_code", "in_figure")


def _attempt(rows: DataFrame, flags: tuple[bool, bool, bool], key: str) -> DataFrame:
    """Elements of the articles of one try: key, pos."""
    strip, weigh, clean = flags
    tabled = _covered(_is("table", "code"), key, True)
    unlikely = F.col("match").rlike(UNLIKELY) & ~F.col("match").rlike(MAYBE) & ~F.col("tabled") & ~_is("body", "a", "html")
    kept = rows.withColumn("tabled", tabled)
    if strip:
        kept = _remaining(kept, unlikely | F.col("role").isin(*ROLES), key)
    measured = _dealt(_measured(kept, key), "measures", key)
    empty = _is("div", "section", "header", *HEADINGS) & (F.col("words") == 0) & (F.col("children") == 0)
    scored = _dealt(_scores(_dealt(_measured(_remaining(measured, empty, key), key), "sums", key), weigh, key), "scores", key)
    chosen = _chosen(scored, _top(scored, key), key)
    if clean:
        chosen = _no_content(chosen, ("form", "fieldset"), weigh, key)
    shared = ~F.col("begins") & F.col("match").rlike(SHARE) & (_chars() < ENOUGH)
    gone = (_is("object", "embed", "iframe") & ~F.col("video")) | _is("footer", "link", "aside", "input", "textarea", "select", "button") | shared
    if weigh:
        gone = gone | (_is("h1", "h2") & (F.col("class_weight") < 0))
    chosen = _dealt(_remaining(chosen, gone, key), "chosen", key)
    if clean:
        chosen = _no_content(_dealt(_no_content(chosen, ("table", "ul"), weigh, key), "cleaned", key), ("div",), weigh, key)
    return chosen.select(key, "pos")


def _object(json: Column) -> Column:
    return F.from_json(json, "map<string,string>")


def metadata(pages: DataFrame, elements: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """Title, byline, excerpt, site name and date of each page, from linked data (the first object of an article type of schema.org), else from meta elements, else the title element."""
    scripts = F.regexp_extract_all(F.coalesce(F.col(html), F.lit("")), F.lit(r"(?is)<script[^>]*type\s*=\s*[\"']?application/ld\+json[\"']?[^>]*>(.*?)</script>"), 1)
    bare = pages.select(key, F.posexplode(scripts).alias("n", "raw")).withColumn("raw", F.regexp_replace("raw", r"^\s*<!\[CDATA\[|\]\]>\s*$", ""))
    graph = F.get_json_object("raw", "$.@graph")
    typed = lambda j: F.coalesce(F.get_json_object(j, "$.@type").rlike(ARTICLE_TYPES), F.lit(False))
    first = lambda listed: F.get(F.filter(F.from_json(listed, "array<string>"), typed), 0)
    is_list = F.startswith(F.ltrim("raw"), F.lit("["))
    picked = bare.withColumn("o", F.when(is_list, first(F.col("raw"))).otherwise(F.col("raw")))
    context = F.coalesce(F.get_json_object("o", "$.@context.@vocab"), F.get_json_object("o", "$.@context"))
    # Of an object without a type, the graph within.
    picked = picked.where(context.rlike(r"^https?://schema\.org/?$")).withColumn("o", F.when(F.get_json_object("o", "$.@type").isNull() & graph.isNotNull(), first(graph)).otherwise(F.col("o"))).where(typed(F.col("o")))
    get = lambda path: F.nullif(text.strip(F.get_json_object("o", path)), F.lit(""))
    authors = F.array_join(F.transform(F.from_json(F.get_json_object("o", "$.author"), "array<struct<name:string>>"), lambda x: text.strip(x["name"])), ", ")
    names = {"name": get("$.name"), "headline": get("$.headline"), "l_byline": F.coalesce(get("$.author.name"), F.when(F.startswith(F.get_json_object("o", "$.author"), F.lit("[")), F.nullif(authors, F.lit("")))), "l_excerpt": get("$.description"), "l_site": get("$.publisher.name"), "l_date": get("$.datePublished")}
    linked = picked.groupBy(key).agg(F.min_by(F.struct(*(v.alias(n) for n, v in names.items())), "n").alias("x")).select(key, "x.*")
    a = F.col("attrs")
    wanted = F.lower(F.coalesce(a["property"], a["name"]))
    of = lambda *properties: F.coalesce(*(F.min_by(F.when(wanted == p, text.collapse(a["content"])), F.when(wanted == p, F.col("pos"))) for p in properties))
    metas = elements.where("tag = 'meta'").groupBy(key).agg(of("dc:title", "dcterm:title", "og:title", "weibo:article:title", "weibo:webpage:title", "title", "twitter:title", "parsely-title").alias("m_title"), of("dc:creator", "dcterm:creator", "author", "parsely-author").alias("m_byline"),
        of("dc:description", "dcterm:description", "og:description", "weibo:article:description", "weibo:webpage:description", "description", "twitter:description").alias("m_excerpt"), of("og:site_name").alias("m_site"), of("article:published_time", "parsely-pub-date").alias("m_date"))
    titles = elements.where("tag = 'title'").groupBy(key).agg(F.min_by("text", "pos").alias("page_title"))
    out = pages.select(key).join(linked, key, "left").join(metas, key, "left").join(titles, key, "left")
    page = F.coalesce("page_title", F.lit(""))
    both = F.col("name").isNotNull() & F.col("headline").isNotNull() & (F.col("name") != F.col("headline"))
    title = F.when(both & (_similar(F.col("headline"), page) > SIMILAR) & ~(_similar(F.col("name"), page) > SIMILAR), F.col("headline")).otherwise(F.coalesce("name", "headline"))
    given = lambda *c: F.coalesce(*(F.nullif(F.col(x) if isinstance(x, str) else x, F.lit("")) for x in c))
    return out.select(key, given(title, "m_title", "page_title").alias("title"), given("l_byline", "m_byline").alias("byline"), given("l_excerpt", "m_excerpt").alias("excerpt"), given("l_site", "m_site").alias("site_name"), given("l_date", "m_date").alias("published"))


def articles(pages: DataFrame, elements: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """The article of each page: key, attempt (1 to 4), length, text, title, byline, excerpt, site_name, published. Pages without any text have no row.

    ``elements`` is what ``html.parsed(pages, article=True)`` gives. What is hidden, a byline and the heading that repeats the title go first. A try then removes unlikely elements, scores containers by their paragraphs, chooses one with its siblings and cleans it
    of what looks like no content. A page whose article has under 500 characters is tried again without the first removal, then without class words, and then without cleaning; only such pages are in the next
    try, and the longest of the four is taken in the end. All measures are sums over ranges of places (``subtree_sums``), so a page costs no more than its elements, however deep.

    Characters are counted with one blank between words. Elements that are not kept by the parser (``em``, ``b`` and such) are part of the text around them. Cleaning judges all elements of one name together, by what
    stood in them before.
    """
    about = stored(metadata(pages, elements, key, html), "article-metadata")
    rows = _prepared(spread(elements, ELEMENTS, key), key).where(~_is("meta", "title", "link"))
    seen = _remaining(rows, F.col("hidden") | F.col("modal"), key).join(about.select(key, "title", F.col("byline").alias("said_by")), key, "left")
    sized = subtree_sums(seen, {"solid": "solid_own", "words": "words_own"}, key)
    doc = Window.partitionBy(key)
    repeats = _is("h1", "h2") & (_similar(F.coalesce("title", F.lit("")), F.coalesce("short", F.lit(""))) > SIMILAR)
    signed = F.col("said_by").isNull() & (F.col("authored") | F.col("match").rlike(BYLINE)) & (_chars() > 0) & (_chars() < 100) & ~_is("body", "html")
    firsts = sized.withColumns({"_head": F.min(F.when(repeats, F.col("pos"))).over(doc), "_by": F.min(F.when(signed, F.struct("pos", "last"))).over(doc)})
    whole = _dealt(firsts, "elements", key)
    bylines = stored(_pieces(whole.where("pos between _by.pos and _by.last").select(key, "pos"), elements, key), "article-bylines").select(key, F.col("text").alias("found_by"))
    left = _dealt(_remaining(whole, (F.col("pos") == F.coalesce("_head", F.lit(-1))) | (F.col("pos") == F.coalesce(F.col("_by.pos"), F.lit(-1))), key).drop("_head", "_by", "title", "said_by", "solid", "words"), "rest", key)
    tries, todo = [], left
    for n, flags in enumerate(TRIES, 1):
        found = stored(_pieces(_attempt(todo, flags, key), elements, key).withColumn("attempt", F.lit(n)), "article-try")
        tries.append(found)
        if n < len(TRIES):
            todo = _dealt(todo.join(found.where(F.col("length") >= ENOUGH).select(key), key, "left_anti"), "rest", key)
            if todo.isEmpty():
                break
    made = tries[0]
    for t in tries[1:]:
        made = made.unionByName(t)
    best = made.groupBy(key).agg(F.max(F.struct((F.col("length") >= ENOUGH).alias("enough"), "length", (-F.col("attempt")).alias("n"), "text")).alias("b")).where("b.length > 0")
    out = best.select(key, (-F.col("b.n")).alias("attempt"), F.col("b.length").alias("length"), F.col("b.text").alias("text")).join(about, key, "left").join(bylines, key, "left")
    return out.select(key, "attempt", "length", "text", "title", F.coalesce("byline", "found_by").alias("byline"), "excerpt", "site_name", "published")


def _pieces(kept: DataFrame, elements: DataFrame, key: str) -> DataFrame:
    """The text of the kept elements of each page, in order: key, text, length."""
    texts = spread(elements.select(key, "pos", "own"), ELEMENTS, key, "pos")
    parts = _dealt(kept.join(texts, [key, "pos"]).select(key, "own"), "texts", key).select(key, F.explode("own").alias("x"))
    joined = text.collapse(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("x.at", "x.text"))), lambda x: x["text"]), ""))
    return parts.groupBy(key).agg(joined.alias("text")).withColumn("length", F.length("text"))
