"""Files of all supported kinds as pages of text, and tabular ones as tables."""

from __future__ import annotations

import io
import posixpath
import re
import zipfile
from collections.abc import Iterator
from datetime import datetime, time, timedelta
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions import text
from tessera.operators import sectioning
from tessera.shipping import ship
from tessera.sources import markdown

# Kinds of files that can be read here, and the limits of an archive's entries.
TEXT_KINDS = ("txt", "text", "csv", "json", "jsonl", "xml", "html", "htm")
MARKUP_KINDS = ("html", "htm")
ARCHIVE_KINDS = ("docx", "xlsx", "pptx")
#: Kinds that need a program of their own: a reader can be given for them.
OTHER_KINDS = ("pdf", "doc", "ppt", "xls")
MAX_ENTRY, MAX_TOTAL = 64 << 20, 512 << 20

PAGE = "path string, page_num int, text string, error string"


def kind(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([^./\\]+)$", 1))


def files(spark: SparkSession, path: str) -> DataFrame:
    """The files under a path with their kind, size and digest; content is read only where it is used. Unknown kinds are marked."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    k = kind(F.col("path"))
    return found.select("path", k.alias("kind"), F.col("length").alias("size"), "modificationTime", F.sha2("content", 256).alias("sha256"), k.isin(*TEXT_KINDS, *ARCHIVE_KINDS, *OTHER_KINDS).alias("supported"), "content")


def _checked(data: bytes) -> zipfile.ZipFile:
    """The archive, if its directory promises no more than the limits."""
    archive = zipfile.ZipFile(io.BytesIO(data))
    sizes = [e.file_size for e in archive.infolist()]
    if max(sizes, default=0) > MAX_ENTRY or sum(sizes) > MAX_TOTAL:
        raise ValueError("the archive is too large unpacked")
    return archive


def _name(element: ElementTree.Element) -> str:
    return element.tag.rpartition("}")[2]


def _lists(archive: zipfile.ZipFile) -> dict[tuple[str, str], tuple[str, int]]:
    """Of each numbering and level of a word document its format and first number."""
    if "word/numbering.xml" not in archive.namelist():
        return {}
    of = lambda e, name: next((v for k, v in e.attrib.items() if _name_of(k) == name), "")
    inner = lambda e, name: next((of(x, "val") for x in e if _name(x) == name), "")
    root = ElementTree.fromstring(archive.read("word/numbering.xml"))
    kinds = {of(a, "abstractNumId"): {of(v, "ilvl"): (inner(v, "numFmt"), int(inner(v, "start") or 1)) for v in a if _name(v) == "lvl"} for a in root if _name(a) == "abstractNum"}
    return {(of(n, "numId"), level): x for n in root if _name(n) == "num" for level, x in kinds.get(inner(n, "abstractNumId"), {}).items()}


class _Numbers:
    """The marks of list paragraphs, in order: bullets, or numbers that go on in their list until a paragraph of a level above comes."""

    def __init__(self, lists: dict[tuple[str, str], tuple[str, int]]) -> None:
        self.lists, self.at = lists, {}

    def mark(self, paragraph: ElementTree.Element) -> str:
        number = next((x for x in paragraph.iter() if _name(x) == "numPr"), None)
        if number is None:
            return ""
        value = {_name(x): next((v for k, v in x.attrib.items() if _name_of(k) == "val"), "") for x in number}
        key = value.get("numId", ""), value.get("ilvl", "0")
        if key[0] in ("", "0"):
            return ""
        kind, start = self.lists.get(key, ("bullet", 1))
        depth = int(key[1]) if key[1].isdigit() else 0
        self.at = {k: n for k, n in self.at.items() if k[0] != key[0] or int(k[1]) <= depth}
        self.at[key] = self.at.get(key, start - 1) + 1
        return "  " * depth + ("- " if kind in ("bullet", "none", "") else f"{self.at[key]}. ")


def _paragraphs(root: ElementTree.Element, numbers: _Numbers | None = None) -> Iterator[str]:
    """Paragraphs of a word processor's body, headings with their signs, list paragraphs with their marks, tables as rows in bars."""
    numbers = numbers or _Numbers({})
    for e in root:
        if _name(e) == "p":
            style = next((v for x in e.iter() if _name(x) == "pStyle" for k, v in x.attrib.items() if k.endswith("val")), "")
            words = "".join(x.text or "" for x in e.iter() if _name(x) == "t")
            level = re.fullmatch(r"[Hh]eading\s?([1-6])", style)
            if words.strip():
                yield ("#" * int(level[1]) + " " if level else numbers.mark(e)) + words
        elif _name(e) == "tbl":
            rows = [["".join(x.text or "" for x in c.iter() if _name(x) == "t").replace("|", "¦") for c in r if _name(c) == "tc"] for r in e if _name(r) == "tr"]
            for i, row in enumerate(rows):
                yield "| " + " | ".join(row) + " |" + ("\n|" + "---|" * len(row) if i == 0 else "")
        else:
            yield from _paragraphs(e, numbers)


def _docx_paragraphs(data: bytes) -> list[tuple]:
    """Paragraphs with the level of their heading style (0 for none) and the package paths of the images in them."""
    with _checked(data) as archive:
        body = ElementTree.fromstring(archive.read("word/document.xml"))
        rels = ElementTree.fromstring(archive.read("word/_rels/document.xml.rels")) if "word/_rels/document.xml.rels" in archive.namelist() else ()
    inside = {}
    for r in rels:
        target = r.get("Target", "").replace("\\", "/").strip()
        if target and r.get("TargetMode", "").lower() != "external" and ("image" in r.get("Type", "").lower() or target.lower().startswith("media/")):
            inside[r.get("Id")] = posixpath.normpath(target.lstrip("/") if target.startswith("/") else f"word/{target}")
    attribute = lambda x, name: next((v for k, v in x.attrib.items() if _name_of(k) == name), "")
    out = []
    for i, p in enumerate(e for e in body.iter() if _name(e) == "p"):
        style = next((attribute(x, "val") for x in p.iter() if _name(x) == "pStyle"), "").lower()
        number = re.search("[1-6]", style)
        level = (min(int(number[0]), 3) if number else 1) if any(w in style for w in ("heading", "标题", "title")) else 0
        used = [attribute(x, "embed") if _name(x) == "blip" else attribute(x, "id") for x in p.iter() if _name(x) in ("blip", "imagedata")]
        out.append((i, "".join(x.text or "" for x in p.iter() if _name(x) == "t").strip(), level, [inside[u] for u in dict.fromkeys(used) if u in inside]))
    return out


def _name_of(qualified: str) -> str:
    return qualified.rpartition("}")[2]


def docx_paragraphs(found: DataFrame) -> DataFrame:
    """Paragraphs of the word processor files among those of ``files``: path, idx, text, style_level, images (package paths). A damaged file has none."""
    ship(found.sparkSession)

    def read(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in it:
            out = []
            for path, content in zip(batch["path"], batch["content"], strict=True):
                try:
                    out += [(path, *p) for p in _docx_paragraphs(content)]
                except (ValueError, KeyError, zipfile.BadZipFile, ElementTree.ParseError):
                    continue
            yield pd.DataFrame(out, columns=["path", "idx", "text", "style_level", "images"])

    return found.where("kind = 'docx'").select("path", "content").mapInPandas(read, "path string, idx int, text string, style_level int, images array<string>")


#: Paragraphs before and after an image that are its context, and characters of that.
BEFORE, AFTER, CONTEXT_CHARS = 4, 3, 1200


def docx_images(paragraphs: DataFrame, path: str = "path") -> DataFrame:
    """Images of documents given as ``docx_paragraphs``: path, image_no (from 1), target, paragraph, near_heading, paragraph_text, context_text.

    The heading is the last one before or at the image, by style or by its number; the context is the paragraphs around it.
    """
    order = Window.partitionBy(path).orderBy("idx")
    levelled = sectioning.with_levels(paragraphs, "text").withColumn("_heading", F.when((F.col("text") != "") & ((F.col("style_level") > 0) | (F.col("level") > 0)), F.col("text")))
    near = F.coalesce(F.last("_heading", ignorenulls=True).over(order), F.lit(""))
    around = F.array_join(F.filter(F.collect_list("text").over(order.rowsBetween(-BEFORE, AFTER)), lambda t: t != ""), "\n")
    told = levelled.select(path, "idx", "text", "images", near.alias("near_heading"), F.substring(around, 1, CONTEXT_CHARS).alias("context_text"))
    each = told.select(path, "idx", "text", "near_heading", "context_text", F.posexplode("images").alias("_nth", "target"))
    number = F.row_number().over(Window.partitionBy(path).orderBy("idx", "_nth"))
    return each.select(path, number.alias("image_no"), "target", F.col("idx").alias("paragraph"), "near_heading", F.col("text").alias("paragraph_text"), "context_text")


def docx_image_count(paragraphs: DataFrame, path: str = "path") -> DataFrame:
    """How many images each document refers to, those of one paragraph once each: path, images."""
    return paragraphs.groupBy(path).agg(F.sum(F.size("images")).alias("images"))


def docx_media(found: DataFrame, target: str = "word/media/") -> DataFrame:
    """The parts of office files under a folder of the package: path, target, content. Archives that unpack too large are left out."""
    ship(found.sparkSession)

    def read(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in it:
            for path, content in zip(batch["path"], batch["content"], strict=True):
                try:
                    with _checked(content) as archive:
                        names = [n for n in archive.namelist() if n.startswith(target)]
                        yield pd.DataFrame([(path, n, archive.read(n)) for n in names], columns=["path", "target", "content"])
                except (ValueError, zipfile.BadZipFile):
                    continue

    return found.where(F.col("kind").isin(*ARCHIVE_KINDS)).select("path", "content").mapInPandas(read, "path string, target string, content binary")


def _docx(data: bytes) -> list[str]:
    with _checked(data) as archive:
        body, numbers = ElementTree.fromstring(archive.read("word/document.xml")), _Numbers(_lists(archive))
    return ["\n".join(_paragraphs(body, numbers))]


def _pptx(data: bytes) -> list[str]:
    with _checked(data) as archive:
        slides = sorted((n for n in archive.namelist() if re.fullmatch(r"ppt/slides/slide\d+\.xml", n)), key=lambda n: int(re.search(r"\d+", n.rpartition("/")[2])[0]))
        return ["\n".join("".join(t.text or "" for t in p.iter() if _name(t) == "t") for p in ElementTree.fromstring(archive.read(n)).iter() if _name(p) == "p").strip() for n in slides]


# Built-in number formats that are dates, and the day that serial 0 is.
_DATE_FORMATS, _DAY_ZERO = frozenset([*range(14, 23), *range(27, 37), *range(45, 48), *range(50, 59)]), datetime(1899, 12, 30)


def _date_styles(archive: zipfile.ZipFile) -> list[bool]:
    """Of each cell style whether its number format is a date."""
    if "xl/styles.xml" not in archive.namelist():
        return []
    root = ElementTree.fromstring(archive.read("xl/styles.xml"))
    own = {int(x.get("numFmtId", "0")): re.sub(r'"[^"]*"|\\.|\[[^\]]*\]', "", x.get("formatCode", "")) for x in root.iter() if _name(x) == "numFmt"}
    dates = lambda n: n in _DATE_FORMATS or bool(re.search("[ymdhs]", own.get(n, "").lower()))
    return [dates(int(x.get("numFmtId", "0"))) for xfs in root if _name(xfs) == "cellXfs" for x in xfs]


def _cell(value: str, kind: str | None, style: str | None, shared: list[str], dates: list[bool]) -> str:
    """What a cell shows: shared texts by number, truth values in words, dates in ISO form, whole numbers without a fraction."""
    if kind == "s" and value:
        return shared[int(value)]
    if kind == "b":
        return {"1": "TRUE", "0": "FALSE"}.get(value, value)
    if kind in (None, "n") and value:
        try:
            number = float(value)
        except ValueError:
            return value
        if style and style.isdigit() and int(style) < len(dates) and dates[int(style)] and 0 <= number < 2_958_466:
            at = _DAY_ZERO + timedelta(seconds=round(number * 86_400))
            return at.strftime("%H:%M:%S") if number < 1 else at.strftime("%Y-%m-%d" if at.time() == time() else "%Y-%m-%d %H:%M:%S")
        return str(int(number)) if number.is_integer() and abs(number) < 1e15 else value
    return value


def _xlsx(data: bytes) -> list[str]:
    """Each sheet as a heading and a table in bars."""
    with _checked(data) as archive:
        names = archive.namelist()
        shared = ["".join(t.text or "" for t in si.iter() if _name(t) == "t") for si in ElementTree.fromstring(archive.read("xl/sharedStrings.xml"))] if "xl/sharedStrings.xml" in names else []
        rels = {r.get("Id"): r.get("Target", "") for r in ElementTree.fromstring(archive.read("xl/_rels/workbook.xml.rels"))} if "xl/_rels/workbook.xml.rels" in names else {}
        dates = _date_styles(archive)
        sheets = [s for s in ElementTree.fromstring(archive.read("xl/workbook.xml")).iter() if _name(s) == "sheet"]
        out = []
        for i, sheet in enumerate(sheets, 1):
            title, target = sheet.attrib["name"], rels.get(next((v for k, v in sheet.attrib.items() if _name_of(k) == "id" and "}" in k), ""), "")
            part = posixpath.normpath(target.lstrip("/") if target.startswith("/") else f"xl/{target}") if target else f"xl/worksheets/sheet{i}.xml"
            rows = []
            for row in (r for r in ElementTree.fromstring(archive.read(part)).iter() if _name(r) == "row"):
                cells: dict[int, str] = {}
                for c in row:
                    column = 0
                    for letter in re.match("[A-Z]*", c.attrib.get("r", ""))[0]:
                        column = column * 26 + ord(letter) - 64
                    value = "".join(x.text or "" for x in c.iter() if _name(x) in ("v", "t"))
                    cells[column or len(cells) + 1] = _cell(value, c.attrib.get("t"), c.attrib.get("s"), shared, dates)
                rows.append([cells.get(k, "") for k in range(1, max(cells, default=0) + 1)])
            width = max(map(len, rows), default=0)
            lines = ["| " + " | ".join(v.replace("|", "¦") for v in r + [""] * (width - len(r))) + " |" for r in rows]
            out.append("\n".join([f"## {title}", *lines[:1], *(["|" + "---|" * width] if lines else []), *lines[1:]]))
    return out


_READERS = {"docx": _docx, "pptx": _pptx, "xlsx": _xlsx}


def pages(found: DataFrame, readers: dict | None = None) -> DataFrame:
    """Pages of the files of ``files``: path, page_num, text, error.

    Texts are one page, decoded in the JVM, and HTML becomes Markdown; office files are read by their task, a sheet or slide a page. A file that can't
    be read gives a page with the error instead of ending the job. ``readers`` has functions of other kinds: bytes in, texts of pages out.
    """
    ship(found.sparkSession)
    mine = _READERS | (readers or {})
    body = F.regexp_replace(F.col("content").cast("string"), "^\ufeff", "")
    shown = F.when(F.col("kind").isin(*MARKUP_KINDS), markdown.from_html(body)).otherwise(body)
    plain = found.where(F.col("kind").isin(*TEXT_KINDS)).select("path", F.lit(1).alias("page_num"), shown.alias("text"), F.lit(None).cast("string").alias("error"))

    def read(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in it:
            out = []
            for path, k, content in zip(batch["path"], batch["kind"], batch["content"], strict=True):
                try:
                    out += [(path, i, t, None) for i, t in enumerate(mine[k](content), 1)]
                except Exception as e:  # a damaged file is a row of its own
                    out.append((path, 1, None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(out, columns=["path", "page_num", "text", "error"])

    office = found.where(F.col("kind").isin(*mine)).select("path", "kind", "content").mapInPandas(read, PAGE)
    missing = found.where(~F.col("kind").isin(*TEXT_KINDS, *mine)).select("path", F.lit(1).alias("page_num"), F.lit(None).cast("string").alias("text"), F.concat(F.lit("no reader for "), "kind").alias("error"))
    return plain.unionByName(office).unionByName(missing)


def csv_markdown(spark: SparkSession, path: str) -> DataFrame:
    """A CSV file with header as a Markdown table by file, read by Spark's own reader."""
    rows = spark.read.csv(path, header=True).withColumn("_path", F.input_file_name()).withColumn("_at", F.monotonically_increasing_id())
    columns = [c for c in rows.columns if c not in ("_path", "_at")]
    line = F.concat(F.lit("| "), F.concat_ws(" | ", *(F.replace(F.coalesce(F.col(f"`{c}`"), F.lit("")), F.lit("|"), F.lit("¦")) for c in columns)), F.lit(" |"))
    head = "| " + " | ".join(columns) + " |\n|" + "---|" * len(columns) + "\n"
    return rows.groupBy("_path").agg(F.concat(F.lit(head), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_at", line.alias("l")))), lambda x: x["l"]), "\n")).alias("text")).withColumnRenamed("_path", "path")


def named(found: DataFrame) -> DataFrame:
    """Files with the document id that their name gives."""
    return found.withColumn("filename", F.regexp_extract("path", r"([^/\\]+)$", 1)).withColumn("id", text.document_id(F.col("filename")))
