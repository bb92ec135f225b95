"""Text expressions: Column in, Column out, all evaluated in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Characters that count as white space at the ends of a text, Unicode ones included.
_EDGE = r"(?U)^\s+|\s+$"


def strip(text: Column) -> Column:
    """Without white space of any kind at either end."""
    return F.regexp_replace(text, _EDGE, "")


def rstrip(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)\s+$", "")


def collapse(text: Column) -> Column:
    """Runs of white space as one space, none at the ends."""
    return F.regexp_replace(strip(text), r"(?U)\s+", " ")


def normalize(text: Column) -> Column:
    """One kind of line end, no runs of blanks, at most one empty line, none at the ends."""
    lines = F.regexp_replace(text, "\r\n|\r", "\n")
    return strip(F.regexp_replace(F.regexp_replace(lines, "[ \t]{2,}", " "), "\n{3,}", "\n\n"))


def _last(text: Column, mark: str) -> Column:
    """Place of the last ``mark``, from 0; -1 where there is none."""
    at = F.instr(F.reverse(text), mark[::-1])
    return F.when(at == 0, -1).otherwise(F.length(text) - at - (len(mark) - 1))


def clip(text: Column, most: int | Column) -> Column:
    """At most that many characters; a cut goes back to the last empty line beyond 60 % of them."""
    most = F.lit(most) if isinstance(most, int) else most
    cut = F.substring(text, F.lit(1), most.cast("int"))
    last = _last(cut, "\n\n")
    short = F.when(last > most * 0.6, F.substring(cut, F.lit(1), last.cast("int"))).otherwise(cut)
    return F.when(F.length(text) <= most, text).otherwise(strip(short))


def smart_truncate(text: Column, most: int) -> Column:
    """At most that many characters and an ellipsis; a cut goes back to the last space beyond 60 % of them."""
    cut = F.substring(text, 1, most)
    last = _last(cut, " ")
    short = F.when(last > most * 0.6, F.substring(cut, F.lit(1), last.cast("int"))).otherwise(cut)
    return F.when(F.length(text) <= most, text).otherwise(F.concat(rstrip(short), F.lit("…")))


def text_hash(text: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(text, 256))


def web_section_id(heading: Column, text: Column) -> Column:
    """Stable id of a web section, from its heading and the first 400 characters of its text without regard to case and spacing."""
    anchor = F.substring(F.lower(collapse(F.coalesce(text, F.lit("")))), 1, 400)
    return F.concat(F.lit("s_"), F.substring(F.sha1(F.concat(F.lower(strip(F.coalesce(heading, F.lit("")))), F.lit("\n"), anchor)), 1, 10))


def section_id(title: Column, text: Column) -> Column:
    """Id of a document section, from its title and the first 200 characters of its text as they are."""
    return F.substring(F.sha1(F.concat(F.coalesce(title, F.lit("")), F.substring(F.coalesce(text, F.lit("")), 1, 200))), 1, 12)


_CJK = "[\\x{4E00}-\\x{9FFF}]"


def token_estimate(text: Column) -> Column:
    """Tokens of a text, at 2.5 characters each where they are Chinese and at 4 elsewhere, rounded down."""
    n = F.length(text)
    share = F.regexp_count(text, F.lit(_CJK)) / F.greatest(n, F.lit(1))
    return F.floor(n / (F.lit(2.5) * share + F.lit(4.0) * (F.lit(1.0) - share))).cast("long")


def detect_locale(text: Column) -> Column:
    """zh where the first 20,000 characters have 20 Chinese ones, or more of them than ASCII letters; en elsewhere."""
    head = F.substring(text, 1, 20_000)
    cjk = F.regexp_count(head, F.lit(_CJK))
    return F.when((cjk >= 20) | (cjk > F.regexp_count(head, F.lit("[A-Za-z]"))), "zh").otherwise("en")


def snippet(text: Column, query: str, radius: int = 90) -> Column:
    """The text around the first place of the query, without regard to case, with dots where it is cut; its beginning where the query is missing."""
    hay = strip(F.coalesce(text, F.lit("")))
    at = F.instr(F.lower(hay), query.lower()) - 1
    start, end = F.greatest(F.lit(0), at - radius), F.least(F.length(hay), at + len(query) + radius)
    inner = strip(F.substring(hay, (start + 1).cast("int"), (end - start).cast("int")))
    around = F.concat(F.when(start > 0, "...").otherwise(""), inner, F.when(end < F.length(hay), "...").otherwise(""))
    return F.when(at < 0, strip(F.substring(hay, 1, 2 * radius))).otherwise(around)


def contains(text: Column, query: str, case_sensitive: bool = False) -> Column:
    """Whether the query occurs in the text; false for null."""
    found = F.contains(text, F.lit(query)) if case_sensitive else F.contains(F.lower(text), F.lit(query.lower()))
    return F.coalesce(found, F.lit(False))


def page_start(page_range: Column) -> Column:
    """First page of ``p.5-12``, ``p.5`` or ``5-12``; null for anything else."""
    found = F.regexp_extract(strip(page_range), r"^(?:p\.)?([0-9]+)(?:-[0-9]+)?$", 1)
    return F.when(found != "", found.cast("int"))


def page_end(page_range: Column) -> Column:
    first, last = page_start(page_range), F.regexp_extract(strip(page_range), r"^(?:p\.)?[0-9]+-([0-9]+)$", 1)
    return F.when(last != "", last.cast("int")).otherwise(first)


def heading_key(text: Column) -> Column:
    """A heading without white space and separators, in lower case, for comparison."""
    return F.lower(F.regexp_replace(text, r"(?U)[\s.．、:：)）\-_]+", ""))


def plain_heading(text: Column) -> Column:
    """A heading without Markdown's number signs and emphasis."""
    out = F.regexp_replace(strip(text), r"^#{1,6}\s*", "")
    out = F.regexp_replace(out, r"^\*{1,3}(.+?)\*{1,3}$", "$1")
    return strip(F.regexp_replace(out, r"^_{1,3}(.+?)_{1,3}$", "$1"))


def markdown_level(line: Column) -> Column:
    """Number of signs that begin a Markdown heading; null for other lines."""
    marks = F.regexp_extract(line, r"^(#{1,6})\s+\S", 1)
    return F.when(marks != "", F.length(marks))


def polluted_heading(text: Column) -> Column:
    """Whether a heading looks like running text: it ends as a sentence does, or is long and ends with a colon or semicolon."""
    t = strip(text)
    return F.endswith(t, F.lit("。")) | ((F.length(t) > 30) & F.substring(t, -1, 1).isin("：", ":", "；", ";"))


def safe_name(text: Column, most: int = 80) -> Column:
    """A name for a file: no characters that paths forbid, blanks as hyphens, cut."""
    return F.substring(F.regexp_replace(F.regexp_replace(strip(text), r"[\\/:*?\"<>|\x00-\x1f]", ""), r"(?U)\s+", "-"), 1, most)


def document_id(filename: Column, most: int = 80) -> Column:
    """A document id from a file's name: its stem, blanks, dots and underscores as hyphens, nothing but ASCII letters, digits and hyphens."""
    stem = F.regexp_replace(filename, r"\.[^.]*$", "")
    out = F.regexp_replace(F.regexp_replace(stem, r"(?U)[\s._]+", "-"), "[^A-Za-z0-9-]", "")
    return F.regexp_replace(F.substring(F.regexp_replace(F.regexp_replace(out, "-{2,}", "-"), "^-+|-+$", ""), 1, most), "-+$", "")


def valid_document_id(text: Column) -> Column:
    """1 to 80 ASCII letters, digits and hyphens, a digit among them, no hyphen at the ends."""
    return F.coalesce(F.length(text).between(1, 80) & text.rlike("^[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?$") & text.rlike("[0-9]"), F.lit(False))


def section_preview(text: Column, most: int = 500) -> Column:
    one = collapse(text)
    return F.when(F.length(one) > most, F.concat(rstrip(F.substring(one, 1, most)), F.lit("..."))).otherwise(one)


def word_tokens(text: Column) -> Column:
    """Lower-case runs of letters and digits, in order."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda t: t != "")


def page_set(spec: Column, last: Column) -> Column:
    """The pages of ``5,10-15,20``, sorted and without those beyond the last; null where the text is no such list."""
    parts = F.transform(F.split(F.regexp_replace(spec, r"\s", ""), ","), lambda p: F.sequence(F.split(p, "-")[0].cast("int"), F.element_at(F.split(p, "-"), -1).cast("int")))
    good = spec.rlike(r"^\s*[0-9]+(\s*-\s*[0-9]+)?(\s*,\s*[0-9]+(\s*-\s*[0-9]+)?)*\s*$")
    return F.when(good, F.filter(F.array_sort(F.array_distinct(F.flatten(parts))), lambda p: (p >= 1) & (p <= last)))


# The groups that a content type may be in.
CONTENT_TYPES = {"general": "General", "contract": "Contract", "bid": "Bid", "knowledge": "Knowledge"}


def content_type(text: Column) -> Column:
    """The content type whatever its case; null counts as General, and an unknown one is an error."""
    known = F.create_map(*(F.lit(v) for kv in CONTENT_TYPES.items() for v in kv))
    key = F.lower(strip(F.coalesce(text, F.lit("General"))))
    return F.coalesce(F.element_at(known, key), F.raise_error(F.concat(F.lit("unknown content type: "), text)).cast("string"))


# Texts of results by language; what is missing in one language is taken from English.
TEMPLATES = {
    "en": {"default_section_title": "Preface", "full_document_title": "Full document", "front_matter_title": "Preface / TOC", "page_title": "Page {page}", "summary_failed": "[Summary generation failed]", "table_prefix": "[Table]", "table_truncated": "[... {total} rows total, showing first {shown} ...]"},
    "zh": {"front_matter_title": "前言/目录"},
}


def locale_of(language: Column, default: str = "en") -> Column:
    """The language of templates that a tag such as zh-CN stands for."""
    tag = F.lower(F.coalesce(language, F.lit("")))
    return F.when(F.startswith(tag, F.lit("zh")), "zh").when(F.startswith(tag, F.lit("en")), "en").otherwise(default)


def template(language: Column, name: str, **values: Column) -> Column:
    """A template in a language, its names in braces replaced by values; an unknown name gives an empty text."""
    english = TEMPLATES["en"].get(name, "")
    out = F.lit(english)
    for code, texts in TEMPLATES.items():
        if texts.get(name, english) != english:
            out = F.when(locale_of(language) == code, texts[name]).otherwise(out)
    for k, v in values.items():
        out = F.replace(out, F.lit("{" + k + "}"), F.coalesce(v.cast("string"), F.lit("")))
    return out


def masked_path(path: Column, home: str) -> Column:
    """A path with the home folder as a tilde, for logs."""
    return F.when(F.startswith(path, F.lit(home)), F.replace(path, F.lit(home), F.lit("~"))).otherwise(path)
