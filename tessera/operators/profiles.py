"""Fields of documents by rules: each rule becomes an expression."""

from __future__ import annotations

import json
import re
from dataclasses import dataclass
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import ocr, text
from tessera.shipping import ship


@dataclass(frozen=True)
class FieldRule:
    """A field: words one of which the page must have, a pattern whose first group is the value, the pages it may be on, and a pattern the value must fit."""

    field: str
    pattern: str | None = None
    aliases: tuple[str, ...] = ()
    pages: tuple[int, ...] = ()
    valid: str | None = None


@dataclass(frozen=True)
class Profile:
    """A kind of documents: its name, the terms one of which such a document has, its field rules, the segments that a better reading replaces, and limits."""

    name: str
    required_terms: tuple[str, ...] = ()
    fields: tuple[FieldRule, ...] = ()
    segments: tuple[Segment, ...] = ()
    limits: dict[str, float | bool] | None = None


@dataclass(frozen=True)
class Segment:
    """A part of a page: from a start word (or the first of some words) to an end word, or the whole page."""

    name: str
    start: str | None = None
    end: str | None = None
    aliases: tuple[str, ...] = ()
    whole: bool = False


# Limits that a profile may set, with what holds where it does not, and the least that they may be.
LIMITS = {
    "sparse_text_chars": (40, 0), "usable_text_chars": (120, 1), "scan_page_ratio": (0.85, None), "mixed_page_ratio": (0.2, None), "toc_max_level": (2, 1), "formal_chinese_min_headings": (4, 1),
    "suppress_arabic_clause_headings_when_formal_chinese": (False, None),
}


def load_profile(config: str) -> Profile:
    """A profile from its JSON text. Lists keep their texts only, pages their whole numbers only; a text that is no JSON object is an error."""
    raw = json.loads(config)
    if not isinstance(raw, dict):
        raise ValueError("a profile is a JSON object")
    part = lambda name: raw[name] if isinstance(raw.get(name), dict) else {}
    texts = lambda v: tuple(str(x) for x in v or () if str(x).strip())
    pages = lambda v: tuple(x for x in v or () if isinstance(x, int) and not isinstance(x, bool))
    items = lambda name: [x for x in raw.get(name, []) if isinstance(x, dict)]
    fields = tuple(FieldRule(str(x.get("id") or f"field_{i}"), x.get("pattern") or None, texts(x.get("aliases")), pages(x.get("page_scope"))) for i, x in enumerate(items("fields"), 1))
    segments = tuple(Segment(str(x.get("id") or f"group_{i}"), (x.get("start_alias") or "").strip() or None, (x.get("end_alias") or "").strip() or None, texts(x.get("aliases")), x.get("replace_mode") == "replace_entire_page") for i, x in enumerate(items("groups"), 1))
    given = part("quality_policy") | part("section_policy")
    limits = {k: type(v)(given.get(k, v)) if least is None else max(least, type(v)(given.get(k, v))) for k, (v, least) in LIMITS.items()}
    return Profile(str(raw.get("profile") or "profile"), texts(part("classification").get("required_terms")), fields, segments, limits)


def replaced_segment(body: Column, segment: Segment, better: Column) -> Column:
    """A page with a segment replaced by a better reading of it; unchanged where the segment does not begin on it or there is no better reading."""
    better = text.strip(better)
    if segment.whole:
        return F.coalesce(better, body)
    at = lambda word: F.locate(word, body)
    words = [w for w in segment.aliases if w]
    first = None
    if words:  # of the words that are there, the first on the page
        found = F.filter(F.array(*(F.struct(at(w).alias("at"), F.lit(len(w)).alias("n")) for w in words)), lambda x: x["at"] > 0)
        first = F.array_min(found)
    start = first["at"] if words else F.lit(None).cast("int")
    size = first["n"] if words else F.lit(0)
    if segment.start:
        start, size = F.when(at(segment.start) > 0, at(segment.start)).otherwise(start), F.when(at(segment.start) > 0, len(segment.start)).otherwise(size)
    rest = F.substring(body, start + size, F.length(body))
    gap = F.locate(segment.end, rest) if segment.end else F.lit(0)
    after = F.when(gap > 0, F.regexp_replace(F.substring(rest, gap, F.length(rest)), r"(?U)^\s+", "")).otherwise("")
    made = text.strip(F.concat(text.rstrip(F.substring(body, F.lit(1), start - 1)), F.lit("\n\n"), better, F.lit("\n\n"), after))
    return F.when(start.isNull() | better.isNull(), body).otherwise(made)


# What a contract's number is not, words one of which an organisation's name has, and how many characters or digits a value has at least.
NO_NUMBERS, ORGANISATIONS = ("甲", "乙", "合同", "合同编号", "方"), "公司|中心|银行|基金|学校|医院|政府|委员会|研究院|事务所|集团"
LEAST_CHARS, LEAST_PHONE, LEAST_ACCOUNT = 4, 7, 6


def refusal(field: str, value: Column) -> Column:
    """Why a value is none for a field of that name; null where it is one. Numbers of contracts need a digit, parties a word of organisations, phones and accounts enough digits."""
    bare = F.regexp_replace(value, r"(?U)\s+", "")
    digits = F.length(F.regexp_replace(bare, r"\D", ""))
    why = F.when(text.strip(value) == "", "empty").when(value.rlike("[\u3040-\u30ff]"), "kana_noise").when(ocr.bracket_noise(value), "bracket_noise")
    if field == "contract_no":
        why = why.when(bare.isin(*NO_NUMBERS), "label_only").when((F.length(bare) < LEAST_CHARS) | ~bare.rlike(r"\d"), "too_short_or_no_digit")
    elif field in ("party_a_name", "party_b_name", "customer_name"):
        why = why.when(F.length(bare) < LEAST_CHARS, "too_short").when(~bare.rlike(ORGANISATIONS), "not_org_like")
    elif field.endswith("_phone"):
        why = why.when(digits < LEAST_PHONE, "not_phone_like")
    elif field.endswith("_account"):
        why = why.when(digits < LEAST_ACCOUNT, "not_account_like")
    return why


def filename_contract_no(filename: Column) -> Column:
    """The contract's number that a file is named by: letters and digits only; null for other names."""
    stem = text.strip(F.regexp_replace(F.regexp_replace(filename, r"^.*/", ""), r"\.[^.]*$", ""))
    return F.when(stem.rlike(ocr.CONTRACT_NUMBER), stem)


def with_contract_no(body: Column, filename: Column) -> Column:
    """The text with its file's contract number as first line, where the text does not have it."""
    number = filename_contract_no(filename)
    missing = number.isNotNull() & ~F.contains(F.regexp_replace(body, r"(?U)\s+", ""), number)
    return F.when(missing, text.strip(F.concat(number, F.lit("\n"), text.strip(body)))).otherwise(text.strip(body))


def _value(rule: FieldRule, body: Column) -> Column:
    present = F.lit(not rule.aliases)
    for alias in rule.aliases:
        present = present | F.contains(body, F.lit(alias))
    if rule.pattern:
        value = text.strip(F.regexp_extract(body, "(?m)" + rule.pattern, 1 if "(" in rule.pattern.replace("(?", "") else 0))
    else:
        value = F.coalesce(*(F.when(F.contains(body, F.lit(a)), F.lit(a)) for a in rule.aliases))
    good = present & refusal(rule.field, value).isNull()
    return F.when(good & value.rlike(rule.valid) if rule.valid else good, value)


def extract_fields(pages: DataFrame, rules: list[FieldRule], key: str = "doc_id") -> DataFrame:
    """For each document and field the value on the first page that gives a valid one: key, field, value, page.

    All rules are expressions over one pass of the pages; one aggregation takes the first page of each.
    """
    found = []
    for rule in rules:
        value = _value(rule, F.coalesce("text", F.lit("")))
        found.append(F.struct(F.lit(rule.field).alias("field"), (F.when(F.col("page_num").isin(*rule.pages), value) if rule.pages else value).alias("value")))
    rows = pages.select(key, "page_num", F.explode(F.array(*found)).alias("f")).where("f.value is not null")
    return rows.groupBy(key, F.col("f.field").alias("field")).agg(F.min(F.struct("page_num", "f.value")).alias("_first")).select(key, "field", F.col("_first.value").alias("value"), F.col("_first.page_num").alias("page"))


def matched_terms(body: Column, terms: list[str]) -> Column:
    """The required terms that a text has, in their order."""
    return F.filter(F.array(*map(F.lit, terms)), lambda t: F.contains(body, t))


def classified(body: Column, terms: list[str]) -> Column:
    """Whether a text is of the profile's kind: it has any of the required terms, or none is required."""
    return F.lit(True) if not terms else F.size(matched_terms(body, terms)) > 0


# The characters that company names are of, and their suffixes, longest first.
_NAME_CHARS, COMPANY_SUFFIXES = "A-Za-z0-9\u4e00-\u9fff", ("股份有限公司", "有限责任公司", "有限公司")
COMPANY = rf"[{_NAME_CHARS}()（）·]+(?:{'|'.join(COMPANY_SUFFIXES)})"


def company_names(documents: DataFrame, key: str = "doc_id", body: str = "text") -> DataFrame:
    """The company names in each text, each once: key, name."""
    return documents.select(key, F.explode(F.array_distinct(F.regexp_extract_all(F.coalesce(F.col(body), F.lit("")), F.lit(f"({COMPANY})"), 1))).alias("name")).distinct()


def likeness(a: Column, b: Column) -> Column:
    """How alike two short texts are: twice the characters in matching blocks (the longest common piece, and so on to both sides of it) over those of both."""

    @F.pandas_udf("double")
    def ratio(left: pd.Series, right: pd.Series) -> pd.Series:
        out, matcher = [], SequenceMatcher(None, autojunk=True)
        for x, y in zip(left, right, strict=True):
            matcher.set_seqs(x, y)
            out.append(matcher.ratio())
        return pd.Series(out, dtype="float64")

    return ratio(a, b)


def unified_companies(names: DataFrame, least: float = 0.7, key: str = "doc_id") -> DataFrame:
    """Company names of a document that are spellings of one: key, name, unified. Those of the same suffix and last two characters before it, and of a likeness of 70 %, become the longest; of equally long ones the first in order.

    Candidates come from an equality join, and likeness is only measured for them. A name whose spellings are no longer than itself stays.
    """
    ship(names.sparkSession)
    split = names.select(key, "name", F.regexp_extract("name", f"({'|'.join(COMPANY_SUFFIXES)})$", 1).alias("_suffix")).distinct()
    keyed = split.where("_suffix <> ''").withColumn("_stem", F.expr("substring(name, 1, length(name) - length(_suffix))")).where(F.length("_stem") >= 2).withColumn("_tail", F.expr("right(_stem, 2)"))
    other = keyed.select(key, "_suffix", "_tail", F.col("name").alias("_other"), F.col("_stem").alias("_other_stem"))
    pairs = keyed.join(other, [key, "_suffix", "_tail"]).where(F.length("_other") > F.length("name"))
    alike = pairs.withColumn("_like", likeness(F.col("_stem"), F.col("_other_stem"))).where(F.col("_like") >= least)
    best = alike.groupBy(key, "name").agg(F.min(F.struct((-F.length("_other")).alias("n"), "_other")).alias("b")).select(key, "name", F.col("b._other").alias("unified"))
    return split.select(key, "name").join(best, [key, "name"], "left").select(key, "name", F.coalesce("unified", "name").alias("unified"))


def with_unified_companies(documents: DataFrame, key: str = "doc_id", body: str = "text", least: float = 0.7) -> DataFrame:
    """Texts with each company name that is a spelling of a longer one replaced by that: one pass over each text for all its names, longest first, where no letter, digit or Chinese character stands next to them. Null texts stay null."""
    ship(documents.sparkSession)
    changed = unified_companies(company_names(documents, key, body), least, key).where("name <> unified")
    of = changed.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("name", "unified"))).alias("_names"))

    @F.pandas_udf("string")
    def replaced(texts: pd.Series, names: pd.Series) -> pd.Series:
        out = []
        for t, n in zip(texts, names, strict=True):
            pairs = dict(n) if n is not None else {}
            if t and pairs:
                any_of = "|".join(map(re.escape, sorted(pairs, key=len, reverse=True)))
                t = re.sub(rf"(?<![{_NAME_CHARS}])(?:{any_of})(?![{_NAME_CHARS}])", lambda m, pairs=pairs: pairs[m[0]], t)
            out.append(t)
        return pd.Series(out, dtype=object)

    joined = documents.join(of, key, "left")
    return joined.withColumn(body, F.when(F.col("_names").isNotNull(), replaced(F.col(body), F.col("_names"))).otherwise(F.col(body))).select(*documents.columns)
