"""Chinese amounts in words."""

from __future__ import annotations

import re
from decimal import ROUND_HALF_UP, Decimal

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Digits and units of amounts in words.
DIGITS = "零壹贰叁肆伍陆柒捌玖"
UNITS = ("", "拾", "佰", "仟")
GROUPS = ("", "万", "亿", "兆")


def _group(n: int) -> str:
    """A number under 10,000; a run of zeros inside is one."""
    named = "".join("零" if d == "0" else DIGITS[int(d)] + UNITS[3 - i] for i, d in enumerate(f"{n:04d}"))
    return re.sub("零+", "零", named).strip("零")


def in_words(amount: str | None) -> str | None:
    """An amount such as ¥1,234.50 in words; null for no amount and for 10^16 and more."""
    found = re.fullmatch(r"\s*¥?\s*([0-9,]+)(\.[0-9]{1,2})?\s*", amount or "")
    if not found or not found[1].replace(",", ""):
        return None
    whole, cents = divmod(int((Decimal(found[1].replace(",", "") + (found[2] or "")) * 100).to_integral_value(ROUND_HALF_UP)), 100)
    if whole >= 10**16:
        return None
    words, gap = "", False
    for i in range(3, -1, -1):
        group = whole // 10000**i % 10000
        if group:
            words += ("零" if words and (gap or group < 1000) else "") + _group(group) + GROUPS[i]
        gap = not group
    words = words or "零"
    tenth, hundredth = divmod(cents, 10)
    if not cents:
        return words + "元整"
    return words + "元" + (DIGITS[tenth] + "角" if tenth else "零") + (DIGITS[hundredth] + "分" if hundredth else "")


def uppercase_rmb(amount: Column) -> Column:
    """``in_words`` of a column of texts."""

    def words(amounts: pd.Series) -> pd.Series:
        return amounts.map(in_words)

    return F.pandas_udf(words, "string")(amount)


# An amount in figures that is followed by one in words, as contracts write it.
PHRASE = re.compile(r"(¥\s*[\d,]+(?:\.\d+)?)\s*[（(]\s*大写[：:]\s*人民币\s*[零〇一二三四五六七八九十百千万亿壹贰叁肆伍陆柒捌玖拾佰仟萬億元角分整正]+\s*[)）]")


def _with_words(m: re.Match[str]) -> str:
    figures = re.sub(r"\s+", "", m[1])
    words = in_words(figures if re.search(r"\.\d{3,}$", figures) is None else str(Decimal(figures[1:].replace(",", "")).quantize(Decimal("0.01"), ROUND_HALF_UP)))
    return m[0] if words is None else f"{m[1]}（大写：人民币{words}）"


def consistent_phrases(body: Column) -> Column:
    """A text in which the words after each amount in figures are those of the figures. Texts without such a phrase do not pass through Python."""

    @F.pandas_udf("string")
    def rewritten(bodies: pd.Series) -> pd.Series:
        return bodies.map(lambda t: None if t is None else PHRASE.sub(_with_words, t))

    return F.when(F.contains(body, F.lit("大写")), rewritten(body)).otherwise(body)
