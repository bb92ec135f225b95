"""Clean-up of scanned text, as expressions over its lines."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions.arrays import bound
from tessera.functions.text import strip

# Misread phrases and what they stand for.
MISREAD = {
    "安装元成": "安装完成", "软件采贝": "软件采购", "合同采贝": "合同采购", "软件东统": "软件系统", "基调研云": "基调听云", "基调所元": "基调听云",
    "营通探针": "普通探针", "邮付申请": "邮件申请", "lava Agent": "Java Agent", "语吉探针": "语言探针", "则特殊开发部分应符\n合需求说明书": "则特殊开发部分应符合需求说明书",
}
# What in a text shows that it was scanned badly.
NOISE = ("[Tp]", "tblaeta", "eeaeee", "Tbabla", "基调研云APM", "基调所元Network", "lava Agent", "语吉探针", "第 4 页 / 共", "-第1页共")
FOOTER = r"^[-—_]*\s*第\s*\d+\s*[页頁]\s*(?:(?:[/／]\s*)?共\s*\d+\s*[页頁]?)?\s*[-—_]*$"
CONTRACT_NUMBER = r"^[A-Za-z]{2,10}\d{4,20}$"


def page_footer(line: Column) -> Column:
    """Whether a line is a page's number and the number of pages."""
    return strip(line).rlike(FOOTER)


# How long a word in brackets is at most, and an unbroken run of ASCII at least; ASCII signs that a noisy line has at least, and how many for each Chinese one.
SHORT_BRACKET, RUN_LEAST, SIGNS_LEAST, SIGNS_SHARE = 5, 5, 6, 2


def bracket_noise(line: Column) -> Column:
    """Whether a line with square brackets is what a table's frame was read as: a short word in brackets, one run of ASCII, or far more ASCII than Chinese."""
    bare = F.regexp_replace(line, r"(?U)\s+", "")
    signs, chinese = F.regexp_count(bare, F.lit(r"[\w\[\]-]")), F.regexp_count(bare, F.lit(r"[\x{4E00}-\x{9FFF}]"))
    one_run = bare.rlike(rf"^\[\w{{1,{SHORT_BRACKET - 1}}}$|^\[\w{{1,{SHORT_BRACKET - 2}}}\]$|^[\w\[\]-]{{{RUN_LEAST},}}$")
    return bare.rlike(r"[\[\]]") & (one_run | (signs >= F.greatest(F.lit(SIGNS_LEAST), chinese * SIGNS_SHARE)))


# A word that is a stamp's remains where it stands after the line with the place of signing, or before a page's footer; the lines before that count.
STAMP, SIGNED_AT, STAMP_LINES = "定作", "合同签订地点", 4


def clean(body: Column, contract_number: Column | None = None) -> Column:
    """Scanned text without blank lines, page footers, bracket noise and what a stamp left, with misread phrases put right; a contract's number that heads it is replaced by the known one."""
    lines = F.transform(F.split(F.regexp_replace(body, "\r\n|\r", "\n"), "\n"), strip)
    # A stamp is judged by the line after it as it was and by the lines kept before it, so lines go first with a mark where the next is a footer.
    feet = lambda a: F.transform(a, page_footer)
    zipped = lambda a: bound(feet(a), lambda f: F.transform(a, lambda line, i: F.struct(line.alias("t"), F.get(f, i).alias("own"), F.coalesce(F.get(f, i + 1), F.lit(False)).alias("foot"))))
    solid = F.filter(bound(lines, zipped), lambda x: (x["t"] != "") & ~bracket_noise(x["t"]) & ~x["own"])

    def near(a: Column, i: Column) -> Column:
        """Whether one of the lines before place i, stamps left out, says where the contract was signed."""
        before = F.reverse(F.filter(F.slice(a, F.lit(1), F.greatest(i, F.lit(0))), lambda x: x["t"] != STAMP))
        return F.exists(F.slice(before, F.lit(1), F.lit(STAMP_LINES)), lambda x: F.contains(x["t"], F.lit(SIGNED_AT)))

    stays = bound(solid, lambda a: F.filter(a, lambda x, i: ~((x["t"] == STAMP) & (x["foot"] | near(a, i)))))
    headed = lambda a: F.when((F.size(a) > 1) & (F.lower(F.get(a, F.lit(0))) == "preface"), F.slice(a, F.lit(2), F.size(a) - 1)).otherwise(a)
    kept = bound(F.transform(stays, lambda x: x["t"]), headed)
    out = F.array_join(kept, "\n")
    for wrong, right in MISREAD.items():
        out = F.replace(out, F.lit(wrong), F.lit(right))
    if contract_number is not None:
        head = F.regexp_replace(F.substring_index(out, "\n", 1), r"(?U)\s+", "")
        swap = contract_number.isNotNull() & head.rlike(CONTRACT_NUMBER) & (head != contract_number)
        out = F.when(swap, F.regexp_replace(out, r"^[^\n]*", contract_number)).otherwise(out)
    return strip(out)


# What a signing service prints across pages, a site's own line, and a misread unit of prices.
WATERMARK = r"^(?=..)(?:[万翼签]*万翼[万翼签]*|(?:万翼签|万翼|翼签)+)$"
SITE_LINE, MONTHLY = "TINGYUN.COM", r"([0-9]+)\s*月/个"


def watermark(line: Column) -> Column:
    """Whether a line is nothing but a signing service's watermark."""
    return F.regexp_replace(line, r"(?U)\s+", "").rlike(WATERMARK)


def without_noise(body: Column) -> Column:
    """Extracted text without watermarks and the site's line, with the misread unit of monthly prices put right."""
    lines = F.split(F.regexp_replace(body, "\r\n|\r", "\n"), "\n")
    kept = F.filter(lines, lambda line: ~watermark(line) & (F.upper(strip(line)) != SITE_LINE))
    return strip(F.array_join(F.transform(kept, lambda line: F.regexp_replace(F.regexp_replace(line, r"(?U)\s+$", ""), MONTHLY, "$1 元/个")), "\n"))


def noise_hits(body: Column) -> Column:
    """The signs of bad scanning that a text has."""
    return F.filter(F.array(*map(F.lit, NOISE)), lambda sign: F.contains(body, sign))


def wrapped(body: Column, nonce: Column, origin: Column, tag: str = "web-content") -> Column:
    """Untrusted text between marks that carry a nonce and the origin as one token each, for readers that must not obey it."""
    token = F.regexp_replace(F.regexp_replace(origin, r"[⟦⟧\s\x00-\x1f]+", "_"), "^_+|_+$", "")
    token = F.when(token == "", "unknown").otherwise(F.substring(token, 1, 200))
    return F.concat(F.lit(f"⟦{tag} nonce="), nonce, F.lit(" origin="), token, F.lit(" note=untrusted-text⟧\n"), body, F.lit(f"\n⟦/{tag} nonce="), nonce, F.lit("⟧"))
