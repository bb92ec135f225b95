"""Images of documents: what their surroundings say, and which section they belong to."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import text
from tessera.functions.arrays import bound

# Kinds of images and the words near them.
CONTEXT = {
    "business_license": ("营业执照", "统一社会信用代码", "business license"), "id_card": ("身份证", "居民身份证", "identity card", "id card"),
    "education_certificate": ("学历", "毕业证", "毕业证书", "学信网", "电子注册备案表"), "degree_certificate": ("学位证", "学位证书"),
    "personnel_certificate": ("项目经理证书", "人员证书", "人员资质", "PMP", "信息系统项目管理师", "系统集成项目管理工程师", "软考"), "certificate": ("证书", "资质", "认证"),
    "contract_copy": ("合同复印件", "合同案例", "类似案例", "业绩证明", "协议复印件"), "financial_statement": ("财务报表", "审计报告", "资产负债表", "利润表", "现金流量表"),
    "product_screenshot": ("产品截图", "系统截图", "功能截图", "界面截图", "截图"), "seal_or_signature": ("签字", "签章", "盖章", "公章", "印章"),
}
# What kinds make an image a candidate for.
CANDIDATES = {
    "personnel_material_candidate": ("education_certificate", "degree_certificate"), "certificate_or_identity_candidate": ("business_license", "id_card", "personnel_certificate", "certificate"),
    "case_contract_candidate": ("contract_copy",), "financial_material_candidate": ("financial_statement",), "product_screenshot_candidate": ("product_screenshot",),
}


def context_keywords(*texts: Column) -> Column:
    """The kinds that words near an image speak of."""
    near = F.lower(F.concat_ws("\n", *texts))
    has = lambda words: F.exists(F.array(*(F.lit(w.lower()) for w in words)), lambda w: F.contains(near, w))
    return F.filter(F.array(*(F.when(has(words), F.lit(kind)) for kind, words in CONTEXT.items())), lambda k: k.isNotNull())


# Pixels below which an image is small; least width and height, and range of width over height, of what looks like a screenshot; least height and range of what looks like a scanned page.
SMALL_PIXELS, SCREEN_WIDTH, SCREEN_HEIGHT, SCREEN_RATIO, SCAN_HEIGHT, SCAN_RATIO = 20_000, 900, 500, (1.2, 2.4), 900, (0.55, 1.15)


def hints(width: Column, height: Column, rendered: Column, keywords: Column) -> Column:
    """What an image may be, by its size, shape and surroundings."""
    ratio, ok = width / height, rendered & (width * height > 0)
    shape = [F.when(~rendered, "render_failed"), F.when(ok & (width * height < SMALL_PIXELS), "small_image"), F.when(ok & (width >= SCREEN_WIDTH) & (height >= SCREEN_HEIGHT) & ratio.between(*SCREEN_RATIO), "screenshot_like"), F.when(ok & (height >= SCAN_HEIGHT) & ratio.between(*SCAN_RATIO), "document_scan_like")]
    candidates = [F.when(F.arrays_overlap(keywords, F.array(*map(F.lit, kinds))), name) for name, kinds in CANDIDATES.items()]
    named = F.transform(F.array_sort(keywords), lambda k: F.concat(F.lit("context:"), k))
    some = lambda items: F.filter(F.array(*items), lambda h: h.isNotNull())
    return F.concat(some(shape), named, some(candidates))


def inventory(images: DataFrame) -> DataFrame:
    """Images (original, width, height, rendered, near_heading, paragraph_text, context_text) with size, digest, aspect, keywords and hints."""
    keywords = context_keywords(F.col("near_heading"), F.col("paragraph_text"), F.col("context_text"))
    sized = images.withColumns({"size_bytes": F.length("original"), "sha256": F.sha2("original", 256), "aspect_ratio": F.when(F.col("height") > 0, F.bround(F.col("width") / F.col("height"), 4)).otherwise(0.0), "keywords": keywords})
    return sized.withColumn("hints", hints(F.col("width"), F.col("height"), F.col("rendered"), F.col("keywords")))


def anchored(images: DataFrame, sections: DataFrame, key: str = "doc_id") -> DataFrame:
    """Each image with the first section of its document whose title is its heading, or whose beginning has its heading or paragraph; null where none does."""
    s = sections.select(F.col(key).alias("_key"), F.col("idx").alias("_idx"), F.col("sid").alias("section_sid"), text.heading_key(F.col("title")).alias("_title"), text.heading_key(F.substring("text", 1, 1500)).alias("_text"))
    head, para = text.heading_key(F.coalesce("near_heading", F.lit(""))), text.heading_key(F.coalesce("paragraph_text", F.lit("")))
    fits = ((head != "") & ((F.col("_title") == head) | F.contains("_text", head))) | ((para != "") & F.contains("_text", para))
    joined = images.join(s, (F.col(key) == F.col("_key")) & fits, "left")
    return joined.groupBy(*images.columns).agg(F.min_by("section_sid", "_idx").alias("section_sid"))


def average_hash(pixels: Column) -> Column:
    """A hash by which images that look alike have few bits of difference: of the grey values of an image scaled to 8 by 8, a bit for each that reaches their mean, in hexadecimal digits; empty without pixels."""
    # Each step is an array of one item and the next one a function over it, so that the pixels and their mean are made once and not once for each bit.
    mean = lambda p: F.aggregate(p, F.lit(0.0), lambda a, x: a + x) / F.size(p)
    digit = lambda p, m, i: F.lower(F.hex(sum((F.when(F.get(p, i * 4 + k) >= m, 8 >> k).otherwise(0) for k in range(4)), F.lit(0))))
    places = lambda p: F.sequence(F.lit(0), F.floor(F.size(p) / 4).cast("int") - 1)
    hashed = lambda p: bound(mean(p), lambda m: F.array_join(F.transform(places(p), lambda i: digit(p, m, i)), ""))
    return bound(pixels, lambda p: F.when(F.coalesce(F.size(p), F.lit(0)) >= 4, hashed(p)).otherwise(""))
