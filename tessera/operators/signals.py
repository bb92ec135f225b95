"""Signals of pages: whether one must be read by OCR, at what scale it may be rendered, and whether it is blank."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

# Grey below which a pixel is no white, and dark; shares of such pixels under which a page is blank.
NO_WHITE, DARK = 245, 180
DARK_SHARE, NO_WHITE_SHARE = 0.00002, 0.001
# Times the threshold up to which a page with images is sparse, and one of few useful characters; the share of these; the least scale.
WITH_IMAGES, GARBLED, USEFUL, LEAST_SCALE = 3, 5, 0.3, 0.5


def needs_ocr(body: Column, images: Column, threshold: int) -> Column:
    """Whether a page's text is too little for what it shows: under the threshold, sparse beside images, or mostly no letters and digits."""
    n = F.length(F.coalesce(body, F.lit("")))
    useful = F.length(F.regexp_replace(F.coalesce(body, F.lit("")), r"[^\p{L}\p{N}]", ""))
    return (n < threshold) | ((F.coalesce(images, F.lit(0)) > 0) & (n < threshold * WITH_IMAGES)) | ((n > 0) & (useful / F.greatest(n, F.lit(1)) < USEFUL) & (n < threshold * GARBLED))


def render_scale(width: Column, height: Column, requested: float, most_pixels: int, least: float = LEAST_SCALE) -> Column:
    """At what scale a page of a size in points is rendered within a budget of pixels: scale, pixels, capped, skip (even the least scale is over the budget) as a struct."""
    requested = max(LEAST_SCALE, requested)
    least = min(requested, max(LEAST_SCALE, least))
    pixels = lambda s: F.greatest(F.lit(1), F.floor(width * s)) * F.greatest(F.lit(1), F.floor(height * s))
    wanted = pixels(F.lit(requested))
    fits = F.sqrt(F.lit(float(max(1, most_pixels))) / F.greatest(F.lit(1.0), width * height))
    over, skip = wanted > most_pixels, (wanted > most_pixels) & (fits < least)
    scale = F.when(~over, requested).when(skip, least).otherwise(F.least(F.lit(requested), fits))
    return F.struct(scale.alias("scale"), pixels(scale).cast("long").alias("pixels"), over.alias("capped"), skip.alias("skip"))


def grey_shares(pixels: Column) -> Column:
    """Shares of a page's pixels that are no white and that are dark, and whether it looks blank, as a struct. ``pixels``: a byte of grey for each, as binary. One histogram for each page over Arrow's own buffers; no pixels count as blank."""

    @F.arrow_udf("no_white double, dark double, blank boolean")
    def shares(column: pa.Array) -> pa.Array:
        no_white, dark = np.zeros(len(column)), np.zeros(len(column))
        for i, page in enumerate(column):
            if page.is_valid and (data := np.frombuffer(page.as_buffer(), np.uint8)).size:
                histogram = np.bincount(data, minlength=256)
                no_white[i], dark[i] = histogram[:NO_WHITE].sum() / data.size, histogram[:DARK].sum() / data.size
        return pa.StructArray.from_arrays([pa.array(no_white), pa.array(dark), pa.array((dark < DARK_SHARE) & (no_white < NO_WHITE_SHARE))], ["no_white", "dark", "blank"])

    return shares(pixels)
