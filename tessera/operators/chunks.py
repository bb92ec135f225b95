"""Sections packed into chunks and batches by their estimated tokens."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions import text
from tessera.operators.streamed import folded

_CJK = re.compile("[一-鿿]")
#: White space as the column expressions mean it.
_SPACE = "\t\n\x0b\x0c\r \x85\xa0                　"


def token_estimate(body: str) -> int:
    """``functions.text.token_estimate`` of a text."""
    n = len(body)
    share = 0.0 if body.isascii() else len(_CJK.findall(body)) / max(n, 1)
    return math.floor(n / (2.5 * share + 4.0 * (1.0 - share)))


def _pieces(body: str, most: int, overlap: int) -> Iterator[str]:
    """The texts that a longer section falls into: cut at empty lines, with the end of each text at the start of the next; a longer paragraph stays whole."""
    parts: list[str] = []
    tokens = 0
    for p in [p for p in (x.strip(_SPACE) for x in re.split("\n{2,}", body)) if p] or [body]:
        n = token_estimate(p)
        if parts and tokens + n > most:
            whole = "\n\n".join(parts).strip(_SPACE)
            yield whole
            tail = whole[-overlap * 4 :] if overlap else ""
            parts, tokens = [tail] if overlap else [], token_estimate(tail)
        parts.append(p)
        tokens += n
    yield "\n\n".join(parts).strip(_SPACE)


#: Sections in order: idx, sid, title, page_start, page_end, text. Chunks: sids, titles, page_start, page_end, text.
Section = tuple[int, str | None, str | None, int | None, int | None, str | None]
Chunk = tuple[list[str], list[str], int | None, int | None, str]


def _packed(sections: Iterator[Section], most: int, merge: bool, threshold: int, overlap: int) -> Iterator[Chunk]:
    """Chunks as their sections come in; only the open one is held."""
    held: list[Section] = []
    used = 0

    def flushed() -> Iterator[Chunk]:
        if held:
            span = lambda i: [s[i] for s in held if s[i] is not None]
            yield span(1), [s[2] for s in held[:3] if s[2] is not None], min(span(3), default=None), max(span(4), default=None), "\n\n".join(span(5)).strip(_SPACE)
            held.clear()

    for s in sections:
        n = token_estimate(s[5] or "")
        if n > most:
            yield from flushed()
            own = [s[1]] if s[1] is not None else [], [s[2]] if s[2] is not None else [], s[3], s[4]
            yield from ((*own, piece) for piece in _pieces(s[5], most, overlap))
            continue
        if not (held and merge and used + n <= most and (used < threshold or n < threshold)):
            yield from flushed()
            used = 0
        held.append(s)
        used += n
    yield from flushed()


def chunk(sections: DataFrame, most: int = 1000, merge: bool = True, threshold: int = 200, overlap: int = 0, key: str = "doc_id") -> DataFrame:
    """Chunks of each document's sections in order: key, idx (from 1), chunk_id, sids, title, page_start, page_end, char_count, token_estimate, text.

    A section joins the chunk before it where both fit and either is below the threshold; one that does not fit at all is cut. A
    document's sections are streamed in order, and only the open chunk is held; null texts count as empty.
    """

    def fold(rows: Iterator[tuple]) -> Iterator[tuple]:
        for i, (sids, titles, start, end, body) in enumerate(_packed(rows, most, merge, threshold, overlap), 1):
            yield i, sids, " / ".join(titles), start, end, body

    rows = sections.select(key, *(F.col(c).cast("int").alias(c) if c in ("idx", "page_start", "page_end") else c for c in ("idx", "sid", "title", "page_start", "page_end", "text")))
    made = folded(rows, "idx int, sids array<string>, title string, page_start int, page_end int, text string", fold)
    title = F.regexp_replace("title", "^[ /]+|[ /]+$", "")
    return made.select(key, "idx", F.format_string("chunk-%04d", "idx").alias("chunk_id"), "sids", title.alias("title"), "page_start", "page_end", F.length("text").alias("char_count"), text.token_estimate(F.col("text")).alias("token_estimate"), "text")


def batches(sections: DataFrame, most: int = 10_000, extra: int = 20, key: str = "doc_id") -> DataFrame:
    """Sections with the number of the batch (from 1) they go to in order, none over ``most`` tokens unless a single one is: key, idx, batch, tokens."""

    def fold(rows: Iterator[tuple]) -> Iterator[tuple]:
        number, used = 1, 0
        for idx, tokens in rows:
            if used and used + tokens > most:
                number, used = number + 1, 0
            used += tokens
            yield idx, number, tokens

    tokens = text.token_estimate(F.col("text")) + text.token_estimate(F.col("title")) + extra
    return folded(sections.select(key, F.col("idx").cast("int").alias("idx"), tokens.alias("tokens")), "idx int, batch int, tokens bigint", fold)
