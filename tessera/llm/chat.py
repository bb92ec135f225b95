"""Chat formatting: conversations as one text with marked turns, its token ids, and a mask of the tokens to learn from."""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cache
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.bpe import vocabulary
from tessera.llm.common import batches, col, new_path, release, ship

#: Characters of a piece of a conversation: a longer one goes on in a next piece, after a turn's end. Characters that are encoded at a time.
PIECE_CHARS, ENCODE_CHARS = 1 << 20, 1 << 20


@dataclass(frozen=True)
class ChatTemplate:
    """``begin`` role ``head`` text ``end`` for each turn. ``trained``: the roles whose texts are learned from. ``others``: further strings that no text may hold, such as the tokenizer's special tokens.

    Inside roles and texts a control string gets the escape after its first character, and so does one that has escapes there already, one more; taking one away gives the text back. So that
    this is unambiguous, no control string has the first character of any of them further on, or the escape.
    """

    begin: str = "[INST]"
    head: str = "[/INST]"
    end: str = "</s>"
    trained: tuple[str, ...] = ("assistant",)
    others: tuple[str, ...] = ()
    escape: str = field(default="\\")

    def __post_init__(self) -> None:
        firsts = {c[:1] for c in self.controls}
        if "" in firsts or any(ch in firsts or ch == self.escape for c in self.controls for ch in c[1:]) or self.escape in firsts or len(self.escape) != 1:
            raise ValueError("control strings must not be empty, nor hold the escape or, after their first character, a character that one begins with")

    @property
    def controls(self) -> tuple[str, ...]:
        return tuple(dict.fromkeys((self.begin, self.head, self.end, *self.others)))

    def _pattern(self, escapes: str) -> str:
        quoted = lambda s: re.sub(r"([^\w\s])", r"\\\1", s)
        return "(?:" + "|".join(f"{quoted(c[0])}(?={quoted(self.escape)}{escapes}{quoted(c[1:])})" for c in self.controls) + ")"

    def escaped(self, text: Column) -> Column:
        """The text with its control strings escaped; null is empty."""
        return F.regexp_replace(F.coalesce(text.cast("string"), F.lit("")), self._pattern("*"), "$0" + "\\" * (self.escape in "\\$") + self.escape)

    def unescaped(self, text: str) -> str:
        return _compiled(f"({self._pattern('+')}){re.escape(self.escape)}").sub(r"\1", text) if self.escape in text else text

    def turns(self, formatted: str) -> Iterator[tuple[str, str]]:
        """Role and text of each turn of a formatted text."""
        for m in _compiled(f"{re.escape(self.begin)}(.*?){re.escape(self.head)}(.*?){re.escape(self.end)}").finditer(formatted):
            yield self.unescaped(m[1]), self.unescaped(m[2])


@cache
def _compiled(pattern: str) -> re.Pattern[str]:
    return re.compile(pattern, re.DOTALL)


def template_for(tokenizer: str, **marks: Any) -> ChatTemplate:
    """A template whose texts can't hold the special tokens of a tokenizer file either."""
    with open(tokenizer, encoding="utf-8") as f:
        return ChatTemplate(others=tuple(t["content"] for t in json.load(f)["added_tokens"]), **marks)


@cache
def _encoder(path: str, marks: tuple[str, ...]) -> Any:
    """The library's tokenizer with the marks as special tokens: they are split off before words are, so no token lies across a mark's edge."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    out = Tokenizer.from_file(path)
    out.no_truncation()
    out.no_padding()
    out.add_special_tokens(list(marks))
    return out


def mark_ids(tokenizer: str, template: ChatTemplate) -> dict[str, int]:
    """The token ids of a template's marks."""
    encoder = _encoder(tokenizer, (template.begin, template.head, template.end))
    return {m: encoder.token_to_id(m) for m in (template.begin, template.head, template.end)}


def token_mask(starts: np.ndarray, ends: np.ndarray, spans: np.ndarray) -> np.ndarray:
    """Which tokens lie within one of the spans; tokens and spans are sorted, so each span's first and last token are found by bisection."""
    first = np.searchsorted(starts, spans[:, 0], "left")
    last = np.searchsorted(ends, spans[:, 1], "right")
    some = last > first
    edge = np.zeros(len(starts) + 1, np.int32)
    np.add.at(edge, first[some], 1)
    np.add.at(edge, last[some], -1)
    return np.cumsum(edge[:-1]) > 0


class _Piece:
    """Turns of one conversation, as they come."""

    def __init__(self, conv: Any, number: int) -> None:
        self.conv, self.number, self.parts, self.chars, self.turns, self.spans, self.last = conv, number, [], 0, 0, [], True

    def add(self, template: ChatTemplate, role: str, text: str, trained: bool) -> None:
        opening = f"{template.begin}{role}{template.head}"
        start = self.chars + len(opening)
        if trained and text:
            self.spans.append((start, start + len(text)))
        self.parts += [opening, text, template.end]
        self.chars = start + len(text) + len(template.end)
        self.turns += 1


_PIECES = "piece int, last boolean, turns long, formatted string, ids array<int>, mask array<boolean>"


def format_chats(df: DataFrame, tokenizer: str, template: ChatTemplate | None = None, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Every conversation as a formatted text with its token ids and the mask of the tokens to learn from.

    Rows are brought together by conversation and sorted by turn (null first; rows of one turn by role and text, null as empty). A task renders whole conversations, encodes each once, and sets the mask where a
    token's characters lie within the text of a trained turn; marks and roles are never under it. Escaping is done in the JVM.

    Returns conv, piece, last, turns, formatted, ids, mask. A conversation is one row unless it has over a million characters, when it goes on in further pieces, each cut after a turn; marks are
    special tokens, so the ids of the pieces are those of the whole. A task holds one piece of a conversation, so a hot one, which must be in order, is long work for a task but none that fills its memory.
    Null roles and texts count as empty, null ids are one conversation, and an empty table gives an empty result. Further columns are left out.
    """
    ship(df.sparkSession)
    template = template or template_for(tokenizer)
    marks = (template.begin, template.head, template.end)
    kind = dict(df.dtypes)[conv]
    plain = lambda c: F.coalesce(col(c).cast("string"), F.lit(""))
    rows = df.select(col(conv).alias("conv"), col(turn).alias("turn"), plain(role).alias("role"), plain(text).alias("text"))
    rows = rows.repartition("conv").sortWithinPartitions("conv", "turn", "role", "text")
    rows = rows.select("conv", template.escaped(F.col("role")).alias("role"), template.escaped(F.col("text")).alias("text"), F.col("role").isin(*template.trained).alias("trained"))

    def formatted(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, held, now, size = _encoder(tokenizer, marks), [], None, 0

        def encoded(pieces: list[_Piece]) -> pa.RecordBatch:
            texts = ["".join(p.parts) for p in pieces]
            ids, masks = [], []
            for p, e in zip(pieces, encoder.encode_batch(texts, add_special_tokens=False), strict=True):
                offsets = np.array(e.offsets, np.int64).reshape(-1, 2)
                ids.append(pa.array(e.ids, pa.int32()))
                masks.append(pa.array(token_mask(offsets[:, 0], offsets[:, 1], np.array(p.spans, np.int64).reshape(-1, 2))))
            at = pa.array(np.cumsum([0, *map(len, ids)]), pa.int32())
            columns = [pa.array([p.conv for p in pieces], kind_arrow), pa.array([p.number for p in pieces], pa.int32()), pa.array([p.last for p in pieces]), pa.array([p.turns for p in pieces], pa.int64()), pa.array(texts, pa.string())]
            columns += [pa.ListArray.from_arrays(at, pa.concat_arrays(ids)), pa.ListArray.from_arrays(at, pa.concat_arrays(masks))]
            return pa.RecordBatch.from_arrays(columns, ["conv", "piece", "last", "turns", "formatted", "ids", "mask"])

        for batch in batches(it, "text"):
            kind_arrow = batch.schema.field("conv").type
            for c, r, t, trained in zip(*(batch.column(n).to_pylist() for n in ("conv", "role", "text", "trained")), strict=True):
                if now is None or now.conv != c or now.chars >= PIECE_CHARS:
                    number = 0
                    if now is not None:
                        same = now.conv == c
                        now.last, number = not same, now.number + 1 if same else 0
                        held.append(now)
                        size += now.chars
                        if size >= ENCODE_CHARS:
                            yield encoded(held)
                            held, size = [], 0
                            release()
                    now = _Piece(c, number)
                now.add(template, r, t, trained)
        if now is not None:
            yield encoded([*held, now])

    out = rows.mapInArrow(formatted, f"conv {kind}, {_PIECES}")
    return out.withColumnRenamed("conv", conv)


def write_chats(df: DataFrame, tokenizer: str, template: ChatTemplate | None = None, **columns: str) -> str:
    """Write ``format_chats`` and return the path."""
    path = new_path(df.sparkSession, "chats")
    format_chats(df, tokenizer, template, **columns).write.parquet(path)
    return path


def read_chats(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def chat_digests(chats: DataFrame, tokenizer: str, template: ChatTemplate | None = None, conv: str = "conv_id") -> DataFrame:
    """What formatted conversations hold: turns, read from the text and unescaped, and all text under the mask, read from the ids.

    Returns conv, n_turns, turns_sha256 (of role, line end, text, line end for each turn), loss_chars, loss_sha256, formatted_chars. Conversations of one piece stay where they are read; pieces of longer
    ones are brought together in order and folded one by one.
    """
    ship(chats.sparkSession)
    template = template or template_for(tokenizer)
    marks = mark_ids(tokenizer, template)
    kind = dict(chats.dtypes)[conv]
    rows = chats.select(col(conv).alias("conv"), "piece", "last", "formatted", "ids", "mask")

    def digests(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = list(vocabulary(tokenizer).pieces)
        pieces += [b""] * (max(marks.values()) + 1 - len(pieces))
        for m, i in marks.items():
            pieces[i] = m.encode()
        turns = loss = None
        for batch in it:
            out: list[tuple] = []
            lists, masks = batch.column("ids"), batch.column("mask")
            ids, mask = lists.values.to_numpy(), masks.values.to_numpy(zero_copy_only=False)
            bounds = lists.offsets.to_numpy()
            for i, (c, number, last, text) in enumerate(zip(*(batch.column(n).to_pylist() for n in ("conv", "piece", "last", "formatted")), strict=True)):
                if number == 0:
                    turns, loss, n, n_loss, chars = hashlib.sha256(), hashlib.sha256(), 0, 0, 0
                for r, t in template.turns(text):
                    turns.update(f"{r}\n{t}\n".encode())
                    n += 1
                chars += len(text)
                a, b = int(bounds[i]), int(bounds[i + 1])
                edge = np.flatnonzero(np.diff(mask[a:b].astype(np.int8), prepend=0, append=0)) + a
                for x, y in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True):
                    learned = template.unescaped(b"".join([pieces[k] for k in ids[x:y].tolist()]).decode())
                    loss.update(learned.encode())
                    n_loss += len(learned)
                if last:
                    out.append((c, n, turns.hexdigest(), n_loss, loss.hexdigest(), chars))
            if out:
                kinds = (batch.schema.field("conv").type, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*out, strict=True), kinds, strict=True)], ["conv", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    schema = f"conv {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    whole = (F.col("piece") == 0) & F.col("last")
    long = rows.where(~whole).repartition("conv").sortWithinPartitions("conv", "piece")
    return rows.where(whole).mapInArrow(digests, schema).unionByName(long.mapInArrow(digests, schema)).withColumnRenamed("conv", conv)
