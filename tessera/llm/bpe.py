"""Byte-level BPE, encoding and decoding, with the contiguous array of ranks."""

from __future__ import annotations

import hashlib
import heapq
import json
import re
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import batches, col, put, release, ship

#: Words of up to so many bytes go through the rank array; longer ones through a heap, whose cost is not quadratic.
SHORT = 32
#: Words whose ids a worker keeps between batches, their characters, and bytes of text that it splits at a time.
CACHE_WORDS, CACHE_CHARS, BATCH_BYTES = 200_000, 8 << 20, 2 << 20
NO_RANK = np.int32(2**31 - 1)
#: Unicode white space, as the tokenizer's expressions mean it.
_WS = r"\t-\r \x85\xa0  -     　"
#: How byte-level tokenizers split text to words: fixed by the vocabulary.
_SPLIT = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{_WS}\p{{L}}\p{{N}}]+|[{_WS}]+(?![^{_WS}])|[{_WS}]+"


def byte_names() -> list[str]:
    """The character that stands for each byte in a byte-level vocabulary: printable ones for themselves, the rest from U+0100 up."""
    own = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = iter(range(256, 512))
    return [chr(b if b in own else next(rest)) for b in range(256)]


class ByteBPE:
    """A byte-level BPE vocabulary from a tokenizer file."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        if model["type"] != "BPE" or spec["normalizer"] or model.get("end_of_word_suffix") or spec["pre_tokenizer"]["type"] != "ByteLevel" or spec["pre_tokenizer"]["add_prefix_space"]:
            raise ValueError("not a plain byte-level BPE file")
        names = byte_names()
        back = {c: b for b, c in enumerate(names)}
        vocab: dict[str, int] = model["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.size = max([*vocab.values(), *self.special.values()]) + 1
        self.pieces = [b""] * self.size
        for token, i in vocab.items():
            self.pieces[i] = bytes(back[c] for c in token) if all(c in back for c in token) else token.encode()
        for token, i in self.special.items():
            self.pieces[i] = token.encode()
        self.decimal = [str(i) for i in range(self.size)]
        self.of_byte = np.array([vocab[c] for c in names], np.int32)
        merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        key = np.array([(vocab[a] << 32) | vocab[b] for a, b in merges], np.int64)
        made = np.array([vocab[a + b] for a, b in merges], np.int32)
        order = np.argsort(key)
        self.keys, self.ranks, self.made = key[order], order.astype(np.int32), made[order]
        self.made_by_rank = made
        # Open addressing: a slot for each pair, so that a lookup is a gather or two and no search.
        self.mask = (1 << 18) - 1
        self.slots = np.full(self.mask + 1, -1, np.int32)
        todo, at = np.arange(len(self.keys), dtype=np.int32), self._hash(self.keys)
        while len(todo):
            free = self.slots[at] < 0
            self.slots[at[free]] = todo[free]
            left = self.slots[at] != todo
            todo, at = todo[left], (at[left] + 1) & self.mask
        self.words: dict[str, int] = {}
        self.split = regex.compile(_SPLIT)
        self.specials = re.compile("|".join(map(re.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        self.clear()

    def _hash(self, key: np.ndarray) -> np.ndarray:
        return ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(46)).astype(np.int64)

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of joining each left part with its right neighbour; NO_RANK where no merge does. A part of -1 is none."""
        key = (left.astype(np.int64) << 32) | right.astype(np.int64)
        at = self._hash(key)
        out = np.full(len(key), NO_RANK, np.int32)
        todo = np.flatnonzero((left >= 0) & (right >= 0))
        at = at[todo]
        while len(todo):
            slot = self.slots[at]
            hit = (slot >= 0) & (self.keys[slot] == key[todo])
            out[todo[hit]] = self.ranks[slot[hit]]
            on = (slot >= 0) & ~hit
            todo, at = todo[on], (at[on] + 1) & self.mask
        return out

    def clear(self) -> None:
        self.words.clear()
        self.chars = 0
        self.flat, self.lengths = [np.zeros(0, np.int32)], [np.zeros(0, np.int64)]

    def merge_short(self, words: list[bytes]) -> list[np.ndarray]:
        """Ids of words of at most SHORT bytes, all at once: a row of parts and a row of adjacent ranks for each word.

        Each turn finds every word's least rank (the leftmost of equals), joins the two parts there, deletes the boundary by
        closing the row up, and looks up the ranks of the two neighbours. Words without a rank left drop out.
        """
        n = np.array([len(w) for w in words])
        wide = int(n.max())
        raw = np.frombuffer(b"".join(words), np.uint8)
        inside = np.arange(wide) < n[:, None]
        parts = np.full((len(words), wide + 1), -1, np.int32)
        parts[:, :wide][inside] = self.of_byte[raw]
        ranks = np.full((len(words), wide + 1), NO_RANK, np.int32)
        ranks[:, :wide] = self.rank(parts[:, :-1].ravel(), parts[:, 1:].ravel()).reshape(len(words), wide)
        out: list[np.ndarray] = [np.zeros(0, np.int32)] * len(words)
        live, columns = np.arange(len(words)), np.arange(wide + 1)
        while len(live):
            at = ranks.argmin(axis=1)
            best = ranks[np.arange(len(live)), at]
            over = best == NO_RANK
            if over.any():
                for k, row, m in zip(live[over], parts[over], n[over], strict=True):
                    out[k] = row[:m]
                go = ~over
                live, parts, ranks, n, at, best = live[go], parts[go], ranks[go], n[go], at[go], best[go]
                if not len(live):
                    break
            rows = np.arange(len(live))
            close = np.minimum(columns + (columns > at[:, None]), wide)  # what moves to each column once the boundary is gone
            parts, ranks = np.take_along_axis(parts, close, 1), np.take_along_axis(ranks, close, 1)
            parts[:, -1], ranks[:, -1] = -1, NO_RANK
            parts[rows, at] = self.made_by_rank[best]
            n = n - 1
            ranks[rows, at] = self.rank(parts[rows, at], parts[rows, np.minimum(at + 1, wide)])
            left = at > 0
            ranks[rows[left], at[left] - 1] = self.rank(parts[rows[left], at[left] - 1], parts[rows[left], at[left]])
            narrow = int(n.max()) + 1
            if narrow < parts.shape[1] - 4:
                wide, columns, parts, ranks = narrow, np.arange(narrow + 1), parts[:, : narrow + 1].copy(), ranks[:, : narrow + 1].copy()
        return out

    def merge_long(self, word: bytes) -> np.ndarray:
        """Ids of one long word: the same merges, with the ranks in a heap and the parts in a linked list."""
        parts = self.of_byte[np.frombuffer(word, np.uint8)]
        ranks = self.rank(parts[:-1], parts[1:])
        ids, n = parts.tolist(), len(parts)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(int(ranks[i]), int(i)) for i in np.flatnonzero(ranks != NO_RANK)]
        current = ranks.tolist() + [int(NO_RANK)]
        heapq.heapify(heap)

        def refresh(i: int) -> None:
            j = after[i]
            r = self.one.get((ids[i] << 32) | ids[j]) if j < n else None
            current[i] = int(NO_RANK) if r is None else r
            if r is not None:
                heapq.heappush(heap, (r, i))

        while heap:
            r, i = heapq.heappop(heap)
            if current[i] != r:
                continue
            j = after[i]
            ids[i], ids[j], current[j] = int(self.made_by_rank[r]), -1, -1
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
            refresh(i)
            if before[i] >= 0:
                refresh(before[i])
        return np.array([x for x in ids if x >= 0], np.int32)

    @property
    def one(self) -> dict[int, int]:
        if not hasattr(self, "_one"):
            self._one = dict(zip(self.keys.tolist(), self.ranks.tolist(), strict=True))
        return self._one

    def learn(self, new: list[str]) -> None:
        raw = [w.encode() for w in new]
        found: list[np.ndarray] = [np.zeros(0, np.int32)] * len(new)
        n = np.array([len(w) for w in raw])
        for low, high in ((0, 8), (8, 16), (16, SHORT)):
            some = np.flatnonzero((n > low) & (n <= high))
            for i in range(0, len(some), 16_384):
                part = some[i : i + 16_384]
                for k, ids in zip(part, self.merge_short([raw[k] for k in part]), strict=True):
                    found[k] = ids
        for k in np.flatnonzero(n > SHORT):
            found[k] = self.merge_long(raw[k])
        self.chars += sum(map(len, new))
        self.words.update(zip(new, range(len(self.words), len(self.words) + len(new)), strict=True))
        self.flat += found
        self.lengths.append(np.array([len(x) for x in found], np.int64))

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of whole texts; the strings of special tokens become their ids."""
        split, special = [], []
        for t in texts:
            words, places = [], []
            if self.specials and any(s in t for s in self.special):
                at = 0
                for m in self.specials.finditer(t):
                    words += self.split.findall(t[at : m.start()])
                    places.append((len(words), self.special[m[0]]))
                    at = m.end()
                words += self.split.findall(t[at:])
            else:
                words = self.split.findall(t)
            split.append(words)
            special.append(places)
        distinct: set[str] = set().union(*split) if split else set()
        new = [w for w in distinct if w not in self.words]
        if len(self.words) + len(new) > CACHE_WORDS or self.chars > CACHE_CHARS:
            self.clear()
            new = list(distinct)
        if new:
            self.learn(new)
        self.flat, self.lengths = [np.concatenate(self.flat)], [np.concatenate(self.lengths)]
        flat, lengths = self.flat[0], self.lengths[0]
        starts = np.cumsum(lengths) - lengths
        get, out = self.words.__getitem__, []
        for words, places in zip(split, special, strict=True):
            w = np.fromiter(map(get, words), np.int64, len(words))
            n = lengths[w]
            ends = np.cumsum(n)
            ids = flat[np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts[w] - ends + n, n)]
            if places:
                ids = np.insert(ids, [int(n[:k].sum()) for k, _ in places], [i for _, i in places]).astype(np.int32)
            out.append(ids)
        return out

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids; bytes that are no UTF-8 become replacement characters."""
        pieces = self.pieces
        return b"".join([pieces[i] for i in ids.tolist()]).decode("utf-8", "replace")


@cache
def vocabulary(path: str) -> ByteBPE:
    out = ByteBPE(path)
    release()  # what reading the file took
    return out


def encode_texts(df: DataFrame, tokenizer: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """Add the token ids of the whole text as an array of ints, in place of a column of that name. Null and empty texts have no ids. No shuffle."""
    ship(df.sparkSession)

    def encoded(texts: pd.Series) -> pd.Series:
        return pd.Series(vocabulary(tokenizer).encode(["" if t is None else t for t in texts]), dtype=object)

    return put(df, {ids: F.pandas_udf(encoded, "array<int>")(col(text))})


def decode_ids(df: DataFrame, tokenizer: str, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """Add the text of an array of token ids; null ids give an empty text. An id outside the vocabulary is an error. No shuffle."""
    ship(df.sparkSession)

    def decoded(lists: pd.Series) -> pd.Series:
        vocab = vocabulary(tokenizer)
        return pd.Series([vocab.decode(np.asarray(x if x is not None else [], np.int64)) for x in lists], dtype=object)

    return put(df, {text: F.pandas_udf(decoded, "string")(col(ids))})


def bpe_round_trip(df: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Encode every whole text, decode its ids again, and return key, n_tokens and the SHA-256 of both.

    ids_sha256 is of the decimal ids joined by commas, decoded_sha256 of the decoded text in UTF-8. Texts and ids stay
    within a task; batches hold 2 MB of text at most, or one longer text. Null texts are empty texts: no tokens, and the digest of nothing. The key
    may be null and may repeat. An empty table gives an empty result.
    """
    ship(df.sparkSession)
    kind = dict(df.dtypes)[key]

    def trip(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(tokenizer)
        decimal = vocab.decimal
        for batch in batches(it, "text", BATCH_BYTES):
            n, a, b = [], [], []
            for ids in vocab.encode(batch.column("text").fill_null("").to_pylist()):
                n.append(len(ids))
                a.append(hashlib.sha256(",".join([decimal[i] for i in ids.tolist()]).encode()).hexdigest())
                b.append(hashlib.sha256(vocab.decode(ids).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())], ["key", "n_tokens", "ids_sha256", "decoded_sha256"])

    out = df.select(col(key).alias("key"), col(text).alias("text")).mapInArrow(trip, f"key {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
    return out.withColumnRenamed("key", key)
