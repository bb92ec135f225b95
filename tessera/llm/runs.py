"""Periodic runs of words: every maximal repetition of a text, by Lyndon arrays over an ordered alphabet."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import IS_SPACE, batches, opened, release, sealed, ship, text_bytes

#: Words of the shortest run that counts, whatever its period.
LEAST = 12
#: Text that a task works on at a time.
BATCH_BYTES = 4 << 20
RUN = "struct<start:bigint,length:bigint,period:bigint>"
_SPACE = np.uint8(32)


def lyndon_edges(word: list[int]) -> tuple[list[int], list[int]]:
    """For each place the next one whose suffix is smaller (so the longest Lyndon word from a place ends before it), and how far the two suffixes match.

    The end of the text is smaller than any letter. Letters are only compared, left to right, against a stack of places whose next smaller suffix is still open. Two suffixes that begin
    alike are told apart by what is known of earlier matches, so that letters are read again as little as can be:

    * by the chain: ``top`` was popped before ``below``, so the match of the three places follows from the two known ones, unless these are of equal length;
    * by the window: the match that reaches furthest right, of (a, b) up to ``reach``, shows places b and on as a copy of a and on, and a pair inside it has the match of its copy, cut at ``reach``.

    Only what lies beyond is read, and then moves the window on.
    """
    n = len(word)
    after, match = [n] * n, [0] * n  # next smaller suffix and the match with it
    before, back = [-1] * n, [0] * n  # previous smaller suffix and the match with it
    a = b = reach = 0
    stack: list[int] = []
    for j in range(n):
        x = word[j]
        last, same = -1, 0  # the place popped last and its match with j
        while stack:
            i = stack[-1]
            y = word[i]
            if y < x:
                break
            if y > x:
                after[i] = j
                last, same = stack.pop(), 0
                continue
            k = 0
            if last >= 0 and before[last] == i:
                known = back[last]
                k = known if known < same else same
                settled = known != same
            else:
                settled = False
            if not settled and j < reach and i >= b:
                shift = b - a
                c, d = i - shift, j - shift
                copy = match[c] if after[c] == d else back[d] if before[d] == c else -1
                if copy >= 0:
                    k, settled = (copy, True) if j + copy < reach else (reach - j, False)
            if not settled:
                e, f = i + k, j + k
                while f < n and word[e] == word[f]:
                    e += 1
                    f += 1
                k = f - j
                if f > reach:
                    a, b, reach = i, j, f
            if j + k < n and word[i + k] < word[j + k]:
                back[j] = k
                break
            after[i], match[i] = j, k
            last, same = stack.pop(), k
        before[j] = stack[-1] if stack else -1
        stack.append(j)
    return after, match


def runs(word: np.ndarray, least: int = LEAST) -> list[tuple[int, int, int]]:
    """All (start, length, period) of maximal repetitions of whole numbers, of at least ``least`` letters and two periods, by start and period.

    Every run has a Lyndon word of its period's length, in the order of the letters or in the opposite one, that is the longest from its place. So each place and order gives one candidate,
    which is stretched to both sides; matches to the right are known from ``lyndon_edges``, those to the left end at the last candidate of the same period that they meet.
    """
    n, found = len(word), {}
    for letters in (word, -word):
        after, match = lyndon_edges(letters.tolist())
        to, right = np.array(after, np.int64), np.array(match, np.int64)
        at = np.arange(n)
        period = to - at
        # A run matches itself one period on over at least its length less the period; part of that lies at the candidate or just before it.
        touches = (right > 0) | ((at > 0) & (word[at - 1] == word[to - 1]))
        ends: dict[int, tuple[int, int]] = {}  # for each period where the last match to the left began, and where it was asked for
        for i, p, r in zip(*(x[touches].tolist() for x in (at, period, right)), strict=True):
            begin, asked = ends.get(p, (0, -1))
            left = _left(word, i, p, asked)
            if left == asked + 1 and asked >= 0:
                left = begin
            ends[p] = (left, i - 1)
            length = i + p + r - left
            if length >= max(least, 2 * p):
                found[left, p] = length
    return sorted((s, length, p) for (s, p), length in found.items())


def _left(word: np.ndarray, i: int, p: int, stop: int) -> int:
    """The first place from which all letters before ``i`` equal those ``p`` on; no further than just after ``stop``."""
    size, at = 16, i
    while at > stop + 1:
        low = max(stop + 1, at - size)
        differ = np.flatnonzero(word[low:at] != word[low + p : at + p])
        if len(differ):
            return low + int(differ[-1]) + 1
        at, size = low, size * 4
    return at


def words_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bytes and row offsets of texts, and starts, ends and letters of their words. Letters number the distinct words of the batch in byte order."""
    data, offsets = text_bytes(column)
    low, high = int(offsets[0]), int(offsets[-1])
    data, offsets = data[low:high], offsets - low
    solid = ~IS_SPACE[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[:-1] = solid
    edge[1:-1] ^= solid[:-1]
    cut = offsets[1:-1]
    cut = cut[(cut > 0) & (cut < len(data))]
    split = np.unique(cut[solid[cut] & solid[cut - 1]])  # one text ends and the next begins without white space between
    if len(data):
        edge[-1] = solid[-1]
    marks = np.flatnonzero(edge)
    marks = np.sort(np.concatenate([marks, split, split])) if len(split) else marks
    starts, ends = marks[::2], marks[1::2]
    sizes = np.concatenate([[0], np.cumsum(ends - starts)]).astype(np.int64)
    packed = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(sizes), pa.py_buffer(data[solid])])
    coded = packed.dictionary_encode()
    order = coded.dictionary.to_pylist()
    rank = np.empty(len(order), np.int64)
    rank[sorted(range(len(order)), key=order.__getitem__)] = np.arange(len(order))
    return data, offsets, starts, ends, rank[coded.indices.to_numpy()]


def stretches(letters: np.ndarray, rows: np.ndarray, least: int = LEAST) -> Iterator[tuple[int, int]]:
    """Where runs can lie: texts cut at words that occur once in their stretch, again and again; stretches under ``least`` words go.

    Each word of a run has its like one period on or back within the run, so a word without its like in a stretch is in none of its runs, and no run reaches across it.
    """
    at = np.arange(len(letters))
    part = rows.astype(np.int64)
    span = int(letters.max()) + 1 if len(letters) else 1
    while len(at):
        key = part * span + letters[at]
        order = np.argsort(key, kind="stable")
        ranked = key[order]
        twin = np.zeros(len(key), bool)
        same = ranked[1:] == ranked[:-1]
        twin[1:] |= same
        twin[:-1] |= same
        keep = np.zeros(len(key), bool)
        keep[order] = twin
        left = at[keep]
        new = np.cumsum((np.diff(left, prepend=-2) != 1) | (np.diff(part[keep], prepend=-1) != 0)) - 1
        long = np.bincount(new)[new] >= least if len(new) else np.zeros(0, bool)
        done = len(left) == len(at)
        at, part = left[long], new[long]
        if done:
            break
    if len(at):
        first = np.flatnonzero(np.diff(part, prepend=-1))
        for i, j in zip(first, np.append(first[1:], len(at)), strict=True):
            yield int(at[i]), int(at[j - 1]) + 1


def find_runs(df: DataFrame, text: str = "text", runs_to: str = "runs", kept_to: str = "collapsed", keep_text: bool = True) -> DataFrame:
    """Add the periodic runs of each whole text's words, and the text without the words that only repeat.

    Words are runs of other than ASCII white space, numbered from 0. A run is a stretch of words with smallest period q, at least 12 words and two periods long, that no neighbouring word
    extends: an array of start, length and period, by start, then period. The collapsed text has the words joined by one space, without those that any run contains after its first q words.

    Runs come from Lyndon arrays in both orders of the alphabet (``lyndon_edges``, after the runs theorem and Ellert and Fischer), over stretches that have no word without its like
    (``stretches``). No suffix array, tree or fingerprint is made: words of a batch are numbered in their order and then only compared. A text is handled whole in one task, in space that follows its length; no shuffle.

    Null and empty texts, and texts of white space, have no runs and an empty collapsed text. Columns of the two names give way, and the text too if ``keep_text`` is false. Rows may repeat; an
    empty table gives an empty result.
    """
    ship(df.sparkSession)
    bare, names = sealed(df)
    words = names[text]
    keep = [n for n in names.values() if keep_text or n != words]

    def found(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(it, words, BATCH_BYTES):
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), *_found(batch.column(words))], [*keep, "out_runs", "out_text"])

    kinds = dict(bare.dtypes)
    out = bare.mapInArrow(found, ", ".join([*(f"`{c}` {kinds[c]}" for c in keep), f"out_runs array<{RUN}>", "out_text string"]))
    return opened(out, {c: n for c, n in names.items() if n in keep}, {runs_to: F.col("out_runs"), kept_to: F.col("out_text")})


def _found(column: pa.Array) -> tuple[pa.ListArray, pa.Array]:
    data, offsets, starts, ends, letters = words_of(column)
    row = np.searchsorted(offsets, starts, "right") - 1
    first = np.searchsorted(row, np.arange(len(offsets)))  # of each text its first word
    drop = np.zeros(len(starts) + 1, np.int64)
    rows, out = [], []
    for a, b in stretches(letters, row):
        piece = np.unique(letters[a:b], return_inverse=True)[1]
        r, base = int(row[a]), a - int(first[row[a]])
        for s, length, p in runs(piece):
            rows.append(r)
            out.append((base + s, length, p))
            drop[a + s + p] += 1
            drop[a + s + length] -= 1
    counts = np.bincount(np.array(rows, np.int64), minlength=len(offsets) - 1)
    table = np.array(out, np.int64).reshape(-1, 3)
    lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32()), pa.StructArray.from_arrays([pa.array(table[:, i]) for i in range(3)], ["start", "length", "period"]))
    kept = np.cumsum(drop[:-1]) == 0
    # Bytes of kept words, and one space before each of them but its text's first.
    write = np.zeros(len(data) + 1, np.int8)
    np.add.at(write, starts[kept], 1)
    np.add.at(write, ends[kept], -1)
    write = np.cumsum(write[:-1], dtype=np.int8).astype(bool)
    lead = kept.copy()
    some = np.flatnonzero(kept)
    lead[some[np.diff(row[some], prepend=-1) != 0]] = False
    gaps = starts[lead] - 1
    data = data.copy()
    data[gaps] = _SPACE
    write[gaps] = True
    sizes = np.concatenate([[0], np.cumsum(write)])[offsets]
    texts = pa.LargeStringArray.from_buffers(len(offsets) - 1, pa.py_buffer(sizes.astype(np.int64)), pa.py_buffer(data[write])).cast(pa.string())
    release()
    return lists, texts
