"""What the operators of this subpackage share: shared storage, shipping of the package, column names, byte-level text work."""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.shipping import ship
from tessera.storage import shared_folder
from tessera.storage import stored as written

__all__ = ["batches", "col", "mix", "new_path", "opened", "pieces", "place_keys", "put", "release", "sealed", "ship", "small", "text_bytes", "unit", "word_hashes", "word_pieces", "written"]

#: Bytes of text that the numpy passes work on at a time.
PIECE = 1 << 20


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/tessera/{name}-{uuid.uuid4().hex}"


#: Rows of a table of one or two longs that is sent to every task; 16 bytes each there.
BROADCAST_ROWS = 2_000_000


def small(table: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """A written table, with the hint to broadcast it if it is counted to have so many rows at most; else it is joined by a shuffle."""
    return F.broadcast(table) if table.count() <= rows else table


def col(name: str) -> Column:
    """The column of just this name, dots and all."""
    return F.col("`" + name.replace("`", "``") + "`")


def sealed(df: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """``df`` with names that clash with none of an operator's own, and the new name of each column. ``opened`` takes the names back."""
    names = {c: f"in_{i}" for i, c in enumerate(df.columns)}
    return df.toDF(*names.values()), names


def opened(df: DataFrame, names: dict[str, str], columns: dict[str, Column] | None = None) -> DataFrame:
    """The columns of a sealed table by their first names, and these ones last; those of the same names give way."""
    columns = columns or {}
    over = {c.lower() for c in columns}
    return df.select(*(F.col(n).alias(c) for c, n in names.items() if c.lower() not in over), *(v.alias(k) for k, v in columns.items()))


def put(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """``df`` with these columns last; columns of the same names give way."""
    over = {c.lower() for c in columns}
    return df.select(*(col(c) for c in df.columns if c.lower() not in over), *(v.alias(k) for k, v in columns.items()))


def unit(*parts: Column | str, seed: int = 0) -> Column:
    """A number in [0, 1) that depends on ``parts`` and ``seed`` only: 48 bits of an MD5, which SQL engines share."""
    text = F.concat_ws("|", F.lit(str(seed)), *(F.coalesce(F.col(p).cast("string") if isinstance(p, str) else p.cast("string"), F.lit("-")) for p in parts))
    return F.conv(F.substring(F.md5(text), 1, 12), 16, 10).cast("double") / F.lit(float(1 << 48))


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix64) over an array."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _byte_table(seed: int) -> np.ndarray:
    table = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed)) | np.uint64(1)
    table[ord("A") : ord("Z") + 1] = table[ord("a") : ord("z") + 1]
    table[SPACES] = 0
    return table


#: ASCII white space.
SPACES = [9, 10, 11, 12, 13, 32]
IS_SPACE = np.zeros(256, bool)
IS_SPACE[SPACES] = True
_TABLE = _byte_table(7)
_keys = np.zeros(0, np.uint64)


def place_keys(n: int) -> np.ndarray:
    """A pseudo-random factor for each of the first ``n`` places of a word. The factors are no powers of one number, so texts built to collide at every base, such as Thue-Morse words, don't."""
    global _keys
    if len(_keys) < n:
        _keys = mix(np.arange(1, max(n, 4096) + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return _keys[:n]


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column and the offsets of its rows; nulls are empty."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    column = column.fill_null("").cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] is not None else np.zeros(0, np.uint8)
    return data, offsets


def pieces(offsets: np.ndarray, size: int = PIECE) -> Iterator[tuple[int, int]]:
    """Runs of rows of about ``size`` bytes; a longer row makes a run of its own."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + size, "right")) - 1)
        yield i, min(j, n)
        i = j


def _words(data: np.ndarray, breaks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and starts of the words in ``data``; a word also begins at each of ``breaks``."""
    space = IS_SPACE[data]
    before = np.empty_like(space)
    before[:1] = True
    before[1:] = space[:-1]
    before[breaks[breaks < len(data)]] = True
    starts = np.flatnonzero(before & ~space)
    if not len(starts):
        return np.zeros(0, np.uint64), starts
    first = int(starts[0])
    place = np.arange(first, len(data)) - np.repeat(starts, np.diff(np.append(starts, len(data))))
    values = _TABLE[data[first:]] * place_keys(int(place.max()) + 1)[place]
    return mix(np.add.reduceat(values, starts - first)), starts


def word_pieces(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """All words (runs of other than ASCII white space, A-Z as a-z) in pieces of bounded size: bytes, 64-bit hashes, starts in those bytes, row numbers. Long rows are cut at white space."""
    for i, j in pieces(offsets):
        at, end = int(offsets[i]), int(offsets[j])
        while at < end:
            stop = min(end, at + 4 * PIECE)
            if stop < end:
                gaps = np.flatnonzero(IS_SPACE[data[at:stop]])
                if len(gaps):
                    stop = at + int(gaps[-1]) + 1
                else:  # one word longer than that: up to its end
                    gap = np.flatnonzero(IS_SPACE[data[stop:end]])
                    stop = stop + int(gap[0]) + 1 if len(gap) else end
            breaks = offsets[i:j] - at
            hashes, starts = _words(data[at:stop], breaks[breaks >= 0])
            yield data[at:stop], hashes, starts, i + np.searchsorted(breaks, starts, "right") - 1
            at = stop


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words and how many each row has."""
    hashes, counts = [np.zeros(0, np.uint64)], np.zeros(len(offsets) - 1, np.int64)
    for _, h, _, rows in word_pieces(data, offsets):
        hashes.append(h)
        counts += np.bincount(rows, minlength=len(counts))
    return np.concatenate(hashes), counts


try:
    _trim = ctypes.CDLL("libc.so.6").malloc_trim
except (OSError, AttributeError):  # another C library: it keeps what it likes
    _trim = None


def release() -> None:
    """Give freed memory back to the system. Workers live on between stages, and what one stage has freed counts against the executor in the next."""
    pa.default_memory_pool().release_unused()
    if _trim:
        _trim(0)


def batches(it: Iterator[pa.RecordBatch], text: str, size: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about ``size`` bytes of text at most."""
    for batch in it:
        if batch.num_rows:
            _, offsets = text_bytes(batch.column(text))
            for i, j in pieces(offsets, size):
                yield batch.slice(i, j - i)
            del batch, offsets
            release()
