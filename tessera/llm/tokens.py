"""Token ids in fixed-width bit-packed blocks."""

from __future__ import annotations

import json
import os
import re
import struct
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.bpe import byte_names
from tessera.llm.common import PIECE, SPACES, batches, mix, new_path, pieces, place_keys, ship, small

#: Ids of a block, about; a document is never cut, so a longer one has a block of its own.
BLOCK_IDS = 1 << 18
#: Head of a block: magic, bits of an id, number of documents, number of ids.
HEAD = struct.Struct("<4sBxxxII")
MAGIC = b"TSR1"


def width(vocabulary: int) -> int:
    """Bits that hold the ids 0 to ``vocabulary`` - 1."""
    return max(1, int(vocabulary - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    """``bits`` bits for each id, least bit first, padded to whole bytes. 64 ids fill ``bits`` 64-bit words, so all groups of 64 are shifted into place side by side."""
    n, groups = len(ids), -(-len(ids) // 64)
    if n and int(ids.max()) >> bits:
        raise ValueError(f"an id needs more than {bits} bits")
    lanes = np.zeros(groups * 64, np.uint64)
    lanes[:n] = ids
    lanes, words = np.ascontiguousarray(lanes.reshape(groups, 64).T), np.zeros((bits, groups), np.uint64)
    for k in range(64):
        word, shift = divmod(k * bits, 64)
        words[word] |= lanes[k] << np.uint64(shift)
        if shift + bits > 64:
            words[word + 1] |= lanes[k] >> np.uint64(64 - shift)
    return words.T.astype("<u8").tobytes()[: -(-n * bits // 8)]


def unpack(data: bytes | memoryview, bits: int, start: int, n: int) -> np.ndarray:
    """The ids ``start`` to ``start + n`` of packed data; reads no bytes but those of their groups of 64."""
    if not n:
        return np.zeros(0, np.uint32)
    low, high = start // 64, -(-(start + n) // 64)
    raw = np.zeros((high - low) * bits * 8, np.uint8)
    held = np.frombuffer(data, np.uint8)[low * bits * 8 : high * bits * 8]
    raw[: len(held)] = held
    words = np.ascontiguousarray(raw.view("<u8").reshape(-1, bits).T)
    lanes, mask = np.empty((64, high - low), np.uint32), np.uint64((1 << bits) - 1)
    for k in range(64):
        word, shift = divmod(k * bits, 64)
        lane = words[word] >> np.uint64(shift)
        if shift + bits > 64:
            lane |= words[word + 1] << np.uint64(64 - shift)
        lanes[k] = lane & mask
    return lanes.T.ravel()[start - low * 64 :][:n]


def write_block(documents: list[np.ndarray], bits: int) -> bytes:
    """Head, the offsets of the documents (in ids), packed ids."""
    lengths = np.array([len(d) for d in documents], np.int64)
    ids = np.concatenate(documents) if documents else np.zeros(0, np.uint32)
    offsets = np.zeros(len(documents) + 1, "<u4")
    offsets[1:] = np.cumsum(lengths)
    return HEAD.pack(MAGIC, bits, len(documents), len(ids)) + offsets.tobytes() + pack(ids, bits)


_BYTE_NAMES = byte_names()


class Block:
    """Random access to the documents of a block."""

    def __init__(self, data: bytes) -> None:
        magic, self.bits, self.documents, self.n = HEAD.unpack_from(data)
        if magic != MAGIC:
            raise ValueError("not a block of token ids")
        self.offsets = np.frombuffer(data, "<u4", self.documents + 1, HEAD.size)
        self.body = memoryview(data)[HEAD.size + 4 * (self.documents + 1) :]

    def ids(self, start: int = 0, n: int | None = None) -> np.ndarray:
        return unpack(self.body, self.bits, start, self.n - start if n is None else n)

    def document(self, i: int) -> np.ndarray:
        return self.ids(int(self.offsets[i]), int(self.offsets[i + 1] - self.offsets[i]))


#: Texts that are split here: ASCII, Latin letters, no apostrophe (which may begin a contraction).
_OTHER = re.compile("[^\t\n\r -&(-~À-ÖØ-öø-įı-ɏ]")
#: Classes of bytes: white space, letters (all of the Latin ones beyond ASCII too), digits, the rest.
_CLASS = np.full(256, 3, np.uint8)
_CLASS[SPACES] = 0
_CLASS[[*range(ord("a"), ord("z") + 1), *range(128, 256)]] = 1
_CLASS[ord("0") : ord("9") + 1] = 2
_HASH = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03))
#: Words whose ids a worker keeps between batches, and bytes of them.
CACHE_WORDS, CACHE_BYTES = 400_000, 16 << 20


@cache
def _tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def _split(data: np.ndarray, breaks: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, lengths and 64-bit hashes of the words in lower-cased bytes: runs of letters, single digits, runs of the rest."""
    kind = _CLASS[data]
    edge = np.empty(len(data), bool)
    edge[0] = True
    np.not_equal(kind[1:], kind[:-1], out=edge[1:])
    edge |= kind == 2
    edge[breaks[breaks < len(data)]] = True
    starts = np.flatnonzero(edge)
    lengths = np.diff(np.append(starts, len(data)))
    place = np.arange(len(data)) - np.repeat(starts, lengths)
    hashes = mix(np.add.reduceat(_HASH[data] * place_keys(int(place.max()) + 1)[place], starts) + lengths.astype(np.uint64))
    words = kind[starts] > 0
    return starts[words], lengths[words], hashes[words]


def _expanded(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """All places of the runs of those starts and lengths, one run after another."""
    ends = np.cumsum(lengths)
    return np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(starts - ends + lengths, lengths)


def _differ(a: np.ndarray, a_starts: np.ndarray, a_lengths: np.ndarray, b: np.ndarray, b_starts: np.ndarray, b_lengths: np.ndarray) -> np.ndarray:
    """Which words of ``a`` are other bytes than the words of ``b`` beside them."""
    out = a_lengths != b_lengths
    for i, j in pieces(np.concatenate([[0], np.cumsum(a_lengths)]), PIECE):
        same = i + np.flatnonzero(~out[i:j])
        unequal = a[_expanded(a_starts[same], a_lengths[same])] != b[_expanded(b_starts[same], b_lengths[same])]
        if unequal.any():
            out[np.repeat(same, a_lengths[same])[unequal]] = True
    return out


class WordEncoder:
    """Ids of whole texts by the tokenizers library, with the ids of words kept.

    A tokenizer that splits normalised text to words before any merge gives a word the same ids at every place. So the
    library's model encodes each new word once, and texts of plain Latin script are only split here. Words are looked up by
    64-bit hashes and then compared byte by byte; a text with a word whose hash is another word's goes to the library whole, as
    do all texts of other scripts.
    """

    def __init__(self, path: str) -> None:
        self.tokenizer = _tokenizer(path)
        spec = json.loads(self.tokenizer.to_str())
        self.special = [t["content"] for t in spec["added_tokens"]]
        steps = [s["type"] for s in (spec["normalizer"] or {}).get("normalizers", [])]
        pre = spec["pre_tokenizer"].get("pretokenizers", [{}])
        self.splits = steps == ["NFC", "Replace", "Lowercase"] and [x["type"] for x in pre] == ["Split", "ByteLevel"] and pre[0]["behavior"] == "Removed" and spec["post_processor"] is None
        self.clear()

    def clear(self) -> None:
        self.hashes, self.place = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.starts, self.lengths, self.flat = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint32)
        self.at, self.size, self.bytes = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint8)

    def learn(self, hashes: np.ndarray, words: list[bytes]) -> None:
        tokenize, ids, lengths = self.tokenizer.model.tokenize, [], []
        for w in words:
            found = [t.id for t in tokenize(w.decode() if w.isascii() else "".join([_BYTE_NAMES[b] for b in w]))]
            ids += found
            lengths.append(len(found))
        n, size = np.array(lengths, np.int64), np.array([len(w) for w in words], np.int64)
        self.starts = np.concatenate([self.starts, len(self.flat) + np.cumsum(n) - n])
        self.lengths, self.flat = np.concatenate([self.lengths, n]), np.concatenate([self.flat, np.array(ids, np.uint32)])
        self.at, self.size = np.concatenate([self.at, len(self.bytes) + np.cumsum(size) - size]), np.concatenate([self.size, size])
        self.bytes = np.concatenate([self.bytes, np.frombuffer(b"".join(words), np.uint8)])
        both, place = np.concatenate([self.hashes, hashes]), np.concatenate([self.place, len(self.place) + np.arange(len(hashes))])
        order = np.argsort(both)
        self.hashes, self.place = both[order], place[order]

    def known(self, hashes: np.ndarray) -> np.ndarray:
        if not len(self.hashes):
            return np.zeros(len(hashes), bool)
        return self.hashes[np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)] == hashes

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        plain = [self.splits and not _OTHER.search(t) and not any(s in t for s in self.special) for t in texts]
        done = iter(self._plain([t.lower().encode() for t, p in zip(texts, plain, strict=True) if p]))
        out = [next(done) if p else None for p in plain]
        rest = [i for i, ids in enumerate(out) if ids is None]
        for i, found in zip(rest, self.tokenizer.encode_batch([texts[i] for i in rest], add_special_tokens=False) if rest else (), strict=True):
            out[i] = np.array(found.ids, np.uint32)
        return out

    def _plain(self, texts: list[bytes]) -> list[np.ndarray | None]:
        """Ids of lower-cased texts; None for one that has to go to the library."""
        offsets = np.zeros(len(texts) + 1, np.int64)
        offsets[1:] = np.cumsum([len(t) for t in texts])
        raw = b"".join(texts)
        data, hashes, counts = np.frombuffer(raw, np.uint8), [], np.zeros(len(texts), np.int64)
        starts, lengths = [], []
        for i, j in pieces(offsets, PIECE // 2):
            at, end = int(offsets[i]), int(offsets[j])
            while at < end:  # once, but for a very long text, which is cut at white space
                stop = min(end, at + 4 * PIECE)
                gaps = np.flatnonzero(_CLASS[data[at:stop]] == 0) if stop < end else ()
                stop = at + int(gaps[-1]) + 1 if len(gaps) else end
                breaks = offsets[i:j][offsets[i:j] >= at]
                s, n, h = _split(data[at:stop], breaks - at)
                counts[i:j] += np.bincount(np.searchsorted(offsets[i:j], s + at, "right") - 1, minlength=j - i)
                starts.append(s + at), lengths.append(n), hashes.append(h)
                at = stop
        if not hashes:
            return [np.zeros(0, np.uint32)] * len(texts)
        words, first, place = np.unique(np.concatenate(hashes), return_index=True, return_inverse=True)
        starts, lengths = np.concatenate(starts), np.concatenate(lengths)
        new = np.flatnonzero(~self.known(words))
        if len(self.hashes) + len(new) > CACHE_WORDS or len(self.bytes) > CACHE_BYTES:
            self.clear()
            new = np.arange(len(words))
        self.learn(words[new], [raw[a : a + n] for a, n in zip(starts[first[new]].tolist(), lengths[first[new]].tolist(), strict=True)])
        index = self.place[np.searchsorted(self.hashes, words)][place]
        strange = np.zeros(len(texts), bool)
        strange[np.repeat(np.arange(len(texts)), counts)[_differ(data, starts, lengths, self.bytes, self.at[index], self.size[index])]] = True
        out, at = [], 0
        for n, other in zip(counts.tolist(), strange.tolist(), strict=True):
            w = index[at : at + n]
            out.append(None if other else self.flat[_expanded(self.starts[w], self.lengths[w])])
            at += n
        return out


@cache
def word_encoder(path: str) -> WordEncoder:
    return WordEncoder(path)


#: A row of the table of blocks: its task and number there, ids before it in the task, its documents' keys, number of ids, the block itself.
_BLOCKS = "part int, block int, before long, keys array<long>, n_ids long, data binary"


def write_tokens(df: DataFrame, tokenizer: str, end_id: int, key: str = "doc_id", text: str = "text", vocabulary: int | None = None) -> str:
    """Encode all texts with the tokenizers library, add ``end_id`` to each, and write the ids in blocks in the order of the key. Returns the path.

    The texts are sorted by range, so each task writes a run of keys. Each row of the table of blocks is one file-format
    block (see ``write_block``) with its part, number, the keys and the number of ids, written by
    Spark's committer: a lost task leaves nothing behind. Ids have the least bits that hold the ``vocabulary``; where it is not
    given, the tokenizer's own and the end id. Null texts count as empty; null keys come first; rows that
    repeat a key stay next to each other, in the order of a hash of their texts. An empty table writes no blocks.
    """
    spark = df.sparkSession
    ship(spark)
    path = new_path(spark, "tokens")
    bits = width(vocabulary or max(end_id, *_tokenizer(tokenizer).get_vocab(with_added_tokens=True).values()) + 1)

    def blocks(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, number, before, held, keys, size = TaskContext.get().partitionId(), 0, 0, [], [], 0

        def flush() -> pa.RecordBatch:
            row = ([part], pa.int32()), ([number], pa.int32()), ([before], pa.int64()), ([keys], pa.list_(pa.int64())), ([size], pa.int64()), ([write_block(held, bits)], pa.binary())
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in row], ["part", "block", "before", "keys", "n_ids", "data"])

        encoder = word_encoder(tokenizer)
        for batch in batches(it, "text"):
            texts = batch.column("text").fill_null("").to_pylist()
            for k, ids in zip(batch.column("key").to_pylist(), encoder.encode(texts), strict=True):
                if held and size + len(ids) + 1 > BLOCK_IDS:
                    yield flush()
                    number, before, held, keys, size = number + 1, before + size, [], [], 0
                held.append(np.append(ids, np.uint32(end_id)))
                keys.append(k)
                size += len(ids) + 1
        if held:
            yield flush()

    rows = df.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text"))
    order = (F.col("key").asc_nulls_first(), F.xxhash64("text"))  # the hash parts the rows of a frequent key, which may be null
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    rows.mapInArrow(blocks, _BLOCKS).write.parquet(path)
    return path


def read_tokens(spark, path: str) -> DataFrame:
    """The documents of a table of blocks: key, start (ids of all documents before it), ids, all from the files.

    Only the numbers of ids by task are added up in order, one for each task that wrote; the blocks stay where they are read.
    """
    table = spark.read.schema(_BLOCKS).parquet(path)
    sums = table.groupBy("part").agg(F.sum("n_ids").alias("n"))
    before = sums.select("part", (F.sum("n").over(Window.partitionBy().orderBy("part")) - F.col("n")).alias("start"))
    placed = table.join(small(before), "part")

    def documents(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for keys, start, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                block = Block(data.as_buffer().to_pybytes())
                ids = block.ids()
                offsets = block.offsets.astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(start + offsets[:-1].astype(np.int64)), pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids.astype(np.int32)))], ["key", "start", "ids"])

    return placed.select("keys", (F.col("start") + F.col("before")).alias("start"), "data").mapInArrow(documents, "key long, start long, ids array<int>")


def token_digests(documents: DataFrame) -> DataFrame:
    """n_tokens and the CRC-32 of the ids as little-endian unsigned 32-bit integers, for each document of ``read_tokens``."""

    def digests(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            lists = batch.column("ids")
            flat, offsets = lists.values.to_numpy().astype("<u4"), lists.offsets.to_numpy()
            crc = [zlib.crc32(flat[a:b].tobytes()) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("start"), pa.array(np.diff(offsets).astype(np.int64)), pa.array(crc, pa.int64())], ["key", "start", "n_tokens", "ids_crc32"])

    return documents.mapInArrow(digests, "key long, start long, n_tokens long, ids_crc32 long")
