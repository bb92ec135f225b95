"""A full-text index that takes upserts and deletes: immutable segments with tombstones, merged by tiers of size."""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions import text
from tessera.operators import search
from tessera.shipping import ship
from tessera.storage import spread, stored

#: Segments of one tier that are merged to one; a tier's segments have up to so many times the documents of the one below.
FANOUT = 4
_LIVE = "version long, segment string, generation long, tier int, documents long"
_DOCS = "doc_id string, generation long, deleted boolean, content_hash string, place long"
_POSTINGS = "generation long, block long, token string, at array<bigint>"
#: Documents of a block, in 64s; documents whose postings one task makes; bytes of text whose words are sorted at a time.
BLOCK, TASK_DOCUMENTS, TEXT_BYTES = 1024, 5000, 8 << 20
#: Rows of a table of live documents, one for each block, that are sent to every task at most; 200 bytes each there.
LIVE_ROWS = 300_000


#: Bytes of words as they are indexed: ASCII capitals as small letters, a space for other ASCII that is no letter or digit.
_BYTES = np.arange(256, dtype=np.uint8)
_BYTES[:128] = [ord(chr(i).lower()) if chr(i).isalnum() else 32 for i in range(128)]


def _for_words(body: Column) -> Column:
    """A text as ``_words`` takes it: one with characters beyond ASCII is in small letters, and of those only letters and digits are left."""
    plain = (F.length(body) == F.octet_length(body)) & F.is_valid_utf8(body)
    return F.when(plain, body).otherwise(F.regexp_replace(F.lower(body), r"[^\x00-\x7F\p{L}\p{N}]+", " "))


def _words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The words of texts, one after the other, as ``text.word_tokens`` splits them, and how many each text has."""
    texts = texts.cast(pa.large_binary()).fill_null(b"")
    ends = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    first, data = int(ends[0]), texts.buffers()[2]
    raw = np.frombuffer(data, np.uint8)[first : int(ends[-1])] if data is not None else np.zeros(0, np.uint8)
    raw, ends = _BYTES[raw], ends - first
    inside = raw != 32
    heads = inside.copy()
    heads[1:] &= ~inside[:-1]
    heads[ends[:-1][ends[:-1] < len(raw)]] = True  # the next text's first word is one of its own
    heads = np.flatnonzero(heads & inside)
    offsets = np.append(np.cumsum(inside) - inside, inside.sum())[np.append(heads, len(raw))].astype(np.int32)
    words = pa.Array.from_buffers(pa.string(), len(heads), [None, pa.py_buffer(offsets), pa.py_buffer(raw[inside])])
    return words, np.diff(np.searchsorted(heads, ends))


def _packed(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of documents' words a row for each word of a block: where it is, as the document's place in the block and the word's place in the document."""
    for whole in it:
        ends = np.cumsum(pc.fill_null(pc.binary_length(whole.column("text")), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        i = 0
        while i < len(ends):
            j = max(i + 1, int(np.searchsorted(ends, (ends[i - 1] if i else 0) + TEXT_BYTES, "right")))
            batch, i = whole.slice(i, j - i), j
            words, size = _words(batch.column("text"))
            if not len(words):
                continue
            coded = words.dictionary_encode()
            place = batch.column("place").to_numpy()
            blocks, mine = np.unique(place // BLOCK, return_inverse=True)
            by_word = pc.sort_indices(coded.dictionary).to_numpy()
            rank = np.empty(len(by_word), np.int64)
            rank[by_word] = np.arange(len(by_word))
            key = rank[coded.indices.to_numpy()] * len(blocks) + np.repeat(mine, size)
            at = (np.repeat(place % BLOCK, size) << 32) | (np.arange(len(key)) - np.repeat(np.cumsum(size) - size, size))
            order = np.argsort(key, kind="stable")
            key = key[order]
            heads = np.flatnonzero(np.diff(key, prepend=-1))
            lists = pa.ListArray.from_arrays(pa.array(np.append(heads, len(key)).astype(np.int32)), pa.array(at[order]))
            yield pa.RecordBatch.from_arrays([pa.array(blocks[key[heads] % len(blocks)]), coded.dictionary.take(pa.array(by_word[key[heads] // len(blocks)])), lists], ["block", "token", "at"])


class TextIndex:
    """Words of documents and their places, in a folder that all executors share.

    A change (``upsert``, ``delete``) writes one segment: a row for each changed document with its generation and whether it is gone (a tombstone), and the postings, a row for each word of a block of documents, which are named by their generation and their place in the change. A task writes those of its documents, sorted by word, so that
    a search skips what it doesn't need; no posting is shuffled. A merge drops the postings of documents that are not live by masks of their places, one row for a block. Segments are never changed. The list of live segments is a table of its own, of which each commit appends a new version last; so a job that fails leaves the
    version before it in force, and its files are of no segment. A search reads the postings of its words in all live segments and keeps those of each document's newest generation. One writer
    at a time: a commit on a version that is no longer the last is refused.

    Ids are kept as text. An upsert with the content that the index already has is left out, so nothing is written for it again. Null texts are documents without words; rows with a null id are left out; of rows that repeat
    an id within a change the greatest text counts.
    """

    def __init__(self, spark: SparkSession, path: str, fanout: int = FANOUT) -> None:
        self.spark, self.path, self.fanout = spark, path.rstrip("/"), fanout

    # The list of segments

    def _versions(self) -> DataFrame:
        from pyspark.errors import AnalysisException

        try:
            return self.spark.read.schema(_LIVE).parquet(f"{self.path}/live")
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], _LIVE)

    def segments(self) -> tuple[int, list[dict]]:
        """The last version and its segments, a few rows; version 0 is the empty index."""
        rows = self._versions()
        last = rows.agg(F.max("version")).first()[0]
        if last is None:
            return 0, []
        return last, [r.asDict() for r in rows.where(F.col("version") == last).orderBy("generation").collect() if r.segment]

    def _commit(self, base: int, live: list[dict]) -> None:
        if self.segments()[0] != base:
            raise RuntimeError("the index has changed since it was read")
        rows = [(base + 1, s["segment"], s["generation"], s["tier"], s["documents"]) for s in live] or [(base + 1, None, 0, 0, 0)]
        self.spark.createDataFrame(rows, _LIVE).coalesce(1).write.mode("append").parquet(f"{self.path}/live")

    def _read(self, kind: str, live: list[dict], schema: str) -> DataFrame:
        paths = [f"{self.path}/{s['segment']}/{kind}" for s in live]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    # Changes

    def _segment(self, generation: int, docs: DataFrame, postings: DataFrame | None) -> dict:
        name = f"segment-{generation:08d}-{uuid.uuid4().hex[:8]}"
        if postings is not None:
            # Each file in the order of words: its statistics say where in it a word is.
            postings.sortWithinPartitions("token").write.parquet(f"{self.path}/{name}/postings")
        else:
            self.spark.createDataFrame([], _POSTINGS).write.parquet(f"{self.path}/{name}/postings")
        docs.write.parquet(f"{self.path}/{name}/docs")
        n = self._read("docs", [{"segment": name}], _DOCS).count()
        return {"segment": name, "generation": generation, "tier": max(0, math.floor(math.log(max(n, 1), self.fanout))), "documents": n}

    def _change(self, rows: DataFrame, tombstones: bool) -> int:
        version, live = self.segments()
        generation = max((s["generation"] for s in live), default=0) + 1
        if tombstones:
            rows, words = rows.withColumn("place", F.lit(None).cast("long")), None
        else:  # stored, so that a document has one place in both tables
            rows = stored(rows.withColumn("place", F.monotonically_increasing_id()), "index-change")
            dealt = spread(rows.select(F.expr(f"place div {BLOCK}").alias("block"), "place", "text"), TASK_DOCUMENTS, "block").sortWithinPartitions("place")
            ship(self.spark)
            words = dealt.select("place", _for_words(F.col("text")).alias("text")).mapInArrow(_packed, "block long, token string, at array<bigint>")
            words = words.select(F.lit(generation).cast("long").alias("generation"), "block", "token", "at")
        docs = rows.select("doc_id", F.lit(generation).cast("long").alias("generation"), F.lit(tombstones).alias("deleted"), "content_hash", "place")
        self._commit(version, [*live, self._segment(generation, docs, words)])
        return generation

    def upsert(self, documents: DataFrame, key: str = "doc_id", body: str = "text") -> int:
        """Index new and changed documents; returns the generation."""
        rows = documents.select(F.col(key).cast("string").alias("doc_id"), F.coalesce(F.col(body), F.lit("")).alias("text")).where("doc_id is not null").groupBy("doc_id").agg(F.max("text").alias("text"))
        rows = rows.withColumn("content_hash", text.text_hash(F.col("text")))
        have = self.documents().select("doc_id", F.col("content_hash").alias("_had"))
        changed = rows.join(have, "doc_id", "left").where(~F.coalesce(F.col("_had") == F.col("content_hash"), F.lit(False))).drop("_had")
        return self._change(changed, False)

    def delete(self, gone: DataFrame, key: str = "doc_id") -> int:
        """Take documents out; ids that the index does not have are passed over."""
        ids = gone.select(F.col(key).cast("string").alias("doc_id")).distinct()
        return self._change(self.documents().join(ids, "doc_id", "left_semi").select("doc_id", F.lit(None).cast("string").alias("content_hash")), True)

    def merge(self) -> bool:
        """Merge the segments of the smallest tier that has as many as the fanout: of each document the newest generation stays. Tombstones stay too while older segments are left. Returns whether there was one."""
        version, live = self.segments()
        tiers: dict[int, list[dict]] = {}
        for s in live:
            tiers.setdefault(s["tier"], []).append(s)
        full = min((t for t, s in tiers.items() if len(s) >= self.fanout), default=None)
        if full is None:
            return False
        # All segments from the tier's oldest on, so that generations stay in order.
        oldest = min(s["generation"] for s in tiers[full])
        merged = [s for s in live if s["generation"] >= oldest]
        rest = [s for s in live if s["generation"] < oldest]
        newest = self._newest(merged)
        docs = newest if rest else newest.where("not deleted")
        made = self._segment(max(s["generation"] for s in merged), docs.select("doc_id", "generation", "deleted", "content_hash", "place"), self._live(merged))
        self._commit(version, [*rest, made])
        return True

    # Reading

    def _newest(self, live: list[dict]) -> DataFrame:
        """Each document's row of the newest generation: a partial aggregate, no sort."""
        rows = self._read("docs", live, _DOCS)
        return rows.groupBy("doc_id").agg(F.max_by(F.struct("generation", "deleted", "content_hash", "place"), "generation").alias("x")).select("doc_id", "x.*")

    def documents(self) -> DataFrame:
        """The documents that are in the index: doc_id, generation, content_hash."""
        return self._newest(self.segments()[1]).where("not deleted").drop("deleted", "place")

    def _live(self, live: list[dict]) -> DataFrame:
        """The postings of documents that are in the index, where they lie: a block's documents are one row of a table that is sent to every task, if it is small."""
        here = self._newest(live).where("not deleted").select("generation", F.expr(f"place div {BLOCK}").alias("block"), F.expr(f"place % {BLOCK} div 64").alias("part"), F.expr("shiftleft(1L, cast(place % 64 as int))").alias("bit"))
        parts = [F.bit_or(F.when(F.col("part") == i, F.col("bit")).otherwise(F.lit(0).cast("long"))) for i in range(BLOCK // 64)]
        masks = stored(here.groupBy("generation", "block").agg(F.array(*parts).alias("mask"), F.count(F.lit(1)).alias("n")), "index-live")
        masks = F.broadcast(masks) if masks.count() <= LIVE_ROWS else masks
        rows = self._read("postings", live, _POSTINGS).join(masks, ["generation", "block"])
        kept = F.when(F.col("n") == BLOCK, F.col("at")).otherwise(F.expr("filter(at, x -> shiftright(mask[cast(shiftright(x, 38) as int)], cast(shiftright(x, 32) & 63 as int)) & 1 = 1)"))
        # Rows without live postings fall away in a generator: a condition on the list would be pushed down and make each list twice.
        return rows.select("generation", "block", "token", F.explode(F.filter(F.array(kept), lambda at: F.size(at) > 0)).alias("at"))

    def _each(self, rows: DataFrame) -> DataFrame:
        """A row for each posting: generation, place, token, pos."""
        rows = rows.select("generation", "block", "token", F.explode("at").alias("at"))
        return rows.select("generation", F.expr(f"block * {BLOCK} + shiftright(at, 32)").alias("place"), "token", F.expr("cast(at & 2147483647 as int)").alias("pos"))

    def _of(self, live: list[dict], words: list[str]) -> DataFrame:
        """The postings of these words, those of former documents too."""
        return self._read("postings", live, _POSTINGS).where(F.col("token").isin(words))

    def _named(self, rows: DataFrame, live: list[dict]) -> DataFrame:
        """Rows of generations and places with the ids of their documents; those of documents that are not in the index fall away."""
        return rows.join(self._newest(live).where("not deleted").select("doc_id", "generation", "place"), ["generation", "place"])

    def postings(self, words: list[str] | None = None) -> DataFrame:
        """Words of the documents that are in the index, of the given words only if any are: doc_id, token, pos."""
        live = self.segments()[1]
        return self._named(self._each(self._live(live) if words is None else self._of(live, words)), live).select("doc_id", "token", "pos")

    def phrase_search(self, phrase: str) -> DataFrame:
        """Documents with the words of a phrase next to each other: doc_id, hits, first_start."""
        live = self.segments()[1]
        rows = self._each(self._of(live, search.phrase_words(phrase))).withColumn("document", F.struct("generation", "place"))
        found = search.phrase_search(rows, phrase, "document").select("document.*", "hits", "first_start")
        return self._named(found, live).select("doc_id", "hits", "first_start")

    def word_counts(self) -> DataFrame:
        """In how many documents each word is, and how often: token, documents, occurrences."""
        # A word's documents are combined within tasks first, so a frequent word is no hot key.
        each = self._live(self.segments()[1]).select("token", F.size(F.array_distinct(F.expr("transform(at, x -> shiftright(x, 32))"))).alias("documents"), F.size("at").alias("n"))
        return each.groupBy("token").agg(F.sum("documents").alias("documents"), F.sum("n").alias("occurrences"))

    def history(self) -> DataFrame:
        """Segments of each version, to see what a commit did."""
        return self._versions().withColumn("place", F.row_number().over(Window.partitionBy("version").orderBy("generation")))
