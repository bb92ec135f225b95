"""Quality classifier: random-indexing word vectors pooled for each document, and a small network."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import IS_SPACE, batches, col, mix, pieces, put, release, ship, text_bytes, word_pieces, written

#: Dimensions of a vector and those of them that an index vector fills; slots that words are hashed to; labelled rows that the fit reads at most.
DIMENSIONS, FILLED, SLOTS, FIT_ROWS = 32, 4, 1 << 14, 6_000
#: Tasks that read the fitted rows; each makes one table of contexts (13 MB at most), and rows of such a table that are added up together.
FIT_TASKS, BLOCK = 8, 1 << 11
HIDDEN = 32
#: Rows whose share of five is this one are held out.
FOLDS = 5
THRESHOLD = 0.3

_LAST = np.zeros(256, np.uint8)  # classes of a word's last byte: letters 0, digits 1, stops 2, shouts 3, bars 4, brackets and quotes 5, other signs 6
_LAST[33:128] = 6
_LAST[[*range(65, 91), *range(97, 123)]] = 0
_LAST[48:58] = 1
_LAST[[ord(c) for c in ".,;:"]] = 2
_LAST[[ord(c) for c in "!?"]] = 3
_LAST[[ord(c) for c in "|"]] = 4
_LAST[[ord(c) for c in "()[]{}<>'\""]] = 5
_UPPER = np.zeros(256, np.int64)
_UPPER[65:91] = 1
_SIZES = np.array([3, 6, 11, 21])
SHAPES = 7 * 3 * 2 * 5


#: Words with a slot of their own at most: those that the fitted rows have most often. All others share SLOTS hashed ones.
OWN_SLOTS = 1 << 15
NO_WORDS = np.zeros(0, np.uint64)


def slots(hashes: np.ndarray, known: np.ndarray) -> np.ndarray:
    """The slot of each word: its own after the hashed ones if it is among the known words (in order), else one it is hashed to."""
    shared = (hashes & np.uint64(SLOTS - 1)).astype(np.int64)
    if not len(known):
        return shared
    at = np.minimum(np.searchsorted(known, hashes), len(known) - 1)
    return np.where(known[at] == hashes, SLOTS + at, shared)


def terms(data: np.ndarray, offsets: np.ndarray, known: np.ndarray = NO_WORDS) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, tuple[int, int, int, int] | None]]:
    """For each piece of the texts: rows, slots and shapes of its words, and (row, hash, slot, shape) of the word before the first one if it is of the same row.

    A shape is the kind of the last byte, case, whether the word repeats the one before, and length. Where a long row is cut makes no difference to any of them.
    """
    last = None
    for raw, hashes, starts, rows in word_pieces(data, offsets):
        if not len(starts):
            continue
        before = last if last is not None and last[0] == rows[0] else None
        first = int(starts[0])
        size = np.add.reduceat((~IS_SPACE[raw[first:]]).astype(np.int64), starts - first)
        upper = np.add.reduceat(_UPPER[raw[first:]], starts - first)
        case = np.where((upper * 2 >= size) & (upper > 1), 2, np.minimum(upper, 1))
        again = np.zeros(len(hashes), np.int64)
        again[1:] = (hashes[1:] == hashes[:-1]) & (rows[1:] == rows[:-1])
        again[0] = before is not None and before[1] == hashes[0]
        shape = ((_LAST[raw[starts + size - 1]].astype(np.int64) * 3 + case) * 2 + again) * 5 + np.searchsorted(_SIZES, size, "right")
        slot = slots(hashes, known)
        yield rows, slot, shape, before
        last = int(rows[-1]), hashes[-1], int(slot[-1]), int(shape[-1])


def word_counts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of the words of these texts and how often each comes."""
    words, counts = NO_WORDS, np.zeros(0, np.int64)
    for _, hashes, _, _ in word_pieces(*text_bytes(column)):
        new, n = np.unique(hashes, return_counts=True)
        words, to = np.unique(np.concatenate([words, new]), return_inverse=True)
        counts = np.bincount(to, np.concatenate([counts, n]), len(words)).astype(np.int64)
    return words, counts


def index_places(n: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """The dimensions that each sparse ternary index vector fills, and 1 or -1 for each, drawn by hash."""
    h = mix(np.arange(n, dtype=np.uint64)[:, None] * np.uint64(FILLED) + np.arange(FILLED, dtype=np.uint64) + np.uint64(seed << 40))
    return (h % np.uint64(DIMENSIONS)).astype(np.int64), np.where(h >> np.uint64(63), 1, -1)


def index_vectors(n: int, seed: int) -> np.ndarray:
    at, sign = index_places(n, seed)
    out = np.zeros((n, DIMENSIONS), np.float32)
    np.add.at(out, (np.arange(n)[:, None], at), sign)
    return out


#: Seeds of the index vectors of words and of shapes.
WORDS, WORD_SHAPES = 1, 2


def contexts(column: pa.Array, known: np.ndarray = NO_WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Random indexing: for each word slot the sum of its neighbours' index vectors, those of the words and of their shapes, and likewise for each shape that of its neighbours' shapes. Whole numbers, so sums do not depend on their order."""
    words, shapes = index_places(SLOTS + len(known), WORDS), index_places(SHAPES, WORD_SHAPES)
    around_word, around_shape = np.zeros((SLOTS + len(known)) * DIMENSIONS), np.zeros(SHAPES * DIMENSIONS)
    for rows, slot, shape, before in terms(*text_bytes(column), known):
        if before is not None:  # the neighbour across a cut
            rows, slot, shape = np.append(before[0], rows), np.append(before[2], slot), np.append(before[3], shape)
        near = np.flatnonzero(rows[1:] == rows[:-1])
        for a, b in ((near, near + 1), (near + 1, near)):
            for total, to, of, (at, sign) in ((around_word, slot, slot, words), (around_word, slot, shape, shapes), (around_shape, shape, shape, shapes)):
                for j in range(FILLED):
                    total += np.bincount(to[a] * DIMENSIONS + at[of[b], j], sign[of[b], j], len(total))
    return around_word.reshape(-1, DIMENSIONS).astype(np.int32), around_shape.reshape(-1, DIMENSIONS).astype(np.int64)


@dataclass
class Model:
    """The words with slots of their own, word and shape vectors, scaling, two layers, temperature."""

    known: np.ndarray
    words: np.ndarray
    shapes: np.ndarray
    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float
    prior: float | None = None

    def pooled(self, column: pa.Array) -> np.ndarray:
        """A vector for each text: the means of its words' and shapes' vectors. A text without words has zeros."""
        data, offsets = text_bytes(column)
        n = len(offsets) - 1
        total, shapes, count = np.zeros((n, DIMENSIONS), np.float64), np.zeros((n, SHAPES), np.float64), np.zeros(n)
        for rows, slot, shape, _ in terms(data, offsets, self.known):
            at = np.flatnonzero(np.diff(rows, prepend=-1))
            total[rows[at]] += np.add.reduceat(self.words[slot], at, axis=0)
            low, span = int(rows[0]), int(rows[-1] - rows[0]) + 1
            shapes[low : low + span] += np.bincount((rows - low) * SHAPES + shape, minlength=span * SHAPES).reshape(span, SHAPES)
            count[low : low + span] += np.bincount(rows - low, minlength=span)
        each = np.maximum(count, 1)[:, None]
        return np.hstack([total / each, shapes @ self.shapes / each])

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.tanh((x - self.mean) / self.scale @ self.w1 + self.b1) @ self.w2 + self.b2

    def scores(self, column: pa.Array) -> np.ndarray:
        if self.prior is not None:
            return np.full(len(column), self.prior)
        return 1 / (1 + np.exp(-np.clip(self.logits(self.pooled(column)) / self.temperature, -60, 60)))


def indexed(known: np.ndarray, around_word: np.ndarray, around_shape: np.ndarray) -> Model:
    """A model that has its word vectors: each is the word's own index vector and the sum of its neighbours'."""
    unit = lambda v: v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-9)
    words = (0.5 * unit(index_vectors(len(around_word), WORDS)) + 0.5 * unit(around_word)).astype(np.float32)
    shapes = unit(index_vectors(SHAPES, WORD_SHAPES)) + 0.25 * unit(around_shape)
    return Model(known, words, shapes, np.zeros(2 * DIMENSIONS), np.ones(2 * DIMENSIONS), np.zeros((2 * DIMENSIONS, HIDDEN)), np.zeros(HIDDEN), np.zeros(HIDDEN), 0.0, 1.0)


def train(model: Model, x: np.ndarray, y: np.ndarray, seed: int = 11) -> Model:
    """The two layers and the temperature, from pooled vectors and labels (0 or 1). With one kind of label or none, every score is that label's share (one half without labels)."""
    if len(set(y.tolist())) < 2:
        model.prior = float(y.mean()) if len(y) else 0.5
        return model
    model.mean, model.scale = x.mean(axis=0), x.std(axis=0) + 1e-6
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(y))
    held, rest = order[: max(1, len(y) // 6)], order[max(1, len(y) // 6) :]
    model.w1, model.w2 = rng.normal(0, 1 / np.sqrt(2 * DIMENSIONS), (2 * DIMENSIONS, HIDDEN)), rng.normal(0, 1 / np.sqrt(HIDDEN), HIDDEN)
    share = y[rest].mean()
    model.b2 = float(np.log(max(share, 1e-3) / max(1 - share, 1e-3)))
    _descend(model, (x - model.mean) / model.scale, y, rest, rng)
    z = model.logits(x[held])
    grid = np.exp(np.linspace(np.log(0.25), np.log(8), 60))
    loss = [np.mean(np.logaddexp(0, z / t) - y[held] * z / t) for t in grid]
    model.temperature = float(grid[int(np.argmin(loss))])
    return model


def fit(texts: list[str], labels: list[int], seed: int = 11) -> Model:
    """Learn from texts and labels that are here; ``fit_quality`` does the same over tables."""
    column = pa.array(texts, pa.large_string())
    words, counts = word_counts(column)
    known = np.sort(words[np.lexsort((words.view(np.int64), -counts))[:OWN_SLOTS]])
    model = indexed(known, *contexts(column, known))
    return train(model, model.pooled(column), np.array(labels, np.float64), seed)


def _descend(model: Model, x: np.ndarray, y: np.ndarray, train: np.ndarray, rng: np.random.Generator, epochs: int = 60, rate: float = 0.01, decay: float = 1e-4) -> None:
    """Adam on the logistic loss in batches of 64."""
    p = [model.w1, model.b1, model.w2, np.array(model.b2)]
    m, v, step = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p], 0
    for _ in range(epochs):
        for part in np.array_split(rng.permutation(train), max(1, len(train) // 64)):
            h = np.tanh(x[part] @ p[0] + p[1])
            d = (1 / (1 + np.exp(-np.clip(h @ p[2] + p[3], -60, 60))) - y[part]) / len(part)
            back = np.outer(d, p[2]) * (1 - h * h)
            grads, step = [x[part].T @ back + decay * p[0], back.sum(axis=0), h.T @ d + decay * p[2], np.array(d.sum())], step + 1
            for i, g in enumerate(grads):
                m[i], v[i] = 0.9 * m[i] + 0.1 * g, 0.999 * v[i] + 0.001 * g * g
                p[i] = p[i] - rate * (m[i] / (1 - 0.9**step)) / (np.sqrt(v[i] / (1 - 0.999**step)) + 1e-8)
    model.w1, model.b1, model.w2, model.b2 = p[0], p[1], p[2], float(p[3])


def fold(key: Column) -> Column:
    """The CRC-32 of the key as text, modulo 5. A null key counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")), F.lit(FOLDS))


def fit_quality(documents: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", rows: int = FIT_ROWS) -> Model:
    """Fit on ``rows`` labelled rows at most, none of them held out: those of least seeded hash of the key, which is a bounded sample.

    The sample is written as a table; its texts, whole ones of any length, stay in the tasks that read them. Its OWN_SLOTS most frequent words
    (ties by hash) get vectors of their own. To the driver come the sums of word contexts and then a vector for each text, so what it holds does not depend on the texts. The sampled keys are few enough to send to
    every task, so the documents are read once and not shuffled. Labels other than 0 and 1 and null keys are left out; a null text is
    an empty one; of rows that repeat a key the greatest text counts.
    """
    spark = documents.sparkSession
    ship(spark)
    marked = labels.select(col(key).alias("k"), col(label).cast("int").alias("y")).where((fold(F.col("k")) != 0) & F.col("y").isin(0, 1) & F.col("k").isNotNull())
    sample = marked.groupBy("k").agg(F.max("y").alias("y")).orderBy(F.xxhash64("k"), "k").limit(rows)
    found = documents.select(col(key).alias("d"), col(text).alias("t")).join(F.broadcast(sample), F.col("d") == F.col("k"))
    fitted = written(found.groupBy("d").agg(F.max("t").alias("t"), F.max("y").alias("y")), "quality-sample").coalesce(FIT_TASKS)

    def counted(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(it, "t"):
            words, counts = word_counts(batch.column("t"))
            yield pa.RecordBatch.from_arrays([pa.array(words.view(np.int64)), pa.array(counts)], ["word", "n"])

    often = fitted.select("t").mapInArrow(counted, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "word").limit(OWN_SLOTS).select("word").collect()
    known = np.sort(np.array([r["word"] for r in often], np.int64).view(np.uint64))

    n_slots = SLOTS + len(known)

    def context_sums(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((n_slots + SHAPES, DIMENSIONS), np.int64)
        for batch in batches(it, "t"):
            word, shape = contexts(batch.column("t"), known)
            total[:n_slots] += word
            total[n_slots:] += shape
        for at in range(0, len(total), BLOCK):
            yield pa.RecordBatch.from_arrays([pa.array([at], pa.int64()), pa.array([total[at : at + BLOCK].tobytes()], pa.binary())], ["at", "v"])

    def added(block: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(v, np.int64) for v in block.column("v").to_pylist())
        return pa.table({"at": block.column("at")[:1], "v": pa.array([total.tobytes()], pa.binary())})

    around = np.zeros((n_slots + SHAPES, DIMENSIONS), np.int64)
    for r in fitted.select("t").mapInArrow(context_sums, "at long, v binary").groupBy("at").applyInArrow(added, "at long, v binary").collect():  # one table, whatever the number of tasks
        around[r["at"] : r["at"] + BLOCK] = np.frombuffer(r["v"], np.int64).reshape(-1, DIMENSIONS)
    around_word, around_shape = around[:n_slots], around[n_slots:]
    model = indexed(known, around_word, around_shape)
    shared = spark.sparkContext.broadcast(model)

    def vectors(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(it, "t"):
            x = shared.value.pooled(batch.column("t"))
            yield pa.RecordBatch.from_arrays([batch.column("d"), batch.column("y"), pa.array([v.tobytes() for v in x], pa.binary())], ["d", "y", "x"])

    kind = dict(fitted.dtypes)["d"]
    got = fitted.select("d", "y", "t").mapInArrow(vectors, f"d {kind}, y int, x binary").orderBy("d").collect()  # ``rows`` short rows at most
    return train(model, np.array([np.frombuffer(r["x"]) for r in got]).reshape(-1, 2 * DIMENSIONS), np.array([r["y"] for r in got], np.float64))


def score_quality(df: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """Add score (0 to 1: how likely the text is of label 1) and predicted (1 at 0.3 or more), in place of columns of those names. Null and empty texts are scored as texts without words. No shuffle."""

    spark = df.sparkSession
    ship(spark)
    shared = spark.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def scored(texts: pa.Array) -> pa.Array:
        _, offsets = text_bytes(texts)
        parts = [shared.value.scores(texts.slice(i, j - i)) for i, j in pieces(offsets, 2 << 20)]
        release()
        return pa.array(np.concatenate([np.zeros(0), *parts]))

    out = put(df, {"score": scored(col(text))})
    return put(out, {"predicted": (F.col("score") >= THRESHOLD).cast("int")})


def quality_scores(documents: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality") -> DataFrame:
    """Score every whole text: key, held_out, score, predicted. Rows may repeat; a null key is held out only if the empty text's remainder is 0."""
    model = fit_quality(documents, labels, key, text, label)
    shared = documents.sparkSession.sparkContext.broadcast(model)
    ship(documents.sparkSession)

    def scored(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(it, "text"):
            yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("held_out"), pa.array(shared.value.scores(batch.column("text")))], ["key", "held_out", "score"])

    kind = dict(documents.dtypes)[key]
    rows = documents.select(col(key).alias("key"), (fold(col(key)) == 0).alias("held_out"), col(text).alias("text"))
    out = rows.mapInArrow(scored, f"key {kind}, held_out boolean, score double").withColumnRenamed("key", key)
    return out.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
