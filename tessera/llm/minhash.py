"""Near-duplicate texts by DartMinHash signatures and banded joining."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import SPACES, batches, col, mix, opened, sealed, ship, small, text_bytes, word_hashes, written
from tessera.llm.components import components

#: Words of a shingle and the least Jaccard similarity of a link.
SHINGLE, SIMILARITY = 5, 0.8
#: Bands and signature coordinates of a band: a pair at 0.8 misses all bands once in 13,000 times.
BANDS, ROWS = 24, 5
#: Buckets of up to so many texts that still have several classes are compared in full.
SMALL_BUCKET = 16
#: Rounds of cheap comparisons between the classes of buckets, before the exact join of what is still open.
ROUNDS = 2
#: Postings of a shingle that one cell of the exact join has on each side.
CELL = 512
#: Rows of the tables of copied texts (24 bytes) and of buckets (40 bytes) that are sent to every task; longer ones are joined by a shuffle.
BROADCAST_COPIES, BROADCAST_BUCKETS = 500_000, 500_000

_COMBINE = mix(np.arange(1, SHINGLE + 1, dtype=np.uint64) * np.uint64(0xA0761D6478BD642F)) | np.uint64(1)


def shingles(words: np.ndarray, counts: np.ndarray, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the runs of ``size`` words of each row and how many there are; a row of fewer words has one of all its words, one without words has none."""
    ends = np.cumsum(counts)
    n = np.where(counts >= size, counts - size + 1, (counts > 0).astype(np.int64))
    factors = _COMBINE if size == SHINGLE else mix(np.arange(1, size + 1, dtype=np.uint64) * np.uint64(0xA0761D6478BD642F)) | np.uint64(1)
    whole = np.zeros(max(0, len(words) - size + 1), np.uint64)
    for j in range(size):
        whole += words[j : j + len(whole)] * factors[j]
    starts = ends - counts
    at = np.repeat(starts - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
    short = np.flatnonzero((counts > 0) & (counts < size))
    out = np.zeros(len(at), np.uint64)
    long_rows = np.repeat(counts >= size, n)
    out[long_rows] = whole[at[long_rows]]
    place = np.cumsum(n) - n
    for i in short:
        w = words[starts[i] : ends[i]]
        out[place[i]] = (w * factors[: len(w)]).sum() + np.uint64(len(w))
    return mix(out), n


def dart_signatures(elements: np.ndarray, counts: np.ndarray, k: int, weights: np.ndarray | None = None, seed: int = 5) -> np.ndarray:
    """DartMinHash: a row of ``k`` 32-bit values for each weighted set; two sets agree at a coordinate with the probability of their weighted Jaccard similarity.

    Each element has a region, its weight wide and endlessly high, into which darts fall as a Poisson process that is
    seeded by the element alone: strips of weight (0, 1], (1, 2], (2, 4], ... have darts at a rate of their width, and those
    beyond the element's weight don't count. Only darts below a height that leaves about k ln k + 2k darts in the set are
    thrown. A dart goes to one hashed coordinate, and each coordinate keeps its earliest dart. Sets with an
    empty coordinate throw higher. So the work follows k ln k plus the number of elements, not k times that number. Sets
    without elements have a row of zeros.
    """
    rows = np.repeat(np.arange(len(counts)), counts)
    weights = np.ones(len(elements)) if weights is None else weights
    out = np.zeros((len(counts), k), np.uint64)
    total = np.bincount(rows, weights=weights, minlength=len(counts))
    height = (k * np.log(k) + 2 * k) / np.maximum(total, 1e-300)
    todo = np.flatnonzero(total > 0)
    while len(todo):
        mine = np.isin(rows, todo) if len(todo) < len(counts) else slice(None)
        e, r, w = elements[mine], rows[mine], weights[mine]
        place = np.zeros(len(counts), np.int64)
        place[todo] = np.arange(len(todo))
        best = np.full(len(todo) * k, np.iinfo(np.uint64).max, np.uint64)
        strip, low, wide = 0, 0.0, 1.0
        while len(e):
            key = mix(e + np.uint64(((seed << 32) + strip + 1) * 0x9E3779B97F4A7C15 % 2**64))
            _throw(key, place[r], w - low, wide, height[r], k, best)
            low, wide, strip = low + wide, max(1.0, low + wide), strip + 1
            more = w > low
            e, r, w = e[more], r[more], w[more]
        best = best.reshape(-1, k)
        full = (best != np.iinfo(np.uint64).max).all(axis=1)
        out[todo[full]] = best[full] & np.uint64(0xFFFFFFFF)
        height[todo[~full]] *= 2
        todo = todo[~full]
    return out.astype(np.uint32)


def _throw(key: np.ndarray, row: np.ndarray, inside: np.ndarray, wide: float, height: np.ndarray, k: int, best: np.ndarray) -> None:
    """The darts of a strip, all elements' first ones, then the second ones, and so on up to each set's height."""
    at = np.zeros(len(key))
    while len(key):
        key = mix(key + np.uint64(0x9E3779B97F4A7C15))
        at = at - np.log(((key >> np.uint64(11)).astype(np.float64) + 1) * 2.0**-53) / wide
        on = at <= height
        if not on.all():
            key, row, inside, height, at = key[on], row[on], inside[on], height[on], at[on]
        dart = mix(key ^ np.uint64(0x5851F42D4C957F2D))
        if wide != 1.0 or inside.min(initial=1.0) < 1.0:
            hit = (mix(dart).astype(np.float64) * 2.0**-64) * wide < inside
        else:
            hit = slice(None)
        d = dart[hit]
        rank = at[hit].astype(np.float32).view(np.uint32).astype(np.uint64)  # positive floats sort as their bits do
        np.minimum.at(best, row[hit] * k + ((d >> np.uint64(32)) % np.uint64(k)).astype(np.int64), (rank << np.uint64(32)) | (d & np.uint64(0xFFFFFFFF)))


def band_keys(signatures: np.ndarray, bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    parts = signatures.reshape(len(signatures), bands, rows).astype(np.uint64)
    out = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15), parts.shape[:2])
    for j in range(rows):
        out = mix(out ^ parts[:, :, j])
    return out.view(np.int64)


#: A-Z as a-z, and all ASCII white space as blanks.
_PLAIN = bytes(32 if b in SPACES else b + 32 if 65 <= b <= 90 else b for b in range(256))


def words_digest(raw: bytes) -> bytes:
    """128 bits of a cryptographic hash of a text's words, a blank between each two."""
    plain = raw.translate(_PLAIN).strip()
    while b"  " in plain:
        plain = plain.replace(b"  ", b" ")
    return hashlib.blake2b(plain, digest_size=16).digest()


def counted(elements: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each row's distinct elements, how often each comes, and how many distinct ones the row has."""
    rows = np.repeat(np.arange(len(counts)), counts)
    order = np.lexsort((elements, rows))
    e, r = elements[order], rows[order]
    first = np.flatnonzero(np.r_[True, (e[1:] != e[:-1]) | (r[1:] != r[:-1])]) if len(e) else np.zeros(0, np.int64)
    return e[first], np.diff(np.append(first, len(e))), np.bincount(r[first], minlength=len(counts))


def numbered(elements: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Each row's elements told apart by their number among equals, so that the Jaccard similarity of the sets is the weighted one of the counts."""
    distinct, often, n = counted(elements, counts)
    place = np.arange(int(often.sum()), dtype=np.uint64) - np.repeat(np.cumsum(often) - often, often).astype(np.uint64)
    return mix(np.repeat(distinct, often) + place * np.uint64(0xA24BAED4963EE407))


def _signed(weighted: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def signed(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(it, "text", 2 << 20):
            data, offsets = text_bytes(batch.column("text"))
            elements, n = shingles(*word_hashes(data, offsets))
            if weighted:
                distinct, often, some = counted(elements, n)
                keys = band_keys(dart_signatures(distinct, some, BANDS * ROWS, often.astype(np.float64)))
            else:
                keys = band_keys(dart_signatures(elements, n, BANDS * ROWS))
            raw = memoryview(data)
            digests = [words_digest(bytes(raw[a:b])) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
            flat = pa.ListArray.from_arrays(pa.array(np.arange(0, keys.size + 1, BANDS, dtype=np.int32)), pa.array(keys.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(digests, pa.binary()), flat], ["id", "digest", "keys"]).filter(pa.array(n > 0))

    return signed


def _sets(weighted: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def sets(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(it, "text", 2 << 20):
            elements, n = shingles(*word_hashes(*text_bytes(batch.column("text"))))
            if weighted:
                elements = numbered(elements, n)
            ends = np.cumsum(n)
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array([np.unique(elements[b - c : b]).tobytes() for b, c in zip(ends, n, strict=True)], pa.binary())], ["id", "shingles"])

    return sets


def _tokens(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in it:
        for i in range(0, batch.num_rows, 64):
            part = batch.slice(i, 64)
            sets = [np.frombuffer(x, np.int64) for x in part.column("shingles").to_pylist()]
            n = np.array([len(x) for x in sets])
            at = pa.array(np.repeat(np.arange(len(sets)), n))
            yield pa.RecordBatch.from_arrays([part.column("id").take(at), part.column("text").take(at), part.column("class").take(at), pa.array(np.repeat(n, n)), pa.array(np.concatenate(sets))], ["id", "text", "class", "size", "token"])


def jaccard(a: pd.Series, b: pd.Series) -> pd.Series:
    """Jaccard similarity of sorted distinct 64-bit values in bytes."""

    def one(x: bytes, y: bytes) -> float:
        p, q = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
        both = np.sort(np.concatenate([p, q]), kind="stable")
        common = int((both[1:] == both[:-1]).sum())
        return common / (len(p) + len(q) - common) if len(both) else 0.0

    return pd.Series([one(x, y) for x, y in zip(a, b, strict=True)], dtype=float)


def _verified(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) whose shingle sets are as similar as that."""
    measured = pairs.join(sets.toDF("a", "sa"), "a").join(sets.toDF("b", "sb"), "b")
    return measured.where(F.pandas_udf(jaccard, "double")("sa", "sb") >= similarity).select("a", "b")


def _pairs(rows: DataFrame, *partners: str) -> DataFrame:
    pair = F.explode(F.array(*(F.struct(F.least("id", p).alias("a"), F.greatest("id", p).alias("b")) for p in partners)))
    return rows.select(pair.alias("p")).select("p.a", "p.b").where("a <> b").distinct()


def near_duplicates(df: DataFrame, key: str = "doc_id", text: str = "text", similarity: float = SIMILARITY, weighted: bool = False) -> DataFrame:
    """Classes of texts that links of Jaccard similarity ``similarity`` or more on five-word shingles hold together: id, class_id, for every text with a word.

    Words are runs of other than ASCII white space, A-Z as a-z. Of texts of equal words the one of smallest id stands for
    all; they are known by a cryptographic digest of their words. Shingles weigh one each, or with ``weighted`` as often as they come, which makes the
    similarity the weighted one; they are compared by 64-bit hashes. Texts that agree in one of 24 bands of 5 DartMinHash values are candidates. Buckets are partial aggregates (size, first,
    last and a seeded member), never gathered; each of their texts is compared with those three, so a hot bucket
    gives a few pairs for each text. Candidates are verified on their whole shingle sets, and the links' components are
    the classes. Buckets that still hold several classes are compared again: in full where they have at most 16
    texts, and where they have more, a member of every class with the member of the largest class that has the most links, then
    with another one. What is still open then goes through an exact join (``_exact_pairs``), which finds every link that is left
    between different classes of a bucket.

    Ids are those of the key as a long; rows with a null id or without a word take no part and get no row. Rows that
    repeat an id are one document with all their texts: it is linked where any of them is. An empty table gives an empty result.
    """
    ship(df.sparkSession)
    texts = df.select(col(key).cast("long").alias("id"), col(text).alias("text")).where(F.col("id").isNotNull())
    signed = written(texts.mapInArrow(_signed(weighted), "id long, digest binary, keys array<long>"), "near-signed")
    copies = signed.groupBy("digest").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    copies = written(copies.select("digest", "first"), "near-copies")
    held = small(copies, BROADCAST_COPIES)
    ids = signed.join(held, "digest", "left").select("id", "keys", F.coalesce("first", "id").alias("first"))
    rows = ids.where("id = first").select("id", F.explode("keys").alias("bucket"))
    buckets = rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("size"), F.min("id").alias("low"), F.max("id").alias("high"), F.min_by("id", F.xxhash64("id", "bucket")).alias("any"))
    buckets = written(buckets.where("low < high"), "near-buckets")
    shared = written(rows.join(small(buckets, BROADCAST_BUCKETS), "bucket"), "near-shared")
    wanted = small(written(shared.select("id").distinct(), "near-wanted"))
    sets = written(texts.join(wanted, "id", "left_semi").mapInArrow(_sets(weighted), "id long, shingles binary").dropDuplicates(), "near-sets")
    links = written(_verified(_pairs(shared, "low", "high", "any"), sets, similarity).unionByName(_same_id(ids)), "near-links")
    classes = written(components(links, "near"), "near-classes")
    degree = links.union(links.select("b", "a")).groupBy(F.col("a").alias("id")).agg(F.count(F.lit(1)).alias("links"))
    for r in range(ROUNDS):
        more = written(_verified(_open_pairs(shared, classes, degree, r), sets, similarity), "near-more")
        if not more.take(1):
            break
        classes = _merged(classes, more)
    rest = written(_verified(_exact_pairs(shared, classes, sets, similarity), sets, similarity), "near-rest")
    if rest.take(1):
        classes = _merged(classes, rest)
    found = ids.select("id", "first").join(small(classes.toDF("first", "component")), "first", "left")
    return found.groupBy("id").agg(F.min(F.coalesce("component", "first")).alias("class_id"))


def _same_id(ids: DataFrame) -> DataFrame:
    """Links between the texts that stand for those of one repeated id."""
    several = ids.groupBy("id").agg(F.min("first").alias("a"), F.max("first").alias("high")).where("a < high").select("id", "a")
    return ids.join(several, "id").select("a", F.col("first").alias("b")).where("a <> b").distinct()


def _merged(classes: DataFrame, links: DataFrame) -> DataFrame:
    """The classes that are left when these links join some."""
    at = small(classes)
    between = links.join(at.toDF("a", "ca"), "a", "left").join(at.toDF("b", "cb"), "b", "left").select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b"))
    moved = written(components(between, "near"), "near-moved").toDF("component", "to")
    kept = classes.join(small(moved), "component", "left").select("id", F.coalesce("to", "component").alias("component"))
    alone = moved.join(classes.select(F.col("id").alias("component")), "component", "left_anti").select(F.col("component").alias("id"), F.col("to").alias("component"))
    return written(kept.unionByName(alone), "near-classes")


def _exact_pairs(shared: DataFrame, classes: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Pairs that hold every link between different classes among the texts of large buckets with several classes.

    A prefix filter: sets as similar as that share one of their first n - ceil(n * similarity) + 1 shingles in any one order. Here
    shingles of a single class come first, as they are in no such pair, then the rare ones. Postings of a
    shingle are dealt to a triangle of cells, so a frequent one is spread over many tasks.
    """
    marked = shared.where(F.col("size") > SMALL_BUCKET).select("bucket", "id").join(small(classes), "id", "left").select("bucket", "id", F.coalesce("component", "id").alias("class"))
    several = marked.groupBy("bucket").agg(F.min("class").alias("lo"), F.max("class").alias("hi")).where("lo < hi").select("bucket")
    texts = written(marked.join(several, "bucket", "left_semi").select("id", "class").distinct(), "near-open")
    tokens = sets.join(small(texts), "id").select("id", F.xxhash64("shingles").alias("text"), "class", "shingles").mapInArrow(_tokens, "id long, text long, class long, size long, token long")
    mixed = tokens.groupBy("token").agg(F.count(F.lit(1)).alias("n"), F.min("class").alias("lo"), F.max("class").alias("hi")).where("lo < hi")
    mixed = small(written(mixed.select("token", "n"), "near-mixed"))
    listed = tokens.join(mixed, "token").groupBy("id", "text", "class", "size").agg(F.array_sort(F.collect_list(F.struct("n", "token"))).alias("m"))
    before = F.col("size") - F.size("m")
    prefix = F.col("size") - F.ceil(F.col("size") * similarity - 1e-9) + 1
    listed = listed.withColumn("before", before).withColumn("m", F.slice("m", F.lit(1), F.greatest(F.lit(0), F.least(prefix - before, F.size("m"))).cast("int")))
    posted = listed.select("id", "class", "size", "before", F.posexplode("m").alias("at", "e")).select("id", "class", "size", (F.col("before") + F.col("at")).alias("at"), "e.token")
    posted = written(posted, "near-posted")
    cells = posted.groupBy("token").agg(F.ceil(F.count(F.lit(1)) / CELL).alias("cells"), F.min("class").alias("lo"), F.max("class").alias("hi")).where("lo < hi")
    dealt = posted.join(small(written(cells.select("token", "cells"), "near-cells")), "token").withColumn("cell", F.pmod(F.xxhash64("id"), F.col("cells")))
    left = dealt.select("token", F.col("cell").alias("i"), F.explode(F.sequence(F.col("cell"), F.col("cells") - 1)).alias("j"), F.struct("id", "class", "size", "at").alias("x"))
    right = dealt.select("token", F.explode(F.sequence(F.lit(0).cast("long"), F.col("cell"))).alias("i"), F.col("cell").alias("j"), F.struct("id", "class", "size", "at").alias("y"))
    once = (F.col("i") < F.col("j")) | (F.col("x.id") < F.col("y.id"))
    sizes = F.col("x.size") + F.col("y.size")
    common = F.least(F.col("x.size") - F.col("x.at"), F.col("y.size") - F.col("y.at"))
    near = (F.least("x.size", "y.size") >= F.greatest("x.size", "y.size") * similarity - 1e-9) & (common >= sizes * (similarity / (1 + similarity)) - 1e-9)
    met = left.join(right, ["token", "i", "j"]).where(once & (F.col("x.class") != F.col("y.class")) & near)
    return met.select(F.least("x.id", "y.id").alias("a"), F.greatest("x.id", "y.id").alias("b")).distinct()


def _open_pairs(shared: DataFrame, classes: DataFrame, degree: DataFrame, r: int) -> DataFrame:
    """Pairs of different classes within buckets that hold several."""
    near = small(written(classes.join(degree, "id", "left").select("id", "component", F.coalesce("links", F.lit(0)).alias("links")), "near-degrees"))
    marked = shared.select("bucket", "id", "size").join(near, "id", "left").select("bucket", "id", "size", F.coalesce("component", "id").alias("class"), F.coalesce("links", F.lit(0)).alias("links"))
    few = marked.where(F.col("size") <= SMALL_BUCKET).groupBy("bucket").agg(F.collect_list(F.struct("id", "class")).alias("m"))
    other = lambda x: F.transform(F.filter("m", lambda y: (y["class"] != x["class"]) & (y["id"] > x["id"])), lambda y: F.struct(x["id"].alias("a"), y["id"].alias("b")))
    full = few.select(F.explode(F.flatten(F.transform("m", other))).alias("p")).select("p.a", "p.b")
    if r:
        best = F.max(F.struct(F.xxhash64("id", F.lit(r)).alias("h"), F.col("id").alias("id")))
    else:
        best = F.max(F.struct(F.col("links").alias("h"), F.col("id").alias("id")))
    large = marked.where(F.col("size") > SMALL_BUCKET).groupBy("bucket", "class").agg(best.alias("best"), F.count(F.lit(1)).alias("n"))
    centre = large.groupBy("bucket").agg(F.max(F.struct("n", "best")).alias("top"), F.count(F.lit(1)).alias("classes")).where("classes > 1")
    star = large.join(centre.select("bucket", F.col("top.best.id").alias("y")), "bucket").select(F.least("best.id", "y").alias("a"), F.greatest("best.id", "y").alias("b")).where("a <> b")
    return (star if r else full.union(star)).distinct()


def mark_near_duplicates(df: DataFrame, key: str = "doc_id", text: str = "text", similarity: float = SIMILARITY, weighted: bool = False) -> DataFrame:
    """Add class_id and kept (the smallest id of a class stays), in place of columns of those names. A row of no class (see ``near_duplicates``) stays and is its own class."""
    df, names = sealed(df)
    found = near_duplicates(df, names[key], names[text], similarity, weighted)
    joined = df.join(found, F.col(names[key]).cast("long") == F.col("id"), "left")
    return opened(joined, names, {"class_id": F.coalesce(F.col("class_id"), F.col(names[key]).cast("long")), "kept": F.coalesce(F.col("class_id") == F.col("id"), F.lit(True))})


def without_near_duplicates(df: DataFrame, key: str = "doc_id", text: str = "text", similarity: float = SIMILARITY, weighted: bool = False) -> DataFrame:
    """The rows of ``df`` but those whose class has a smaller id. Only the ids that go meet the rows."""
    df, names = sealed(df)
    gone = small(written(near_duplicates(df, names[key], names[text], similarity, weighted).where("id <> class_id").select("id"), "near-gone"))
    return opened(df.join(gone, F.col(names[key]).cast("long") == F.col("id"), "left_anti"), names)
