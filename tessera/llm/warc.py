"""WARC archives of pages, and their capture index merged from sorted runs."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from itertools import groupby, islice

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import new_path, ship, written

#: Payloads shorter than this are always stored.
REVISIT_BYTES = 100
#: Bytes of payload of an archive file, about.
ARCHIVE_BYTES = 16 << 20
#: Repeated payloads whose digests are sent to every task (72 bytes each); of more than these the table is joined by a shuffle.
BROADCAST_DIGESTS = 100_000
EPOCH = 1_704_067_200  # 2024-01-01, the capture time of page 0; each page is a second later

#: Runs that are merged at a time, and rows of a block of a run.
FAN, BLOCK = 64, 512

_INDEX = "page_id long, url string, urlkey string, ts string, archive string, offset long, length long, record_type string, payload_bytes long, payload_digest string, refers_to long"


def url_key(url: str) -> str:
    """The URL with its host turned round, without scheme, leading www. and default port, in lower case: captures of one site sort together."""
    m = re.match(r"(?:[a-z][a-z0-9+.-]*://)?(?:[^/?#@]*@)?([^/?#:]*)(?::(\d*))?([^#]*)", url.lower(), re.S)
    host, port, rest = m[1].removeprefix("www."), m[2], m[3]
    return ",".join(reversed(host.split("."))) + (f":{port}" if port not in (None, "", "80", "443") else "") + ")" + (rest or "/")


def _record(kind: Column, page: Column, url: Column, date: Column, digest: Column, refers: Column, n: Column, payload: Column) -> Column:
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), n.cast("string"), F.lit("\r\n\r\n"))
    none = F.concat(F.lit("none:"), F.monotonically_increasing_id().cast("string"))
    urn = lambda x: F.concat(F.lit("<urn:page:"), F.coalesce(x.cast("string"), none), F.lit(">"))
    revisit = F.when(kind == "revisit", F.concat(F.lit("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest\r\nWARC-Refers-To: "), urn(refers), F.lit("\r\n"))).otherwise("")
    body = F.when(kind == "revisit", F.lit("")).otherwise(payload)
    return F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: "), kind, F.lit("\r\nWARC-Record-ID: "), urn(page), F.lit("\r\nWARC-Target-URI: "), url, F.lit("\r\nWARC-Date: "), date,
        F.lit("\r\nWARC-Payload-Digest: sha256:"), digest, F.lit("\r\n"), revisit, F.lit("Content-Type: application/http; msgtype=response\r\nContent-Length: "),
        (F.octet_length(http) + F.octet_length(body)).cast("string"), F.lit("\r\n\r\n"), http, body,
    )


def write_archives(pages: DataFrame, key: str = "page_id", url: str = "url", payload: str = "html", date: Column | None = None) -> str:
    """Write a WARC/1.1 record for each page and return the folder of archives.

    Of pages with equal payloads of at least 100 bytes the one with the smallest key is a response, the others are
    revisits that refer to it and store no payload. Smallest keys by digest are counted with partial aggregation, and only
    digests that repeat meet the pages again, so no payload is shuffled. Spark's text writer puts one record in each line
    and ends it with the two line ends that the format asks for, so the files are plain WARC files, committed by Spark.

    A null payload is empty; line ends in a URL are escaped; a null key is written as ``none`` and a number, and is never referred to.
    Rows that repeat the smallest key are all responses. An empty table gives a folder without records.
    """
    spark = pages.sparkSession
    html, n = F.coalesce(F.col(payload), F.lit("")), F.octet_length(F.coalesce(F.col(payload), F.lit("")))
    rows = pages.select(F.col(key).cast("long").alias("page"), F.coalesce(F.col(url), F.lit("")).alias("url"), html.alias("html"), n.alias("n"), F.sha2(html.cast("binary"), 256).alias("digest"), (F.timestamp_seconds(F.coalesce(F.col(key).cast("long"), F.lit(0)) + EPOCH) if date is None else date).alias("at"))
    seen = rows.where(F.col("n") >= REVISIT_BYTES).groupBy("digest").agg(F.min("page").alias("first"), F.count(F.lit(1)).alias("copies"), F.sum("n").alias("bytes"))
    seen = written(seen.where("copies > 1 and first is not null").select(F.col("digest").alias("first_digest"), "first"), "warc-repeats")
    if seen.count() <= BROADCAST_DIGESTS:
        seen = F.broadcast(seen)
    total = rows.agg(F.coalesce(F.avg("n"), F.lit(0.0))).first()[0]
    joined = rows.join(seen, (F.col("digest") == F.col("first_digest")) & (F.col("n") >= REVISIT_BYTES), "left")
    kind = F.when(F.col("first").isNotNull() & ~F.col("page").eqNullSafe(F.col("first")), "revisit").otherwise("response")
    safe = F.replace(F.replace(F.col("url"), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    record = _record(kind, F.col("page"), safe, F.date_format("at", "yyyy-MM-dd'T'HH:mm:ss'Z'"), F.col("digest"), F.col("first"), F.col("n"), F.col("html"))
    path = new_path(spark, "warc")
    joined.select(record.alias("value")).write.option("lineSep", "\r\n\r\n").option("maxRecordsPerFile", max(1, int(ARCHIVE_BYTES // (total + 500)))).text(path)
    return path


def parse_records(data: bytes) -> Iterator[tuple[int, int, dict[str, str], memoryview]]:
    """Offset, length, header and block of each record, by the lengths that the headers give."""
    at, view = 0, memoryview(data)
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        lines = data[at:end].decode().split("\r\n")
        head = dict(x.split(": ", 1) for x in lines[1:])
        start, n = end + 4, int(head["Content-Length"])
        if not lines[0].startswith("WARC/") or start + n > len(data):
            raise ValueError(f"damaged record at {at}")
        yield at, start + n + 4 - at, head, view[start : start + n]
        at = start + n + 4


def _page(urn: str | None) -> int | None:
    found = re.fullmatch(r"<urn:page:(-?\d+)>", urn or "")
    return int(found[1]) if found else None


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """The index entries of all records, written as sorted runs: one for each task that read archives.

    Digests and lengths of responses are taken from the payloads read, and one that differs from its header's is an
    error; a revisit has them from its header. A run is in the order of URL key, time and page and is cut into blocks: ``run``, ``block`` and ``at`` are an
    entry's place, and the columns of ``head`` tell its block's first entry.
    """
    ship(spark)

    def entries(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        rows = []
        for batch in it:
            for name, content in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
                for offset, length, head, block in parse_records(content.as_buffer().to_pybytes()):
                    raw = bytes(block)
                    split = raw.index(b"\r\n\r\n") + 4
                    size = int(re.search(rb"\r\nContent-Length: (\d+)", raw[:split])[1])
                    digest = head["WARC-Payload-Digest"].removeprefix("sha256:")
                    if head["WARC-Type"] == "response" and (len(raw) - split != size or hashlib.sha256(raw[split:]).hexdigest() != digest):
                        raise ValueError(f"payload of {head['WARC-Record-ID']} is damaged")
                    url, ts = head["WARC-Target-URI"], re.sub(r"\D", "", head["WARC-Date"])
                    rows.append((_page(head["WARC-Record-ID"]), url, url_key(url), ts, name, offset, length, head["WARC-Type"], size, digest, _page(head.get("WARC-Refers-To"))))
        rows.sort(key=_order)
        yield from _run(iter(rows), TaskContext.get().partitionId(), 0)

    read = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("path", "content")
    return written(read.mapInArrow(entries, _RUN), "warc-runs")


_RUN = _INDEX + ", run int, block long, at int, head_key string, head_ts string, head_page long, head_archive string, head_offset long"
_NAMES = [x.split()[0] for x in _RUN.split(", ")]
_ARROW = [{"long": pa.int64(), "int": pa.int32(), "string": pa.string()}[x.split()[1]] for x in _RUN.split(", ")]
_WIDTH = len(_INDEX.split(", "))


def _order(row: tuple) -> tuple:
    """Of an index row: URL key, time, page (null first), archive and offset."""
    return row[2], row[3], row[0] is not None, row[0] or 0, row[4], row[5]


def _head(row: tuple) -> tuple:
    """The order of the first row of a run's row's block."""
    key, ts, page, archive, offset = row[_WIDTH + 3 :]
    return key, ts, page is not None, page or 0, archive, offset


def _batch(rows: list[tuple], names: list[str], types: list[pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)


def _run(rows: Iterator[tuple], run: int, block: int) -> Iterator[pa.RecordBatch]:
    """Sorted index rows as blocks of a run, numbered from ``block``."""
    while part := list(islice(rows, BLOCK)):
        first = part[0]
        yield _batch([(*r, run, block, i, first[2], first[3], first[0], first[4], first[5]) for i, r in enumerate(part)], _NAMES, _ARROW)
        block += 1


class LoserTree:
    """Sorted streams as one: each row taken costs one comparison a level. Streams are added where others have run out."""

    def __init__(self, order: Callable[[tuple], tuple]) -> None:
        self.order, self.streams, self.heads, self.keys, self.losers = order, [], [], [], [0]

    def add(self, stream: Iterator[tuple]) -> None:
        """Another stream, whose rows are none of them before those already taken."""
        spent = next((i for i, k in enumerate(self.keys) if k is None), None)
        if spent is None:
            for x in (self.streams, self.heads, self.keys):
                x.append(None)
            spent = len(self.keys) - 1
        self.streams[spent] = stream
        self._next(spent)
        self._play()

    def _next(self, run: int) -> None:
        self.heads[run] = next(self.streams[run], None)
        self.keys[run] = None if self.heads[run] is None else self.order(self.heads[run])

    def _wins(self, a: int, b: int) -> bool:
        """Whether stream a's head goes before stream b's; -1 beats all while the tree is built."""
        if a < 0 or b < 0:
            return a < 0
        if self.keys[a] is None or self.keys[b] is None:
            return self.keys[b] is None and (self.keys[a] is not None or a < b)
        return (self.keys[a], a) < (self.keys[b], b)

    def _replay(self, run: int) -> None:
        node = (run + len(self.keys)) // 2
        while node:
            if self._wins(self.losers[node], run):
                self.losers[node], run = run, self.losers[node]
            node //= 2
        self.losers[0] = run

    def _play(self) -> None:
        self.losers = [-1] * max(1, len(self.keys))
        for run in range(len(self.keys) - 1, -1, -1):
            self._replay(run)

    def first(self) -> tuple | None:
        """The key of the next row; null if there is none."""
        return self.keys[self.losers[0]] if self.keys else None

    def take(self) -> tuple:
        run = self.losers[0]
        row = self.heads[run]
        self._next(run)
        self._replay(run)
        return row


def merge_runs(runs: list[Iterator[tuple]], order: Callable[[tuple], tuple] = _order) -> Iterator[tuple]:
    """The rows of sorted runs in order, by a tree of losers."""
    tree = LoserTree(order)
    for r in runs:
        tree.add(r)
    while tree.first() is not None:
        yield tree.take()


def merge_blocks(rows: Iterator[tuple]) -> Iterator[tuple]:
    """Index rows in order, from the blocks of several runs in the order of their heads.

    All rows before the next block's head can be given out before that block is read, and by then its run's block before it has none left. So
    there is one block of each run in memory at a time, however long the runs are.
    """
    tree = LoserTree(_order)
    for _, block in groupby(rows, key=lambda r: r[_WIDTH : _WIDTH + 2]):
        held = list(block)
        head = _head(held[0])
        while (key := tree.first()) is not None and key < head:
            yield tree.take()
        tree.add(iter([r[:_WIDTH] for r in held]))
    while tree.first() is not None:
        yield tree.take()


def _merged(runs: DataFrame, group: Column, schema: str, out: Callable[[Iterator[tuple], int, int], Iterator[pa.RecordBatch]]) -> DataFrame:
    """Each group's runs merged, in ranges of the order; ``out`` makes batches of a range's rows, its group and its partition."""
    ship(runs.sparkSession)

    def merged(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        rows = (r for batch in it for r in zip(*(c.to_pylist() for c in batch.columns), strict=True))
        for g, mine in groupby(rows, key=lambda r: r[-1]):
            yield from out(merge_blocks(r[:-1] for r in mine), g, part)

    page = lambda c: F.col(c).asc_nulls_first()
    dealt = runs.withColumn("group", group).repartitionByRange("group", "urlkey", "ts", page("page_id"), "archive", "offset")
    return dealt.sortWithinPartitions("group", "head_key", "head_ts", page("head_page"), "head_archive", "head_offset", "run", "block", "at").mapInArrow(merged, schema)


def capture_index(runs: DataFrame, fan: int = FAN) -> DataFrame:
    """One index of all captures in the order of URL key, time and page, from the sorted runs of ``read_archives``.

    An external merge: while there are more than ``fan`` runs, passes merge that many to one and write it; the last pass merges what
    is left, dealt by key range, so that part and place give the global order. Each task streams the blocks of its runs through a tree of losers and
    holds one block of each. A URL with very many captures is split by time, page and place in the archives. Adds
    part and place; the n-th capture of a URL follows from them.
    """
    n = (runs.agg(F.max("run")).first()[0] or 0) + 1
    while n > fan:
        runs = written(_merged(runs, F.floor(F.col("run") / fan).cast("int"), _RUN, lambda rows, g, part: _run(rows, g, part << 33)), "warc-runs")
        n = -(-n // fan)

    def placed(rows: Iterator[tuple], _: int, part: int) -> Iterator[pa.RecordBatch]:
        at = 0
        while some := list(islice(rows, 10_000)):
            yield _batch([(*r, part, at + i) for i, r in enumerate(some)], [*_NAMES[:_WIDTH], "part", "place"], [*_ARROW[:_WIDTH], pa.int32(), pa.int64()])
            at += len(some)

    return _merged(runs, F.lit(0), _INDEX + ", part int, place long", placed)
