import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera.llm import tokens
from tessera.llm.queries import op5_sharding, op6_token_output, tokenizer_path
from tessera.llm.sharding import _draw, communication_matrix, even_sizes, shuffle_to_shards
from tessera.llm.warc import _order, capture_index, merge_blocks, merge_runs, parse_records, read_archives, url_key, write_archives

PAGES = [
    (1, "http://www.A.example:80/x?q=1#f", "p" * 120), (2, "https://b.example/", "p" * 120), (3, None, "short"), (4, "http://c.example/", "short"), (5, "http://c.example/", None),
    (None, "http://n.example/\r\nevil: 1", "p" * 120), (6, "http://d.example/", "WARC/1.1\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n" * 5), (7, "http://e.example/", "é" * 200_000), (1, "http://again.example/", "p" * 120),
]


def test_warc_round_trip(spark):
    df = spark.createDataFrame(PAGES, "page_id long, url string, html string").withColumn("page", F.lit(0)).repartition(3)
    path = write_archives(df)
    out = capture_index(read_archives(spark, path)).collect()
    assert len(out) == len(PAGES)
    by_payload = defaultdict(list)
    for k, _, h in PAGES:
        by_payload[h or ""].append(k)
    for r in out:
        if r["page_id"] is None:
            continue
        html = next(h for k, _, h in PAGES if k == r["page_id"]) or ""
        first = min(k for k in by_payload[html] if k is not None)
        revisit = len(html.encode()) >= 100 and first != r["page_id"]
        assert (r["payload_bytes"], r["payload_digest"]) == (len(html.encode()), hashlib.sha256(html.encode()).hexdigest())
        assert (r["record_type"], r["refers_to"]) == (("revisit", first) if revisit else ("response", None))
    assert [r["record_type"] for r in out if r["page_id"] is None] == ["revisit"]
    order = [(r["part"], r["place"], r["urlkey"], r["ts"]) for r in out]
    assert [x[2:] for x in sorted(order)] == sorted(x[2:] for x in order)


def test_captures_are_merged_in_passes(spark, monkeypatch):
    monkeypatch.setattr("tessera.llm.warc.ARCHIVE_BYTES", 4000)
    rng = random.Random(6)
    rows = [(i, f"http://h{rng.randint(0, 9)}.example/{rng.choice(['', 'a', 'b'])}", "x" * 50) for i in range(900)] + [(None, "http://h1.example/", "n")] * 5
    runs = read_archives(spark, write_archives(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(7)))
    runs = runs.withColumn("run", (F.col("run") * 300 + F.floor(F.col("at") / 4)).cast("int"))  # as if each four entries were a run
    runs = runs.withColumns({"head_key": F.first("urlkey").over(w := Window.partitionBy("run", "block").orderBy("at")), "head_ts": F.first("ts").over(w), "head_page": F.first("page_id").over(w), "head_archive": F.first("archive").over(w), "head_offset": F.first("offset").over(w)})
    assert runs.select("run").distinct().count() > 100
    out = [r.asDict() for r in capture_index(runs, fan=5).orderBy("part", "place").collect()]
    keys = [(r["urlkey"], r["ts"], r["page_id"] is not None, r["page_id"] or 0) for r in out]
    assert keys == sorted(keys) and len(out) == 905 and Counter(r["page_id"] for r in out) == Counter(k for k, _, _ in rows)


def test_blocks_are_read_one_a_run():
    rng = random.Random(7)
    runs = [sorted(((rng.randint(0, 99), "u", f"k{rng.randint(0, 9)}", "t", f"a{i}", j, 1, "response", 1, "d", None) for j in range(60)), key=_order) for i in range(9)]
    blocks = [[(*r, i, j, at, *[b[0][c] for c in (2, 3, 0, 4, 5)]) for at, r in enumerate(b)] for i, run in enumerate(runs) for j, b in enumerate([run[a : a + 5] for a in range(0, 60, 5)])]
    blocks.sort(key=lambda b: (_order(b[0]), b[0][11], b[0][12]))
    read, most = [0], [0]

    def stream():
        for b in blocks:
            read[0] += len(b)
            yield from b

    out = []
    for row in merge_blocks(stream()):
        out.append(row)
        most[0] = max(most[0], read[0] - len(out))
    assert out == sorted((r for run in runs for r in run), key=_order) and most[0] <= 5 * 10 and len(out) == 540


def test_warc_empty_table_and_damage(spark):
    assert capture_index(read_archives(spark, write_archives(spark.createDataFrame([], "page_id long, url string, html string")))).collect() == []
    with pytest.raises(ValueError):
        list(parse_records(b"WARC/1.1\r\nContent-Length: 99\r\n\r\nshort\r\n\r\n"))


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(0, 30)), max_size=9))
def test_merge_runs(runs):
    rows = [[(x, i) for x in sorted(r)] for i, r in enumerate(runs)]
    out = list(merge_runs([iter(r) for r in rows], lambda r: (r[0],)))
    assert out == sorted((x for r in rows for x in r), key=lambda r: r[0]) and Counter(out) == Counter(x for r in rows for x in r)


def test_url_key():
    assert url_key("http://www.A.example:80/X?q=1#f") == "example,a)/x?q=1"
    assert url_key("https://u@b.example:8443") == "example,b:8443)/"
    assert url_key("") == ")/"


def test_matrix_is_exact_and_uniform():
    sizes, shards = np.array([5, 0, 17, 3]), even_sizes(25, 7)
    m = communication_matrix(sizes, shards, 1)
    assert (m.sum(axis=1) == sizes).all() and (m.sum(axis=0) == shards).all() and (m >= 0).all()
    mean = np.mean([communication_matrix(sizes, shards, s) for s in range(3000)], axis=0)
    assert np.abs(mean - np.outer(sizes, shards) / 25).max() < 0.12


def test_shards(spark, sf):
    out = op5_sharding(spark, sf).collect()
    docs = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    assert Counter(r["doc_id"] for r in out) == Counter(docs.keys())
    by = defaultdict(list)
    for r in out:
        by[r["shard"]].append(r["slot"])
        assert (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (len(docs[r["doc_id"]].encode()) + 16, zlib.crc32(docs[r["doc_id"]].encode()), "rows", None)
    assert set(by) == set(range(40)) and max(map(len, by.values())) - min(map(len, by.values())) <= 1
    assert all(sorted(s) == list(range(len(s))) for s in by.values())
    assert [(r["doc_id"], r["shard"], r["slot"]) for r in sorted(out, key=str)] == [(r["doc_id"], r["shard"], r["slot"]) for r in sorted(op5_sharding(spark, sf).collect(), key=str)]


def test_groups_of_partitions_share_a_row_of_the_matrix(spark, monkeypatch):
    monkeypatch.setattr("tessera.llm.sharding.MATRIX_ROWS", 3)
    df = spark.range(1000).repartition(10)
    out = shuffle_to_shards(df, 7, seed=3).collect()
    assert sorted(Counter(r["shard"] for r in out).values()) == [142] + [143] * 6 and sorted(r["id"] for r in out) == list(range(1000))
    assert {(r["shard"], r["slot"]) for r in out} == {(s, i) for s in range(7) for i in range(143 if s < 6 else 142)}


def test_shard_edges(spark):
    rows = [(None, None, 9)] * 30 + [(1, "same", 8)] * 30 + [(2, "x" * 100_000, 7)]
    out = shuffle_to_shards(spark.createDataFrame(rows, "doc_id long, text string, shard int").repartition(3), 7).collect()
    assert sorted(Counter(r["shard"] for r in out).values()) == [8, 8, 9, 9, 9, 9, 9]
    assert Counter((r["doc_id"], r["text"]) for r in out) == Counter((a, b) for a, b, _ in rows)
    assert shuffle_to_shards(spark.createDataFrame([], "doc_id long, text string"), 7).collect() == []
    assert len(shuffle_to_shards(spark.createDataFrame([(1, "a")], "doc_id long, text string"), 7).collect()) == 1


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 32), st.data())
def test_packing(bits, data):
    ids = np.array(data.draw(st.lists(st.integers(0, 2**bits - 1), max_size=70)), np.uint32)
    packed = tokens.pack(ids, bits)
    assert len(packed) == -(-len(ids) * bits // 8)
    a = data.draw(st.integers(0, len(ids)))
    b = data.draw(st.integers(a, len(ids)))
    assert (tokens.unpack(packed, bits, a, b - a) == ids[a:b]).all()


def test_block_random_access():
    docs = [np.array(x, np.uint32) for x in ([1, 2, 3], [], [49407], list(range(500)))]
    block = tokens.Block(tokens.write_block(docs, tokens.width(49408)))
    assert block.bits == 16 and all((block.document(i) == d).all() for i, d in enumerate(docs))
    with pytest.raises(ValueError):
        tokens.pack(np.array([8], np.uint32), 3)


def test_tokens_against_the_library(spark):
    from tokenizers import Tokenizer

    path = tokenizer_path("word_bpe_49k.json")
    rng = random.Random(3)
    odd = ["", None, "<|endoftext|> x", "İstanbul ẞ ﬁ", "á é", "don't 'S we'LL", "１２ ²³ 中文", "\x1c \x85 \xa0", "A" * 50_000 + " b", " "]
    rows = [(i, t) for i, t in enumerate(odd)] + [(None, "null key"), (3, "again")] + [(100 + i, "".join(rng.choice("aB 1!'éß\n€") for _ in range(rng.randint(0, 80)))) for i in range(200)]
    tokens.CACHE_WORDS, old = 50, tokens.CACHE_WORDS
    try:
        out = tokens.token_digests(tokens.read_tokens(spark, tokens.write_tokens(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), path, 1))).collect()
    finally:
        tokens.CACHE_WORDS = old
    library = Tokenizer.from_file(path)
    want = Counter()
    for k, t in rows:
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 1]
        want[(k, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))] += 1
    assert Counter((r["key"], r["n_tokens"], r["ids_crc32"]) for r in out) == want
    at = 0
    for r in sorted(out, key=lambda r: r["start"]):
        assert r["start"] == at
        at += r["n_tokens"]
    keyed = [r["key"] for r in sorted(out, key=lambda r: r["start"])]
    assert keyed == sorted(keyed, key=lambda k: (k is not None, k or 0))


def _thue_morse(n, a, b):
    return "".join(a if bin(i).count("1") % 2 == 0 else b for i in range(n))


def test_words_built_to_collide(monkeypatch):
    from tokenizers import Tokenizer

    path = tokenizer_path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    texts = [_thue_morse(n, *ab) for n in (1024, 2048, 4096) for ab in ("ab", "ba")] + ["abba baab", "baab abba", "cat tac act", "act", ""]
    want = [library.encode(t, add_special_tokens=False).ids for t in texts]
    assert [x.tolist() for x in tokens.WordEncoder(path).encode(texts)] == want
    monkeypatch.setattr(tokens, "_HASH", np.zeros(256, np.uint64))  # all words of a length collide, in a batch and between batches
    encoder = tokens.WordEncoder(path)
    assert [x.tolist() for x in encoder.encode(texts)] == want
    assert [x.tolist() for x in encoder.encode(texts[::-1])] == want[::-1]


def test_a_word_of_megabytes():
    from tokenizers import Tokenizer

    path = tokenizer_path("word_bpe_49k.json")
    text = "".join(random.Random(5).choice("abcdefgh") for _ in range(1_000_000)) + " end"
    encoder = tokens.WordEncoder(path)
    assert encoder.encode([text])[0].tolist() == Tokenizer.from_file(path).encode(text, add_special_tokens=False).ids


def test_token_output_over_the_table(spark, sf):
    out = op6_token_output(spark, sf).orderBy("doc_id").collect()
    assert len(out) == spark.read.parquet(f"{sf}/documents.parquet").count()
    assert [r["start"] for r in out] == [int(x) for x in np.cumsum([0] + [r["n_tokens"] for r in out[:-1]])]
    assert tokens.read_tokens(spark, tokens.write_tokens(spark.createDataFrame([], "doc_id long, text string"), tokenizer_path("word_bpe_49k.json"), 1)).collect() == []


def test_draws_from_large_populations():
    rng = np.random.default_rng(3)
    rare = np.array([_draw(rng, 1_000_000, 1_999_000_000, 1000) for _ in range(4000)])
    assert abs((rare == 0).mean() - np.exp(-0.5)) < 0.03 and abs(rare.mean() - 0.5) < 0.04
    good, bad, n = 1_000_000_000, 3_000_000_000, 1_500_000_000
    many = np.array([_draw(rng, good, bad, n) for _ in range(2000)])
    sd = np.sqrt(n * 0.25 * 0.75 * (1 - n / (good + bad)))
    assert abs(many.mean() - n / 4) < 5 * sd / np.sqrt(2000) and abs(many.std() / sd - 1) < 0.1
    assert _draw(rng, good, 0, n // 3) == n // 3 and _draw(rng, good, bad, good + bad) == good
