import hashlib
import random

import numpy as np
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tessera.llm.bpe import ByteBPE, bpe_round_trip, decode_ids, encode_texts
from tessera.llm.queries import op3_bpe, tokenizer_path

PATH = tokenizer_path("byte_bpe_50k.json")
ODD = ["", "   ", "<|endoftext|>", "a<|endoftext|>  b<|endoftext|>\n", "x" * 5000, "ab" * 3000, " " * 400, "don't I'LL 'S ''s", "\n\n\n  a", "é" * 300, "中文 字", "　 \x85 \xa0 \x1c", "\U0001f600‍", "１²¾"]


def _fuzz(n, seed=1):
    rng = random.Random(seed)
    pool = [chr(c) for c in [*range(0x20, 0x7F), *range(0, 0x20), *range(0xA0, 0x180), 0x2028, 0x3000, 0x4E2D, 0x1F600, 0x301]]
    return ["".join(rng.choice(pool) for _ in range(rng.randint(0, 120))) for _ in range(n)]


def test_encode_and_decode_as_the_library(monkeypatch):
    vocab, library = ByteBPE(PATH), Tokenizer.from_file(PATH)
    texts = ODD + _fuzz(400)
    monkeypatch.setattr("tessera.llm.bpe.CACHE_WORDS", 300)
    for i in range(0, len(texts), 50):
        for t, ids in zip(texts[i : i + 50], vocab.encode(texts[i : i + 50]), strict=True):
            want = library.encode(t, add_special_tokens=False).ids
            assert ids.tolist() == want
            assert vocab.decode(ids) == library.decode(want, skip_special_tokens=False)


def test_long_words_do_not_fill_the_cache(monkeypatch):
    vocab, library = ByteBPE(PATH), Tokenizer.from_file(PATH)
    monkeypatch.setattr("tessera.llm.bpe.CACHE_CHARS", 10_000)
    rng = random.Random(2)
    for _ in range(6):
        text = "".join(rng.choice("abcdefgh") for _ in range(20_000)) + " end"
        assert vocab.encode([text])[0].tolist() == library.encode(text, add_special_tokens=False).ids
        assert vocab.chars <= 30_000


def test_short_and_long_words_merge_alike():
    vocab = ByteBPE(PATH)
    for word in (b"internationalization", b"aaaaaaaaaaaaaaaa", "ééééé".encode(), b"x", b"thththththth"):
        assert vocab.merge_short([word])[0].tolist() == vocab.merge_long(word).tolist()


def test_broken_bytes_decode_to_replacements():
    vocab, library = ByteBPE(PATH), Tokenizer.from_file(PATH)
    ids = [int(vocab.of_byte[0xC3]), int(vocab.of_byte[0x28]), 50256]
    assert vocab.decode(np.array(ids)) == library.decode(ids, skip_special_tokens=False)


def test_round_trip_rows(spark, sf):
    library = Tokenizer.from_file(PATH)
    rows = [(i, t) for i, t in enumerate(ODD)] + [(None, None), (1, "again"), (1, "again")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n_tokens", F.lit("x"))
    out = sorted(bpe_round_trip(df, PATH).collect(), key=str)
    want = []
    for k, t in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids
        want.append((k, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    assert sorted(map(tuple, out), key=str) == sorted(want, key=str)
    assert bpe_round_trip(spark.createDataFrame([], "doc_id long, text string"), PATH).collect() == []
    assert op3_bpe(spark, sf).count() == spark.read.parquet(f"{sf}/documents.parquet").count()


def test_ids_and_texts_as_columns(spark):
    df = spark.createDataFrame([(1, "Hello <|endoftext|> wörld"), (2, None)], "doc_id long, text string")
    out = {r["doc_id"]: r for r in decode_ids(encode_texts(df, PATH), PATH).collect()}
    assert out[1]["decoded"] == "Hello <|endoftext|> wörld" and out[2]["ids"] == [] and out[2]["decoded"] == ""
