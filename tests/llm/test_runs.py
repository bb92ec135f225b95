"""Periodic runs against brute force over all periods."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm.runs import find_runs, lyndon_edges, runs

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(words, least=12):
    ids = {}
    v, out = np.array([ids.setdefault(w, len(ids)) for w in words], int), []
    for p in range(1, len(v) // 2 + 1):
        edge = np.diff(np.concatenate([[0], (v[:-p] == v[p:]).astype(int), [0]]))
        for i, j in zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist(), strict=True):
            n = j - i + p
            if n >= max(least, 2 * p) and not any(p % q == 0 and (v[i : i + n - q] == v[i + q : i + n]).all() for q in range(1, p)):
                out.append((i, n, p))
    return sorted(out)


def fibonacci(n):
    a, b = [0], [0, 1]
    while len(b) < n:
        a, b = b, b + a
    return b[:n]


def samples(seed, count):
    r = random.Random(seed)
    for _ in range(count):
        k, n = r.choice([1, 2, 2, 3, 4, 9]), r.randint(0, 70)
        noise = lambda m, k=k: [r.randrange(k) for _ in range(r.randint(0, m))]
        kind = r.random()
        if kind < 0.4:
            w = [r.randrange(k) for _ in range(n)]
        elif kind < 0.8:
            w = noise(9) + ([r.randrange(k) for _ in range(r.randint(1, 11))] * 70)[:n] + noise(9)
        else:
            w = fibonacci(n + 5)[r.randint(0, 5) :]
        if w and r.random() < 0.3:
            w[r.randrange(len(w))] = r.randrange(k)
        yield w


@pytest.mark.parametrize("least", [2, 12])
def test_runs_of_letters(least):
    for w in samples(least, 1500):
        assert runs(np.array(w, int), least) == brute(w, least)


def test_lyndon_edges_are_next_smaller_suffixes():
    for w in samples(5, 300):
        after, match = lyndon_edges(w)
        for i in range(len(w)):
            j = next((j for j in range(i + 1, len(w)) if w[j:] < w[i:]), len(w))
            assert after[i] == j
            n = 0
            while j + n < len(w) and w[i + n] == w[j + n]:
                n += 1
            assert match[i] == n


class Counted(int):
    """A letter that counts how often letters are compared."""

    looks = 0

    def __lt__(self, other):
        Counted.looks += 1
        return int(self) < int(other)

    def __gt__(self, other):
        Counted.looks += 1
        return int(self) > int(other)

    def __eq__(self, other):
        Counted.looks += 1
        return int(self) == int(other)

    __hash__ = int.__hash__


@pytest.mark.parametrize("make", [lambda n: [0] * n, lambda n: [0, 1] * (n // 2), fibonacci, lambda n: [bin(i).count("1") % 2 for i in range(n)], lambda n: ([*range(97)] * n)[:n], lambda n: [*range(n // 2)] * 2])
def test_letters_are_compared_a_linear_number_of_times(make):
    looks = []
    for n in (1000, 8000):
        Counted.looks = 0
        lyndon_edges([Counted(x) for x in make(n)])
        looks.append(Counted.looks / n)
    assert looks[1] < 1.2 * looks[0] + 1 and looks[1] < 12


def expected(text):
    words = WORD.findall(text or "")
    found = brute(words)
    drop = {k for s, n, p in found for k in range(s + p, s + n)}
    return found, " ".join(w for i, w in enumerate(words) if i not in drop)


def test_texts(spark):
    unit = "a b c d e f g "
    texts = [None, "", " \t\n", "word", "x " * 11, "x " * 12, "x " * 12 + "y", unit * 2, f"start {unit * 3}a b end", "é ü\x0bß\x0c" * 9, "a\xa0b " * 20, "x y " * 400_000, "z" * 3_000_000 + " q" * 20]
    texts += ["a b a b a b a b a b a b " + unit * 4, "no\rbreak" * 20, "\n".join(["same line of words here and on"] * 5), "p q r " * 5 + "tail " + "p q r " * 5]
    df = spark.createDataFrame([(i, t, "kept", i) for i, t in enumerate(texts * 2)], "id long, text string, runs string, in_0 long")
    out = {r.id: r for r in find_runs(df.repartition(3)).collect()}
    for i, t in enumerate(texts * 2):
        if t == "x y " * 400_000:
            assert [tuple(x) for x in out[i].runs] == [(0, 800_000, 2)] and out[i].collapsed == "x y"
            continue
        found, kept = expected(t)
        assert [tuple(x) for x in out[i].runs] == found, t[:50]
        assert out[i].collapsed == kept and out[i].text == t and out[i].in_0 == i
    assert find_runs(df.limit(0)).count() == 0
    assert find_runs(df, keep_text=False).columns == ["id", "in_0", "runs", "collapsed"]


def test_texts_that_end_where_the_next_begins(spark):
    texts = ["a a a a a a", "a a a a a a", "", "b", "b b b", "b"] * 30
    out = find_runs(spark.createDataFrame([(t,) for t in texts], "text string").coalesce(1)).collect()
    assert all(not r.runs for r in out) and [r.collapsed for r in out] == texts


def test_query(spark, sf):
    from tessera.llm.queries import QUERIES

    out = {r.doc_id: r for r in QUERIES["op12_runs"](spark, sf).collect()}
    docs = spark.read.parquet(f"{sf}/documents.parquet").where(F.length("text") < 20_000).collect()
    planted = 0
    for d in docs:
        w, h = WORD.findall(d.text or ""), zlib.crc32(str(d.doc_id).encode())
        n, g = len(w), h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
        found, kept = expected(" ".join(w))
        planted += len(found)
        best = max(found, key=lambda r: (r[1], -r[0], -r[2])) if found else (None, None, None)
        lines = "".join(f"{a},{b},{c}\n" for a, b, c in found)
        want = (d.doc_id, len(found), *best, best[1] * 1000 // best[2] if found else None, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(kept.encode()).hexdigest())
        assert tuple(out[d.doc_id]) == want
    assert planted
