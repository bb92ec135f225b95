import random
from collections import Counter, defaultdict

import numpy as np
from pyspark.sql import functions as F

from tessera.llm.components import components
from tessera.llm.embedding_dedup import BEAM, NEEDLES, RECALL, WIDEST, _search, embedding_duplicates, forest
from tessera.llm.hnsw import Graph
from tessera.llm.minhash import dart_signatures, mark_near_duplicates, shingles, without_near_duplicates, words_digest


def _classes(n, links):
    parent = list(range(n))

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def _shingle_set(text):
    w = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").split()
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def _texts():
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 6)))
    base = [[word() for _ in range(rng.choice([6, 30, 120, 400]))] for _ in range(60)]
    out = [" ".join(b) for b in base]
    for b in base[:20]:
        for _ in range(rng.randint(1, 6)):
            c = list(b)
            for _ in range(max(1, len(c) // rng.choice([40, 100, 200]))):
                c[rng.randrange(len(c))] = word()
            out.append(" ".join(c))
    hot = [word() for _ in range(200)]
    for _ in range(120):  # a large group of near copies
        c = list(hot)
        for _ in range(rng.randint(0, 4)):
            c[rng.randrange(len(c))] = word()
        out.append(" ".join(c))
    return out + ["same few", "Same  few", "same\nfew", "one two three four five", "one two three four six", "x " * 30_000, "x " * 29_000]


def test_near_duplicates_brute_force(spark):
    texts = _texts()
    sets = [_shingle_set(t) for t in texts]
    links = [(i, j) for i in range(len(texts)) for j in range(i) if sets[i] and sets[j] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
    want = _classes(len(texts), links)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("n", F.lit("clash")).withColumn("id", F.lit(-1)).repartition(5)
    out = {r["doc_id"]: r for r in mark_near_duplicates(df).collect()}
    assert [out[i]["class_id"] for i in range(len(texts))] == want
    assert all(out[i]["kept"] == (want[i] == i) and out[i]["n"] == "clash" for i in out)
    assert sorted(r["doc_id"] for r in without_near_duplicates(df).collect()) == sorted(set(want))


def test_near_duplicates_of_independent_edits(spark):
    """Copies around 0.8 that meet in large buckets only, where few of the pairs are links."""
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    base, texts = [word() for _ in range(360)], []
    for _ in range(120):
        c = list(base)
        for at in rng.sample(range(360), 5):
            c[at] = word()
        texts.append(" ".join(c))
    sets = [_shingle_set(t) for t in texts]
    want = _classes(len(texts), [(i, j) for i in range(len(texts)) for j in range(i) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])])
    assert 1 < len(set(want)) < 100
    found = mark_near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert [r["class_id"] for r in sorted(found, key=lambda r: r["doc_id"])] == want


def test_near_duplicates_edges(spark):
    rows = [(1, None), (2, ""), (3, " \n"), (None, "a b c d e f"), (4, "a b c d e f"), (5, "A b c d e f"), (5, "A b c d e f"), (6, "other words here only now")]
    out = sorted(((r["doc_id"], r["class_id"], r["kept"]) for r in mark_near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=str)
    assert out == sorted([(1, 1, True), (2, 2, True), (3, 3, True), (None, None, True), (4, 4, True), (5, 4, False), (5, 4, False), (6, 6, True)], key=str)
    assert mark_near_duplicates(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    assert without_near_duplicates(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_texts_built_to_collide_are_no_copies(spark):
    word = lambda n, a, b: "".join(a if bin(i).count("1") % 2 == 0 else b for i in range(n))
    rows, k = [], 0
    for n in (1024, 2048, 4096):
        for a, b in ("ab", "ba"):
            rows.append((k, f"{word(n, a, b)} {word(n, b, a)}"))
            k += 1
    out = mark_near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert all(r["class_id"] == r["doc_id"] and r["kept"] for r in out)


def test_digest_is_of_the_words():
    assert words_digest(b" A  b\tC\r\n") == words_digest(b"a b c") != words_digest(b"ab c")
    assert words_digest("É x".encode()) != words_digest("é x".encode()) and words_digest(b" \n") == words_digest(b"")


def test_texts_of_a_repeated_id_are_one_document(spark):
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    x, y = [word() for _ in range(200)], [word() for _ in range(200)]
    near = lambda t: " ".join([*t[:150], word(), *t[151:]])
    rows = [(5, " ".join(x)), (5, " ".join(y)), (3, " ".join(y)), (9, near(x)), (7, near(y)), (8, "on its own")]
    out = mark_near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert len(out) == 6 and {r["doc_id"]: r["class_id"] for r in out} == {5: 3, 3: 3, 9: 3, 7: 3, 8: 8}


def test_weighted_near_duplicates_brute_force(spark):
    rng = random.Random(12)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    phrase, texts = " ".join(word() for _ in range(6)), []
    for _ in range(12):
        base = [word() for _ in range(40)]
        texts += [" ".join([*base, *[phrase] * k]) for k in rng.sample(range(1, 60), 4)]

    def bag(t):
        w = t.split()
        return Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))

    bags = [bag(t) for t in texts]
    want = _classes(len(texts), [(i, j) for i in range(len(texts)) for j in range(i) if (bags[i] & bags[j]).total() >= 0.8 * (bags[i] | bags[j]).total()])
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r["doc_id"]: r["class_id"] for r in mark_near_duplicates(df, weighted=True).collect()}
    assert [found[i] for i in range(len(texts))] == want and len(set(want)) > 1
    assert want != [r["class_id"] for r in mark_near_duplicates(df).orderBy("doc_id").collect()]


def test_dart_signatures_estimate_weighted_similarity():
    rng = np.random.default_rng(1)
    common, a, b = (rng.integers(0, 2**63, n, dtype=np.uint64) for n in (300, 60, 40))
    sets = [np.concatenate([common, a]), np.concatenate([common, b])]
    sig = dart_signatures(np.concatenate(sets), np.array([360, 340]), 2000)
    assert abs((sig[0] == sig[1]).mean() - 0.75) < 0.05
    w = [np.concatenate([np.full(300, 3.0), np.full(60, 0.5)]), np.concatenate([np.full(300, 1.5), np.full(40, 5.0)])]
    sig = dart_signatures(np.concatenate(sets), np.array([360, 340]), 2000, np.concatenate(w))
    assert abs((sig[0] == sig[1]).mean() - 300 * 1.5 / (300 * 3 + 60 * 0.5 + 40 * 5)) < 0.05
    assert (dart_signatures(np.zeros(0, np.uint64), np.array([0, 0]), 8) == 0).all()


def test_shingles_of_short_rows():
    words = np.arange(1, 9, dtype=np.uint64)
    s, n = shingles(words, np.array([0, 2, 0, 6]))
    assert n.tolist() == [0, 1, 0, 2] and len(set(s.tolist())) == 3


def test_components_of_chains_stars_and_noise(spark):
    rng = random.Random(2)
    links = [(i, i + 1) for i in range(200)] + [(1000, 1000 + i) for i in range(1, 300)] + [(rng.randrange(2000, 2400), rng.randrange(2000, 2400)) for _ in range(250)] + [(5000, 5000), (None, 3)]
    want = _classes(6000, [(a, b) for a, b in links if a is not None])
    out = {r["id"]: r["component"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert out == {i: want[i] for a, b in links if a is not None and a != b for i in (a, b)}
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []
    a, b = forest(np.array([5, 7, 9, 5]), np.array([7, 9, 5, 5]))
    assert sorted(zip(a.tolist(), b.tolist(), strict=True)) == [(7, 5), (9, 5)]


def _vectors():
    rng = np.random.default_rng(5)
    v = rng.normal(size=(700, 24))
    for i in range(0, 200, 4):
        v[i + 1] = v[i] + rng.normal(size=24) * 0.25
    v[300:420] = rng.normal(size=24) + rng.normal(size=(120, 24)) * 0.05
    return v.astype(np.float32)


def test_embeddings_brute_force(spark):
    v = _vectors()
    rows = [(i, x.tolist()) for i, x in enumerate(v)]
    bad = [(900, None), (901, []), (902, [0.0] * 24), (903, [float("nan")] + [1.0] * 23), (904, [float("inf")] * 24), (905, [None] + [1.0] * 23), (906, [1.0, 2.0]), (907, [2.0, 4.0]), (908, [1e-30] * 24), (909, [1e30] * 24)]
    u = v.astype(np.float64) / np.linalg.norm(v.astype(np.float64), axis=1)[:, None]
    hit = u @ u.T >= 0.9
    np.fill_diagonal(hit, False)
    want = _classes(len(v), np.argwhere(hit).tolist())
    df = spark.createDataFrame(rows + bad + [(None, v[0].tolist())], "vec_id long, embedding array<float>").withColumn("label", F.lit(1)).withColumn("kept", F.lit("x")).repartition(3)
    out = {r["vec_id"]: r for r in embedding_duplicates(df).collect()}
    assert len(out) == len(rows) + len(bad) + 1
    assert [out[i]["n_links"] for i in range(len(v))] == hit.sum(axis=1).tolist()
    assert [out[i]["component_id"] for i in range(len(v))] == want
    assert [out[i]["n_links"] for i in range(900, 910)] == [0, 0, 0, 0, 0, 0, 1, 1, 1, 1]
    assert out[907]["component_id"] == 906 and out[909]["component_id"] == 908 and out[900]["kept"] and not out[907]["kept"]
    assert (out[None]["n_links"], out[None]["component_id"], out[None]["kept"]) == (0, None, True)
    assert embedding_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>")).collect() == []


def test_two_shards_meet_once(spark):
    from tessera.llm.embedding_dedup import meetings

    for parts in (4, 5, 7, 8):
        ahead, counts = meetings(F.lit(parts))
        met = spark.range(parts).select(F.col("id").alias("block"), ahead).where(counts).select("block", ((F.col("block") + F.col("ahead")) % parts).alias("shard")).collect()
        pairs = sorted(tuple(sorted((r.block, r.shard))) for r in met)
        assert pairs == [(i, j) for i in range(parts) for j in range(i, parts)]


def test_sparse_links_among_many_vectors_are_all_found():
    """8,000 vectors of 384 dimensions with 300 links: too few for a sample of the queries to meet one."""
    rng = np.random.default_rng(1)
    v = rng.normal(size=(8000, 384))
    v[-300:] = v[:300] + rng.normal(size=(300, 384)) * 0.45
    v /= np.linalg.norm(v, axis=1)[:, None]
    graph = Graph.build(v)
    beam = graph.tuned(0.9, RECALL, BEAM, WIDEST, NEEDLES)
    some, own = np.r_[:300, 7700:8000], np.arange(8000)
    a, b, truth, hit = _search(graph, beam, own, v[some], some, 0.9)
    want = {(i, j) for i in range(300) for j in [7700 + i] if v[i] @ v[j] >= 0.9}
    assert set(zip(a.tolist(), b.tolist(), strict=True)) == want | {(j, i) for i, j in want} and hit == truth >= 100
    r, c = graph.exactly(v[some], 0.9)
    assert {(some[i], j) for i, j in zip(r, c, strict=True) if some[i] != j} == set(zip(a.tolist(), b.tolist(), strict=True))


def test_a_block_that_no_beam_serves_is_searched_exactly():
    v = np.random.default_rng(2).normal(size=(600, 8))
    v /= np.linalg.norm(v, axis=1)[:, None]
    graph = Graph.build(v)
    graph.layers[0][:] = -1  # no links: beams reach nothing
    assert graph.tuned(0.9, RECALL, BEAM, WIDEST, NEEDLES) == 0
    own = np.arange(600)
    truth = (v @ v.T >= 0.9).sum() - 600
    assert len(_search(graph, 0, own, v, own, 0.9)[0]) == len(_search(graph, BEAM, own, v, own, 0.9)[0]) == truth > 0


def test_graph_recall():
    v = np.random.default_rng(6).normal(size=(1500, 16))
    v /= np.linalg.norm(v, axis=1)[:, None]
    graph = Graph.from_bytes(Graph.build(v).to_bytes())
    truth = v @ v.T >= 0.7
    r, c = graph.within(v, 0.7, 64)
    found = np.zeros_like(truth)
    found[r, c] = True
    assert not (found & ~truth).any() and (found & truth).sum() >= 0.99 * truth.sum()
    assert defaultdict(int) == {} and Graph.build(v[:1]).within(v[:3], 0.99, 8)[0].tolist() == [0]
