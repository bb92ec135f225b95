import random
from difflib import SequenceMatcher

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessera.functions import amounts, text
from tessera.operators import grid, index, layout, profiles, search
from tessera.operators.index import TextIndex
from tessera.storage import shared_folder


def _phrases(df):
    return sorted((r.doc_id, r.hits, r.first_start) for r in df.collect())


def test_index_after_changes_is_one_built_anew(spark, tmp_path):
    shared_folder(spark)
    random.seed(1)
    index, texts = TextIndex(spark, f"file://{tmp_path}/index", fanout=3), {}
    line = lambda: " ".join(random.choices(["the", "of", "cat", "Dog", "éa"], k=random.randint(0, 8)))
    frame = lambda d: spark.createDataFrame(list(d.items()), "doc_id long, text string")
    assert index.phrase_search("of the").count() == 0
    for step in range(7):
        change = {random.randrange(30): line() for _ in range(9)}
        texts |= change
        index.upsert(frame(change))
        if step % 2:
            gone = random.sample(sorted(texts), 3)
            texts = {k: v for k, v in texts.items() if k not in gone}
            index.delete(frame(dict.fromkeys([*gone, 99], "")))
        merged = index.merge()
        anew = search.phrase_search(search.postings(frame(texts)), "of the").withColumn("doc_id", F.col("doc_id").cast("string"))
        assert _phrases(index.phrase_search("of the")) == _phrases(anew), (step, merged)
        assert {r.doc_id for r in index.documents().collect()} == {str(k) for k in texts}
    assert index.history().where("version = 1").count() == 1 and len(index.segments()[1]) < 7 + 3
    counts = {r.token: (r.documents, r.occurrences) for r in index.word_counts().collect()}
    words = [w for t in texts.values() for w in set(t.lower().split())]
    assert {w: n[0] for w, n in counts.items()} == {w: words.count(w) for w in set(words)}
    before = index.segments()[1]
    index.upsert(frame(texts))  # nothing new
    assert index.segments()[1][-1]["documents"] == 0 and len(index.segments()[1]) == len(before) + 1


def test_index_refuses_a_stale_writer_and_ignores_what_was_not_committed(spark, tmp_path):
    index = TextIndex(spark, f"file://{tmp_path}/index")
    df = spark.createDataFrame([(1, "a b"), (None, "c"), (2, None), (1, "a c")], "doc_id long, text string")
    index.upsert(df)
    assert {(r.doc_id, r.token) for r in index.postings().collect()} == {("1", "a"), ("1", "c")}
    version, live = index.segments()
    index._segment(9, spark.createDataFrame([("7", 9, False, "x")], "doc_id string, generation long, deleted boolean, content_hash string"), None)  # a job that failed before its commit
    assert index.documents().count() == 2
    index.delete(df.where("doc_id = 2"))
    with pytest.raises(RuntimeError):
        index._commit(version, live)


def test_index_words_are_those_of_the_text_functions(spark):
    random.seed(5)
    texts = ["".join(random.choices("aB éÉİK3-,\n中٣。\u0307_", k=random.randint(0, 9))) for _ in range(500)] + [None, "", "a" * 9, " ", "Ab-Cd", "\u212a-É"]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, t string")
    rows = df.select(text.word_tokens(F.coalesce("t", F.lit(""))).alias("want"), index._for_words(F.col("t")).alias("t")).collect()
    for low in (0, 3, 499):  # also of a slice
        words, size = index._words(pa.array([r.t for r in rows], pa.string())[low:])
        assert words.to_pylist() == [w for r in rows[low:] for w in r.want]
        assert size.tolist() == [len(r.want) for r in rows[low:]]
    # Bytes that are no UTF-8 are split as the text function does it.
    odd = spark.sql("select cast(x as string) as t from values (X'61804262'), (X'C3'), (X'6120FF20C3A942') as v(x)")
    odd = odd.select(text.word_tokens(F.col("t")).alias("want"), index._for_words(F.col("t")).alias("t")).collect()
    assert index._words(pa.array([r.t for r in odd], pa.string()))[0].to_pylist() == [w for r in odd for w in r.want]


def test_index_has_few_rows_for_a_word_and_makes_each_list_once_in_a_merge(spark, tmp_path):
    shared_folder(spark)
    made = TextIndex(spark, f"file://{tmp_path}/index", fanout=2)
    docs = spark.range(0, 600, 1, 1).select(F.col("id").alias("doc_id"), F.lit("of the").alias("text"))
    made.upsert(docs)
    rows = made._read("postings", made.segments()[1], index._POSTINGS)
    assert rows.count() == 2 * rows.select("block").distinct().count()  # no block of a task is cut up further
    made.delete(docs.where("doc_id < 599"))
    live = made._live(made.segments()[1])
    assert live._jdf.queryExecution().optimizedPlan().toString().count("filter(at") == 1
    assert made.merge() and [(r.doc_id, r.hits, r.first_start) for r in made.phrase_search("of the").collect()] == [("599", 1, 0)]
    assert made.word_counts().count() == 2


def test_points_meet_boxes_as_by_all_pairs(spark):
    random.seed(2)
    number = lambda: random.choice([random.uniform(-50, 900), float(random.randint(0, 64) * 8)])
    boxes = []
    for i in range(300):
        x, y, w = number(), number(), random.choice([0.0, 0.5, 8.0, 64.0, 700.0])
        boxes.append((i % 3, i, x, y, x + w, y + random.choice([w, 1.0, 300.0])))
    boxes += [(0, 900, None, 0.0, 1.0, 1.0), (0, 901, 5.0, 0.0, 1.0, 1.0), (0, 902, 0.0, 0.0, float("nan"), 1.0), (0, 903, 0.0, 0.0, float("inf"), 1.0)]
    points = [(i % 4, i, number(), number()) for i in range(500)] + [(0, 1000, None, 1.0), (0, 1001, float("nan"), 1.0)]
    b = spark.createDataFrame(boxes, "page int, box int, x0 double, y0 double, x1 double, y1 double")
    p = spark.createDataFrame(points, "page int, point int, x double, y double")
    got = sorted((r.point, r.box.box) for r in grid.boxes_at(p, b, ["page"]).collect())
    inside = lambda q, c: c[2] is not None and q[2] is not None and c[2] <= c[4] < 1e15 and c[2] <= q[2] <= c[4] and c[3] <= q[3] <= c[5]
    want = sorted((q[1], c[1]) for q in points for c in boxes if q[0] == c[0] and inside(q, c))
    assert got == want and want
    best = {q: min((c for c in boxes if (q, c[1]) in set(want)), key=lambda c: ((c[4] - c[2]) * (c[5] - c[3]), -c[1]))[1] for q, _ in want}
    assert {r.point: r.found for r in grid.smallest_box(p, b, ["page"], "point", "box").collect()} == {q[1]: best.get(q[1]) for q in points}
    assert grid.boxes_at(p.limit(0), b, ["page"]).count() == 0 == grid.boxes_at(p, b.limit(0), ["page"]).count()
    assert "CartesianProduct" not in (plan := grid.boxes_at(p, b, ["page"])._jdf.queryExecution().executedPlan().toString()) and "NestedLoop" not in plan


def test_elements_that_points_mean(spark):
    attrs = lambda **a: {k.replace("_", "-"): v for k, v in a.items()}
    rows = [(1, 0, 9, "body", attrs(), None, 0.0, 0.0, 100.0, 100.0), (1, 1, 3, "a", attrs(href="/x", aria_label="Go on"), "text", 10.0, 10.0, 50.0, 30.0), (1, 2, 2, "p", attrs(), "inner words", 12.0, 12.0, 40.0, 20.0),
            (1, 4, 4, "input", attrs(type="checkbox", title="Tick"), None, 60.0, 60.0, 70.0, 70.0), (1, 5, 6, "div", attrs(), None, 80.0, 80.0, 99.0, 99.0), (1, 6, 6, "p", attrs(), "plain words", 80.0, 80.0, 99.0, 99.0)]
    e = spark.createDataFrame(rows, "page_id int, pos int, last int, tag string, attrs map<string,string>, text string, x0 double, y0 double, x1 double, y1 double")
    p = spark.createDataFrame([(1, 1, 15.0, 15.0), (1, 2, 65.0, 65.0), (1, 3, 90.0, 90.0), (1, 4, 5.0, 99.0), (1, 5, 500.0, 5.0)], "page_id int, point_id int, x double, y double")
    got = {r.point_id: (r.pos, r.role, r.name) for r in grid.elements_at(p, e).collect()}
    assert got == {1: (1, "link", "Go on"), 2: (4, "checkbox", "Tick"), 3: (6, "p", "plain words"), 4: (0, "body", "")}


def test_blocks_outside_boxes_keep_repeated_rows(spark):
    blocks = spark.createDataFrame([("d", 1, "a", 0.0, 0.0, 10.0, 10.0), ("d", 1, "a", 0.0, 0.0, 10.0, 10.0), ("d", 1, "in", 50.0, 50.0, 60.0, 60.0), ("d", 2, "in", 50.0, 50.0, 60.0, 60.0)], "doc_id string, page int, text string, x0 double, y0 double, x1 double, y1 double")
    boxes = spark.createDataFrame([("d", 1, 40.0, 40.0, 70.0, 70.0), ("d", 1, 45.0, 40.0, 70.0, 70.0)], "doc_id string, page int, x0 double, y0 double, x1 double, y1 double")
    assert sorted((r.page, r.text) for r in layout.text_outside_tables(blocks, boxes).collect()) == [(1, "a"), (1, "a"), (2, "in")]


SUFFIXES = ("股份有限公司", "有限责任公司", "有限公司")


def _unified(names):
    split = lambda n: next(((n[: -len(s)], s) for s in SUFFIXES if n.endswith(s)), (n, ""))
    out = {}
    for n in names:
        stem, suffix = split(n)
        fits = [o for o in sorted(names) if len(o) > len(n) and split(o)[1] == suffix and len(stem) > 1 and stem[-2:] == split(o)[0][-2:] and SequenceMatcher(None, stem, split(o)[0]).ratio() >= 0.7]
        out[n] = min(fits, key=lambda o: (-len(o), o)) if fits else n
    return out


def test_company_names_collected_unified_and_replaced(spark):
    random.seed(3)
    texts = {}
    for d in range(40):
        base = "".join(random.choices("北京天地科技信息", k=random.randint(3, 7)))
        names = []
        for _ in range(5):
            stem = list(base)
            for _ in range(random.randint(0, 2)):
                stem.insert(random.randint(0, len(stem)), random.choice("北京天地A1"))
            names.append("".join(stem) + random.choice(SUFFIXES))
        texts[d] = " ".join(f"{n}，甲" for n in names) + "。X" + names[0] + "乙"
    df = spark.createDataFrame([*texts.items(), (100, None), (101, "")], "doc_id int, text string")
    names = profiles.company_names(df)
    found = {}
    for r in names.collect():
        found.setdefault(r.doc_id, []).append(r.name)
    got = {(r.doc_id, r.name): r.unified for r in profiles.unified_companies(names).collect()}
    want = {(d, n): u for d, ns in found.items() for n, u in _unified(ns).items()}
    assert got == want and any(n != u for (_, n), u in want.items())
    out = {r.doc_id: r.text for r in profiles.with_unified_companies(df).collect()}
    assert out[100] is None and out[101] == ""
    import re

    for d, t in texts.items():
        for n, u in sorted(((n, u) for (k, n), u in want.items() if k == d and n != u), key=lambda x: -len(x[0])):
            t = re.sub(rf"(?<![A-Za-z0-9一-鿿]){re.escape(n)}(?![A-Za-z0-9一-鿿])", u, t)
        assert out[d] == t


def test_values_that_no_field_takes(spark):
    rows = [("contract_no", "甲", "label_only"), ("contract_no", "AB", "too_short_or_no_digit"), ("contract_no", "AB-2024", None), ("party_a_name", "天地公司", None), ("party_a_name", "某某某某", "not_org_like"), ("customer_name", "公司", "too_short"), ("buyer_phone", "12 34", "not_phone_like"), ("buyer_phone", "010-1234567", None), ("bank_account", "12345", "not_account_like"), ("any", "かな", "kana_noise"), ("any", "  ", "empty"), ("any", "[ab", "bracket_noise"), ("any", "x", None)]
    df = spark.createDataFrame(rows, "field string, value string, why string")
    for f, v, w in rows:
        assert df.where((F.col("field") == f) & (F.col("value") == v)).select(profiles.refusal(f, F.col("value"))).first()[0] == w, (f, v)
    files = spark.createDataFrame([("a/HT20240001.pdf", " body "), ("notes.pdf", "x"), ("HT20240001.docx", "no HT2024 0001")], "f string, t string")
    assert [r[0] for r in files.select(profiles.with_contract_no(F.col("t"), F.col("f"))).collect()] == ["HT20240001\nbody", "x", "no HT2024 0001"]


def test_amounts_in_running_text(spark):
    texts = ["共¥1,234.50（大写：人民币壹仟元整）付", "¥ 20 (大写: 人民币二十元) 和 ¥300（大写：人民币叁佰元整）", "¥7 大写", None, "¥12.345（大写：人民币拾贰元整）"]
    out = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(amounts.consistent_phrases(F.col("t"))).collect()]
    assert out[:4] == ["共¥1,234.50（大写：人民币壹仟贰佰叁拾肆元伍角）付", "¥ 20（大写：人民币贰拾元整） 和 ¥300（大写：人民币叁佰元整）", "¥7 大写", None] and "壹拾贰元叁角伍分" in out[4]
