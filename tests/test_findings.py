"""Cases of reviewers' findings."""

from tessera.queries import ORACLES, QUERIES


def _differing(spark, name, folder):
    """Rows of a query that its SQL does not give, and the other way round."""
    import duckdb

    con = duckdb.connect()
    for f in folder.iterdir():
        con.sql(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}/*.parquet'")
    wanted = sorted(map(repr, con.sql(ORACLES[name]).fetchall()))
    return set(wanted) ^ {repr(tuple(r)) for r in QUERIES[name](spark, str(folder)).collect()}


def test_a_line_below_the_banner_is_no_header(spark, tmp_path):
    rows = [(1, t, ("same\n" if t < 2 else "") + f"body {t}") for t in range(4)] + [(2, t, "all the same") for t in range(9)] + [(3, t, "short") for t in range(3)]
    spark.createDataFrame(rows, "conv_id long, turn long, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    assert not _differing(spark, "header_footer_strip", tmp_path)


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_boxes_are_folded_without_python(spark):
    import random

    from tessera.operators import layout

    rng, rows = random.Random(3), []
    for image in range(40):
        for box in range(rng.randint(1, 12)):
            x, y = float(rng.randint(0, 30)), float(rng.randint(0, 10))
            rows.append((image, box, x, y, x + rng.randint(-1, 30), y + rng.randint(-1, 20), rng.randint(0, 5) / 10))
    rows += [(99, i, None if i == 2 else 0.0, 0.0, -1.0 if i == 1 else 9.0, 9.0, 0.9 - i / 10) for i in range(4)]
    found = layout.suppress_boxes(spark.createDataFrame(rows, "image_id int, box_id int, x1 double, y1 double, x2 double, y2 double, score double"), most=5)
    assert "Python" not in _plan(found)
    wanted = set()
    for image in {r[0] for r in rows}:
        kept = []
        for _, box, x1, y1, x2, y2, _ in sorted((r for r in rows if r[0] == image), key=lambda r: (-r[6], r[1])):
            if x1 is None:
                x1 = float("nan")
            if len(kept) < 5 and all(_part(k, (x1, y1, x2, y2)) <= 0.5 for _, k in kept):
                kept.append((box, (x1, y1, x2, y2)))
        wanted |= {(image, box, i) for i, (box, _) in enumerate(kept)}
    assert {(r.image_id, r.box_id, r.place) for r in found.collect()} == wanted


def _part(a, b):
    nan = float("nan")
    if any(v != v for v in (*a, *b)):
        return nan
    area = lambda v: (v[2] - v[0] + 1) * (v[3] - v[1] + 1)
    both = max(min(a[2], b[2]) - max(a[0], b[0]) + 1, 0) * max(min(a[3], b[3]) - max(a[1], b[1]) + 1, 0)
    union = area(a) + area(b) - both
    return both / union if union else nan


def test_tables_of_blocks_need_one_shuffle_and_no_group(spark):
    import random

    from tessera.operators import layout

    rng, rows = random.Random(4), []
    for page in range(60):
        for b in range(rng.choice([3, 4, 8, 12, 30])):
            x, y = rng.choice([0, 100, 200]) + rng.choice([0, 5, 13.5]), rng.choice([0, 20, 40, 60]) + rng.choice([0, 3, 9])
            rows.append((f"d{page // 2}", page % 2, f"b{b}", rng.choice(["a", " t|x ", "", None, " z\n"]), float(x), float(y), x + rng.choice([20.0, 90.0, 300.0]), y + rng.choice([10.0, 20.0]), rng.random()))
    blocks = spark.createDataFrame(rows, "doc_id string, page int, block_id string, text string, x0 double, y0 double, x1 double, y1 double, confidence double")
    found = layout.blocks_markdown(blocks)
    assert "Aggregate" not in _plan(found) and "Window" not in _plan(found)
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, layout.layout_markdown(layout.layout_tables(blocks)).collect())) and found.count() > 20


def test_pages_of_blocks_step_side_by_side(monkeypatch):
    import pyarrow as pa

    from tessera.operators import layout

    block = lambda d, r, c: (d, 1, f"{r}-{c}", f" r{r}c{c}", 100.0 * c, 30.0 * r, 100.0 * c + 80, 30.0 * r + 20, 0.5)
    rows = [block(f"d{d}", r, c) for d in range(20) for r in range(d % 4 + 1) for c in range(3)]
    names = ["doc_id", "page", "block_id", "text", "x0", "y0", "x1", "y1", "confidence"]
    batches = [pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows[i : i + 7], strict=True)], names) for i in range(0, len(rows), 7)]
    asked = []
    cells = layout._cells
    monkeypatch.setattr(layout, "_cells", lambda *a: asked.append(a[0].shape) or cells(*a))
    made = [t for b in layout._page_tables(iter(batches)) for t in b.to_pylist()]
    assert sorted(asked) == [(5, 6), (5, 9), (5, 12)]
    assert [(t["doc_id"], len(t["cells"])) for t in sorted(made, key=lambda t: int(t["doc_id"][1:]))] == [(f"d{d}", 3 * (d % 4 + 1)) for d in range(20) if d % 4]
    assert made[0]["cells"][4] == {"row": 2, "col": 2, "colspan": 1, "text": "r1c1", "x0": 100.0, "y0": 30.0, "x1": 180.0, "y1": 50.0, "confidence": 0.5, "blocks": "1-1"}
    monkeypatch.setattr(layout, "_BLOCKS", 10)
    assert sum(b.num_rows for b in layout._page_tables(iter(batches))) == len(made)


def test_elements_of_articles_are_dealt_by_their_number(spark, monkeypatch):
    from tessera.operators import readability
    from tessera.sources import html
    from tessera.storage import shared_folder

    shared_folder(spark)
    pages = spark.createDataFrame([(i, f"<html><body><div><p>Page {i}, of some words.</p><p>More, of them.</p></div></body></html>") for i in range(40)], "page_id long, html string")
    monkeypatch.setattr(readability, "ELEMENTS", 20)
    rows = readability._dealt(readability._prepared(html.parsed(pages, article=True), "page_id"), "test", "page_id")
    assert rows.rdd.getNumPartitions() == 10
    plan = readability._measured(rows, "page_id")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and plan.count("Window") >= 2


def test_long_pages_give_all_their_blocks(spark, tmp_path):
    import random

    rng, made = random.Random(5), []
    for page, n in enumerate((1500, 1501, 1502, 3200, 9, 0)):
        parts = [f"<h1>Part {i}</h1>" if i % 50 == 0 else f"<{t}>Block {rng.randrange(max(n - 5, 1))} of page {page}, long enough</{t}>" for i, t in enumerate(rng.choices(["p", "li"], k=n))]
        made.append((page, f"<html><head><title>Page {page}</title></head><body>{''.join(parts)}</body></html>"))
    made.append((6, "<html><head><title>Six</title></head><body>" + "".join(f"<div>{'Own text of a container. ' * 4}{i}</div>" for i in range(2000)) + "<p>One paragraph, long enough</p></body></html>"))
    made.append((7, "<html><head><title>Seven</title></head><body>" + "".join(f"<p>Paragraph {i}, long enough</p>" for i in range(4000)) + "</body></html>"))
    spark.createDataFrame(made, "page_id long, html string").write.parquet(str(tmp_path / "pages.parquet"))
    # Sections are of the first 1,501 blocks still, as their SQL has it.
    assert not _differing(spark, "page_blocks", tmp_path) and not _differing(spark, "page_sections", tmp_path)
    counts = {r.page_id: r["count"] for r in QUERIES["page_blocks"](spark, str(tmp_path)).groupBy("page_id").count().collect()}
    assert counts[6] == 2001 and counts[7] == 4000 and counts[3] > 1501 and 5 not in counts


def test_pages_are_parsed_once_for_their_blocks(spark):
    from tessera.operators import pages
    from tessera.sources import html

    made = spark.createDataFrame([(1, "<h1>Top</h1><section>" + "a long text " * 9 + "<p>A paragraph of some length<p>short</section><td>" + "b " * 40)], "page_id long, html string")
    found = pages.blocks(html.elements(made))
    assert _plan(found).count("MapInArrow") == 1
    assert [(r.tag, r.text) for r in found.orderBy("idx").collect()] == [("h1", "Top"), ("p", "A paragraph of some length"), ("p", ("a long text " * 9).strip())]
