import random
import time

from pyspark.sql import functions as F

from tessera.operators import signals
from tessera.sources import markdown
from tessera.streaming import progress

CASES = [
    ("<h1>Top <b>bold</b></h1><p>One  <em> two </em>three<br>four</p>", "# Top **bold**\n\nOne *two* three  \nfour"),
    ("<ul><li>a<li>b<ul><li>c</li><li>d</li></ul></li><li><p>e</p><p>f</p></li></ul>", "- a\n- b\n  - c\n  - d\n- e\n\n  f"),
    ('<ol start="3"><li>x</li><li>y<ol><li>z</li></ol></li></ol>after', "3. x\n4. y\n   1. z\n\nafter"),
    ('<p><a href="/u"> link </a> and <img src="i.png" alt="an  image"> <code>a`b</code></p>', "[link](/u) and ![an image](i.png) ``a`b``"),
    ('<pre><code class="language-py">def f():\n    return "*"\n</code></pre>', '```py\ndef f():\n    return "*"\n```'),
    ("<blockquote><p>q1</p><p>q2</p></blockquote><hr><p>*stars* _and_ [x]</p>", "> q1\n>\n> q2\n\n---\n\n\\*stars\\* \\_and\\_ \\[x\\]"),
    ("<table><tr><th>k<th>v<tr><td>a|b<td><b>1</b><tr><td>only</table>", "| k | v |\n| --- | --- |\n| a¦b | **1** |\n| only |  |"),
    ("<head><title>t</title></head><script>x</script><style>y</style><div>d1<div>d2</div>d3</div>", "d1\n\nd2\n\nd3"),
    ("<p>a<b></b>b<strong> </strong>c</p><li>loose</li></ul></p>", "ab c\n\n- loose"),
    ("", ""), ("plain &lt;text&gt; &amp; more", "plain <text> & more"),
]


def test_html_as_markdown(spark):
    df = spark.createDataFrame([(i, h) for i, (h, _) in enumerate(CASES)] + [(99, None)], "i int, h string")
    got = {r.i: r.m for r in df.select("i", markdown.from_html(F.col("h")).alias("m")).collect()}
    for i, (h, m) in enumerate(CASES):
        assert got[i] == m, h
    assert got[99] is None


def test_lists_of_any_depth_are_read_back():
    random.seed(5)

    def make(depth):
        return [(f"w{random.randint(0, 99)}", make(depth - 1) if depth and random.random() < 0.5 else []) for _ in range(random.randint(1, 3))]

    def html(items, ordered):
        tag = "ol" if ordered else "ul"
        return f"<{tag}>" + "".join(f"<li>{w}{html(kids, not ordered) if kids else ''}</li>" for w, kids in items) + f"</{tag}>"

    def lines(items, ordered, indent):
        for i, (w, kids) in enumerate(items, 1):
            mark = f"{i}. " if ordered else "- "
            yield indent + mark + w
            if kids:
                yield from lines(kids, not ordered, indent + " " * len(mark))

    for _ in range(100):
        items = make(4)
        assert markdown.convert(html(items, False)) == "\n".join(lines(items, False, ""))


def test_broken_markup_never_fails():
    random.seed(6)
    parts = ["<p>", "</p>", "<ul>", "</ul>", "<li>", "</li>", "<table>", "</table>", "<tr>", "<td>", "</td>", "</tr>", "<pre>", "</pre>", "<code>", "</code>", "<b>", "</b>", "<a href=x>", "</a>", "word ", "<blockquote>", "</blockquote>", "<script>", "</script>", "<h2>", "</h2>", "<ol start=z>", "</ol>"]
    for _ in range(3000):
        page = "".join(random.choices(parts, k=random.randint(0, 25)))
        assert isinstance(markdown.convert(page), str), page


def test_signals_of_pages(spark):
    rows = [("x" * 39, 0, True), ("x" * 50, 0, False), ("x" * 50, 1, True), ("x" * 130, 2, False), ("." * 150, 0, True), ("." * 250, 0, False), (None, 0, True), ("中" * 50, None, False)]
    df = spark.createDataFrame(rows, "t string, n int, want boolean")
    assert df.where(signals.needs_ocr(F.col("t"), F.col("n"), 40) != F.col("want")).count() == 0
    sizes = spark.createDataFrame([(600.0, 800.0), (3000.0, 4000.0), (14400.0, 14400.0), (0.0, 0.0)], "w double, h double")
    got = [tuple(r[0]) for r in sizes.select(signals.render_scale(F.col("w"), F.col("h"), 2.0, 4_000_000)).collect()]
    assert got[0] == (2.0, 1_920_000, False, False) and got[1][2:] == (True, False) and got[1][1] <= 4_000_000 and got[2] == (0.5, 7200 * 7200, True, True) and got[3] == (2.0, 1, False, False)
    white, one, grey = bytes([255]) * 60_000, bytes([255]) * 59_999 + b"\x00", bytes([200]) * 100 + bytes([255]) * 900
    pages = spark.createDataFrame([(0, white), (1, one), (2, grey), (3, b""), (4, None)], "i int, px binary").select("i", signals.grey_shares(F.col("px")).alias("s")).orderBy("i")
    out = [(r.s.no_white, r.s.dark, r.s.blank) for r in pages.collect()]
    assert [x[2] for x in out] == [True, True, False, True, True] and out[1][1] == 1 / 60_000 and out[2][:2] == (0.1, 0.0)


def test_counters_of_running_jobs(spark, tmp_path):
    df = spark.createDataFrame([(i, "h" * i, "" if i % 3 else "t" * i) for i in range(30)], "i int, html string, text string")
    counted, seen = progress.observed(df.repartition(3), progress.text_counters())
    counted.write.format("noop").mode("overwrite").save()
    want = df.agg(*(c.alias(n) for n, c in progress.text_counters().items())).first().asDict()
    assert seen.get == want
    df.repartition(4).write.parquet(f"file://{tmp_path}/in")
    counters = progress.Counters()
    spark.streams.addListener(counters)
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"file://{tmp_path}/in")
    stream = stream.observe("pages", *(c.alias(n) for n, c in progress.text_counters().items()))
    q = stream.writeStream.format("noop").option("checkpointLocation", f"file://{tmp_path}/check").trigger(availableNow=True).start()
    q.awaitTermination(60)
    end = time.time() + 20
    while counters.totals.get("pages", {}).get("rows") != 30 and time.time() < end:
        time.sleep(0.2)
    spark.streams.removeListener(counters)
    assert counters.totals["pages"] == want
