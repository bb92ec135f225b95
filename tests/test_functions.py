import hashlib
import json

import pytest
from pyspark.sql import functions as F

from tessera.functions import amounts, arrays, text, urls


def _values(spark, rows, column, schema="v string"):
    return [r[0] for r in spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], f"i int, {schema}").orderBy("i").select(column).collect()]


def _one(values):
    return [(v,) for v in values]


def test_cleanup(spark):
    v = F.col("v")
    assert _values(spark, _one(["\t a\r\nb  \t c\n\n\n\nd 　", "", None]), text.normalize(v)) == ["a\nb c\n\nd", "", None]
    assert _values(spark, _one(["abcdef ghij", "short"]), text.smart_truncate(v, 8)) == ["abcdef…", "short"]
    assert _values(spark, _one(["a" * 70 + "\n\n" + "b" * 60, "a" * 10 + "\n\n" + "b" * 120, "ok"]), text.clip(v, 100)) == ["a" * 70, "a" * 10 + "\n\n" + "b" * 88, "ok"]
    assert _values(spark, _one(["# Title", "**Bold**", "_it_", " plain "]), text.plain_heading(v)) == ["Title", "Bold", "it", "plain"]


def test_ids(spark):
    v = F.col("v")
    got = _values(spark, [("  Head ", " Some \n text")], text.web_section_id(F.col("h"), F.col("t")), "h string, t string")
    assert got == ["s_" + hashlib.sha1(b"head\nsome text").hexdigest()[:10]]
    assert _values(spark, [("T", "x" * 300)], text.section_id(F.col("h"), F.col("t")), "h string, t string") == [hashlib.sha1(("T" + "x" * 200).encode()).hexdigest()[:12]]
    assert _values(spark, _one(["A1-b", "abc", "-a1", "a" * 81 + "1", None, "1"]), text.valid_document_id(v)) == [True, False, False, False, False, True]
    assert _values(spark, _one(["My  report_v1.2.pdf", "数据 9.docx"]), text.document_id(v)) == ["My-report-v1-2", "9"]


def test_estimates(spark):
    v = F.col("v")
    assert _values(spark, _one(["a" * 9, "汉" * 10, "", "ab汉汉"]), text.token_estimate(v)) == [2, 4, 0, int(4 / 3.25)]
    assert _values(spark, _one(["汉" * 20 + "a" * 90, "abc汉", "汉汉a"]), text.detect_locale(v)) == ["zh", "en", "zh"]


def test_pages(spark):
    v = F.col("v")
    rows = _one(["p.5-12", "p.5", "5-12", "sheet 1", None])
    assert _values(spark, rows, text.page_start(v)) == [5, 5, 5, None, None] and _values(spark, rows, text.page_end(v)) == [12, 5, 12, None, None]
    assert _values(spark, _one(["5, 10-12,30", "x", "3-1"]), text.page_set(v, F.lit(20)))[:2] == [[5, 10, 11, 12], None]


def test_snippet(spark):
    body = "x" * 120 + "Needle" + "y" * 120
    assert _values(spark, _one([body, "none", None]), text.snippet(F.col("v"), "needle")) == ["..." + "x" * 90 + "Needle" + "y" * 90 + "...", "none", ""]


def test_content_types(spark):
    assert _values(spark, _one([None, " BID "]), text.content_type(F.col("v"))) == ["General", "Bid"]
    with pytest.raises(Exception, match="unknown content type"):
        _values(spark, _one(["nope"]), text.content_type(F.col("v")))


@pytest.mark.parametrize(("url", "why"), [
    ("https://example.org/a", None), ("ftp://example.org", "scheme"), ("http:///x", "no host"), ("http://localhost:80/", "blocked name"), ("http://a.LOCALHOST", "blocked name"),
    ("http://127.0.0.1/", "private address"), ("http://2130706433/", "private address"), ("http://0x7f.1/", "private address"), ("http://0177.0.0.1/", "private address"),
    ("http://10.1.2.3/", "private address"), ("http://172.32.0.1/", None), ("http://169.254.169.254/", "private address"), ("http://[::1]/", "private address"), ("http://[fd00::1]/", "private address"),
    ("http://[::ffff:10.0.0.1]/", "private address"), ("http://8.8.8.8/", None), ("http://user@192.168.0.9:8080/", "private address"), ("http://999.1.1.1/", None),
])
def test_url_guard(spark, url, why):
    assert _values(spark, [(url,)], urls.violation(F.col("v"))) == [why]


def test_url_parts(spark):
    u = ("HTTPS://User@WWW.Example.org:8443/a/b?x=1&y=2#frag",)
    got = [_values(spark, [u], f(F.col("v")))[0] for f in (urls.scheme, urls.host, urls.path, urls.query, urls.fragment)]
    assert got == ["https", "www.example.org", "/a/b", "x=1&y=2", "frag"] and _values(spark, [u], urls.parameter(F.col("v"), "y")) == ["2"]


def test_arrays(spark):
    df = spark.createDataFrame([(["b", "a"], ["c", "a"], {"k": "1"}, {"k": "2", "n": None}), (None, None, None, None)], "a array<string>, b array<string>, m map<string,string>, n map<string,string>")
    assert [r[0] for r in df.select(arrays.merged_tags(F.col("a"), F.col("b"))).collect()] == [["a", "b", "c"], []]
    assert [r[0] for r in df.select(arrays.first_touch(F.col("m"), F.col("n"))).collect()] == [{"k": "1", "n": None}, {}]
    match = lambda m, e: spark.createDataFrame([(m,)], "m map<string,string>").select(arrays.metadata_matches(F.col("m"), "k", e)).first()[0]
    assert match({"k": "ABC"}, "abc") and match({}, "None") and not match({"k": "x"}, "") and match({"k": '["p", "Q"]'}, "q") and not match({"k": "xy"}, "x")
    nums = spark.createDataFrame([([3.0, 1.0, 2.0],), ([4.0, 1.0],), ([],)], "v array<double>")
    assert [r[0] for r in nums.select(arrays.median(F.col("v"), 7.0)).collect()] == [2.0, 2.5, 7.0]


def test_json_as_ids_hash_it(spark):
    got = _values(spark, [('a"b\\\n', "é")], arrays.python_json({"name": arrays.json_string(F.col("x")), "alt": arrays.json_string(F.col("y")), "nth": F.lit("0")}), "x string, y string")[0]
    assert got == json.dumps({"name": 'a"b\\\n', "alt": "é", "nth": 0}, ensure_ascii=False, sort_keys=True)


def test_amounts():
    for amount, words in (("¥0.00", "零元整"), ("10", "壹拾元整"), ("¥100,010", "壹拾万零壹拾元整"), ("100001000", "壹亿零壹仟元整"), ("1010101", "壹佰零壹万零壹佰零壹元整"), ("12345678.90", "壹仟贰佰叁拾肆万伍仟陆佰柒拾捌元玖角"), ("10000.05", "壹万元零伍分"), ("10000000000000000", None), ("x", None), (None, None)):
        assert amounts.in_words(amount) == words
