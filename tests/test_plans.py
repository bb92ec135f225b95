import re

from pyspark.sql import functions as F

from tessera.operators import search, tables
from tessera.queries import QUERIES


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_a_document_filter_reaches_the_scan(spark, sf):
    turns = spark.read.parquet(f"{sf}/conversations.parquet").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("idx"), F.col("role").alias("title"), "text")
    assert re.search(r"PushedFilters: \[[^\]]*EqualTo\(conv_id,3\)", _plan(search.search_sections(turns, 3, "us")))


def test_columns_that_a_query_does_not_need_are_not_read(spark, sf):
    found = re.findall(r"ReadSchema: (\S+)", _plan(QUERIES["nth_occurrence"](spark, sf)))
    assert found and all("props" not in x and "value" not in x for x in found)


def test_top_k_is_no_global_sort(spark, sf):
    plan = _plan(QUERIES["library_search"](spark, sf))
    assert "TakeOrderedAndProject" in plan and "rangepartitioning" not in plan


def test_expression_queries_run_no_python(spark, sf):
    for name in ("library_search", "search_full_text", "section_ids", "text_cleanup", "url_guard", "sections_diff", "table_stats", "page_quality", "split_sections", "section_table_overlap", "cache_lookup", "failover_first_ok"):
        assert not re.search("Python|Arrow|InPandas", _plan(QUERIES[name](spark, sf))), name


def test_overlaps_are_no_cross_join(spark):
    s = spark.createDataFrame([(1, 1, 1, 2)], "doc_id int, idx int, page_start int, page_end int")
    t = spark.createDataFrame([(1, "t", 1, 2)], "doc_id int, table_id string, page_start int, page_end int")
    assert not re.search("CartesianProduct|NestedLoop", _plan(tables.sections_with_tables(s, t)))


def test_documents_are_read_and_split_once(spark, sf):
    plan = _plan(QUERIES["split_sections"](spark, sf))
    assert len(re.findall("FileScan", plan)) == 1 and len(re.findall(r"\bWindow \[", plan)) < 20


def test_pages_are_parsed_before_they_are_used_several_times(spark, sf):
    assert not re.search("MapInArrow", _plan(QUERIES["page_digest"](spark, sf)))


def test_every_query_with_sql_is_registered():
    import __spark_entry__

    queries, sql = __spark_entry__.queries(), __spark_entry__.oracle_sql()
    assert set(sql) <= set(queries) and len(queries) > 120
