def test_each_operator_has_one_query():
    import __spark_entry__

    queries = __spark_entry__.queries()
    for n in range(1, 14):
        assert len([q for q in queries if q.startswith(f"op{n}_")]) == 1
    assert "pipeline" in queries
