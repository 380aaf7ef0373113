from lexweave.operators import understanding


def test_names_are_worked_out_once(spark):
    """The words of whole titles are split for one table of names, which all later joins read."""
    titles = spark.createDataFrame([("d1", "Kesavananda Bharati"), ("d2", "Maneka Gandhi")], "document_id string, title string")
    asked = spark.createDataFrame([(1, "what of kesavananda"), (2, "and of manekaa")], "query_id long, query string")
    found = understanding.match_cases(asked, titles)
    assert "title" not in found._jdf.queryExecution().optimizedPlan().toString()
    assert sorted((r.query_id, r.document_id, r.corrected) for r in found.collect()) == [(1, "d1", False)]
