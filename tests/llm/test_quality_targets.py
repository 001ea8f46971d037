from sparlink.llm.queries import quality_targets


def test_toxic_rows_are_others(spark):
    labels = spark.createDataFrame([(1, 1, 0), (2, 1, 1), (3, 0, 0), (4, 0, 1), (5, 1, 0), (5, 1, 1)], "doc_id long, quality int, toxic int")
    assert {r.doc_id: r.target for r in quality_targets(labels).collect()} == {1: True, 2: False, 3: False, 4: False, 5: False}
