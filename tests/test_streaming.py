from granthika.streaming.ingest import ingest


def test_only_new_texts_are_appended(spark, tmp_path):
    a, out, ck = (str(tmp_path / x) for x in ("in", "out", "ck"))
    first = spark.createDataFrame([(1, "one"), (2, "two"), (3, "ONE ")], "id long, text string")
    first.coalesce(1).write.mode("append").parquet(a)
    ingest(spark, a, first.schema, out, ck, "id").awaitTermination()
    spark.createDataFrame([(4, "two"), (5, "three")], first.schema).coalesce(1).write.mode("append").parquet(a)
    ingest(spark, a, first.schema, out, ck, "id").awaitTermination()
    assert sorted(r.id for r in spark.read.parquet(out).collect()) == [1, 2, 5]
