from tidemark.streaming.keep_up import keep_up


def test_batches_add_new_keys_once(spark, tmp_path):
    source, table = f"{tmp_path}/in", f"{tmp_path}/table"
    for k, rows in enumerate(([(1, "a"), (2, "b"), (2, "b")], [(2, "c"), (3, "d"), (None, "x")])):
        spark.createDataFrame(rows, "id long, v string").coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema("id long, v string").parquet(source)
        query = keep_up(stream, table, f"{tmp_path}/state", "id")
        query.awaitTermination(120)
        assert sorted(r.id for r in spark.read.parquet(table).collect()) == ([1, 2] if k == 0 else [1, 2, 3])
