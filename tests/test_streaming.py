from isoweave.streaming.votes import merged, shards_to


def test_shards_add_up(spark, tmp_path):
    kind = "id string, pos int, allele string, weight double"
    for k, w in enumerate((3.0, 1.0)):
        spark.createDataFrame([("r", 0, "A", w), ("r", 0, "C", 1.0)], kind).write.parquet(f"{tmp_path}/in/{k}")
    stream = spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    q = shards_to(stream, f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/mark").trigger(availableNow=True).start()
    q.awaitTermination()
    prior = spark.createDataFrame([("r", 0, "A", 1.5)], kind)
    assert sorted((r.allele, r.weight) for r in merged(spark, f"{tmp_path}/out", prior).collect()) == [("A", 5.5), ("C", 2.0)]
