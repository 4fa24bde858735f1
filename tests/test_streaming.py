"""The windowed plan on a stream gives what it gives on the table."""

from strandlake.streaming.events import windowed


def test_stream_equals_table(spark, sf_dir, tmp_path):
    table = spark.read.parquet(f"{sf_dir}/events.parquet")
    table.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(table.schema).parquet(str(tmp_path / "in"))
    run = windowed(stream).writeStream.outputMode("complete").format("memory").queryName("windows").trigger(availableNow=True).start()
    run.awaitTermination()
    key = lambda df: sorted((r.window_start, r.event_type, r.n, round(r.total, 4)) for r in df.collect())
    assert key(spark.table("windows")) == key(windowed(table))
