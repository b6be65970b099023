from pyspark.sql import functions as F

from cutloom.streaming.arrivals import arrivals, embed_incrementally, first_deliveries
from cutloom.streaming.periods import stream_periods

INTERVALS = "key string, s long, e long"


def test_stream_periods(spark, tmp_path):
    source = tmp_path / "in"
    for n, batch in enumerate([[("a", 0, 10), ("a", 20, 30)], [("a", 10, 15), ("b", 5, 6)], [("a", 14, 21), ("a", None, 3)]]):
        spark.createDataFrame(batch, INTERVALS).coalesce(1).write.mode("append").parquet(str(source))
        if n == 0:
            stream = spark.readStream.schema(INTERVALS).parquet(str(source))
        query = stream_periods(stream, "key", "s", "e").writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        query.awaitTermination()
    rows = spark.read.parquet(str(tmp_path / "out")).collect()
    now = {}
    for r in sorted(rows, key=lambda r: (r["version"], r["item"] != "gone")):
        if r["item"] == "gone":
            now.pop((r["entity"], r["start_ms"], r["end_ms"]), None)
        elif r["item"] == "period":
            now[(r["entity"], r["start_ms"], r["end_ms"])] = True
    assert set(now) == {("a", 0, 30), ("b", 5, 6)}


def test_streams_of_segments(spark, data, tmp_path):
    source = f"{data}/segments.parquet"
    schema = spark.read.parquet(source).schema
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "segments.parquet").symlink_to(source)
    read = lambda: spark.readStream.schema(schema).parquet(str(folder))
    first_deliveries(read()).writeStream.format("memory").queryName("firsts").trigger(availableNow=True).start().awaitTermination()
    assert spark.table("firsts").count() == spark.read.parquet(source).select("id").distinct().count()
    arrivals(read()).writeStream.format("memory").queryName("arrivals").outputMode("complete").trigger(availableNow=True).start().awaitTermination()
    assert spark.table("arrivals").agg(F.sum("segments")).first()[0] == spark.read.parquet(source).count()
    embed = lambda rows: rows.select("id", F.lit(1).alias("done"))
    embed_incrementally(read(), embed, str(tmp_path / "out"), str(tmp_path / "cp"), "frame").awaitTermination()
    want = spark.read.parquet(source).filter("kind = 'frame' and embedding is null").select("id").distinct().count()
    assert spark.read.parquet(str(tmp_path / "out")).count() == want
