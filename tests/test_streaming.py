from pyspark.sql import functions as F

from gridloom.operators import features
from gridloom.streaming.features import append_features, last_states, windowed_features


def test_windows_and_blocks(spark, tmp_path):
    rows = [(i, f"2024-01-01 0{i % 5}:10:00", "ab"[i % 2], float(i)) for i in range(60)]
    df = spark.createDataFrame(rows, "id long, ts string, k string, v double").withColumn("ts", F.to_timestamp("ts"))
    df.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    out = last_states(windowed_features(stream, "ts", ["k"], "v"), ["window", "k"], str(tmp_path / "states"))
    got = {(r.h, r.k): (r.n, r.total) for r in out.select(F.hour("window.start").alias("h"), "k", "n", "total").collect()}
    want = {(r.h, r.k): (r.n, r.total) for r in df.groupBy(F.hour("ts").alias("h"), "k").agg(F.count("*").alias("n"), F.sum("v").alias("total")).collect()}
    assert got == want

    pixels = df.select(F.col("k").alias("label"), F.col("id").alias("x"), F.lit(1).alias("y"), "v")
    pixels.write.parquet(str(tmp_path / "pixels"))
    stream = spark.readStream.schema(pixels.schema).parquet(str(tmp_path / "pixels"))
    append_features(stream, features.FeatureExtractor([features.BasicProps("v")]), ["label"], str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination()
    out = spark.read.parquet(str(tmp_path / "out"))
    assert {(r.label, r.BasicProps_Area) for r in out.collect()} == {("a", 30), ("b", 30)}


def test_last_states_over_batches(spark, tmp_path):
    """Each window's state after several batches, without what came later than the watermark."""
    schema = "ts timestamp, k string, v double"
    for n, rows in enumerate([[("2024-01-01 01:10:00", 1.0), ("2024-01-01 05:10:00", 2.0)], [("2024-01-01 05:20:00", 3.0), ("2024-01-01 01:20:00", 9.0)], [("2024-01-01 05:30:00", 4.0)]]):
        df = spark.createDataFrame([(t, "a", v) for t, v in rows], "ts string, k string, v double").withColumn("ts", F.to_timestamp("ts"))
        df.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        # a run after each write goes on from the checkpoint of the one before, so that batches come in this order
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        out = last_states(windowed_features(stream, "ts", ["k"], "v"), ["window", "k"], str(tmp_path / "states"))
    assert sorted((r.h, r.n, r.total) for r in out.select(F.hour("window.start").alias("h"), "n", "total").collect()) == [(1, 1, 1.0), (5, 3, 9.0)]
