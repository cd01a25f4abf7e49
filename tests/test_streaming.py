"""Streams give what the batch operators give."""


from pyspark.sql import functions as F

from cairn.operators import events as batch
from cairn.streaming import events as stream

ROWS = [(k, s, float(t), float(x), 0.0) for k in (1, 2) for s, (t, x) in enumerate([(0, 0), (1, 0), (1.2, 1), (5, 1), (5.1, 1), (5.3, 1), (9, 2), (30, 2), (31, 7)])]
SCHEMA = "key long, seq long, t double, x double, y double"


def run(spark, tmp_path, make, name):
    src = str(tmp_path / "in")
    for part in (0, 1):
        spark.createDataFrame([r for r in ROWS if (r[2] >= 5) == bool(part)], SCHEMA).coalesce(1).write.mode("append").parquet(src)
    read = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(src)
    q = make(read).writeStream.format("memory").queryName(name).outputMode("append").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp")).start()
    q.awaitTermination(120)
    return spark.table(name)


def keys(df):
    return sorted((r.key, r.seq) for r in df.collect())


def test_throttle(spark, tmp_path):
    got = run(spark, tmp_path, lambda s: stream.throttle(s, 1.0), "throttled")
    want = batch.throttle(spark.createDataFrame(ROWS, SCHEMA), "key", ["t", "seq"], F.col("t"), 1.0, "x", "y")
    assert keys(got) == keys(want)


def test_double_clicks(spark, tmp_path):
    got = run(spark, tmp_path, lambda s: stream.double_clicks(s, 0.5, 20.0), "clicked")
    want = batch.double_clicks(spark.createDataFrame(ROWS, SCHEMA), "key", ["t", "seq"], F.col("t"), 0.5, 20.0, "x", "y")
    assert keys(got) == keys(want)
    assert keys(got)


def test_debounce(spark, tmp_path):
    at = lambda s: s.withColumn("ts", F.timestamp_seconds(F.col("t") + 1_000_000))
    got = run(spark, tmp_path, lambda s: stream.debounce(at(s), "2 seconds", "1 second"), "debounced")
    want = batch.debounce(spark.createDataFrame(ROWS, SCHEMA), "key", ["t", "seq"], F.col("t"), 2.0)
    closed = {k for k in keys(want) if k[1] != max(r[1] for r in ROWS)}  # the last burst is still open
    assert closed <= set(keys(got)) <= set(keys(want))


def test_sync(spark, tmp_path):
    src, to = str(tmp_path / "tiles"), str(tmp_path / "out")
    schema = "cell string, level long, x long"
    for k in (0, 1):
        spark.createDataFrame([("c", k, 1), ("d", k, 2)], schema).write.mode("append").parquet(src)
        q = stream.sync(spark.readStream.schema(schema).parquet(src), to, str(tmp_path / "cp"), once=True)
        q.awaitTermination(120)
        assert spark.read.parquet(to).count() == 2 * (k + 1)
