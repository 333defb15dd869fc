from pyspark.sql import functions as F

from lithoframe.plans.views import records
from lithoframe.streaming import append


def test_stream_gives_the_batch_answer(spark, data, tmp_path):
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    rec = records(spark, data).select("record_id", "line", "trace_offset", "has_offset", "recorded_at")
    twice = rec.unionByName(rec.where("record_id % 5 = 0"))
    twice.repartition(4).write.parquet(src)
    stream = append.once(append.record_stream(spark, src, twice.schema, 1))
    append.append_to(stream.select(*twice.columns), out, str(tmp_path / "cp")).awaitTermination(120)
    got = spark.read.parquet(out)
    assert got.count() == rec.count()
    key = lambda df: sorted(tuple(map(str, r)) for r in append.windowed_fold(df).collect())
    assert key(got) == key(rec)


def test_windowed_fold_stream(spark, data, tmp_path):
    src = str(tmp_path / "in")
    rec = records(spark, data).select("record_id", "line", "trace_offset", "has_offset", "recorded_at")
    rec.repartition(3).write.parquet(src)
    q = append.windowed_fold(append.record_stream(spark, src, rec.schema)).writeStream.format("memory").queryName("folds").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert spark.table("folds").agg(F.sum("traces")).collect()[0][0] == rec.count()
