from pyspark.sql import functions as F

from tessera.functions import scalars
from tessera.streaming.novelty import first_seen


def test_scalars(spark):
    c = F.col
    df = spark.createDataFrame([("Ab", "aB", 2, 5, 9.9995)], "a string, b string, x int, y int, t double")
    row = df.select(scalars.iequals(c("a"), c("b")), scalars.combine_sum(c("x"), c("y")), scalars.combine_max(c("x"), c("y")), scalars.type_predicate(c("a")), scalars.whole_seconds(c("t"))).first()
    assert tuple(row) == (True, 7, 5, "type@Ab", 10)
    assert df.select(scalars.tuple_hash(c("x"), c("y")) == scalars.tuple_hash(c("x"), c("y"))).first()[0]


def test_stream_of_first_occurrences(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b"), (1, "a")], "s int, atom string").withColumn("ts", F.timestamp_seconds("s"))
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    q = first_seen(stream, ["atom"], "ts").writeStream.format("memory").queryName("seen").outputMode("append").start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    assert sorted(r.atom for r in spark.table("seen").collect()) == ["a", "b"]
