from pyspark.sql import functions as F

from archiveloom.sources import readers as R
from archiveloom.streaming import pipelines as P


def test_text_files(spark, tmp_path):
    (tmp_path / "deep").mkdir()
    (tmp_path / "a.md").write_text("one\ntwo")
    (tmp_path / "deep" / "b.md").write_text("three\n")
    (tmp_path / "c.txt").write_text("no")
    got = {r["name"]: r["text"] for r in R.text_files(spark, str(tmp_path)).collect()}
    assert got == {"a.md": "one\ntwo", "b.md": "three\n"}
    lines = sorted((r["file"], r["line_no"], r["line"]) for r in R.wiki_lines(spark, str(tmp_path), "*.md").collect())
    assert lines == [("a.md", 0, "one\n"), ("a.md", 1, "two"), ("b.md", 0, "three\n")]
    made = {r["name"]: r["text"] for r in R.binary_files(spark, str(tmp_path), "*.md", lambda b: b.decode().split("o")[3] if b"three" in b else b.decode()).collect()}
    assert made == {"a.md": "one\ntwo", "b.md": None}


def test_tables(spark, tmp_path):
    path = str(tmp_path / "t")
    R.write_table(spark.range(3), path, dataset="a", strategy="semantic")
    R.write_table(spark.range(5), path, dataset="b", strategy="semantic")
    assert R.read_table(spark, path, dataset="b").count() == 5 and R.read_table(spark, path).count() == 8
    R.write_edges(spark.createDataFrame([("a", "b")], "src string, dst string"), str(tmp_path / "e"))
    assert spark.read.option("header", True).csv(str(tmp_path / "e")).columns == ["src", "dst"]


def test_streams(spark, tmp_path):
    docs = spark.createDataFrame([(1, "The wells were repaired.\nThe road was opened.\n"), (2, None)], "doc_id bigint, text string")
    docs.write.parquet(str(tmp_path / "docs"))
    stream = lambda: spark.readStream.schema(docs.schema).parquet(str(tmp_path / "docs"))
    P.stream_chunks(stream(), str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    assert {r["doc_id"] for r in spark.read.parquet(str(tmp_path / "out")).collect()} == {1}
    P.stream_transform(stream(), lambda d: d.withColumn("n", F.length("text")), str(tmp_path / "plain"), str(tmp_path / "state2")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "plain")).count() == 2

    events = spark.sql("select id as k, timestamp_seconds(1000 + id * 600) as at, if(id % 2 = 0, 'a', 'b') as kind from range(12) union all select 1, timestamp_seconds(1001), 'b'")
    events.write.parquet(str(tmp_path / "events"))
    stream = lambda: spark.readStream.schema(events.schema).parquet(str(tmp_path / "events"))
    P.to_memory(P.stream_counts(stream(), "at", "kind"), "t_counts", str(tmp_path / "s3"), "complete").awaitTermination()
    want = events.groupBy(F.window("at", "1 hour").alias("w"), "kind").count().select("w.start", "kind", "count")
    assert sorted(map(str, spark.table("t_counts").select("start", "kind", F.col("n").alias("count")).collect())) == sorted(map(str, want.collect()))
    P.to_memory(P.stream_first(stream(), "k", "at"), "t_first", str(tmp_path / "s4")).awaitTermination()
    assert spark.table("t_first").count() == 12
