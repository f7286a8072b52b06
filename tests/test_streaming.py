import pytest
from pyspark.sql import functions as F

from pagemill.sources import docx
from pagemill.streaming import incremental


def run(df, name):
    q = df.writeStream.format("memory").queryName(name).outputMode("append").start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    return df.sparkSession.table(name)


def test_docx_stream(spark, tmp_path):
    (tmp_path / "a.docx").write_bytes(docx.package(docx.paragraph_xml("one") + docx.paragraph_xml("two")))
    (tmp_path / "b.txt").write_text("x")
    rows = run(incremental.docx_blocks(spark, str(tmp_path), most_bytes=1 << 20), "docx_rows").orderBy("ord").collect()
    assert [r.visible for r in rows] == ["one", "two"]


def test_series_keep_their_state(spark, tmp_path):
    schema = "doc_id long, series string, ord int, reset_to int, repeats boolean"
    parts = [[(1, "f", 0, None, False), (1, "f", 1, None, False)], [(1, "f", 2, None, True), (1, "f", 3, 10, False), (1, "t", 4, None, False)]]
    for k, rows in enumerate(parts):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    got = {(r.series, r.ord): r.seq for r in run(incremental.number_series(stream), "series_rows").collect()}
    assert got == {("f", 0): 1, ("f", 1): 2, ("f", 2): 2, ("f", 3): 10, ("t", 4): 1}


def test_list_labels_and_windows(spark, sf_dir, tmp_path):
    spark.createDataFrame([(1, 1, 0, 0), (1, 1, 1, 1), (1, 1, 2, 0)], "doc_id long, num_id int, ord int, level int").coalesce(1).write.parquet(str(tmp_path / "items"))
    stream = spark.readStream.schema("doc_id long, num_id int, ord int, level int").parquet(str(tmp_path / "items"))
    levels = {1: {0: (1, "decimal", "%1.", None, False), 1: (1, "decimal", "%1.%2", None, False)}}
    assert [r.label for r in run(incremental.list_labels(stream, levels), "label_rows").orderBy("ord").collect()] == ["1.", "1.1", "2."]
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    assert incremental.windowed_counts(events).agg(F.sum("n")).first()[0] == events.count()


def test_written_stream(spark, tmp_path):
    schema = "doc_id long, ord int, kind string, style string, text string"
    for rows in ([(1, 0, "paragraph", None, "a"), (1, 1, "paragraph", None, "b")], [(2, 0, "paragraph", None, "c")]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = incremental.write_files(stream, str(tmp_path / "out"), str(tmp_path / "state"))
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    files = spark.read.parquet(str(tmp_path / "out"))
    assert {r.doc_id: r.text for r in docx.document_text(docx.read(files, id_col="doc_id"), "doc_id").collect()} == {1: "a\nb", 2: "c"} and files.select("batch").distinct().count() == 2


def test_cancellation(spark):
    import threading
    import time

    c = incremental.Cancellation(spark)
    assert c.run(lambda: spark.range(3).count()) == 3
    slow = spark.range(8).repartition(8).mapInPandas(lambda frames: (time.sleep(30) or f for f in frames), "id long")
    timer = threading.Timer(3, c.cancel)
    timer.start()
    began = time.time()
    with pytest.raises(incremental.Cancelled):
        c.run(slow.count)
    assert time.time() - began < 25
    with pytest.raises(incremental.Cancelled):
        c.run(lambda: 1)
