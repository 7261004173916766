import subprocess
import sys

from tidemark.streaming.cooldown import stream_cooldown


def test_queries_and_sql_need_no_session():
    code = "import __spark_entry__ as e; q, s = e.queries(), e.oracle_sql(); assert set(s) <= set(q) and len(q) > 90, len(q)"
    subprocess.run([sys.executable, "-c", code], check=True, timeout=120)


def test_the_rest_works_without_the_text_operators():
    code = "import sys; sys.modules['tidemark.llm'] = None; import __spark_entry__ as e; assert not [n for n in e.queries() if n.startswith(('p6', 'p7', 'p8'))]"
    subprocess.run([sys.executable, "-c", code], check=True, timeout=120)


def test_cooldown_on_a_stream(spark, tmp_path):
    def batch(name, rows):
        spark.createDataFrame(rows, "ticker string, pos int").coalesce(1).write.parquet(str(tmp_path / "in" / name))

    batch("b=1", [("A", 105), ("A", 100), ("B", 7), (None, 1), ("A", None)])
    source = spark.readStream.schema("ticker string, pos int").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / "b=*"))
    q = stream_cooldown(source, 20).writeStream.format("memory").queryName("cooled").option("checkpointLocation", str(tmp_path / "cp")).start()
    try:
        q.processAllAvailable()
        batch("b=2", [("A", 110), ("A", 130), ("A", 131), ("B", 27)])
        q.processAllAvailable()
    finally:
        q.stop()
    got = sorted((r.ticker, r.pos, r.kept, r.anchor, r.episode_length) for r in spark.table("cooled").collect())
    assert got == [("A", 100, True, 100, 1), ("A", 105, False, 100, 2), ("A", 110, False, 100, 3), ("A", 130, True, 130, 1), ("A", 131, False, 130, 2), ("B", 7, True, 7, 1), ("B", 27, True, 27, 1)]
