from types import SimpleNamespace

import pytest

from tidemark import session
from tidemark.session import drop_written, shared_folder, written


def fake(master, setting=None, checkpoint=None):
    context = SimpleNamespace(master=master, applicationId=f"app-{master}", getCheckpointDir=lambda: checkpoint)
    return SimpleNamespace(conf=SimpleNamespace(get=lambda k, d: setting), sparkContext=context)


def test_only_a_local_master_may_go_without_a_shared_folder(monkeypatch):
    assert shared_folder(fake("yarn", "hdfs://x/y/")) == "hdfs://x/y"
    assert shared_folder(fake("spark://h:7077", None, "file:///mnt/z")) == "file:///mnt/z"
    for master in ("yarn", "spark://h:7077", "k8s://h", "local-cluster[2,1,1024]"):
        with pytest.raises(ValueError, match="spark.checkpoint.dir"):
            shared_folder(fake(master))
    one = shared_folder(fake("local[4]"))
    assert one.startswith("file://") and shared_folder(fake("local[4]")) == one


def test_written_tables_can_be_dropped(spark):
    drop_written(spark)
    df = written(spark.createDataFrame([(1, None), (2, "x")], "a int, b string"), "t")
    folder = df.inputFiles()[0].rsplit("/", 1)[0]
    assert folder.startswith(shared_folder(spark).split(":")[0]) and sorted(r.a for r in df.collect()) == [1, 2]
    assert drop_written(spark) == 1 and drop_written(spark) == 0
    fs, path = session.hadoop_path(spark, folder)
    assert not fs.exists(path)
