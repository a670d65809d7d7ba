import os
from types import SimpleNamespace

from depthframe.llm import common


def session(**settings):
    get = lambda key, *other: settings.get(key, *other)
    return SimpleNamespace(sparkContext=SimpleNamespace(getConf=lambda: SimpleNamespace(get=get)), conf=SimpleNamespace(get=get))


def test_shared_folder():
    both = {"spark.checkpoint.dir": "s3a://bucket/shared/", "spark.sql.warehouse.dir": "hdfs://store/warehouse/", "spark.master": "spark://host:7077"}
    assert common.shared_folder(session(**both)) == "s3a://bucket/shared"
    del both["spark.checkpoint.dir"]
    assert common.shared_folder(session(**both)) == "hdfs://store/warehouse/checkpoints"
    assert common.shared_folder(session(**both | {"spark.master": "local-cluster[2,1,1024]"})) == "hdfs://store/warehouse/checkpoints"
    assert common.shared_folder(session(**both | {"spark.master": "local[4]"})) == "/tmp/checkpoints"


def test_tables_that_are_forgotten_are_gone(spark):
    kept, gone = (common.checkpointed(spark.range(k)) for k in (5, 7))
    folder = gone.inputFiles()[0].rpartition("/")[0].removeprefix("file://")
    assert os.path.isdir(folder)
    common.forget(gone)
    assert not os.path.isdir(folder) and kept.count() == 5
