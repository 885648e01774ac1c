"""Where derived tables are written."""

import pytest

from guichet.session import ensure_checkpoint_dir


class Context:
    def __init__(self, master, folder=None):
        self.master, self.folder = master, folder

    def getCheckpointDir(self):
        return self.folder

    def setCheckpointDir(self, folder):
        self.folder = folder


class Conf(dict):
    def get(self, key, default=None):
        return dict.get(self, key, default)


class Session:
    def __init__(self, master, folder=None, **conf):
        self.sparkContext, self.conf = Context(master, folder), Conf(conf)


def test_the_folder_in_use_stays():
    session = Session("yarn", "hdfs:///a", **{"spark.checkpoint.dir": "hdfs:///b"})
    ensure_checkpoint_dir(session)
    assert session.sparkContext.folder == "hdfs:///a"


def test_the_named_folder_is_used():
    session = Session("yarn", **{"spark.checkpoint.dir": "hdfs:///b"})
    ensure_checkpoint_dir(session)
    assert session.sparkContext.folder == "hdfs:///b"


def test_a_cluster_without_a_folder_is_an_error():
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        ensure_checkpoint_dir(Session("spark://host:7077"))


def test_a_local_session_gets_its_own_folder():
    session = Session("local[2]")
    ensure_checkpoint_dir(session)
    assert session.sparkContext.folder


def test_staged_tables_land_in_the_named_folder(spark):
    from guichet.operators.settle import stage

    staged = stage(spark.range(3))
    folder = spark.sparkContext.getCheckpointDir()
    assert all(f.replace("file://", "file:").startswith(folder.replace("file://", "file:")) for f in staged.inputFiles())
    assert staged.count() == 3
