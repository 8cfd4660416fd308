"""The folder of tables that cut lineage."""

import pytest

from airflux import scratch


class _Conf:
    def __init__(self, **values):
        self.values = values

    def get(self, key, default=None):
        return self.values.get(key, default)


class _Session:
    def __init__(self, **values):
        self.conf = _Conf(**{k.replace("_", "."): v for k, v in values.items()})


def test_setting_wins():
    assert scratch.shared_dir(_Session(spark_checkpoint_dir="file:///a/b/", spark_master="yarn")) == "file:///a/b"


def test_unset_in_local_mode_is_one_folder_of_the_process():
    session = _Session(spark_master="local[4]")
    assert scratch.shared_dir(session) == scratch.shared_dir(session)


def test_unset_on_a_cluster_raises():
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        scratch.shared_dir(_Session(spark_master="spark://host:7077"))


def test_written_without_the_setting(spark, monkeypatch):
    """As in a session that does not set the folder: Spark's own setting cannot be changed once it runs."""
    monkeypatch.setattr(scratch, "shared_dir", lambda _: scratch._own_dir())
    assert scratch.written(spark.range(5), "five").count() == 5
