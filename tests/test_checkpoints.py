import pytest

from causeway.sources import checkpoints as C


class _Missing:
    def isDefined(self):
        return False


class _Context:
    """A session on a cluster without a shared folder."""

    master = "spark://host:7077"

    @property
    def _jsc(self):
        return self

    def sc(self):
        return self

    def getCheckpointDir(self):
        return _Missing()

    def getConf(self):
        return {}


class _Frame:
    class sparkSession:  # noqa: N801
        sparkContext = _Context()


def test_a_cluster_needs_a_shared_folder():
    with pytest.raises(RuntimeError):
        C.cut_lineage(_Frame())


def test_local_masters():
    assert C.is_local("local") and C.is_local("local[8]") and not C.is_local("local-cluster[3,2,1024]") and not C.is_local("yarn")


def test_rows_stay(spark):
    assert C.cut_lineage(spark.range(7)).count() == 7
