import pytest

from invoicelens import session


class Stub:
    """A session's settings without the session."""

    def __init__(self, **settings):
        self.conf = self
        self.settings = settings
        self.sparkContext = self
        self.applicationId = "app-1"

    def get(self, key, default=None):
        return self.settings.get(key, default)


def test_the_cluster_names_the_folder():
    assert session.shared_folder(Stub(**{"spark.checkpoint.dir": "hdfs://x/y/", "spark.master": "yarn"})) == "hdfs://x/y"


def test_only_a_local_master_gets_a_folder_of_its_own():
    local = Stub(**{"spark.master": "local[4]"})
    assert session.shared_folder(local) == session.shared_folder(local)
    with pytest.raises(RuntimeError):
        session.shared_folder(Stub(**{"spark.master": "yarn"}))


def test_materialised_rows_are_read_back(spark):
    frame = spark.range(10).selectExpr("id", "CAST(id AS DECIMAL(18,4)) AS m")
    assert session.materialise(frame).agg({"m": "sum"}).first()[0] == 45
