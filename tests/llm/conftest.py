import pytest

from pollweave.llm import common


@pytest.fixture(scope="session")
def llm(spark, tmp_path_factory):
    """The session with a shared folder; the tables of the smallest size as pandas."""
    if not spark.conf.get("spark.checkpoint.dir", None):
        spark.sparkContext.setCheckpointDir(str(tmp_path_factory.mktemp("shared")))
    return common.ready(spark)
