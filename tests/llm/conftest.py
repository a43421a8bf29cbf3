from pathlib import Path

import pytest

HOME = str(Path(__file__).resolve().parents[2])


@pytest.fixture(scope="session", autouse=True)
def workers(spark, tmp_path_factory):
    spark.sparkContext.environment["PYTHONPATH"] = HOME
    if not spark.conf.get("spark.checkpoint.dir", None):
        spark.sparkContext.setCheckpointDir(str(tmp_path_factory.mktemp("shared")))


@pytest.fixture
def docs(spark):
    """Documents with a clashing extra column from (doc_id, text) rows."""
    def build(rows, schema="doc_id long, text string"):
        extra = [(*r, "x") for r in rows]
        return spark.createDataFrame(extra, f"{schema}, score string")

    return build
