import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from cellweave.session import get_spark  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = get_spark("tests", "local[8]", **{
        "spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false", "spark.driver.memory": "6g",
        "spark.ui.showConsoleProgress": "false"})
    session.sparkContext.setLogLevel("ERROR")
    return session


@pytest.fixture(scope="session")
def matrix(spark):
    """Five cells by three genes; cell 1 differs in depth and profile."""
    rows = [[3, 1, 1], [3, 1, 22], [3, 1, 1], [6, 2, 2], [6, 2, 2]]
    data = [(c, g, float(v)) for c, row in enumerate(rows) for g, v in enumerate(row)]
    return spark.createDataFrame(data, "cell long, gene long, value double")
