import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parent))
import helpers  # noqa: E402


@pytest.fixture(scope="session")
def docs(spark):
    return spark.createDataFrame(helpers.rows(), helpers.DOCS).repartition(3)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], helpers.DOCS)
