import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parent))

from odd_rows import DOCS, ODD  # noqa: E402


@pytest.fixture(scope="session")
def odd(spark):
    return spark.createDataFrame([r + (len(r[1] or ""), "x", "k", "n") for r in ODD], DOCS)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], DOCS)
