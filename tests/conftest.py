import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))


@pytest.fixture(scope="session")
def spark():
    from tidewright.session import get_spark

    return get_spark("local[4]", 4, "4g")


@pytest.fixture(scope="session")
def sf():
    return "/root/testdata/sf0.001"
