import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from wardbook.session import get_spark
    s = get_spark("local[4]", app="wardbook-tests", shuffle_partitions=8)
    yield s


@pytest.fixture()
def seed(spark):
    from wardbook.sources.seed import sample_tables
    return sample_tables(spark)
