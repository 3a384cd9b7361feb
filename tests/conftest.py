import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from loomwright.session import get_session

    return get_session("tests", cpus=4, spark_sql_shuffle_partitions="4", spark_driver_memory="2g")
