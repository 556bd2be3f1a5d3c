import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from pliego.session import local_session

    s = local_session(app="pliego-tests", cores="4", shuffle_partitions=4)
    yield s
    s.stop()


def one_col(spark, values, name="v", ddl="string"):
    return spark.createDataFrame([(v,) for v in values], f"{name} {ddl}")
