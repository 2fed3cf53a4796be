import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from skyloom.session import session, ship

    shared = tmp_path_factory.mktemp("shared")
    extra = {"spark.sql.shuffle.partitions": "4", "spark.checkpoint.dir": f"file://{shared}", "spark.driver.memory": "4g"}
    spark = session("tests", "local[4]", **extra)
    spark.sparkContext.setLogLevel("ERROR")
    ship(spark)
    yield spark
    spark.stop()
