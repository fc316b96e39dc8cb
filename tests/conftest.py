import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))


@pytest.fixture(scope="session")
def spark():
    from rxlink import session

    spark = session.session("tests", 8)
    spark.sparkContext.setLogLevel("ERROR")
    session.ship_package(spark)
    return spark
