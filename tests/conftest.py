import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from siftwood.session import session

    out = session("local[8]", 4, **{"spark.ui.showConsoleProgress": "false", "spark.driver.memory": "6g"})
    out.sparkContext.setLogLevel("ERROR")
    yield out
    out.stop()
