import os
import sys

import pytest

HERE = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, os.path.dirname(HERE))
# stubs of models are sent to workers, which then import these modules
os.environ["PYTHONPATH"] = os.pathsep.join([os.path.dirname(HERE), HERE, *filter(None, [os.environ.get("PYTHONPATH")])])


@pytest.fixture(scope="session")
def spark():
    from corpusmill.session import build

    s = build("tests", "local[4]", **{"spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "4g", "spark.python.worker.reuse": "true"})
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()
