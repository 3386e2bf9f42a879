import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from typeloom.session import get_spark

    folder = tmp_path_factory.mktemp("spark")
    s = get_spark("local[4]", **{"spark.sql.shuffle.partitions": "4", "spark.sql.warehouse.dir": str(folder / "wh"), "spark.checkpoint.dir": f"file://{folder}/ck", "spark.driver.memory": "4g", "spark.ui.showConsoleProgress": "false"})
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()
