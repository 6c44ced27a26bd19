import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from tabulon.session import session

    base = tmp_path_factory.mktemp("spark")
    found = session(
        "tests",
        "local[4]",
        **{
            "spark.sql.shuffle.partitions": "4",
            "spark.driver.memory": "3g",
            "spark.sql.warehouse.dir": str(base / "warehouse"),
            "spark.checkpoint.dir": str(base / "checkpoint"),
            "spark.ui.showConsoleProgress": "false",
        },
    )
    found.sparkContext.setLogLevel("ERROR")
    yield found
    found.stop()
