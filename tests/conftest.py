import os
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark():
    from lorekeep.session import session, ship

    found = session(
        "tests",
        **{"spark.master": f"local[{os.environ.get('TEST_CPUS', '4')}]", "spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false", "spark.driver.memory": "4g", "spark.ui.showConsoleProgress": "false"},
    )
    found.sparkContext.setLogLevel("ERROR")
    yield ship(found)
    found.stop()


@pytest.fixture(scope="session")
def sf():
    return os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
