import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from feedlake.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = build_session(
        "feedlake-tests", "local[8]",
        **{
            "spark.sql.shuffle.partitions": "4", "spark.sql.warehouse.dir": tempfile.mkdtemp(prefix="feedlake-tests-"), "spark.ui.enabled": "false", "spark.driver.memory": "8g",
            "spark.ui.showConsoleProgress": "false", "spark.log.level": "ERROR",
        },
    )
    yield session
    session.stop()
