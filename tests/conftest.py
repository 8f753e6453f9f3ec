import tempfile

import pytest

from ledgerloom.session import session


@pytest.fixture(scope="session")
def spark():
    scratch = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    active = session(
        "local[4]",
        **{
            "spark.sql.shuffle.partitions": "4",
            "spark.driver.memory": "4g",
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
            "spark.local.dir": scratch,
            "spark.sql.warehouse.dir": f"file://{scratch}/warehouse",
        },
    )
    active.sparkContext.setLogLevel("ERROR")
    yield active
    active.stop()
