import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from stagecast.session import local_session  # noqa: E402

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = local_session(8, memory="8g", shuffle_partitions=4)
    session.conf.set("spark.sql.execution.arrow.pyspark.enabled", "true")
    yield session
    session.stop()
