import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))
sys.path.insert(0, str(ROOT / "tests"))

from paths import SF_MID, SF_SMALL  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    from tabsieve.session import get_session

    s = get_session("local[4]", shuffle_partitions=8, extra={"spark.driver.memory": "6g"})
    yield s
    s.stop()


@pytest.fixture(scope="session")
def tables_small(spark):
    from tabsieve.sources.tables import Tables

    return Tables(spark, SF_SMALL)


@pytest.fixture(scope="session")
def tables_mid(spark):
    from tabsieve.sources.tables import Tables

    return Tables(spark, SF_MID)
