import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))


@pytest.fixture(scope="session")
def spark():
    from docloom.session import local_session

    session = local_session("tests", cores=4, memory="4g")
    session.conf.set("spark.sql.shuffle.partitions", "4")
    yield session
    session.stop()
