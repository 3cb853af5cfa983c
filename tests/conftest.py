import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))


@pytest.fixture(scope="session")
def spark():
    from rosterlens.session import clear, local_session

    session = local_session(8, 8, "4g", **{"spark.sql.adaptive.coalescePartitions.enabled": "true"})
    yield session
    clear(session)
