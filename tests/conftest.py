import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parent.parent))


@pytest.fixture(scope="session")
def spark():
    from inkwell.session import local_session, ship

    session = local_session("tests", "4", 4)
    session.sparkContext.setLogLevel("ERROR")
    yield ship(session)
    session.stop()
