import sys
from pathlib import Path

import pytest

sys.path[:0] = [str(Path(__file__).parent.parent), str(Path(__file__).parent)]

from embermill.session import get_session

DATA = Path("/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    s = get_session("embermill-tests", 4)
    yield s
    s.stop()


@pytest.fixture(scope="session")
def data() -> str:
    if not DATA.exists():
        pytest.skip("the driver's tables aren't here")
    return str(DATA)
