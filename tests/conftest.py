import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from cropcube.session import session  # noqa: E402

DATA = "/root/testdata"


@pytest.fixture(scope="session")
def spark():
    return session("tests", "4", 4, spark__driver__memory="4g")


@pytest.fixture(scope="session")
def small():
    return f"{DATA}/sf0.001"
