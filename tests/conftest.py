import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
os.environ.setdefault("PYSPARK_PYTHON", sys.executable)


@pytest.fixture(scope="session")
def spark():
    from quadweave.session import build_session

    session = build_session("local[4]", 4, spark__driver__memory="4g")
    yield session
    session.stop()
