import pathlib
import sys

import pytest

sys.path.insert(0, str(pathlib.Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark():
    from memgov.session import build_session, clear_scratch

    session = build_session("local[4]", 4)
    session.sparkContext.setLogLevel("ERROR")
    yield session
    clear_scratch(session)
    session.stop()


DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def data():
    return DATA
