import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)


@pytest.fixture(scope="session")
def spark():
    from tracewright.session import local_session, reach_workers

    session = local_session(cores=4, partitions=4, memory="4g", name="tests")
    session.sparkContext.setLogLevel("ERROR")
    reach_workers(session, ROOT)
    yield session
    session.stop()
