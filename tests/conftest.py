import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
os.environ["PYTHONPATH"] = os.pathsep.join(filter(None, [sys.path[0], os.environ.get("PYTHONPATH", "")]))


@pytest.fixture(scope="session")
def spark():
    from graphloam.session import local_session, shared_dir

    s = local_session(8, 4)
    s.sparkContext.setLogLevel("ERROR")
    shared_dir(s)
    yield s
    s.stop()
