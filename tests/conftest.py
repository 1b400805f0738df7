import os
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
sys.path.insert(0, str(Path(__file__).resolve().parent))
# Python workers import the package too
os.environ["PYTHONPATH"] = os.pathsep.join([str(Path(__file__).resolve().parent.parent), os.environ.get("PYTHONPATH", "")])


@pytest.fixture(scope="session")
def spark():
    from caseloom.session import local_session

    s = local_session(8, "tests", shuffle=4)
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()
