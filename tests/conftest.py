import os
import sys
from pathlib import Path

import pytest

ROOT = str(Path(__file__).resolve().parent.parent)
sys.path.insert(0, ROOT)
# Python workers import the package too
os.environ["PYTHONPATH"] = os.pathsep.join([ROOT, *filter(None, [os.environ.get("PYTHONPATH")])])


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from tessera.session import session

    base = tmp_path_factory.mktemp("spark")
    s = session("tests", "local[4]", spark__sql__shuffle__partitions="4", spark__ui__enabled="false", spark__checkpoint__dir=f"file://{base}/shared", spark__sql__warehouse__dir=f"{base}/warehouse")
    s.sparkContext.setLogLevel("ERROR")
    s.sparkContext.setCheckpointDir(f"{base}/checkpoints")
    return s
