import os
import sys
import tempfile

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = ROOT + os.pathsep + os.environ.get("PYTHONPATH", "")

SF_SMALL = "/root/testdata/sf0.001"
SF_TEST = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from ledgerlens.session import session

    shared = tempfile.mkdtemp(prefix="spark-")
    s = session(
        "tests",
        master=f"local[{os.environ.get('TEST_CPUS', '8')}]",
        spark__sql__shuffle__partitions="8",
        spark__driver__memory="6g",
        spark__driver__host="127.0.0.1",
        spark__sql__warehouse__dir=f"{shared}/warehouse",
        spark__local__dir=f"{shared}/local",
        spark__checkpoint__dir=f"file://{shared}/checkpoints",
        spark__ui__showConsoleProgress="false",
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()
