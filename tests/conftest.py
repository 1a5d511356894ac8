from __future__ import annotations

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
os.environ["PYTHONPATH"] = sys.path[0] + os.pathsep + os.environ.get("PYTHONPATH", "")


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from filigree.session import get_session

    shared = tmp_path_factory.mktemp("shared")
    s = get_session(
        "tests", "local[4]", spark__sql__shuffle__partitions="4", spark__driver__memory="4g", spark__ui__enabled="false", spark__checkpoint__dir=f"file://{shared}", spark__sql__warehouse__dir=f"{shared}/warehouse"
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()
