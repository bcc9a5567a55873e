import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from quillspark.session import build_session

    session = build_session("tests", "4", **{"spark__checkpoint__dir": str(tmp_path_factory.mktemp("shared")), "spark__driver__memory": "6g", "spark__sql__warehouse__dir": str(tmp_path_factory.mktemp("warehouse"))})
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()
