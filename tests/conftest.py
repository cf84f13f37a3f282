import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from paneltide.session import build

    s = build("local[4]", 4, spark__checkpoint__dir=f"file://{tmp_path_factory.mktemp('checkpoint')}", spark__driver__memory="4g")
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()
