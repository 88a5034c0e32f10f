import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from terrace.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    s = build_session(
        "local[8]", "tests", spark__sql__shuffle__partitions="4", spark__ui__enabled="false", spark__driver__memory="8g"
    )
    s.sparkContext.setLogLevel("OFF")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def sf_dir():
    return "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def matches(spark, sf_dir):
    from terrace.scale import checkpoint
    from terrace.sources import derived

    return checkpoint(derived.matches(spark, sf_dir))
