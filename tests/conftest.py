import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from axiomill.session import get_spark  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    s = get_spark(
        "tests", "local[4]", spark__sql__shuffle__partitions="2", spark__default__parallelism="2", spark__ui__enabled="false", spark__driver__memory="4g",
        spark__sql__codegen__wholeStage="false",
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
