import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from cartwright.llm.shipping import ship  # noqa: E402


@pytest.fixture(scope="session", autouse=True)
def shipped(spark):
    return ship(spark)
