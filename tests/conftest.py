import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path[:0] = [ROOT, os.path.join(ROOT, "tests")]

from cartwright.session import local_session, prepare, work_dir  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = prepare(
        local_session(
            "*",
            "tests",
            spark__sql__shuffle__partitions="4",
            spark__checkpoint__dir=str(tmp_path_factory.mktemp("shared")),
        )
    )
    work_dir(session)
    return session
