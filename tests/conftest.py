import os

os.environ.setdefault("OMP_NUM_THREADS", "1")

import pytest

from adlattice.session import local_session


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    folder = tmp_path_factory.mktemp("shared")
    session = local_session("tests", cpus=4, spark__checkpoint__dir=f"file://{folder}", spark__driver__memory="4g")
    yield session
    session.stop()
