import pytest

from docframe.session import build


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    s = build("local[4]", app="tests", spark__sql__shuffle__partitions="4", spark__checkpoint__dir=str(tmp_path_factory.mktemp("checkpoint")))
    yield s
    s.stop()
