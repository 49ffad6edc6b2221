import pytest


@pytest.fixture(autouse=True)
def clean():
    yield
    from keyloom.llm.common import release

    release()
