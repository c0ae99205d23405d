import pytest


@pytest.fixture(scope="session", autouse=True)
def shipped(spark):
    from quillspark.llm.base import ship_by_value

    ship_by_value()
