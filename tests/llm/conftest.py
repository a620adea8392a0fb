import pytest

from feedlake.llm.shared import ship


@pytest.fixture(scope="session", autouse=True)
def shipped(spark):
    ship(spark)
