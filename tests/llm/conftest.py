import pytest


@pytest.fixture(autouse=True)
def _importable(spark):
    """Python workers find the package wherever the tests are started."""
    from netprism.llm.common import reach

    reach(spark)
