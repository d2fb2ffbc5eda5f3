import pytest

from shoalwater.session import session


@pytest.fixture(scope="session")
def spark():
    s = session("local[4]", 4, spark__driver__memory="4g", spark__sql__execution__arrow__pyspark__enabled="true")
    s.sparkContext.setLogLevel("ERROR")
    yield s
