import os
import tempfile

import pytest

from loomspan.session import local_session

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    shared = tempfile.mkdtemp(prefix="loomspan-tests-")
    session = local_session(4, 4, **{"spark.checkpoint.dir": shared, "spark.sql.warehouse.dir": f"{shared}/warehouse"})
    yield session
    session.stop()
