import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from linkgraph.session import local_session
    s = local_session(cores=4, shuffle_partitions=4, app="linkgraph-tests", driver_memory="4g")
    yield s


@pytest.fixture()
def tmpdir_path():
    return tempfile.mkdtemp(prefix="linkgraph-test-")


SF_SMALL = "/root/testdata/sf0.001"
