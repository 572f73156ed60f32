import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from runlens.session import local_session

    s = local_session(cores="*", shuffle_partitions=8, app="runlens-tests")
    yield s
    s.stop()


@pytest.fixture
def tmp_root():
    import tempfile

    return tempfile.mkdtemp(prefix="runlens-test-")
