import sys
import tempfile
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from braidgraph.session import local_session  # noqa: E402
from braidgraph.workload.fixtures import VOCABULARY  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session("tests", cores=4, partitions=4)
    session.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="braidgraph-", dir="/tmp"))
    yield session
    session.stop()


@pytest.fixture(scope="session")
def voc():
    return VOCABULARY
