import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF_SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from groupcast.session import local_session

    folder = f"file://{tmp_path_factory.mktemp('checkpoints')}"
    s = local_session(cpus="*", shuffle_partitions=8, app="groupcast-tests", checkpoint_dir=folder)
    yield s
    s.stop()
