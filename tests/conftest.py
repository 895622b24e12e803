import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from ledgerlens.session import checkpoint_dir, get_session

    s = get_session("local[4]", 4, app_name="ledgerlens-tests",
                    extra={"spark.ui.showConsoleProgress": "false", "spark.ui.enabled": "false"})
    s.sparkContext.setLogLevel("ERROR")
    checkpoint_dir(s)
    yield s


@pytest.fixture
def tmpdir_path():
    return tempfile.mkdtemp(prefix="ledgerlens-test-")


SF = "/root/testdata/sf0.001"
