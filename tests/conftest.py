import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from phrasedex.session import get_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    s = get_session("local[4]", app="phrasedex-tests", shuffle_partitions=4, extra={"spark.driver.memory": "4g"})
    s.sparkContext.setLogLevel("ERROR")
    if not s.sparkContext.getCheckpointDir():
        # Tests only: no cluster folder is configured, so use a local one.
        s.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="phrasedex-test-ckpt-"))
    yield s


SF0001 = "/root/testdata/sf0.001"

FIXTURE_DOC = (
    '<doc id="12" url="http://x?curid=12" title="Civil War" nonfiltered="1" dbindex="0">\n'
    "Civil War\n\nCivil war fighting, foo-bar\n"
)
