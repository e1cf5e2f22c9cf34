import json
import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path[:0] = [ROOT, os.path.dirname(os.path.abspath(__file__))]

from pollweave.session import local_session  # noqa: E402

DATA = "/root/testdata"


@pytest.fixture(scope="session")
def spark():
    session = local_session("pollweave-tests", cpus=8, partitions=4)
    yield session
    session.stop()


@pytest.fixture
def landing(tmp_path):
    """Write poll documents: ``put('status', 1000, {...})``; returns the folder."""

    class Landing:
        folder = str(tmp_path / "landing")

        def put(self, document, poll, body):
            path = os.path.join(self.folder, document, f"poll_ts={poll}")
            os.makedirs(path, exist_ok=True)
            text = body if isinstance(body, str) else json.dumps(body)
            with open(os.path.join(path, "doc.json"), "w", encoding="utf-8") as f:
                f.write(text)

    return Landing()
