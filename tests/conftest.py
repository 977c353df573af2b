from __future__ import annotations

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from rolloom.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    s = local_session(4, "3g", **{"spark.sql.shuffle.partitions": "3", "spark.sql.adaptive.coalescePartitions.enabled": "true"})
    yield s
    s.stop()
