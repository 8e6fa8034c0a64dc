from __future__ import annotations

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark():
    from millrace.session import local_session

    s = local_session("tests", 4)
    s.conf.set("spark.sql.shuffle.partitions", "4")
    return s


@pytest.fixture(scope="session")
def sf():
    path = "/root/testdata/sf0.001"
    if not Path(path).exists():
        pytest.skip("no test tables")
    return path
