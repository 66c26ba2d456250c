from __future__ import annotations

import os
import sys
import tempfile

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = os.pathsep.join([ROOT, os.environ.get("PYTHONPATH", "")])

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    from sigspark.session import get_session

    folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    return get_session(8, "tests", spark__checkpoint__dir=f"file://{folder}/shared", spark__local__dir=f"{folder}/local", spark__sql__warehouse__dir=f"{folder}/warehouse")


@pytest.fixture(scope="session")
def sf_dir():
    return SF_DIR
