from __future__ import annotations

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parent.parent))

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from tidewell.session import session

    s = session("local[4]", spark_checkpoint_dir=str(tmp_path_factory.mktemp("shared")), spark_sql_shuffle_partitions="4", spark_driver_memory="4g", spark_ui_enabled="false", spark_ui_showConsoleProgress="false")
    s.sparkContext.setLogLevel("OFF")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def folder():
    return DATA
