from __future__ import annotations

import sys
from datetime import datetime
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from pricetide.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = build_session(
        "tests",
        "local[8]",
        **{
            "spark.sql.shuffle.partitions": "4",
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
            "spark.driver.memory": "4g",
            "spark.checkpoint.dir": str(tmp_path_factory.mktemp("checkpoints")),
        },
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def make(spark):
    """DataFrame from tuples; date texts become UTC timestamps."""

    def build(rows, schema):
        moments = [i for i, part in enumerate(schema.split(",")) if part.split()[-1] == "timestamp_ntz"]
        fixed = [
            tuple(datetime.fromisoformat(v) if i in moments and v is not None else v for i, v in enumerate(row))
            for row in rows
        ]
        return spark.createDataFrame(fixed, schema)

    return build
