from __future__ import annotations

import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pyspark.sql import SparkSession  # noqa: E402

from evlog.schema import ENVELOPE_SCHEMA  # noqa: E402

SMALL = "/root/testdata/sf0.001"
MEDIUM = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    session = (SparkSession.builder.master("local[*]")
               .config("spark.sql.shuffle.partitions", "8")
               .config("spark.ui.enabled", "false")
               .config("spark.sql.session.timeZone", "UTC")
               .getOrCreate())
    session.sparkContext.setLogLevel("ERROR")
    if not session.sparkContext.getCheckpointDir():
        session.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="evlog-test-cp-"))
    yield session
    session.stop()


@pytest.fixture()
def scratch():
    return tempfile.mkdtemp(prefix="evlog-test-")


def envelope_rows(spark, rows):
    """rows: (hub, partition_id, body bytes|str|None, offset, seq, enqueuedTime)."""
    data = []
    for hub, pid, body, off, seq, t in rows:
        if isinstance(body, str):
            body = body.encode()
        data.append((hub, pid, bytearray(body) if body is not None else None, off, seq, t, None, None))
    return spark.createDataFrame(data, ENVELOPE_SCHEMA)
