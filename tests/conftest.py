import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from sessionrec.sources.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session("4", partitions=4, memory="6g")
    session.conf.set("spark.sql.dataFrameQueryContext.enabled", "false")
    return session


@pytest.fixture(scope="session")
def log(spark):
    """Hand-written events: one event, repeats, equal seconds, no clicks, cart only."""
    rows = [
        (1, 10, 100, 0, 1),
        (2, 10, 100, 0, 2),
        (2, 10, 160, 1, 3),
        (2, 11, 200, 0, 4),
        (2, 10, 300, 2, 5),
        (3, 12, 500, 0, 6),
        (3, 13, 500, 0, 7),
        (4, 14, 100, 1, 8),
        (4, 15, 200, 2, 9),
        (5, 16, 100, 1, 10),
    ]
    from sessionrec.sources.events import EVENT_SCHEMA

    return spark.createDataFrame(rows, EVENT_SCHEMA)


@pytest.fixture(scope="session")
def sf():
    return "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def train(spark, sf):
    from sessionrec.sources.fixtures import train_events
    from sessionrec.sources.stages import materialize

    return materialize(train_events(spark, sf), "test-train")
