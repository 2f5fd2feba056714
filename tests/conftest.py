from __future__ import annotations

import pytest

from tests.support import local_session


@pytest.fixture(scope="session")
def spark():
    return local_session()


@pytest.fixture
def many_slices(spark):
    """Keep range partitions apart, so that a key of a small fixture spans several tasks."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield spark
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


