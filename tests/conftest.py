from __future__ import annotations

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from roadstats.session import local_session  # noqa: E402

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = local_session("tests", cores="4")
    yield session
    session.stop()


@pytest.fixture
def rows(spark):
    """``rows([(..), ..], "a string, b int")`` as a DataFrame."""
    return lambda data, schema: spark.createDataFrame(data, schema)


@pytest.fixture
def accidents(spark):
    """Accidents from dicts; fields not given are NULL."""
    from roadstats import schema as S

    names = S.ENTITIES["incidenti"].names

    def make(*records: dict):
        data = [tuple(r.get(n) for n in names) for r in records]
        return spark.createDataFrame(data, S.ENTITIES["incidenti"])

    return make


@pytest.fixture
def children(spark):
    """Children of one entity from dicts."""
    from roadstats import schema as S

    def make(entity: str, *records: dict):
        names = S.ENTITIES[entity].names
        return spark.createDataFrame(
            [tuple(r.get(n) for n in names) for r in records], S.ENTITIES[entity]
        )

    return make
