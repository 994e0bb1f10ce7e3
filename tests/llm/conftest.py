from __future__ import annotations

import pytest
from cases import frame, texts


@pytest.fixture(scope="session")
def rows():
    return texts()


@pytest.fixture(scope="session")
def docs(spark, rows):
    return frame(spark, rows).repartition(3)


@pytest.fixture(scope="session")
def none(spark):
    return frame(spark, [])
