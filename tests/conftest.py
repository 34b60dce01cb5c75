import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from innlytics.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    s = build_session("local[*]", 8)
    yield s


@pytest.fixture(scope="session")
def seed(spark):
    import seed as seed_mod
    return seed_mod.frames(spark, "A")


@pytest.fixture(scope="session")
def seed_b(spark):
    import seed as seed_mod
    return seed_mod.frames(spark, "B")


def rows(df, *cols):
    cols = cols or df.columns
    return [tuple(r[c] for c in cols) for r in df.collect()]
