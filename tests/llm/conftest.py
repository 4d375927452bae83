import os
import random
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def reasons_of(spark):
    """Records of the engine from (event_id, reason) pairs; event ids may be text or integers."""
    def build(rows, kind="string", extra=""):
        return spark.createDataFrame(rows, f"event_id {kind}, reason string{extra}")
    return build


@pytest.fixture()
def prose():
    """Deterministic sentences about clicks."""
    words = ("click device address user campaign burst shared many within window score flagged rule graph model seconds same the of and to in "
             "network interval entropy publisher blocked review medium critical country account young repeated ad").split()
    rng = random.Random(5)

    def make(n):
        return " ".join(rng.choice(words) for _ in range(n))
    return make
