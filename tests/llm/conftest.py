import random
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parent))
# Tests of the folder above import it from "conftest", which is this file where both are collected.
from llm_classes import DATA  # noqa: E402, F401

SYLLABLES = "an ber ca do en fi gu ha is jo ka lu mi no or pa qui ro sa te ur ve wo xi yo zu".split()


def words(r: random.Random, n: int) -> list[str]:
    return ["".join(r.choice(SYLLABLES) for _ in range(r.randint(1, 4))) for _ in range(n)]


@pytest.fixture
def make():
    """Seeded prose: make(n) gives a text of n words."""
    r = random.Random(3)
    return lambda n: " ".join(words(r, n))


@pytest.fixture
def documents(spark):
    def build(rows, schema="doc_id long, text string, lang string, source string, n_chars long"):
        return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], schema)

    return build

