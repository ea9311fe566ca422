import os
import random
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
from tests_llm_prose import prose


@pytest.fixture(scope="session")
def documents(spark):
    """Prose with exact and near copies, nulls, empty and very long texts, repeated rows, and columns with odd names."""
    rng = random.Random(5)
    texts = [prose(rng, rng.choice([3, 40, 200])) for _ in range(30)]
    base = prose(rng, 120).split()
    for k in range(40):  # a family of near copies, some too far apart to be linked
        own = base.copy()
        for _ in range(k % 9):
            own[rng.randrange(len(own))] = prose(rng, 1)
        texts.append(" ".join(own))
    texts += [texts[0], texts[0].upper(), None, "", " \n\t", "one two", "One  TWO", prose(rng, 30_000), "a\x00b ñandú 日本 <|endoftext|> it's we'll"]
    rows = [(n, t, ("en", "de", None)[n % 3], ("s1", "s2", None, "hot", "hot")[n % 5], n if n % 4 else None, "x", n) for n, t in enumerate(texts)]
    rows += [rows[3], rows[3], (None, texts[5], "en", "s1", 1, "y", 2), (None, None, None, None, None, None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, size string, score long").repartition(4)


@pytest.fixture(scope="session")
def nothing(spark, documents):
    return spark.createDataFrame([], documents.schema)
