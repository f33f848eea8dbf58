from __future__ import annotations

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
PAGES = "page_id long, url string, html string"


@pytest.fixture(scope="session")
def docs(spark):
    def make(*texts, first=0, extra=""):
        """Documents numbered from `first`; a tuple gives its own id."""
        rows = []
        for k, t in enumerate(texts):
            i, t = t if isinstance(t, tuple) else (first + k, t)
            rows.append((i, t, "en", "s", None if t is None else len(t)))
        return spark.createDataFrame(rows, DOCS)

    return make


@pytest.fixture(scope="session")
def pages(spark):
    return lambda *rows: spark.createDataFrame(list(rows), PAGES)


@pytest.fixture(scope="session")
def prose():
    """Deterministic prose: `words(seed, n)` are n words that other seeds hardly share."""
    import random

    def words(seed: int, n: int) -> str:
        r = random.Random(seed)
        return " ".join("".join(r.choice("bcdfghlmnprst") + r.choice("aeiou") for _ in range(r.randint(2, 4))) for _ in range(n))

    return words
