import datetime

import pytest

WORDS = "the old river runs below a stone bridge where people wait for boats and sing quiet songs about rain harvest winter roads markets lanterns".split()


def prose(n, seed=0):
    """n words in an order that the seed decides; no long stretch repeats."""
    out, x = [], seed * 7919 + 13
    for i in range(n):
        x = (x * 1103515245 + 12345) % (1 << 31)
        out.append(WORDS[(x >> 8) % len(WORDS)] + str((x >> 16) % 97))
    return " ".join(out)


@pytest.fixture(scope="session")
def text():
    return prose


@pytest.fixture(scope="session")
def docs(spark):
    """A function that makes a documents table from texts, with clashing extra columns."""

    def make(texts, lang="en"):
        rows = [(i, t, lang, "s", 0, "x", 1, 2, 3, datetime.date(2024, 1, 1)) for i, t in enumerate(texts)]
        return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, keep_id string, n long, head long, row_id long, token date")

    return make

