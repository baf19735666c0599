"""Fixtures of the training-data operators' tests; test modules import what they use."""
import random

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = [a + b for a in "the an in on er re ti st".split() for b in "da lo mi ne ru sa to vi".split()]


def rows(df, *cols):
    """Collected rows as tuples (of the given columns), sorted with nulls last."""
    got = (df.select(*cols) if cols else df).collect()
    return sorted((tuple(r) for r in got), key=lambda t: [(x is None, x if x is not None else 0) for x in t])


def sentence(rnd, n):
    return " ".join(rnd.choice(WORDS) for _ in range(n))


@pytest.fixture(scope="session")
def make_docs(spark):
    def make(rows, schema=DOCS):
        """Documents from (id, text) pairs."""
        return spark.createDataFrame([(i, t, "en", "s", len(t) if t is not None else None) for i, t in rows], schema)
    return make


@pytest.fixture(scope="session")
def odd_rows():
    """Null, empty, blank, very long, repeated and tied rows."""
    rnd = random.Random(7)
    long = "\n".join(sentence(rnd, 12) for _ in range(4000))
    return [(1, None), (2, ""), (3, "  \n\t "), (4, long), (5, "Same line here, and it is long enough."),
            (6, "same LINE here, and it is long enough."), (7, "Same line here, and it is long enough."),
            (7, "Same line here, and it is long enough."), (None, "only words"), (8, "x"), (9, "ÉCLAIR éclair"), (10, "éclair ÉCLAIR")]


@pytest.fixture(scope="session")
def clashing(spark):
    """Documents whose extra columns bear the names that operators use inside."""
    return spark.createDataFrame(
        [(1, "a b c d", 1, 2, "k"), (2, "A B C D", 3, 4, "k"), (3, None, 5, 6, None)],
        "doc_id long, text string, id long, fp long, digest string")
