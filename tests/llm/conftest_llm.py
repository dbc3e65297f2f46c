"""Small tables with every awkward case: nulls, empty and long texts, ties, repeated rows, extra columns whose names clash."""

import pytest

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega".split()


def prose(seed: int, n: int) -> str:
    """``n`` words of a reproducible text; different seeds share no long passage."""
    out, state = [], seed * 7919 + 13
    for _ in range(n):
        state = (state * 1103515245 + 12345) % 2**31
        out.append(WORDS[(state >> 8) % len(WORDS)] + str((state >> 16) % 97))
    return " ".join(out)


ODD = [
    (101, None),
    (102, ""),
    (103, "   \n\t "),
    (104, "один два три"),
    (105, "😀 ß naïve café 日本語 ９"),
    (106, "a\x0bb\x0cc\r\nd"),
    (None, "a row without an id"),
    (107, "same text twice here"),
    (107, "same text twice here"),
]


@pytest.fixture(scope="session")
def odd(spark):
    rows = [(i, t, "x", 1, "clash", 2) for i, t in [*ODD, (108, prose(5, 60_000))]]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, score int, key string, node int")


@pytest.fixture(scope="session")
def none(odd):
    return odd.limit(0)
