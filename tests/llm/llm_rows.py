import random

import pytest

from sealdex.llm import tables

SF_DIR = "/root/testdata/sf0.001"
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lam mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega".split()


@pytest.fixture(scope="session")
def shipped(spark):
    tables.ship(spark)
    return spark


def prose(draw: random.Random, n: int) -> str:
    return " ".join(draw.choice(WORDS) + draw.choice(["", "", ",", "."]) + str(draw.randrange(50)) for _ in range(n))


@pytest.fixture(scope="session")
def odd_rows():
    """(doc_id, text): null, empty, blank, tiny, repeated, special strings, accents, very long."""
    draw = random.Random(5)
    base = prose(draw, 120)
    return [
        (0, None), (1, ""), (2, " \n\t "), (3, "one"), (4, "one two three four"), (5, base), (6, base), (6, base), (7, base.upper()),
        (8, base + " tail"), (9, "<|endoftext|> <|startoftext|>x it's we'LL \x1c a\x1fb c É é ﬁ 中文字 🙂🙂 ΑΣ Σ"), (10, prose(draw, 20_000)),
        (11, prose(draw, 7)), (12, "a b c d e f"), (None, base), (13, "x" * 3000), (14, "!!! ... '' 's"),
    ]
