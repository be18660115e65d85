import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, fold int, start long"


@pytest.fixture(scope="session")
def make(spark):
    """Documents with extra columns whose names clash with the operators' own."""

    def docs(rows):
        return spark.createDataFrame([(i, t, "en", "s", len(t or ""), 1.0, 2, 3) for i, t in rows], SCHEMA)

    return docs


WORDS = "the quick brown fox jumps over a lazy dog while seven wizards brew odd potions near frozen lakes and hum".split()


def prose(seed: int, n: int) -> str:
    import random

    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + str(r.randint(0, 400)) for _ in range(n))


#: Null, empty, blank, ties, repeats, non-ASCII white space, special strings, one long text.
EDGE = [(1, None), (2, ""), (3, " \n\t "), (4, "Hello  world"), (5, "Hello  world"), (5, "Hello  world"), (6, "naïve café  x"), (7, "a <|endoftext|> b"), (8, prose(1, 6000)), (9, "one two three"), (None, "no id")]
