import random

import pytest

LONG = " ".join(f"word{i % 977} and" for i in range(20_000))


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls, empty and very long texts, ties, repeated rows, and columns that clash with those of the operators."""
    rng = random.Random(5)
    base = [" ".join(rng.choice("alpha beta gamma delta eta theta iota kappa lambda mu nu xi pi rho tau phi".split()) for _ in range(120)) for _ in range(12)]
    texts = [None, "", " \n\t ", "one", "one two three four", "!!! ???", LONG, LONG, *base, base[0], base[0] + " extra", base[1].upper(), "a\x00b퟿é ü\U0001f600 c", None, ""]
    rows = [(None if i == 4 else i if i != 9 else 8, t, "x", i, "kept", True) for i, t in enumerate(texts)]
    rows.append(rows[-3])
    return spark.createDataFrame(rows, "doc_id long, text string, source string, n_words int, `hits.x` string, `row` boolean")


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.where("false")
