import random

import pytest

ODD_SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key string, pos int, row string, h string, size int"


def invented(rng, n, words=300):
    """``n`` words of an invented vocabulary."""
    return [f"w{int(rng.paretovariate(0.7)) % words}" for _ in range(n)]


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in every column, empty and long texts, ties, repeated rows, and columns with clashing names."""
    rng = random.Random(5)
    body = " ".join(invented(rng, 60))
    long = "\n".join(" ".join(invented(rng, 40)) for _ in range(400))
    texts = [None, "", " \t\n ", "one", "one two", body, body, body + " end", "x" * 5000, long, "a\x0bb\fc\rd e",
             "ünï — ▁ 日本 𐍈", "\n".join(["same line here again now"] * 4), "$$$ ### %%% &&& *** ||| <<< >>> $$ ##"]
    rows = [(i, t, "en", f"src{i % 3}", len(t or ""), "k", 1, "r", "h", 2) for i, t in enumerate(texts)]
    rows += [rows[5], rows[5], (None, body, None, None, None, None, None, None, None, None),
             (None, None, None, None, None, None, None, None, None, None)]
    return spark.createDataFrame(rows, ODD_SCHEMA)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], ODD_SCHEMA)
