import pytest

from fathom.llm.queries import vocabulary


@pytest.fixture(scope="session")
def documents(spark):
    """Edge cases: nulls, empty and long texts, ties, repeated rows and clashing columns."""
    rng = __import__("random").Random(3)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 6)))
    base = " ".join(word() for _ in range(80))
    rows = [(1, base), (2, base), (3, base + " tail"), (4, ""), (5, None), (6, "  \n\t "), (7, "One two"), (7, "One two"), (None, "no id here"), (8, " ".join(word() for _ in range(30_000))), (9, "Ünïcödé — straße x  y\n\n\nz"), (10, base.upper())]
    rows += [(20 + k, " ".join(word() for _ in range(rng.randint(1, 300)))) for k in range(40)]
    return spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t), 0.5, [1]) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long, score double, spans array<int>")


@pytest.fixture(scope="session")
def tokenizer():
    return vocabulary()


@pytest.fixture(scope="session")
def empty(documents):
    return documents.limit(0)
