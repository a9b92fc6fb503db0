import random

import pytest

AWKWARD = [None, "", " ", "\n\t", "a", "é", "word", "one two", "日本語 テキスト", "123 456", "x" * 5000, "!!! ???", "a b" * 2000]


def prose(rng: random.Random, n: int) -> str:
    parts = ["the", "and", "ing", "er", "tion", "on", "re", "st", "ha", "ed", "wh", "ou", "le", "ti", "sh", "an"]
    return " ".join("".join(rng.choices(parts, k=rng.randint(1, 4))) for _ in range(n))


@pytest.fixture(scope="session")
def texts():
    """Prose, copies, near copies, shared passages, and awkward cases."""
    rng = random.Random(5)
    base = [prose(rng, rng.randint(5, 200)) for _ in range(60)]
    passage = prose(rng, 60)
    near = []
    for t in base[:10]:
        w = t.split()
        w[len(w) // 2] = "changed"
        near.append(" ".join(w))
    shared = [f"{prose(rng, 20)} {passage} {prose(rng, 20)}" for _ in range(8)]
    return base + base[:15] + near + shared + [base[0]] * 20 + AWKWARD + AWKWARD


@pytest.fixture(scope="session")
def docs(spark, texts):
    rows = [(i * 3 % 1009, t, "en" if i % 3 else "fr", "src", len(t or ""), 0.5, 7) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, rank double, bucket int").repartition(5)


@pytest.fixture(scope="session")
def empty(docs):
    return docs.where("false")
