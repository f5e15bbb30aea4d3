import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def corpus(seed: int = 1, n: int = 60) -> list[tuple]:
    """Random prose with copies, near copies, shared passages, repeats, odd rows."""
    rng = random.Random(seed)
    vocab = ["the", "of", "and", "la", "de", "und", "die", *("".join(rng.choice(["th", "er", "on", "é", "ou", "an", "ß", "ti"]) for _ in range(rng.randrange(2, 6))) for _ in range(400))]

    def prose(k: int) -> str:
        out = []
        for i in range(k):
            w = rng.choice(vocab[:7]) if rng.random() < 0.3 else rng.choice(vocab)
            out.append(w.capitalize() if i % 9 == 0 else w + ("." if i % 9 == 8 else ""))
        return " ".join(out) + "."

    shared = [prose(60) for _ in range(3)]
    texts: list[str | None] = []
    for i in range(n):
        t = "\n".join(prose(rng.randrange(5, 60)) for _ in range(rng.randrange(1, 5)))
        if i % 6 == 5:
            t += " " + rng.choice(shared) + " " + prose(10)
        if i % 9 == 8:
            t = texts[rng.randrange(len(texts))] or t
        if i % 11 == 10:
            words = (texts[rng.randrange(len(texts))] or t).split(" ")
            words[rng.randrange(len(words))] = "changed"
            t = " ".join(words)
        texts.append(t)
    texts += [None, "", "  \n\t", "one", "one two", "The. The.", "a b c\n\na b c", " ".join(["same"] * 500), "É" * 5000, "x" + "\n" * 300 + "y", prose(20_000)]
    return [(i, t, "en", f"s{i % 3}", len(t or "")) for i, t in enumerate(texts)]


@pytest.fixture(scope="session")
def rows():
    return corpus()


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def odd(spark):
    """Null ids, repeated rows, and columns with names that operators use."""
    rows = [(None, "the of and it is so", "x", 1, 2, 3), (None, None, "x", 1, 2, 3), (5, "a b " * 40, None, 1, None, 3), (5, "a b " * 40, None, 1, None, 3), (7, "a b " * 40, "z", 1, 2, 3), (7, "other text for the id", "z", 1, 2, 3)]
    return spark.createDataFrame(rows, "doc_id long, text string, mark string, n long, fp long, id long")


@pytest.fixture(scope="session")
def empty(docs):
    return docs.where("false")
