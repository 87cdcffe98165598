import random

import pytest


def texts(seed: int = 0, n: int = 60) -> list[str | None]:
    """Small odd texts: near and exact copies, shared passages, empty, null, short and long ones."""
    rng = random.Random(seed)
    vocabulary = [f"{a}{b}" for a in ("ka", "lo", "mi", "Né", "ru") for b in ("t", "s.", "", "vo", "x,")]
    words = lambda k: [rng.choice(vocabulary) + str(rng.randrange(40)) for _ in range(k)]
    passage = " ".join(words(25))
    out: list[str | None] = [None, "", " \n\t", "one", "one", "three short words", "THREE  short\twords"]
    while len(out) < n:
        base = words(rng.choice([4, 5, 6, 20, 60, 200]))
        out.append(" ".join(base))
        for _ in range(rng.randrange(3)):
            copy = list(base)
            for _ in range(max(1, len(copy) // 50)):
                copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            out.append(" ".join(copy))
        if rng.random() < 0.4:
            out.append(f"{' '.join(words(30))}\n{passage}\n{' '.join(words(5))}")
    return out


@pytest.fixture(scope="session")
def odd_texts():
    return texts()


@pytest.fixture(scope="session")
def docs(spark, odd_texts):
    rows = [(i, t, ("en", "fr", None)[i % 3], f"s{i % 4}" if i % 7 else None, len(t or "")) for i, t in enumerate(odd_texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3)


@pytest.fixture(scope="session")
def none(docs):
    return docs.limit(0)
