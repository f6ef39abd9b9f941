import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def make(spark, rows, schema=SCHEMA):
    return spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t)) for i, t in rows], schema)


@pytest.fixture(scope="session")
def words():
    rng = random.Random(3)
    return ["".join(rng.choice(["th", "er", "on", "an", "re", "he", "in", "ed"]) for _ in range(rng.randint(1, 4))) for _ in range(600)]


@pytest.fixture(scope="session")
def corpus(words):
    """Prose with exact and near copies, shared passages and lines, and odd cases."""
    rng = random.Random(5)
    sentence = lambda n: " ".join(rng.choice(words) for _ in range(n))
    passage, line = sentence(60), sentence(12)
    docs = []
    for i in range(120):
        kind = i % 10
        text = "\n".join(sentence(rng.randint(5, 40)) + "." for _ in range(rng.randint(1, 6)))
        if kind == 1 and docs:
            text = rng.choice(docs)
        elif kind == 2 and docs:
            w = rng.choice(docs).split(" ")
            w[rng.randrange(len(w))] = rng.choice(words)
            text = " ".join(w)
        elif kind == 3:
            text = f"{text} {passage}\n{sentence(9)}"
        elif kind == 4:
            text = f"{line}\n{text}\n{line} {rng.choice(words)}"
        docs.append(text)
    odd = ["", "   ", "\n\n", "one", "one two", "The Cat sat", "the cat SAT", "été x ☃ \U0001d11e", "a b c " * 400, ("x" * 30 + " ") * 50, "tab\tand\x0bvt\x0cff\rcr"]
    return [(3 * i + 1, t) for i, t in enumerate(docs + odd + [None])]


@pytest.fixture(scope="session")
def docs(spark, corpus):
    return make(spark, corpus).cache()


@pytest.fixture(scope="session")
def empty(spark):
    return make(spark, [])


@pytest.fixture(scope="session")
def clashing(spark, corpus):
    """Repeated rows, null ids, and columns named as the operators' own."""
    rows = [*corpus[:30], *corpus[:3], (None, "null id text here"), (None, None)]
    df = make(spark, rows)
    for name in ("id", "fp", "h", "line", "w", "t", "key", "n", "y", "score", "sequence_id", "component_id", "start", "r", "s"):
        df = df.withColumn(name, df["lang"])
    return df
