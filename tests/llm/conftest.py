from __future__ import annotations

import random

import pytest

WORDS = "the of and water house river stone light green walk under over small great night morning paper table window garden".split()


def prose(rng: random.Random, n: int) -> str:
    return " ".join(rng.choice(WORDS) + rng.choice(["", "s", "ly", "er", "ing"]) for _ in range(n))


SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture(scope="session")
def corpus():
    """Texts with exact and near copies, repeats, long and empty ones, by doc_id."""
    rng = random.Random(1)
    texts = [prose(rng, rng.choice([4, 30, 80, 200])) for _ in range(40)]
    texts += [texts[3], texts[7], texts[7]]
    for t in (texts[2], texts[5], texts[11]):
        for _ in range(3):
            w = t.split()
            w[rng.randrange(len(w))] = "changed"
            texts.append(" ".join(w))
    texts += ["", "one", "two words", "two words", "ÉTÉ été Été", prose(rng, 3000), "a b c", "A B C", "... 123 !!!"]
    return texts


@pytest.fixture(scope="session")
def docs(spark, corpus):
    rows = [(i, t, ["en", "fr", None][i % 3], f"s{i % 4}", len(t)) for i, t in enumerate(corpus)]
    return spark.createDataFrame([*rows, (900, None, "en", "s1", 0), (None, "no id here at all, none", "en", None, 5)], SCHEMA)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def odd(docs):
    """The documents twice, with extra columns of clashing names."""
    from pyspark.sql import functions as F

    return docs.unionAll(docs).withColumns({c: F.lit("x") for c in ("h", "n", "node", "part", "score", "bucket", "comp", "kept", "topic", "tokens", "start", "pos", "shard")})
