"""Small tables for the operators' tests."""

import random

LONG = "word " * 30_000 + "end"
DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"


def documents(spark, texts, ids=None):
    """A documents table of these texts, numbered from 1."""
    ids = ids or range(1, len(texts) + 1)
    return spark.createDataFrame([(i, t, "en", "src0", None if t is None else len(t)) for i, t in zip(ids, texts)],
                                 DOCUMENTS)


def prose(rng, n, vocabulary=60):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


def rng(seed=5):
    return random.Random(seed)
