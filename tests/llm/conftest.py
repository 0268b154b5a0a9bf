import random

import pytest

from pinchgraph.llm.common import prepare

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def llm(spark):
    return prepare(spark)


@pytest.fixture(scope="session")
def docs_of(llm):
    """Rows of documents from (doc_id, text) pairs, with columns whose names clash with those the operators use."""
    def make(pairs):
        rows = [(i, t, "en", "src0", len(t or "")) for i, t in pairs]
        df = llm.createDataFrame(rows, DOCS)
        from pyspark.sql import functions as F
        for name in ("size", "shard", "slot", "fp", "start", "length", "score", "block", "_class", "rank", "_rank", "sequence_id", "spans", "key"):
            df = df.withColumn(name, F.lit("x"))
        return df

    return make


@pytest.fixture(scope="session")
def prose():
    """prose(n, seed): n random words of a small made-up language."""
    def make(n, seed):
        rng = random.Random(seed)
        parts = ["ka", "lo", "mi", "tur", "ves", "on", "pel", "dra", "shi", "nu", "ost", "em"]
        return " ".join("".join(rng.choice(parts) for _ in range(rng.randint(1, 4))) for _ in range(n))

    return make


#: Null ids and texts, empty and blank texts, a very long text, equal rows and equal ids.
@pytest.fixture(scope="session")
def odd(prose):
    return [(1, None), (2, ""), (3, " \n\t"), (4, "a"), (5, "a"), (5, "a"), (5, "b c"), (None, "null id"), (None, None), (6, prose(60_000, 1)), (7, "ÀÉ ſ " * 40), (8, "x" * 30_000), (9, prose(60_000, 1))]
