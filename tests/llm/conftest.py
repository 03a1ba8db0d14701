import random

import pytest

from framewright.llm.common import shared_dir

EXTRA = "block int, id string, text_ string, sid long, kept boolean, n_tokens long, shard string, slot string, ids string, n_chars long, source string, rest string, copy int, size int"


def words(rng, n, vocabulary=4000):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


@pytest.fixture(scope="session")
def edge_rows():
    """(doc_id, text): nulls, empty and white, ties, repeated rows, copies, near copies, shared passages, runs, a very long text."""
    rng = random.Random(7)
    base = [words(rng, rng.randrange(60, 300)) for _ in range(12)]
    passage = words(rng, 60)
    texts = [None, "", " \n\t ", "one", "one two three", "ONE two three", *base]
    texts += [base[0], base[0], base[1] + " extra", base[2].replace("w1", "W1"), words(rng, 30) + " " + passage + " " + words(rng, 40), passage + " " + words(rng, 40)]
    texts += ["a " * 200, "a b " * 150, base[3] + " " + base[3], words(rng, 12_000, 500), "x" * 70_000, "é漢 😀 <|endoftext|> ▁ </s>[INST] \\ & 12 " * 9]
    rows = list(enumerate(texts))
    for k in range(6):
        w = base[4].split()
        w[rng.randrange(len(w))] = f"new{k}"
        rows.append((100 + k, " ".join(w)))
    rows += [(500, base[5]), (500, base[5]), (500, base[6]), (None, base[7]), (None, None), (None, words(rng, 80))]
    return rows


@pytest.fixture(scope="session")
def edge_docs(spark, edge_rows):
    """The rows with further columns whose names the operators use too."""
    shared_dir(spark)
    df = spark.createDataFrame(edge_rows, "doc_id long, text string")
    for c in EXTRA.split(", "):
        name, kind = c.split()
        df = df.selectExpr("*", f"cast(null as {kind}) as {name}")
    return df.repartition(3).cache()


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], "doc_id long, text string")
