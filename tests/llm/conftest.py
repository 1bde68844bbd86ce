import random

import pytest


def sentence(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


WORDS = "the of and is a ring stone über blend été water quick Brown fox, jumps over lazy dogs token ABC don't señor 12 x-y night day moon sun star".split()


def corpus():
    """(doc_id, text, source) rows: copies, near copies, nulls, empty and long texts, repeated rows."""
    rng = random.Random(3)
    rows = []
    for i in range(60):
        text = "\n".join(sentence(rng, rng.randint(1, 14)) for _ in range(rng.randint(1, 8)))
        rows.append((i, text, f"s{i % 4}" if i % 7 else None))
    for i in range(60, 80):
        words = rows[i - 60][1].split(" ")
        words[len(words) // 2] = "changed"
        rows.append((i, " ".join(words), "s0"))
    for i in range(80, 95):
        rows.append((i, rows[3][1] + " " * (i % 3), "s1"))
    rows += [(95, None, "s2"), (96, "", "s2"), (97, " \n\t ", None), (98, "one", "s9"), (99, "one two", "s9"), (100, sentence(rng, 9000), "s3"), (101, "a\u00a0b\u2003c İ Σς ñ\u0301 <|endoftext|> x", "s3"), (101, "a\u00a0b\u2003c İ Σς ñ\u0301 <|endoftext|> x", "s3")]
    return rows


@pytest.fixture(scope="session")
def docs(spark):
    """The corpus with extra columns whose names the operators use too."""
    schema = "doc_id long, text string, source string, size long, _id long, _p int, _t string, target double, id long, n int, label int"
    return spark.createDataFrame([(*r, 5, 6, 7, "t", 1.0, 9, 3, 4) for r in corpus()], schema)


@pytest.fixture(scope="session")
def none(spark, docs):
    return docs.where("false")
