from __future__ import annotations

import os
import random

import pytest

# Tasks import the package from here, wherever the tests are started.
os.environ["PYTHONPATH"] = os.pathsep.join(
    [os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))), os.environ.get("PYTHONPATH", "")]
)

SF = "/root/testdata/sf0.001"
WORDS = "the and of river stone light walks under morning glass paper wind house quiet door seven green".split()
# Extra columns carry names that the operators use themselves.
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score int, h string, words int, row int, text_hash int, doc int, `a.b` int"


def prose(seed: int, n: int) -> str:
    rnd = random.Random(seed)
    return " ".join(rnd.choice(WORDS) + str(rnd.randint(0, 99)) for _ in range(n))


def edge_rows() -> list[tuple]:
    texts = [
        (1, prose(1, 60)), (2, None), (3, ""), (4, " \t\n "), (5, "word"), (6, prose(1, 60)), (7, prose(7, 9000)),
        (8, "x\ty\x0bz " * 40), (9, "línea única\n\n" + prose(3, 30) + "\nlínea única"), (9, prose(9, 40)), (10, prose(10, 40)),
        (10, prose(10, 40)), (None, prose(12, 40)), (None, None), (11, "ſK password: hunter22 \U0001f600 a@b.co \U0001f600 +49 170 1234567"),
        (12, "a" * 5000), (13, "4111 1111 1111 1111 and 10.0.0.1 or 300.1.1.1 and 1.2.3.4.5"), (14, "<|endoftext|> a  b <|startoftext|>c"),
    ]
    return [
        (i, t, None if n % 5 == 0 else "en" if n % 2 else "de", "s", None if t is None else len(t), n, "h", n, n, n, n, n)
        for n, (i, t) in enumerate(texts)
    ]


@pytest.fixture(scope="session")
def edge(spark):
    return spark.createDataFrame(edge_rows(), SCHEMA)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="session")
def labels(spark):
    return spark.read.parquet(f"{SF}/labels.parquet")


def as_set(df):
    return sorted(map(tuple, df.collect()), key=repr)
