import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row long, digest string, score double, content string"


def edge_rows():
    """Nulls, empty and very long texts, ties, repeated rows; and columns named as the operators name their own."""
    rng = random.Random(3)
    words = ["alpha", "beta", "gamma", "delta", "eps", "zeta"]
    sentence = lambda n: " ".join(rng.choice(words) + str(rng.randrange(50)) for _ in range(n))
    near = sentence(120)
    lines = "\n".join(sentence(6) for _ in range(12))
    texts = [
        (None, "no id"), (None, "no id"), (1, None), (2, ""), (3, ""), (4, "Same Text"), (5, "same text"), (5, "same text"), (6, "SAME TEXT"), (7, "éÉ"), (8, "ÉÉ"),
        (9, "long " * 60_000 + "end"), (10, near), (11, near + " one more"), (12, near.replace("alpha", "omega", 1)), (13, "a"), (14, "  two  spaces \n tail "),
        (15, lines), (16, "intro line here\n" + lines), (17, lines + "\nand an end"), (18, "word"), (None, None), (19, "x\ty z\r\nq"), (20, near.upper()),
    ]
    return [(i, t, None if k % 5 == 0 else "en", None if k % 4 == 0 else "src0", None, k, "d", 0.5, "c") for k, (i, t) in enumerate(texts)]


@pytest.fixture(scope="session")
def docs(spark, tmp_path_factory):
    """The edge rows as a stored table."""
    path = str(tmp_path_factory.mktemp("edge") / "documents.parquet")
    spark.createDataFrame(edge_rows(), SCHEMA).repartition(3).write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="session")
def empty(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("none") / "documents.parquet")
    spark.createDataFrame([], SCHEMA).write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="session")
def pairs():
    return [(r[0], r[1]) for r in edge_rows()]
