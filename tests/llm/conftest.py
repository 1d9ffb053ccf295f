import random
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent))


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, chunk int, h1 string, kept string, weight double, score string"


def words(rng, n):
    return " ".join("".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(1, 6))) for _ in range(n))


def cases():
    """Copies, near copies, shared passages, short and long texts, empty and null ones, other spaces and alphabets."""
    rng = random.Random(5)
    base, passage = words(rng, 120), words(rng, 60)
    texts = [None, "", " \t\n", "one", "a b c", "Ünïcode grüße, straße! 世界 🎉", base, base, base.upper(), base + " tail", "head " + base]
    for _ in range(12):
        w = base.split()
        for i in rng.sample(range(len(w)), rng.randint(1, 4)):
            w[i] = "x" + w[i]
        texts.append(" ".join(w))
    texts += [f"{words(rng, 40)}\n{passage}\u00a0\u2003{words(rng, 30)}" for _ in range(6)]
    texts += [words(rng, n) for n in (3, 34, 35, 36, 200)] + ["ab " * 300, "z" * 900, words(rng, 4000), words(rng, 50) + " " + passage + " " + passage]
    return [(i, t, ["en", "de", None][i % 3], None if i % 7 == 0 else f"s{i % 4}", len(t or ""), i, "h", "k", 1.0, "s") for i, t in enumerate(texts)]


@pytest.fixture(scope="session")
def rows():
    got = cases()
    return got + [got[6], got[12]]  # repeated rows


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(5)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
