import random

import pytest

SF = "/root/testdata/sf0.001"
DOC = "doc_id bigint, text string, lang string, source string, n_chars bigint, kind string, row string, fp bigint, component_id string, size string, spans string"


@pytest.fixture(scope="session")
def sf():
    return SF


@pytest.fixture(scope="session")
def edge(spark):
    """Documents with nulls, empty and very long texts, repeats, odd characters and columns with clashing names."""
    rng = random.Random(3)
    words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7))) for _ in range(300)]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    base = text(120)
    texts = [None, "", "   \n\t ", "x", "12 34 !!", "Für Äpfel ☃ 𝔘nicode", text(60_000), "a" * 100_000, "7" * 60_000, "\n" * 2000, base, base, base.upper(), base + " tail", text(30) + "\n" + base + "\n" + text(40), text(30) + "\n" + base + "\n" + text(25)]
    rows = [(i, t, "en" if i % 3 else None, None if i % 4 == 0 else f"s{i % 3}", len(t or ""), "k", "r", 1, "c", "s", "p") for i, t in enumerate(texts)]
    rows += [(None, base, "en", "s1", 1, None, None, None, None, None, None), (10, base, "en", "s1", 1, "k", "r", 1, "c", "s", "p"), (10, base, "en", "s1", 1, "k", "r", 1, "c", "s", "p")]
    return spark.createDataFrame(rows, DOC)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], DOC)
