import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, fp long, rng int, key string"


def sentences(rng, words, n):
    return " ".join(rng.choice(words) for _ in range(n))


def corpus():
    """Rows with nulls, empty, blank and very long texts, ties, repeated rows, copies, and columns whose names clash."""
    rng = random.Random(5)
    en = "the of and that with other tion ing from there house water".split()
    de = "der die das und nicht über schön zwischen haben werden straße".split()
    rows = []
    for i in range(60):
        lang = ("en", "de")[i % 2]
        text = sentences(rng, en if lang == "en" else de, rng.randint(5, 120))
        rows.append((i, text, lang, f"src{i % 3}"))
    base = sentences(rng, [f"w{k}" for k in range(400)], 900)
    rows += [(100 + i, base + f" tail{i}", "en", "src0") for i in range(12)]
    rows += [(200 + i, base, "en", "src0") for i in range(12)]
    rows += [(300, None, "en", None), (301, "", None, "src1"), (302, " \t\n", "en", "src1"), (303, None, None, None), (None, "a b c d", "en", "src2"), (None, None, None, None)]
    rows += [(304, "one", "en", "src1"), (304, "one", "en", "src1"), (304, "two words", "en", "src1"), (305, "É😀\n\n\nß ñ\x0b\x0cA", "de", "src1"), (306, "123 !! ??", "en", "src1")]
    rows += [(307, sentences(rng, en, 30_000), "en", "src2"), (308, "x" * 20_000, "en", "src2"), (-5, "negative id here", "en", "src2")]
    return [(d, t, lang, s, None if t is None else len(t), 7, 1, "k") for d, t, lang, s in rows]


@pytest.fixture(scope="session")
def rows():
    return corpus()


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(5)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)
