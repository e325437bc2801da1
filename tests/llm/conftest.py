import random

import pytest

WORDS = [a + b for a in ("ther", "ing", "ou", "en", "st") for b in ("ab", "le", "ti", "on", "er", "ha")]


def prose(rng, n):
    return " ".join(rng.choice(WORDS) + (".\n" if rng.random() < 0.05 else "") for _ in range(n))


#: Columns that clash with names operators use inside or return.
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept boolean, size long, _pattern string, id long, n long, h long, score double"


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls anywhere, empty and very long texts, ties, exact and near copies, repeated rows."""
    rng = random.Random(5)
    base = prose(rng, 300)
    words = base.split(" ")
    near = [" ".join(words[:k] + ["changed"] + words[k + 1 :]) for k in (10, 150)]
    far = " ".join(words[:100]) + " " + prose(rng, 400)
    texts = [None, "", "   \n\t", "a", "a b c", "a b c", "A b C", "a b c d", "a b c d", base, base, *near, far, prose(rng, 30_000), "x" * 200_000, "日本語 テスト 😀 ñß", "ab " * 400, *(prose(rng, rng.randrange(5, 200)) for _ in range(30))]
    rows = [(i, t, "en" if i % 3 else None, (None, "s1", "s2", "s1")[i % 4], len(t or ""), True, 7, "p", 1, 2, 3, 0.5) for i, t in enumerate(texts)]
    rows.append(rows[9])  # a repeated row
    rows.append((None, base, "en", "s1", 1, None, None, None, None, None, None, None))
    return rows


@pytest.fixture(scope="session")
def odd(spark, odd_rows):
    return spark.createDataFrame(odd_rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)
