import random

import pytest

WORDS = ["the", "of", "and", "to", "Ab", "été", "naïve", "x1", "ß", "o'clock", "zu", "sie", "MIT", "deep,", "end."] + [f"w{i}" for i in range(60)]


def prose(rng, n):
    return " ".join(rng.choice(WORDS) if rng.random() < 0.7 else f"u{rng.randrange(10**6)}" for _ in range(n))


@pytest.fixture(scope="session")
def texts():
    """Texts with copies, near copies, shared passages, repeats, odd white space, nothing, and one that is long."""
    rng = random.Random(5)
    passage, license_ = prose(rng, 45), "Licensed under the MIT License. See cc-by-nc, and Apache License, Version 2.0!"
    out = [prose(rng, rng.randrange(1, 150)) for _ in range(60)]
    base = prose(rng, 120).split()
    for k in range(25):
        words = list(base)
        for _ in range(k % 6):
            words[rng.randrange(len(words))] = f"new{rng.randrange(1000)}"
        out.append(" ".join(words))
    out += [out[3]] * 4 + [f"{prose(rng, 10)} {passage} {prose(rng, 12)}" for _ in range(6)]
    out += [None, "", " \n\t ", "one", "one", "Two Words", "two words", prose(rng, 20) + " " + license_, license_ * 3, ("abc " * 50).strip(), passage + " " + passage, "a\u00a0b\u2003c \x0b d", "🎉 日本 テキスト " * 9]
    out.append(prose(rng, 6000) + " " + passage)
    return out


@pytest.fixture(scope="session")
def rows(texts):
    return list(enumerate(texts))


@pytest.fixture
def docs(spark, rows):
    """With columns that clash with those of operators, and partitions of uneven size."""
    return spark.createDataFrame([(i, t, "en", "s", 1, "mine", True) for i, t in rows], "doc_id long, text string, lang string, source string, n_words int, labels string, kept boolean").repartition(3, "source")


@pytest.fixture
def odd(spark):
    """Null ids, ids with two texts, rows twice."""
    a, b = " ".join(f"p{i}" for i in range(30)), " ".join(f"q{i}" for i in range(30))
    rows = [(None, a), (None, b), (1, a), (1, a), (1, b), (2, a + " " + b), (3, None), (3, None), (-4, b)]
    return spark.createDataFrame(rows, "doc_id long, text string")


@pytest.fixture
def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string")
