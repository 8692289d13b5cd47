import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n_words int, label string, size int, shard int, word string, comp long"


def prose(rng, n, words="the of and thin eron ing hat ble stre ound tion ver mit license".split()):
    return " ".join(rng.choice(words) + rng.choice(["", "", "er", "ing", "s"]) + str(rng.randint(0, 40)) * (rng.random() < 0.3) for _ in range(n))


@pytest.fixture(scope="session")
def texts():
    """(doc_id, text): prose, copies, near copies, nulls, blanks, one very long text, repeated rows and null ids."""
    rng = random.Random(5)
    rows = [(i, prose(rng, rng.randint(5, 160))) for i in range(60)]
    base = prose(rng, 120)
    rows += [(100 + i, base) for i in range(25)]  # exact copies
    for i in range(25):  # near copies
        words = base.split()
        for _ in range(rng.randint(1, 3)):
            words[rng.randrange(len(words))] = f"edit{rng.randint(0, 999)}"
        rows.append((200 + i, " ".join(words)))
    rows += [(300, None), (301, ""), (302, " \n\t "), (303, "one"), (304, "one two"), (305, "ONE Two"), (306, "!!! ... ###"), (307, "Ünïcödé ﬁ K ΣΑΣ 日本 語"), (308, "\x1c a\x1cb")]
    rows += [(400, prose(rng, 30_000)), (401, "word " * 5000), (402, ("same line here\n") * 30)]
    rows += [(0, rows[0][1]), (0, rows[0][1]), (None, base), (None, None), (None, "lonely text of null id")]
    return rows


@pytest.fixture(scope="session")
def docs(spark, texts):
    extra = [(i, t, "en" if (i or 0) % 2 else None, "src0", len(t) if t else 0, 1, "x", 2, 3, "w", 4) for i, t in texts]
    return spark.createDataFrame(extra, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)
