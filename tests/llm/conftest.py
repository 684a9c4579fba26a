import random

import pytest

DOC = "doc_id long, text string, lang string, source string, n_chars long"
CLASH = "size string, key string, h string, fp string, p string, tail string, word string, toxicity string, __n string"


@pytest.fixture(scope="session")
def make_docs(spark):
    """Documents from (doc_id, text[, source]) rows, with extra columns whose names clash."""

    def make(rows, extra=True):
        full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s", None if r[1] is None else len(r[1])) for r in rows]
        extras = CLASH.count(",") + 1
        schema = f"{DOC}, {CLASH}" if extra else DOC
        return spark.createDataFrame([(*r, *["x"] * (extras if extra else 0)) for r in full], schema)

    return make


@pytest.fixture(scope="session")
def hostile():
    """Nulls, empty, very long, repeated rows and ids, shared passages, ties."""
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 6)))
    passage = " ".join(word() for _ in range(60))
    rows = [(i, " ".join(word() for _ in range(rng.randint(0, 80))), rng.choice(["a", "b", None])) for i in range(40)]
    rows += [(100 + i, f"{word()} {passage}\t{word()}", "a") for i in range(12)]
    rows += [(200, None, None), (201, "", "b"), (202, " \n\t ", "c"), (None, passage, None), (None, None, "a")]
    rows += [(203, "x" * 150_000, "long"), (204, "na " * 30_000, "long"), (205, "same text " * 20, "a")]
    rows += [(205, "same text " * 20, "a"), (205, "other text " * 20, "a"), (206, passage, "b"), (206, passage, "b")]
    return rows
