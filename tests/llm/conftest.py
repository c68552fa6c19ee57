import random

import pytest

WORDS = "the of and stone river light garden window paper mountain silver quiet morning bridge yellow market winter ocean candle forest letter music garden2 thread basket copper harbor velvet lantern meadow".split()


def prose(seed, n):
    """Made-up sentences of n words."""
    r, out = random.Random(seed), []
    for k in range(n):
        w = r.choice(WORDS) + r.choice(["", "", "s", "ing", "ed", str(r.randrange(99))])
        out.append(w + r.choice(["", "", "", "", ",", ".", ".\n"]))
    return " ".join(out)


def edited(text, every):
    """The text with one word changed in ``every``."""
    w = text.split(" ")
    return " ".join(x if i % every else f"changed{i}" for i, x in enumerate(w))


CLASHING = ["key", "block", "node", "id", "a", "tokens", "score", "edited"]


def corpus():
    """(doc_id, text) rows: copies, near copies, passages, hostile rows."""
    passage = prose(900, 60)
    rows = [(i, prose(i, 30 + 13 * i)) for i in range(20)]
    rows += [(20, rows[3][1]), (21, rows[3][1]), (22, edited(rows[5][1], 60)), (23, edited(rows[15][1], 40)), (24, edited(rows[15][1], 9))]
    rows += [(30 + i, f"{prose(300 + i, 40)} {passage} {prose(400 + i, 30)}") for i in range(6)]
    rows += [(40, None), (41, ""), (42, " \n\t "), (43, "one two three"), (44, "One two  three"), (45, "x"), (46, "x " * 4000), (47, prose(47, 6000)), (48, "é" * 3000), (49, "\U0001f600 ß ÄÖ é́ a\x1cb")]
    return rows


@pytest.fixture(scope="session")
def docs(spark):
    """The corpus with the columns of documents and some that clash."""
    rows = [(i, t, ["en", "de", None][i % 3], f"src{i % 4}", None if t is None else len(t)) for i, t in corpus()]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").repartition(3)
    from pyspark.sql import functions as F

    return df.withColumns({c: F.lit("extra") for c in CLASHING}).cache()


@pytest.fixture(scope="session")
def empty(docs):
    return docs.where("false")


@pytest.fixture(scope="session")
def texts():
    return dict(corpus())
