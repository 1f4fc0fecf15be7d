import random

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, block int, shard string"


@pytest.fixture(scope="session")
def corpus():
    """Rows with copies, near copies, shared passages, nulls, empty and one long text, repeated rows."""
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 7)))
    text = lambda n: " ".join(word() for _ in range(n))
    base, passage = text(120), text(60)
    rows = []
    for i in range(150):
        kind = i % 10
        if kind == 0:
            w = base.split()
            for _ in range(rng.randint(0, 3)):
                w[rng.randrange(len(w))] = word()
            t = " ".join(w)
        elif kind == 1:
            t = text(30) + "\n" + passage + "\n" + text(20)
        elif kind == 2:
            t = "  Common Line of the Corpus \t\n" + text(20) + "\ncommon line of the corpus"
        elif kind == 3:
            t = base
        elif kind == 4:
            t = rng.choice([None, "", " ", "one", "a b c d", "a b c d e", "A b C d e", "\n\n", "z" * 500])
        else:
            t = text(rng.randint(1, 200))
        rows.append((i, t, "en", f"s{i % 3}", len(t or ""), 1, "x"))
    rows.append((200, " ".join([text(4000), base, text(3000), "ab " * 900]), "en", "s0", 0, None, None))
    rows += [rows[3], rows[3], (None, base, None, None, None, None, None), (None, passage, None, None, None, None, None), (None, None, None, None, None, None, None), (7, "clashing id " + passage, "en", "s", 1, 1, "y")]
    return rows


@pytest.fixture(scope="session")
def docs(spark, corpus):
    return spark.createDataFrame(corpus, DOCS).repartition(5).persist()


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], DOCS)
