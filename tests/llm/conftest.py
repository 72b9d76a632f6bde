import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, k long, t string, found string, kept boolean, h string"


def _documents():
    """Texts with nulls, empty and long ones, copies, near copies, shared passages and lines."""
    rnd = random.Random(7)
    vocab = ["".join(rnd.choice("abcdefghijklmnopé") for _ in range(rnd.randint(1, 9))) for _ in range(400)]
    prose = lambda n: " ".join(rnd.choice(vocab) for _ in range(n))
    passage, line, item = prose(90), "Shared LINE " + prose(9), prose(14)
    texts = [None, "", " \n\t", "one", "a b c d", "\n\n" + prose(20) + "\r\n", prose(6000)]
    for i in range(36):
        body = prose(rnd.randint(30, 160))
        if i % 3 == 0:
            body = f"{body} {passage} {prose(40)}"
        if i % 4 == 0:
            body = f"{body}\n  {line if i % 8 else line.upper().replace('É', 'é')}\t\n{prose(5)}"
        if i % 6 == 0:
            body += " " + item.upper().replace("É", "é") + ", end"
        texts.append(body)
    base = prose(300)
    texts += [base, base, base]
    for _ in range(6):
        words = base.split(" ")
        words[rnd.randrange(300)] = "changed"
        words[rnd.randrange(300)] = "again"
        texts.append(" ".join(words))
    texts += ["x" * 3000, "x" * 2999, "né " * 500, "<|endoftext|> end<|endoftext|>", "-- # $ | " * 30]
    rows = [(i * 3, t) for i, t in enumerate(texts)]
    return rows, item


@pytest.fixture(scope="session")
def corpus():
    rows, _ = _documents()
    return rows


@pytest.fixture(scope="session")
def items():
    _, item = _documents()
    words = item.split()
    return [(3, item), (12, " ".join(words[:11])), (5, "nowhere to be found at all in these texts, really, truly, never"), (7, None), (8, ""), (9, "x y z"), (10, "one")]


@pytest.fixture(scope="session")
def make(spark):
    """A documents table from (doc_id, text) pairs, with columns more whose names the operators use themselves."""

    def build(rows):
        data = [(d, t, "en", "web" if i % 3 else None, None, 1, "t", "f", True, "h") for i, (d, t) in enumerate(rows)]
        return spark.createDataFrame(data, SCHEMA).repartition(3)

    return build
