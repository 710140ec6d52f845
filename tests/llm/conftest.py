import random

import pytest

WORDS = ("alpha bravo charlie delta echo foxtrot golf hotel india juliet kilo lima mike november oscar papa quebec romeo "
         "sierra tango uniform victor whiskey xray yankee zulu").split()


def prose(seed: int, words: int) -> str:
    own = random.Random(seed)
    out = []
    for _ in range(words):
        out.append("".join(own.choices("abcdefghijklmnopqrstuvwxyz", k=own.randint(2, 9))))
        if own.random() < 0.08:
            out[-1] += "." + ("\n" if own.random() < 0.3 else "")
    return " ".join(out).replace("\n ", "\n")


@pytest.fixture(scope="session")
def odd_rows():
    """Texts that are NULL, empty, blank, very long, repeated, shared in parts, not Latin; ids NULL and repeated."""
    passage = prose(1, 60)
    long = prose(2, 180_000)
    texts = [
        (1, None), (2, ""), (3, " \n\t "), (4, "one"), (5, "one two"), (6, prose(3, 80)), (7, prose(3, 80)),
        (8, prose(4, 50) + "\n" + passage + "\n" + prose(5, 50)), (9, prose(6, 40) + " " + passage), (10, passage),
        (11, long), (12, long[:3000]), (13, "é漢字 ß " * 60), (14, "é漢字 ß " * 60), (15, "x" * 900), (16, "<s>" + prose(7, 90)),
        (None, prose(8, 90)), (17, prose(9, 90)), (17, prose(9, 90)), (17, prose(10, 90)), (18, "same same same same " * 40),
        (None, None), (19, prose(3, 80).replace("a", "A", 3)), (20, prose(3, 79) + " edited"),
    ]
    return texts


@pytest.fixture(scope="session")
def odd_docs(spark, odd_rows):
    """The same rows with columns whose names the operators might use themselves."""
    rows = [(i, t, "en", None, 5, 1.5, "x", True, [1]) for i, t in odd_rows]
    return spark.createDataFrame(
        rows, "doc_id long, text string, lang string, source string, n_chars long, score double, row string, kept boolean, "
              "spans array<int>").repartition(3)


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.where("false")
