"""Texts and tables shared by the tests of this folder."""
import random

import pytest

SF001 = "/root/testdata/sf0.001"

WORDS = ("the ship sails over calm water while small birds follow and the captain reads old maps near "
         "open windows until evening light fades behind green hills where quiet farmers walk home").split()


def prose(seed, n):
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) for _ in range(n))


def edge_texts():
    """Nulls, empty and blank texts, one very long text, ties, repeated rows."""
    long = prose(1, 30_000) + " password = abcdefghijkl99 " + prose(2, 500)
    return [None, "", " \n\t ", "one", "ÀÉ ß 中文 \U0001f600 x", prose(3, 120), prose(3, 120), prose(4, 60), long,
            "All rights reserved. CC  BY all rights reserved", "a\n\n b\r\n a\x0bb"]


SCHEMA = ("doc_id bigint, text string, lang string, source string, n_chars bigint, "
          "n_words int, items string, score string, base string, spans string, removed string, size int, node string")

@pytest.fixture(scope="session")
def edges(spark):
    rows = [(i, t, "en", "s1" if i % 2 else None, 0 if t is None else len(t), 1, "i", "s", "b", "p", "r", 2, "n")
            for i, t in enumerate(edge_texts())]
    rows += [rows[5], (None, prose(9, 80), None, None, None, None, None, None, None, None, None, None, None)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
