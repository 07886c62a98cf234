import random

import pytest

ODD_SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, part int, bucket long, fp long, row long, w array<string>, kept boolean, shard int, slot long, n_lines long, n_words long, id string"


@pytest.fixture(scope="session")
def odd_rows():
    """Documents with nulls in every column, empty and long texts, ties, repeated rows, and columns named like helpers."""
    rng = random.Random(4)
    words = ["alpha", "beta", "gamma", "delta", "Él", "straße", "日本", "zeta", "the", "of", "and", "license", "all", "rights", "reserved", "cc", "by", "\u212a", "😀"]
    say = lambda n: " ".join(rng.choice(words) for _ in range(n))
    shared = " ".join(f"s{i}" for i in range(60))
    texts = [None, "", " ", "\n\n", "one", "two words", "\x0b\x0c\t", "all rights reserved", "General   Public-License; all RIGHTS reserved cc by cc by", say(30), say(30)]
    texts += [shared, shared + " tail of the text", "head " + shared, say(200) + " " + shared + " " + say(40), "a line that is long enough to be compared\n" + "a line that is long enough to be compered\nshort", "\\ ▁ </turn> ### x"]
    texts += ["x " * 15 + "end", " ".join(["same words again now here"] * 30), "\n".join(["a repeated line of text, long enough"] * 4), "lonG" * 5000, say(9000)]
    rows = []
    for i, t in enumerate(texts):
        rows.append((i, t, "en" if i % 3 else None, ["b", "a", None][i % 3], None if i % 4 == 0 else 5, 1, 2, 3, 4, ["w"], True, 1, 2, 3, 4, "k"))
    rows += [rows[9], rows[9], rows[12]]  # repeated rows
    rows += [(9, "another text of document nine, with a few more words in it", *rows[9][2:]), (None, "no id here at all", *rows[3][2:]), (None, None, *[None] * 14)]
    return rows


@pytest.fixture(scope="session")
def odd(spark, odd_rows):
    return spark.createDataFrame(odd_rows, ODD_SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], ODD_SCHEMA)
