from __future__ import annotations

import random

import pytest

#: Nulls in every column, empty and odd texts, ties, repeated rows, and columns whose names operators use inside.
ODD = [None, "", "", " ", "a", "A b", "\n\n", "word " * 3000, "x" * 20_000, "é É ² 日本 😀\x00", "All rights reserved.", "Cc  by; CC BY-NC 4.0.", "\r x y", None]


@pytest.fixture(scope="session")
def odd_rows():
    r = random.Random(5)
    lines = ["This work is licensed under the GNU General Public License, version 3.", "Licensed under the Apache License, Version 2.0.", "Released under the MIT License."]
    vocabulary = ["".join(r.choice("aeiontrsh") for _ in range(r.randint(1, 7))) for _ in range(60)]
    rows = [(i, t) for i, t in enumerate(ODD)] + [(3, ODD[3]), (None, "null id"), (None, None), (9, "another text")]
    for i in range(20, 60):
        words = [r.choice(vocabulary) for _ in range(r.randint(3, 120))]
        text = " ".join(words) + (" " + r.choice(lines) if i % 3 == 0 else "")
        rows.append((i, text))
        if i % 4 == 0:  # an exact and a near copy
            rows += [(i + 100, text), (i + 200, text.replace(words[0], "Q", 1))]
    r.shuffle(rows)
    return rows


_SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, fingerprint string, digest string, n long, row long"


@pytest.fixture(scope="session")
def odd(spark, odd_rows):
    """The odd rows over several partitions, with clashing columns that are null."""
    return spark.createDataFrame([(i, t, *[None] * 7) for i, t in odd_rows], _SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], _SCHEMA)
