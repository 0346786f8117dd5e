"""The words of many texts at once are those of each."""

from __future__ import annotations

import random

from textloom.llm import hmm


def test_coded_words_are_those_of_each_text():
    r = random.Random(1)
    texts = ["", " ", "a", *["".join(r.choices("aB \t\n\x0b\x0c\r\x1c\x85\xa0é\x00İ", k=r.randint(0, 12))) for _ in range(2000)]]
    for many in (texts, [""], ["", " "]):
        code, ends, own = hmm.coded(many)
        begins = [0, *ends.tolist()]
        assert [[own[i] for i in code[a:b].tolist()] for a, b in zip(begins, begins[1:], strict=False)] == [hmm.words(t) for t in many]


def test_classes_in_the_table_of_counts(spark):
    docs = spark.createDataFrame(list(enumerate(["a bc déf ghij", "a ﻿é x", "", "A a"])), "doc_id long, text string")
    rows = hmm.token_counts(docs).collect()
    assert all(r["class"] == hmm.ending(bytes(r["token"])) for r in rows) and len(rows) == 7
    assert {bytes(r["token"]): r["seen"] for r in rows}[b"a"] == 4 and {bytes(r["token"]): r["seen"] for r in rows}[hmm.END] == 4
