"""Licence scan by a positional rare-token index, in DataFrame operations only.

The index is a posting table: for each licence word the templates and places it stands at. How many documents hold each
licence word is counted over the whole corpus first. A file's own licence words are then ranked by IDF, and for each
template of which the file holds enough words, the file's rarest ones are looked up: each occurrence votes for where the
template would begin, and beginnings with VOTES votes are left. So many words are looked up that a template with
COVERAGE of its words in place gets that many votes whichever words were altered, so none is lost. At what is left the
key phrase must stand in full and enough of the words in their places. Apart from that, all places of three base phrases
are found.
"""

from __future__ import annotations

import json
from functools import reduce
from math import ceil

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.functions.text import let
from textloom.llm.common import ascii_lower, id_text

#: Phrases and their labels; fixed values.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
#: label, notice, key phrase that must stand in it. Wording of well-known public licence notices; fixed values.
TEMPLATES = (
    ("agpl-3.0-or-later", "this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version", "gnu affero general public license"),
    ("apache-2.0", "licensed under the apache license version 2 0", "apache license"),
    ("apache-2.0", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at", "apache license"),
    ("apache-2.0", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied see the license for the specific language governing permissions and limitations under the license", "see the license for the specific language"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "redistribution and use in source"),
    ("bsd", "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer", "redistributions of source code must retain"),
    ("bsd", "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution", "redistributions in binary form must reproduce"),
    ("bsl-1.0", "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license", "any person or organization obtaining a copy"),
    ("cc-by-4.0", "this work is licensed under a creative commons attribution 4 0 international license", "creative commons attribution 4 0"),
    ("cc-by-nc", "licensed under cc by nc 4 0", "cc by nc"),
    ("cc-by-sa", "licensed under cc by sa 4 0", "cc by sa"),
    ("cc-by-sa-4.0", "this work is licensed under a creative commons attribution sharealike 4 0 international license", "creative commons attribution sharealike"),
    ("cc0-1.0", "to the extent possible under law the person who associated cc0 with this work has waived all copyright and related or neighboring rights to this work", "waived all copyright and related or neighboring rights"),
    ("epl-2.0", "this program and the accompanying materials are made available under the terms of the eclipse public license 2 0 which is available at", "eclipse public license"),
    ("gpl-2.0-or-later", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version", "either version 2 of the license"),
    ("gpl-3.0", "licensed under the gnu general public license version 3", "gnu general public license"),
    ("gpl-3.0-or-later", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version", "either version 3 of the license"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "permission to use copy modify"),
    ("lgpl-2.1-or-later", "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 2 1 of the license or at your option any later version", "gnu lesser general public license"),
    ("mit", "released under the mit license", "mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", "permission is hereby granted free of charge"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software", "without restriction including without limitation the rights"),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0", "mozilla public license"),
    ("unlicense", "this is free and unencumbered software released into the public domain", "free and unencumbered software"),
    ("zlib", "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software", "in no event will the authors be held liable"),
)
#: Least share of a template's words that must stand in their places.
COVERAGE = 0.8
#: Looked-up words that must agree on where a template begins.
VOTES = 2
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def normalised(text: Column) -> Column:
    """Lower-case words with one space between them and no other separators."""
    return F.btrim(F.regexp_replace(ascii_lower(text), SEPARATORS, " "))


def _with_words(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    spaced = id_text(docs, id_col, text_col).select("doc_id", normalised(F.col("text")).alias("spaced"))
    return spaced.withColumn("w", F.when(F.col("spaced") == "", F.array().cast("array<string>")).otherwise(F.split("spaced", " ")))


def _array(words: list[str]) -> Column:
    """A constant array, as one expression: a call for each of hundreds of words would take seconds."""
    return F.split(F.lit(" ".join(words)), " ")


def document_frequencies(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> dict[str, int]:
    """How many documents hold each word of the templates; as many entries as the templates have words."""
    known = sorted({w for _, notice, _ in TEMPLATES for w in notice.split()})
    held = _with_words(docs, id_col, text_col).select(F.explode(F.array_intersect("w", _array(known))).alias("word"))
    return dict.fromkeys(known, 0) | {r["word"]: r["n"] for r in held.groupBy("word").agg(F.count(F.lit(1)).alias("n")).collect()}


def spare(notice: str) -> int:
    """How many of a template's words may be out of place."""
    n = len(notice.split())
    return n - ceil(COVERAGE * n - 1e-9)


def postings(df: dict[str, int]) -> Column:
    """The posting table by template: its words in order of IDF (the rarest in the corpus first, equally rare ones by
    the alphabet) with their places, its words as they stand, its key phrase and how many words it can spare."""
    made = []
    for t, (_, notice, phrase) in enumerate(TEMPLATES):
        own, key = notice.split(), phrase.split()
        at = {w: [i for i, x in enumerate(own) if x == w] for w in sorted(set(own), key=lambda w: (df[w], w))}
        key_at = next(i for i in range(len(own)) if own[i : i + len(key)] == key)
        ranked = [{"word": w, "at": x} for w, x in at.items()]
        made.append({"t": t, "distinct": list(at), "ranked": ranked, "notice": own, "key": key, "key_at": key_at, "spare": spare(notice)})
    return F.from_json(F.lit(json.dumps(made)), _POSTINGS)


_POSTINGS = "array<struct<t:int,distinct:array<string>,ranked:array<struct<word:string,at:array<int>>>,notice:array<string>,key:array<string>,key_at:int,spare:int>>"


def _beginnings(t: Column, mine: Column) -> Column:
    """Where template t may begin: mine are its words that the file holds, the rarest first.

    Of the words that it can spare, those that the file doesn't hold are gone already. Among one more word than are left
    to spare, one at least is in its place, and so on.
    """
    left = t.spare - (F.size(t.notice) - F.aggregate(mine, F.lit(0), lambda n, r: n + F.size(r.at)))
    looked = F.slice(mine, F.lit(1), F.greatest(left + VOTES, F.lit(0)))
    of = lambda r: let(F.array_compact(F.transform("w", lambda x, i: F.when(x == r.word, i))), lambda at: F.flatten(F.transform(r.at, lambda j: F.transform(at, lambda i: i - j))))
    begun = F.array_sort(F.flatten(F.transform(looked, of)))
    voted = let(begun, lambda x: F.filter(x, lambda b, i: ((i == 0) | (F.get(x, i - 1) != b)) & F.coalesce(F.get(x, i + (VOTES - 1)) == b, F.lit(False))))
    return F.when(left >= 0, voted).otherwise(F.array().cast("array<int>"))


def _found(t: Column) -> Column:
    """The template's number and its best share of words in place over verified beginnings (null without any)."""
    stands = lambda words, at: lambda k: F.coalesce(F.get("w", at + k) == F.get(words, k), F.lit(False))
    all_of = lambda words: F.sequence(F.lit(0), F.size(words) - 1)
    mine = F.filter(t.ranked, lambda r: F.array_contains("held", r.word))
    keyed = F.filter(let(mine, lambda m: _beginnings(t, m)), lambda b: F.forall(all_of(t.key), stands(t.key, b + t.key_at)))
    share = F.transform(keyed, lambda b: F.size(F.filter(all_of(t.notice), stands(t.notice, b))) / F.size(t.notice))
    return F.struct(t.t.alias("t"), F.array_max(share).alias("share"))


def _phrase_places(phrase: str) -> Column:
    own = phrase.split()
    return F.when(
        F.concat(F.lit(" "), "spaced", F.lit(" ")).contains(f" {phrase} "),
        F.filter(
            F.sequence(F.lit(0), F.size("w") - len(own)),
            lambda i: reduce(lambda a, b: a & b, [F.col("w")[i + k] == x for k, x in enumerate(own)]),
        ),
    ).otherwise(F.array().cast("array<int>"))


def scan(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score: one row for each row of docs.

    A null text has no words, like an empty one: no places (null first_word and last_word), empty labels, score 0. Rows
    that repeat get the same result each; an empty table gives none; whole texts of any length are read. score is the
    best share of a notice's words found in place, or 1 where a base phrase stands. Only the two named columns are read.
    """
    table = postings(document_frequencies(docs, id_col=id_col, text_col=text_col))
    known = sorted({w for _, notice, _ in TEMPLATES for w in notice.split()})
    rows = _with_words(docs, id_col, text_col).withColumn("held", F.array_intersect("w", _array(known)))
    enough = F.filter(table, lambda t: F.size(F.array_intersect(t.distinct, F.col("held"))) >= F.size(t.distinct) - t.spare)
    looked = let(enough, lambda x: F.when(F.size(x) > 0, F.filter(F.transform(x, _found), lambda r: r.share >= COVERAGE)))
    rows = rows.withColumns({f"p{i}": _phrase_places(p) for i, p in enumerate(BASE)} | {"found": looked})
    places = F.concat(*[f"p{i}" for i in range(len(BASE))])
    base = F.array_compact(F.array(*[F.when(F.size(f"p{i}") > 0, F.lit(x)) for i, x in enumerate(BASE.values())]))
    more = F.transform(F.coalesce("found", F.array().cast("array<struct<t:int,share:double>>")), lambda r: F.get(_array([x for x, _, _ in TEMPLATES]), r.t))
    rows = rows.select("doc_id", F.size("w").alias("n"), places.alias("places"), base.alias("base"), more.alias("more"), F.array_max(F.transform("found", lambda r: r.share)).alias("best"))
    return rows.select(
        "doc_id",
        F.col("n").cast("long").alias("n_words"),
        F.size("places").cast("long").alias("n_base"),
        F.array_min("places").cast("long").alias("first_word"),
        F.array_max("places").cast("long").alias("last_word"),
        F.array_join(F.array_sort(F.array_distinct("base")), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_distinct(F.concat("base", "more"))), ",").alias("labels"),
        F.when(F.size("base") > 0, 1.0).otherwise(F.coalesce("best", F.lit(0.0))).alias("score"),
    )


_WORDS_SQL = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"


def oracle() -> str:
    """The same by all beginnings on which any word of a template stands in its place; no index and no ranks."""
    base = ", ".join(f"('{p}', '{x}', {len(p.split())})" for p, x in BASE.items())
    notices = ", ".join(f"({i}, '{x}', '{n}', '{k}')" for i, (x, n, k) in enumerate(TEMPLATES))
    return f"""
WITH d AS (SELECT doc_id, {_WORDS_SQL} AS w FROM documents),
p(phrase, label, n) AS (VALUES {base}),
t(t, label, notice, keyed) AS (VALUES {notices}),
dw AS (SELECT doc_id, w, len(w) AS n, unnest(w) AS word, unnest(range(len(w))) AS i FROM d),
b AS (SELECT doc_id, i, p.label FROM dw, p WHERE word = string_split(phrase, ' ')[1] AND array_to_string(w[i + 1:i + p.n], ' ') = phrase),
tw AS (SELECT t, unnest(string_split(notice, ' ')) AS word, unnest(range(len(string_split(notice, ' ')))) AS j FROM t),
tn AS (SELECT t, label, keyed, len(string_split(notice, ' ')) AS n, len(string_split(split_part(' ' || notice || ' ', ' ' || keyed || ' ', 1), ' ')) - 1 AS k, len(string_split(keyed, ' ')) AS k_n FROM t),
cover AS (SELECT doc_id, t, i - j AS s, count(*) AS in_place FROM (SELECT doc_id, word, i FROM dw) JOIN tw USING (word) GROUP BY ALL),
found AS (SELECT doc_id, label, in_place / tn.n AS share FROM cover JOIN tn USING (t) JOIN d USING (doc_id) WHERE in_place / tn.n >= {COVERAGE} AND s + k >= 0 AND array_to_string(w[greatest(s + k, 0) + 1:s + k + k_n], ' ') = keyed),
s AS (SELECT doc_id, max(share) AS best FROM found GROUP BY doc_id),
l AS (SELECT doc_id, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM (SELECT doc_id, label FROM b UNION SELECT doc_id, label FROM found) GROUP BY doc_id),
bs AS (SELECT doc_id, count(*) AS n_base, min(i) AS first_word, max(i) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels FROM b GROUP BY doc_id)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word, last_word::BIGINT AS last_word,
coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, CASE WHEN n_base > 0 THEN 1.0::DOUBLE ELSE coalesce(best, 0)::DOUBLE END AS score
FROM d LEFT JOIN bs USING (doc_id) LEFT JOIN l USING (doc_id) LEFT JOIN s USING (doc_id)"""
