"""Language identification with a blended-spectrum string kernel.

Two texts are as alike as their sets of byte n-grams, n from 1 to 3: the kernel is the number of n-grams that both
have, divided by the geometric mean of their numbers. N-grams are compared as they are, none are hashed: a text is its
sorted set of numbers, and as only n-grams that some landmark has can be common with one, its product with all landmarks
runs over these. Landmark texts give the Nyström approximation, one-versus-rest kernel ridge regression is solved over
it, and texts are scored by batched matrix products with the landmarks.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textloom.llm.common import fold_col, id_text, map_rows

#: Learned from this many texts of each language, about; landmarks of each.
TRAIN, LANDMARKS = 1500, 48
RIDGE = 0.1
#: How sharply ridge outputs are told apart in a score.
SHARPNESS = 4.0
FOLDS, HELD_OUT = 4, 2
#: ASCII bytes that are no letters become spaces.
_LETTERS = bytes(c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def has_letter(text: str | None) -> bool:
    return text is not None and any(map(str.isalpha, text))


def grams(text: str) -> np.ndarray:
    """The text's distinct byte n-grams, n from 1 to 3, as ascending numbers: an n-gram's bytes after a 1."""
    b = np.frombuffer(b" " + text.lower().encode().translate(_LETTERS) + b" ", np.uint8).astype(np.int32)
    two = (b[:-1] << 8) + b[1:]
    return np.unique(np.concatenate([b + (1 << 8), two + (1 << 16), (two[:-1] << 8) + b[2:] + (1 << 24)]))


@dataclass
class Landmarks:
    """The n-grams that landmarks have, ascending, and a column for each landmark: 1 / sqrt(number of its n-grams) where
    it has an n-gram."""

    known: np.ndarray
    columns: np.ndarray

    @classmethod
    def of(cls, texts: list[str]) -> Landmarks:
        sets = [grams(t) for t in texts]
        known = np.unique(np.concatenate(sets)) if sets else np.zeros(0, np.int32)
        columns = np.zeros((len(known), len(sets)), np.float32)
        for i, own in enumerate(sets):
            columns[np.searchsorted(known, own), i] = 1 / np.sqrt(len(own))
        return cls(known, columns)

    def kernel(self, texts: list[str]) -> np.ndarray:
        """The kernel of each text with each landmark."""
        has, size = np.zeros((len(texts), len(self.known)), np.float32), np.zeros(len(texts), np.float32)
        for i, text in enumerate(texts):
            own = grams(text)
            at = np.searchsorted(self.known, own)
            at = at[self.known[np.minimum(at, len(self.known) - 1)] == own]
            has[i, at] = 1
            size[i] = len(own)
        return (has @ self.columns) / np.sqrt(size)[:, None]


@dataclass
class Model:
    languages: list[str]
    landmarks: Landmarks
    weights: np.ndarray  # landmarks x languages

    def outputs(self, texts: list[str]) -> np.ndarray:
        return self.landmarks.kernel(texts) @ self.weights


def fit(rows: list[tuple[str, str]]) -> Model:
    """From (text, language) rows, whose order decides on landmarks."""
    languages = sorted({x for _, x in rows})
    chosen = [t for lang in languages for t in [t for t, x in rows if x == lang][:LANDMARKS]]
    if not chosen:
        return Model([], Landmarks.of([]), np.zeros((0, 0), np.float32))
    marks = Landmarks.of(chosen)
    values, vectors = np.linalg.eigh(marks.kernel(chosen).astype(np.float64))
    keep = values > 1e-6 * values[-1]
    root = vectors[:, keep] / np.sqrt(values[keep])
    z = np.concatenate([marks.kernel([t for t, _ in rows[i : i + 256]]) @ root for i in range(0, len(rows), 256)])
    y = np.array([[1.0 if x == lang else -1.0 for lang in languages] for _, x in rows])
    # every language weighs as much as any other
    weight = np.array([len(rows) / sum(v == x for _, v in rows) for x in languages])[[languages.index(x) for _, x in rows]][:, None]
    solved = np.linalg.solve(z.T @ (weight * z) + RIDGE * np.eye(z.shape[1]), z.T @ (weight * y))
    return Model(languages, marks, (root @ solved).astype(np.float32))


def learn(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", train: int = TRAIN) -> Model:
    """Fits on at most `train` texts of each language, the bound on labelled rows, whatever repeats: those with the
    smallest hashes of id, text and place. The fold HELD_OUT isn't looked at."""
    rows = docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text"), docs[lang_col].alias("lang"))
    rows = rows.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (fold_col(F.col("doc_id"), FOLDS) != HELD_OUT))
    n = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}  # one row for each language
    if not n:
        return fit([])
    rows = rows.withColumn("dice", F.pmod(F.xxhash64("doc_id", F.xxhash64("text"), F.monotonically_increasing_id()), F.lit(1_000_000)))
    share = F.create_map(*[F.lit(v) for x, k in n.items() for v in (x, min(1_000_000, 1_500_000 * train // k + 1))])
    rows = rows.where(F.col("dice") < share[F.col("lang")])  # about half as much again as is taken
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("dice", "doc_id", "text"))
    got = rows.withColumn("rank", rank).where(F.col("rank") <= train).select("dice", "doc_id", "text", "lang").toPandas()
    got = got.sort_values(["dice", "doc_id", "text"])
    return fit([(t, x) for t, x in zip(got["text"], got["lang"], strict=True) if has_letter(t)])


def predict(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", train: int = TRAIN) -> DataFrame:
    """doc_id, held_out, lang_pred, score (0 to 1): one row for each row of docs.

    A text that is null or has no letter is `und` with score 0, and so is any text if nothing was learned. Rows that
    repeat get the same result each; a null id is held out of no fold; an empty table gives none. Texts are read whole.
    Only the three named columns are read, and lang only in learning.
    """
    model = learn(docs, id_col=id_col, text_col=text_col, lang_col=lang_col, train=train)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # n-grams of LANDMARKS texts a language x these texts

    def run(batches: Iterator[dict[str, list]]) -> Iterator[dict[str, list]]:
        model = shared.value
        for x in batches:
            names, scores = ["und"] * len(x["text"]), [0.0] * len(x["text"])
            known = [i for i, t in enumerate(x["text"]) if model.languages and has_letter(t)]
            for at in range(0, len(known), 256):
                own = known[at : at + 256]
                e = SHARPNESS * model.outputs([x["text"][i] for i in own])
                e = np.exp(e - e.max(axis=1, keepdims=True))
                e /= e.sum(axis=1, keepdims=True)
                for i, j, p in zip(own, e.argmax(axis=1), e.max(axis=1), strict=True):
                    names[i], scores[i] = model.languages[j], float(p)
            yield {"doc_id": x["doc_id"], "held_out": x["held_out"], "lang_pred": names, "score": scores}

    rows = id_text(docs, id_col, text_col).withColumn("held_out", fold_col(F.col("doc_id"), FOLDS) == HELD_OUT)
    return map_rows(rows, run, "doc_id long,held_out boolean,lang_pred string,score double")
