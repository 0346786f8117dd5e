"""What the corpus operators share: storage, text columns and the word byte tables."""

from __future__ import annotations

import ctypes
import gc
import os
import re
import zlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, LongType, StringType, StructField, StructType

from textloom.runtime import ship
from textloom.workspace import Workspace  # noqa: F401

#: Letters and digits of ASCII and everything beyond ASCII are word characters; A-Z is lowered.
WORD_BYTES = bytes(
    c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256)
)
#: Lowers A-Z only.
LOWER_BYTES = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def id_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Just doc_id and text; a null text is empty. Other columns, whatever their names, are left behind."""
    return docs.select(
        docs[id_col].cast("long").alias("doc_id"), F.coalesce(docs[text_col].cast("string"), F.lit("")).alias("text")
    )


#: A key with more rows than this, or than this share of all rows, is joined apart from the others.
HOT_ROWS, HOT_SHARE = 256, 1000


def join_by_key(rows: DataFrame, to: DataFrame, key: str | list[str], total: int, how: str = "inner") -> DataFrame:
    """rows joined with `to`, which has one row for each key and in n how many rows have it, without n.

    Rows of a hot key stay where they are: hot keys, HOT_SHARE at most as each has that share of `total` rows, are
    broadcast. The others are joined as usual, and none of them gathers many rows in one task.
    """
    most, on = max(HOT_ROWS, total // HOT_SHARE), [key] if isinstance(key, str) else key
    hot = F.broadcast(to.where(F.col("n") > most).drop("n"))
    rest = rows.join(hot.select(*on), on, "left_anti").join(to.where(F.col("n") <= most).drop("n"), on, how)
    return rows.join(hot, on).unionByName(rest)


def ascii_lower(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def fold(doc_id: int | None, parts: int) -> int:
    """crc32 of the id as text, modulo parts."""
    return zlib.crc32(str(doc_id).encode()) % parts if doc_id is not None else -1


def fold_col(c: Column, parts: int) -> Column:
    """As fold(); a null id is in none of the folds."""
    return F.coalesce(F.crc32(c.cast("string").cast("binary")) % parts, F.lit(-1))


def map_rows(
    df: DataFrame, function: Callable[[Iterator[dict[str, list]]], Iterable[dict[str, list]]], schema: str
) -> DataFrame:
    """mapInArrow with batches as dicts of lists or arrays."""
    to = _arrow_schema(schema)
    ship(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for out in function(small(batches)):
            yield pa.RecordBatch.from_arrays([pa.array(_plain(out[f.name]), f.type) for f in to], schema=to)

    def small(batches: Iterator[pa.RecordBatch], most: int = 3_000_000) -> Iterator[dict[str, list]]:
        for batch in batches:
            step = max(1, min(batch.num_rows, int(batch.num_rows * most / max(1, batch.nbytes))))
            for i in range(0, batch.num_rows, step):
                yield batch.slice(i, step).to_pydict()

    return df.mapInArrow(run, schema)


_clear: dict[str, Callable[[], None]] = {}


def claim(name: str, clear: Callable[[], None] | None = None) -> None:
    """What the operator `name` remembers in this Python worker stays, what others do goes: Spark uses a worker for one
    stage after another, and an executor's memory shouldn't hold the caches of all."""
    if name in _clear and len(_clear) == 1:
        return
    for other in [x for x in _clear if x != name]:
        _clear.pop(other)()
    _clear[name] = clear or (lambda: None)
    trim()


def trim() -> None:
    """Gives memory that isn't used any more back to the system."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    if hasattr(_libc, "malloc_trim"):
        _libc.malloc_trim(0)


_libc = ctypes.CDLL(None)


def append(df: DataFrame, text_col: str, start: Callable[[], Callable[[list[str]], list]], name: str, kind: str) -> DataFrame:
    """df with one more column made from its texts (a null text is empty), row by row in place: nothing is shuffled.

    start() is called once in each task and gives the function of a batch's texts.
    """
    ship(df.sparkSession)
    if name in df.columns:
        raise ValueError(f"{name} is a column already")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        function = start()
        for batch in batches:
            step = max(1, min(batch.num_rows, int(batch.num_rows * 8_000_000 / max(1, batch.nbytes))))
            for i in range(0, batch.num_rows, step):
                part = batch.slice(i, step)
                made = function([x or "" for x in part.column(text_col).to_pylist()])
                yield part.append_column(name, pa.array(_plain(made), _TYPES[kind]))

    return df.mapInArrow(run, StructType([*df.schema.fields, StructField(name, _SPARK_TYPES[kind])]))


def free_name(df: DataFrame, name: str) -> str:
    """name, or with further underscores, so that it isn't a column of df."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def _plain(values):
    return list(values) if isinstance(values, (range, tuple)) else values


#: The SQL types that operators return.
_TYPES = {
    "long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "string": pa.string(), "boolean": pa.bool_(),
    "binary": pa.binary(), "array<long>": pa.list_(pa.int64()), "array<int>": pa.list_(pa.int32()), "array<double>": pa.list_(pa.float64()), "array<string>": pa.list_(pa.string()), "array<binary>": pa.list_(pa.binary()),
}


_SPARK_TYPES = {"boolean": BooleanType(), "double": DoubleType(), "long": LongType(), "string": StringType()}


def _arrow_schema(schema: str) -> pa.Schema:
    return pa.schema([(x.split()[0], _TYPES[x.split()[1]]) for x in schema.split(",")])


#: ASCII characters that are neither letters, digits nor white space.
MARKS = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum())
#: White space other than spaces and line feeds.
OTHER_SPACE = re.compile(r"[^\S \n]")


def odd_space(text: str) -> bool:
    """Whether some white space isn't a single space or line feed between two other characters."""
    runs = "  " in text or "\n\n" in text or " \n" in text or "\n " in text
    return runs or text[:1].isspace() or text[-1:].isspace() or OTHER_SPACE.search(text) is not None


class PieceEncoder:
    """Encodes texts piece by piece, distinct pieces once a batch, and remembers words.

    The byte-level pre-tokenizer always starts a piece at a lone space or line feed between two other characters, so
    the ids of a text are those of its pieces, each with the white space before it, one after another. Texts with
    other white space are encoded whole. A piece of letters with ASCII marks after it is two: a word with a space
    before it, and marks. `texts` encodes distinct strings, `words` distinct strings of letters with a space before
    each; both return packed 32-bit ids. Splitting, finding distinct pieces and putting ids together is done by arrays.
    """

    def __init__(self, texts: Callable[[list[str]], list[bytes]], words: Callable[[list[str]], list[bytes]], most: int = 400_000, longest: int = 48):
        self.texts, self.words, self.most, self.longest = texts, words, most, longest
        self.young: dict[str, bytes] = {}  # words; the older ones go when these are many
        self.old: dict[str, bytes] = {}
        self.marks: dict[str, bytes] = {}  # other strings

    def __call__(self, texts: list[str]) -> list[bytes]:
        whole = [i for i, t in enumerate(texts) if odd_space(t)]
        out: list[bytes] = [b""] * len(texts)
        for i, ids in zip(whole, self.texts([texts[i] for i in whole]), strict=True):
            out[i] = ids
        odd = set(whole)
        rest = [i for i in range(len(texts)) if i not in odd]
        for i, ids in zip(rest, self._pieces([texts[i] for i in rest]) if rest else [], strict=True):
            out[i] = ids
        return out

    def _pieces(self, texts: list[str]) -> list[bytes]:
        # what has no space before it, first pieces and those after a line feed, begins with a mark
        marked = pc.replace_substring(pa.array(["\r" + t for t in texts], pa.string()), "\n", " \n")
        split = pc.split_pattern(marked, " ")
        pieces = split.flatten().dictionary_encode()
        at = pieces.indices.to_numpy()
        stems = pc.utf8_rtrim(pieces.dictionary, MARKS).dictionary_encode()
        stem_of = stems.indices.to_numpy()
        names = _strings(stems.dictionary)
        found = self._known(names)
        wordy = np.array([x is not None for x in found], bool)
        rest = pc.binary_length(pieces.dictionary).to_numpy() - pc.binary_length(stems.dictionary).to_numpy()[stem_of]
        # segments: none, then stems (words; the others stay empty), then marks and pieces that aren't made of these two
        other: dict[str, int] = {}
        plain = wordy[stem_of]
        first, second = np.where(plain, stem_of + 1, 0), np.zeros(len(plain), np.int32)
        ended = np.flatnonzero(plain & (rest > 0))
        second[ended] = [other.setdefault(x[-n:], len(other) + 1 + len(names)) for x, n in zip(_strings(pieces.dictionary.take(pa.array(ended))), rest[ended].tolist(), strict=True)]
        whole = np.flatnonzero(~plain)
        first[whole] = [other.setdefault(self._whole(x), len(other) + 1 + len(names)) for x in _strings(pieces.dictionary.take(pa.array(whole)))]
        segments = pa.array([b"", *[x or b"" for x in found], *self._others(list(other))], pa.large_binary())
        order = np.stack([first[at], second[at]], axis=1).ravel()
        taken = pc.take(segments, pa.array(order))
        ends = np.frombuffer(taken.buffers()[1], np.int64, len(order) + 1)
        raw = memoryview(taken.buffers()[2]) if taken.buffers()[2] is not None else memoryview(b"")
        cuts = ends[2 * split.offsets.to_numpy()].tolist()
        return [bytes(raw[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]

    def _known(self, names: list[str]) -> list[bytes | None]:
        """Ids of the names that are words, with a space before them; None for other names."""
        if len(self.young) > self.most:
            self.old, self.young = self.young, {}
        young, old = self.young, self.old
        found = list(map(young.get, names))
        new = []
        for i, ids in enumerate(found):
            if ids is None:
                x = names[i]
                if (ids := old.get(x)) is not None:
                    found[i] = young[x] = ids
                elif x.isalpha():
                    new.append(i)
        for at in range(0, len(new), 2048):
            part = new[at : at + 2048]
            for i, ids in zip(part, self.words([names[i] for i in part]), strict=True):
                found[i] = ids
                if len(names[i]) <= self.longest:
                    young[names[i]] = ids
        return found

    def _others(self, many: list[str]) -> list[bytes]:
        known = self.marks
        if len(known) > self.most:
            known.clear()
        new = [x for x in many if x not in known]
        made: dict[str, bytes] = {}
        for at in range(0, len(new), 2048):
            part = new[at : at + 2048]
            made.update(zip(part, self.texts(part), strict=True))
        out = [known[x] if x in known else made[x] for x in many]
        known.update((x, ids) for x, ids in made.items() if len(x) <= self.longest)
        return out

    @staticmethod
    def _whole(piece: str) -> str:
        if piece[:1] == "\r":
            return piece[1:]
        return piece if piece[:1] == "\n" else " " + piece


def _strings(array: pa.Array) -> list[str]:
    """As to_pylist(), without a scalar for each."""
    return array.to_numpy(zero_copy_only=False).tolist()


def native_path(path: str) -> str:
    """A tokenizer file is given by a path on every machine; it isn't shipped."""
    if not os.path.exists(path):
        raise FileNotFoundError(path)
    return path
