"""Token files: ids under a canonical length-limited Huffman code, in independent blocks with bit-offset checkpoints.

Documents are encoded once and kept as packed ids; ids are counted over all of them, the code is built on the driver
(as many lengths as the vocabulary has ids) and every run of rows is written as blocks in ascending doc_id order. A
block holds whole documents, the bit offset of every CHECKPOINT-th id and its own id and document counts, so any block
decodes alone and, within it, all stretches between checkpoints decode side by side through one table.

A file is a folder: `code` (id, bits), `blocks` (part, first, payload) and nothing else; parts ascend in doc_id.
Spark's committer writes it, so lost executors leave nothing behind.
"""

from __future__ import annotations

import os
import struct
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.llm.common import PieceEncoder, Workspace, id_text, map_rows, native_path

#: Most bits of a code word; the decoding table has 2 to this power entries.
MAX_BITS = 20
#: Ids between two checkpoints.
CHECKPOINT = 256
#: Ids in a block, about: it ends with the document that reaches them.
BLOCK = 262_144
#: Ids encoded in one step, a multiple of CHECKPOINT.
STRIDE = 16_384
MAGIC = b"TLH1"
#: magic, documents, ids, first document's start among all ids of the part, bytes of bits
HEADER = struct.Struct("<4sIQQQ")


def code_lengths(counts: np.ndarray, limit: int = MAX_BITS) -> np.ndarray:
    """Optimal lengths of at most `limit` bits, by package-merge; 0 for ids that don't occur, 1 for an only one."""
    own = np.flatnonzero(counts)
    lengths = np.zeros(len(counts), np.uint8)
    if len(own) < 2:
        lengths[own] = 1
        return lengths
    if len(own) > 1 << limit:
        raise ValueError("more ids than code words")
    order = own[np.argsort(counts[own], kind="stable")]
    weight = counts[order].astype(np.float64)
    n = len(order)
    merged, levels = weight, []
    for _ in range(limit - 1):
        pairs = merged[: len(merged) // 2 * 2].reshape(-1, 2).sum(axis=1)
        both = np.concatenate([weight, pairs])
        place = np.argsort(both, kind="stable")
        levels.append(place)
        merged = both[place]
    take, found = 2 * n - 2, np.zeros(n, np.int64)
    for place in reversed(levels):
        chosen = place[:take]
        leaves = chosen[chosen < n]
        found[leaves] += 1
        take = 2 * (len(chosen) - len(leaves))
    found[:take] += 1
    lengths[order] = found
    return lengths


def canonical(lengths: np.ndarray) -> np.ndarray:
    """Code words by length, then id."""
    words = np.zeros(len(lengths), np.uint32)
    code, bits = 0, 0
    for i in np.lexsort((np.arange(len(lengths)), lengths)):
        if lengths[i]:
            code <<= int(lengths[i]) - bits
            bits = int(lengths[i])
            words[i] = code
            code += 1
    return words


class Code:
    def __init__(self, lengths: np.ndarray):
        self.lengths, self.words = lengths, canonical(lengths)
        self.bits = max(1, int(lengths.max(initial=0)))
        table = np.zeros(1 << self.bits, np.uint32)  # id and, in the low five bits, its length
        for i in np.flatnonzero(lengths):
            n = self.bits - int(lengths[i])
            table[int(self.words[i]) << n : int(self.words[i]) + 1 << n] = i << 5 | int(lengths[i])
        self.table = table

    def encode(self, ids: np.ndarray) -> tuple[bytes, np.ndarray]:
        """The bits, padded to whole 8 bytes and 8 more, and the offset of every CHECKPOINT-th id."""
        out = np.zeros(int(self.lengths[ids].sum(dtype=np.int64)) // 64 + 2, np.uint64)
        marks, total = [], 0
        for i in range(0, len(ids), STRIDE):  # so that all arrays of a step stay in the processor's cache
            part = ids[i : i + STRIDE]
            n = self.lengths[part].astype(np.int64)
            ends = np.cumsum(n) + total
            begin = ends - n
            value = self.words[part].astype(np.uint64)
            room = 64 - (begin & 63) - n  # below 0: the code word goes on in the next word
            over = np.flatnonzero(room < 0)
            head = value << np.maximum(room, 0).astype(np.uint64)
            head[over] = value[over] >> (-room[over]).astype(np.uint64)
            at = begin >> 6
            starts = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
            out[at[starts]] |= np.bitwise_or.reduceat(head, starts)
            out[at[over] + 1] |= value[over] << (64 + room[over]).astype(np.uint64)  # one at most goes on into a word
            marks.append(begin[::CHECKPOINT])
            total = int(ends[-1])
        return out.astype(">u8").tobytes(), np.concatenate(marks) if marks else np.zeros(0, np.int64)

    def decode(self, bits: bytes, checkpoints: np.ndarray, n: int) -> np.ndarray:
        if not n:
            return np.zeros(0, np.uint32)
        raw = np.frombuffer(bits, np.uint8).astype(np.uint32)
        quad = raw[:-3] << 24 | raw[1:-2] << 16 | raw[2:-1] << 8 | raw[3:]  # four bytes from each byte on
        at, out = checkpoints.astype(np.int64), np.zeros((len(checkpoints), CHECKPOINT), np.uint32)
        last = len(quad) - 1
        drop, mask = 32 - self.bits, np.uint32((1 << self.bits) - 1)
        for i in range(min(n, CHECKPOINT)):
            found = self.table[quad[np.minimum(at >> 3, last)] >> (drop - (at & 7)).astype(np.uint32) & mask]
            out[:, i] = found >> 5
            at += found & 31
        return out.reshape(-1)[:n]  # stretches are full but for the last


def pack(code: Code, doc_ids: list[int | None], sizes: list[int], ids: np.ndarray, start: int) -> bytes:
    bits, marks = code.encode(ids)
    docs = np.array([-(1 << 63) if d is None else d for d in doc_ids], "<i8")
    null = np.packbits([d is None for d in doc_ids]).tobytes()
    body = docs.tobytes() + null + np.array(sizes, "<u4").tobytes() + marks.astype("<u8").tobytes() + bits
    return HEADER.pack(MAGIC, len(docs), len(ids), start, len(bits)) + body + struct.pack("<I", zlib.crc32(body))


def unpack(code: Code, payload: bytes) -> tuple[list[int | None], np.ndarray, np.ndarray, int]:
    """doc_ids, sizes, ids of all documents, start."""
    magic, docs, n, start, size = HEADER.unpack_from(payload)
    body = payload[HEADER.size : -4]
    if magic != MAGIC or zlib.crc32(body) != struct.unpack("<I", payload[-4:])[0]:
        raise ValueError("this block is damaged")
    at = docs * 8
    null = np.unpackbits(np.frombuffer(body, np.uint8, -(-docs // 8), at), count=docs).tolist()
    names = [None if x else d for d, x in zip(np.frombuffer(body, "<i8", docs).tolist(), null, strict=True)]
    at += -(-docs // 8)
    sizes = np.frombuffer(body, "<u4", docs, at)
    marks = np.frombuffer(body, "<u8", -(-n // CHECKPOINT), at + docs * 4)
    return names, sizes, code.decode(body[len(body) - size :], marks, n), start


@lru_cache(maxsize=2)
def _tokenizer(path: str) -> PieceEncoder:
    from tokenizers import Tokenizer

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    found = Tokenizer.from_file(native_path(path))
    found.no_truncation()
    found.no_padding()
    starts = np.zeros(found.get_vocab_size(with_added_tokens=True), bool)
    starts[[i for x, i in found.get_vocab().items() if x.startswith("Ġ")]] = True  # the letter for a space

    def texts(many: list[str]) -> list[bytes]:
        return [array("I", x.ids).tobytes() for x in found.encode_batch_fast(many, add_special_tokens=False)]

    def words(many: list[str]) -> list[bytes]:
        """One text of all words: a word's ids begin with the only one that begins with its space."""
        ids = np.array(found.encode_batch_fast([" " + " ".join(many)], add_special_tokens=False)[0].ids, "<u4")
        cuts = (4 * np.flatnonzero(starts[ids])).tolist()
        if len(cuts) != len(many):
            return texts([" " + x for x in many])
        raw = ids.tobytes()
        return [raw[a:b] for a, b in zip(cuts, [*cuts[1:], len(raw)], strict=True)]

    return PieceEncoder(texts, words)


_PACKED = "part int,seq long,doc_id long,start long,n_tokens long,ids binary"
#: The number of the row that sums up a part: its ids counted, their number, the first and last doc_id, in order or not.
SUMMARY = -1
_LEAST = -(1 << 63)  # stands for a null id


class _Part:
    """Numbers rows in a task and sums them up in a last row."""

    def __init__(self) -> None:
        from pyspark import TaskContext

        self.part = TaskContext.get().partitionId()
        self.seq = self.start = 0
        self.first = self.last = self.least = self.most = None
        self.ascends = True
        self.counts = np.zeros(1, np.int64)

    def rows(self, doc_ids: list[int | None], ids: list[np.ndarray]) -> dict[str, list]:
        sizes = [len(i) for i in ids]
        if doc_ids:
            n = np.bincount(np.concatenate(ids), minlength=len(self.counts))
            n[: len(self.counts)] += self.counts
            own = np.array([_LEAST if d is None else d for d in doc_ids])
            self.ascends &= bool((own[1:] >= own[:-1]).all() and (self.last is None or own[0] >= self.last))
            self.counts, self.last = n, int(own[-1])
            low, high = int(own.min()), int(own.max())
            self.least = low if self.least is None else min(low, self.least)
            self.most = high if self.most is None else max(high, self.most)
        starts = (np.cumsum(sizes) - sizes + self.start).tolist() if sizes else []
        out = {"part": [self.part] * len(ids), "seq": range(self.seq, self.seq + len(ids)), "doc_id": doc_ids, "start": starts, "n_tokens": sizes, "ids": [_narrow(i) for i in ids]}
        self.seq, self.start = self.seq + len(ids), self.start + sum(sizes)
        return out

    def summary(self) -> Iterator[dict[str, list]]:
        if self.seq:
            used = np.flatnonzero(self.counts)
            packed = bytes([self.ascends]) + np.stack([used, self.counts[used]]).astype("<i8").tobytes()
            yield {"part": [self.part], "seq": [SUMMARY], "doc_id": [self.least], "start": [self.most], "n_tokens": [self.start], "ids": [packed]}


def tokens(docs: DataFrame, path: str, end_id: int) -> DataFrame:
    """doc_id and packed ids in the order of the input, numbered in parts, each summed up in a last row."""

    def run(batches: Iterator[dict[str, list]]) -> Iterator[dict[str, list]]:
        encode, part, end = _tokenizer(path), _Part(), np.array([end_id], "<u4").tobytes()
        for x in batches:
            yield part.rows(x["doc_id"], [np.frombuffer(i + end, "<u4") for i in encode(x["text"])])
        yield from part.summary()

    return map_rows(docs, run, _PACKED)


def _narrow(ids: np.ndarray) -> bytes:
    """Ids as a width byte and 16 bits each where all fit, else 32."""
    return b"\2" + ids.astype("<u2").tobytes() if ids.max(initial=0) < 65_536 else b"\4" + ids.astype("<u4").tobytes()


def _wide(packed: bytes) -> np.ndarray:
    return np.frombuffer(packed, "<u2" if packed[:1] == b"\2" else "<u4", offset=1).astype(np.uint32)


def _renumbered(rows: DataFrame) -> DataFrame:
    """Sorted rows numbered anew in their new parts."""

    def run(batches: Iterator[dict[str, list]]) -> Iterator[dict[str, list]]:
        part = _Part()
        for x in batches:
            yield part.rows(x["doc_id"], [_wide(i) for i in x["ids"]])
        yield from part.summary()

    return map_rows(rows, run, _PACKED)


def _counts(rows: DataFrame) -> np.ndarray:
    """How often each id occurs in all rows, from the parts' summaries; as many entries as ids come to the driver."""

    def run(batches: Iterator[dict[str, list]]) -> Iterator[dict[str, list]]:
        for x in batches:
            for packed in x["ids"]:
                own, n = np.frombuffer(packed, "<i8", offset=1).reshape(2, -1)
                yield {"id": own, "n": n}

    got = map_rows(rows.where(F.col("seq") == SUMMARY).select("ids"), run, "id long,n long").groupBy("id").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(max([r["id"] for r in got], default=0) + 1, np.int64)
    for r in got:
        out[r["id"]] = r["n"]
    return out


def _bases(rows: DataFrame) -> tuple[dict[int, tuple[int, int]], bool]:
    """For each part its place and the ids before it, and whether rows ascend throughout. One row for each part."""
    found = rows.where(F.col("seq") == SUMMARY).select("part", F.col("doc_id").alias("a"), F.col("start").alias("b"), F.col("n_tokens").alias("n"), (F.hex(F.substring("ids", 1, 1)) == "01").alias("ascends"))
    parts = sorted(found.collect(), key=lambda r: (r["a"], r["b"], r["part"]))
    ascend = all(r["ascends"] for r in parts) and all(x["b"] <= y["a"] for x, y in zip(parts, parts[1:], strict=False))
    out, n = {}, 0
    for place, r in enumerate(parts):
        out[r["part"]] = (place, n)
        n += r["n"]
    return out, ascend


def write(docs: DataFrame, path: str, to: str, *, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encodes every text whole with the tokenizer file at `path` and writes the token file `to`, ascending in doc_id.

    A null text is empty: its document holds the end id alone. Rows that repeat are written each; rows of equal ids
    follow one another in any order; null ids come first. An empty table makes a file without blocks. Only the two
    named columns are read. Rows that don't lie in ascending order already are dealt out by range of ids and sorted.
    """
    spark = docs.sparkSession
    space = Workspace(spark, "tokens")
    rows = space.save(tokens(id_text(docs, id_col, text_col), path, end_id), "rows")
    code = code_lengths(_counts(rows))
    parts, ascend = _bases(rows)
    if not ascend:
        rows = space.save(_renumbered(rows.where(F.col("seq") != SUMMARY).repartitionByRange("doc_id").sortWithinPartitions("doc_id")), "sorted")
        space.drop("rows")
        parts, _ = _bases(rows)
    spark.createDataFrame([(int(i), int(code[i])) for i in np.flatnonzero(code)], "id long, bits int").coalesce(1).write.mode("overwrite").parquet(f"{to}/code")
    map_rows(rows.where(F.col("seq") != SUMMARY), _block_writer(code.tobytes(), parts), "part int,first long,documents long,ids long,payload binary").write.mode("overwrite").option("compression", "none").parquet(f"{to}/blocks")
    space.close()


def _block_writer(lengths: bytes, parts: dict[int, tuple[int, int]]):
    def run(batches: Iterator[dict[str, list]]) -> Iterator[dict[str, list]]:
        code = _code(lengths)
        held: list[tuple] = []
        size, after = 0, None

        def block() -> dict[str, list]:
            part, seq, _, start = held[0][:4]
            place, before = parts[part]
            ids = np.concatenate([r[5] for r in held])
            payload = pack(code, [r[2] for r in held], [len(r[5]) for r in held], ids, before + start)
            return {"part": [place], "first": [seq], "documents": [len(held)], "ids": [len(ids)], "payload": [payload]}

        for x in batches:
            for part, seq, doc_id, start, n, ids in zip(*(x[c] for c in ("part", "seq", "doc_id", "start", "n_tokens", "ids")), strict=True):
                if held and ((part, seq) != after or size >= BLOCK):
                    yield block()
                    held, size = [], 0
                held.append((part, seq, doc_id, start, n, _wide(ids)))
                size += n
                after = (part, seq + 1)
        if held:
            yield block()

    return run


@lru_cache(maxsize=2)
def _code(lengths: bytes) -> Code:
    return Code(np.frombuffer(lengths, np.uint8))


def read(spark: SparkSession, at: str, *, ids: bool = True) -> DataFrame:
    """doc_id, start (ids of all documents before), n_tokens, ids_crc32, and the ids packed as 32-bit integers."""
    held = spark.read.parquet(f"{at}/code").collect()  # one row for each id of the vocabulary
    lengths = np.zeros(max([r["id"] for r in held], default=0) + 1, np.uint8)
    for r in held:
        lengths[r["id"]] = r["bits"]
    packed = lengths.tobytes()

    def run(batches: Iterator[dict[str, list]]) -> Iterator[dict[str, list]]:
        code = _code(packed)
        for x in batches:
            for payload in x["payload"]:
                names, sizes, found, start = unpack(code, payload)
                raw = found.astype("<u4").tobytes()
                ends = np.cumsum(sizes, dtype=np.int64)
                own = [raw[4 * a : 4 * b] for a, b in zip((ends - sizes).tolist(), ends.tolist(), strict=True)]
                out = {"doc_id": names, "start": ends - sizes + start, "n_tokens": sizes.astype(np.int64), "ids_crc32": [zlib.crc32(i) for i in own]}
                yield out | ({"ids": own} if ids else {})

    rows = spark.read.schema("part int, first long, documents long, ids long, payload binary").parquet(f"{at}/blocks").select("payload")
    return map_rows(rows, run, "doc_id long,start long,n_tokens long,ids_crc32 long" + ",ids binary" * ids)
