"""Hidden Markov language model: Baum-Welch counts from all training texts, exact sequence likelihood by scaled forward
recursion. Texts are whole in both: a long one is worked on in pieces, and products of the pieces' transition matrices
carry the recursions across their borders exactly.

States emit symbols: each of the SYMBOLS most frequent tokens is one, and all other tokens share CLASSES symbols by
their endings. A token within a class has the probability (c + 0.5) / (N_class + 0.5 (V_class + 1)), so that each
state's probabilities sum to one over all tokens of the training texts and one unknown token in each class.

Token counts are kept as a table, as the vocabulary grows with the corpus. Only the HEAD most frequent tokens go to all
machines; a document's other tokens meet their counts in a join, which no frequent token can skew.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm.common import LOWER_BYTES, Workspace, fold, id_text, map_rows

#: Latent states; tokens that are symbols of their own; classes of all others; tokens that each machine knows.
STATES, SYMBOLS, CLASSES, HEAD = 8, 32_000, 1024, 200_000
#: Baum-Welch rounds over all training texts at most, and the gain (log10 a token) below which no further one is made.
ROUNDS, SETTLED = 6, 0.002
#: Symbols in a row that are worked on at once; a longer sequence is carried on exactly from piece to piece.
BLOCK = 1024
#: Weight of the symbols' overall distribution in each state's.
PRIOR = 50.0
#: Pieces side by side.
ABREAST = 512
FOLDS, HELD_OUT = 5, 1
END = b""  # no word is empty


def words(text: str) -> list[bytes]:
    """Words apart by ASCII white space, A-Z lowered."""
    return text.encode().translate(LOWER_BYTES).split()


def coded(texts: list[str]) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """The words of many texts as numbers of distinct ones, where each text's end, and the distinct words: words() of
    all texts at once, by arrays."""
    split = pc.ascii_split_whitespace(pc.ascii_lower(pa.array(texts, pa.large_string())))
    flat = split.flatten().dictionary_encode()
    code, ends, own = flat.indices.to_numpy(), split.offsets.to_numpy()[1:], flat.dictionary.cast(pa.large_binary()).to_numpy(zero_copy_only=False).tolist()
    if END in own:  # beside white space at a text's start or end
        none = own.index(END)
        full = code != none
        before = np.concatenate([[0], np.cumsum(full)])
        code, ends, own = code[full], before[ends], own[:none] + own[none + 1 :]
        code = code - (code > none)
    return code, ends, own


def ending(word: bytes) -> int:
    return zlib.crc32(word[-3:]) % CLASSES


@dataclass
class Vocabulary:
    """The head: number of each token, and by number the training count and the symbol."""

    number: dict[bytes, int]
    count: np.ndarray
    symbol: np.ndarray
    singles: int  # symbols of one token each; classes follow
    share: np.ndarray  # of each symbol in all tokens
    tokens: int  # N
    distinct: int  # V
    class_total: np.ndarray  # N_class + 0.5 (V_class + 1)


@dataclass
class Model:
    start: np.ndarray
    step: np.ndarray
    emit: np.ndarray  # symbols x states


def token_counts(docs: DataFrame) -> DataFrame:
    """token, class, c (in training texts), seen (in all texts): one row for each token; summed in each task first."""

    def run(batches: Iterator[dict[str, list]]) -> Iterator[dict[str, list]]:
        train: dict[bytes, int] = {}
        seen: dict[bytes, int] = {}

        def flush() -> dict[str, list]:
            own, n = list(seen.keys()), list(seen.values())
            c = [train.get(w, 0) for w in own]
            train.clear()
            seen.clear()
            return {"token": own, "c": c, "seen": n}

        for x in batches:
            if x["text"]:
                code, ends, own = coded(x["text"])
                lengths = np.diff(ends, prepend=0)
                learned = np.array([fold(d, FOLDS) != HELD_OUT for d in x["doc_id"]], bool)
                every = np.bincount(code, minlength=len(own)).tolist()
                some = np.bincount(code[np.repeat(learned, lengths)], minlength=len(own)).tolist()
                own.append(END)
                every.append(len(ends))
                some.append(int(learned.sum()))
                for w, n, c in zip(own, every, some, strict=True):
                    seen[w] = seen.get(w, 0) + n
                    if c:
                        train[w] = train.get(w, 0) + c
            if len(seen) > 300_000:
                yield flush()
        yield flush()

    got = map_rows(docs, run, "token binary,c long,seen long").groupBy("token").agg(F.sum("c").alias("c"), F.sum("seen").alias("seen"))
    class_ = F.crc32(F.substring("token", -3, 3)) % CLASSES  # ending()
    return got.select("token", class_.cast("int").alias("class"), "c", "seen")


def vocabulary(counts: DataFrame, *, head: int = HEAD, symbols: int = SYMBOLS) -> Vocabulary:
    """From the table of counts: as many rows as the head and the classes have come to the driver.

    The head is all tokens that are seen so often (in steps of a twentieth) that there are at most `head` of them.
    """
    step = F.floor(F.log("seen") * 20)
    room, least = head, None
    for r in sorted(counts.groupBy(step.alias("step")).agg(F.count(F.lit(1)).alias("n")).collect(), reverse=True):
        room -= r["n"]
        if room < 0:
            break
        least = r["step"]
    top = counts.where(step >= least if least is not None else F.lit(False)).toPandas()
    by_class = counts.groupBy("class").agg(F.sum("c").alias("n"), F.sum((F.col("c") > 0).cast("long")).alias("v")).toPandas()
    n, v = np.zeros(CLASSES, np.int64), np.zeros(CLASSES, np.int64)
    n[by_class["class"]], v[by_class["class"]] = by_class["n"], by_class["v"]
    tokens, distinct = int(n.sum()), int(v.sum())
    top = top.sort_values(["c", "token"], ascending=[False, True], kind="stable") if len(top) else top
    count, cls = top["c"].to_numpy(np.int64), top["class"].to_numpy(np.int64)
    singles = min(symbols, int((count > 0).sum()))
    np.subtract.at(n, cls[:singles], count[:singles])
    np.subtract.at(v, cls[:singles], 1)
    total = n + 0.5 * (v + 1)
    symbol = np.where(np.arange(len(count)) < singles, np.arange(len(count)), singles + cls)
    weight = np.concatenate([count[:singles] + 0.5, total])
    return Vocabulary({bytes(w): i for i, w in enumerate(top["token"])}, count, symbol.astype(np.uint32), singles, weight / weight.sum(), tokens, distinct, total)


def symbols_of(docs: DataFrame, known: Vocabulary) -> DataFrame:
    """Each row's symbols (packed), what the head says about its tokens, and its other tokens with their numbers."""
    shared = docs.sparkSession.sparkContext.broadcast(known)  # HEAD entries at most

    def run(batches: Iterator[dict[str, list]]) -> Iterator[dict[str, list]]:
        known = shared.value
        get, singles = known.number.get, known.singles
        value, is_known = np.log10(known.count + 0.5), known.count > 0
        divisor = np.log10(known.class_total)
        kind = "<u2" if len(known.share) < 65_536 else "<u4"
        for x in batches:
            out: dict[str, list] = {c: [] for c in ("symbols", "n_tokens", "head_known", "head_log", "class_log", "rest", "times")}
            if x["text"]:
                code, ends, own = coded(x["text"])
                code, own = np.insert(code, ends, len(own)), [*own, END]  # each text's end token
                ends = ends + np.arange(1, len(ends) + 1)
                of = np.repeat(np.arange(len(ends)), np.diff(ends, prepend=0))
                # of the distinct words: number in the head, symbol, and what each adds to a text's sums
                at = np.array([get(w, -1) for w in own], np.int64)
                here = at >= 0
                symbol = np.empty(len(own), np.uint32)
                symbol[here] = known.symbol[at[here]]
                symbol[~here] = [singles + ending(own[i]) for i in np.flatnonzero(~here).tolist()]
                head_known, head_log, class_log = np.zeros(len(own)), np.zeros(len(own)), np.zeros(len(own))
                head_known[here], head_log[here] = is_known[at[here]], value[at[here]]
                classed = symbol >= singles
                class_log[classed] = head_log[classed] - divisor[symbol[classed] - singles]
                sums = lambda v: np.bincount(of, v[code], len(ends))
                symbols = symbol.astype(kind)[code]
                places = np.flatnonzero(~here[code])
                cuts = np.searchsorted(places, ends).tolist()
                rest, begin, cut = [own[i] for i in code[places].tolist()], 0, 0
                for end, stop in zip(ends.tolist(), cuts, strict=True):
                    times = Counter(rest[cut:stop])
                    out["symbols"].append(symbols[begin:end].tobytes())
                    out["rest"].append(list(times.keys()))
                    out["times"].append(list(times.values()))
                    begin, cut = end, stop
                out["n_tokens"] = np.diff(ends, prepend=0).astype(np.int64)
                out["head_known"], out["head_log"], out["class_log"] = sums(head_known).astype(np.int64), sums(head_log), sums(class_log)
            yield {"row": x["row"], "doc_id": x["doc_id"], "held_out": [fold(d, FOLDS) == HELD_OUT for d in x["doc_id"]]} | out

    rows = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text")
    return map_rows(rows, run, "row long,doc_id long,held_out boolean,symbols binary,n_tokens long,head_known long,head_log double,class_log double,rest array<binary>,times array<long>")


@dataclass
class Lanes:
    """Whole sequences as pieces of BLOCK symbols at most that are worked on side by side.

    A piece knows what its sequence says about it: `before` are the states' probabilities after all earlier symbols
    (the start's, unstepped, for a first piece), `after` is in proportion to the probability of all later symbols.
    """

    pieces: list[np.ndarray]
    of: np.ndarray  # the sequence of each piece
    first: np.ndarray
    before: np.ndarray
    after: np.ndarray


def _abreast(pieces: list[np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Groups of about equally long pieces: which, symbols (time x piece), how many go on at each time."""
    sizes = np.array([len(s) for s in pieces])
    order = np.argsort(-sizes, kind="stable")
    for at in range(0, len(order), ABREAST):
        own = order[at : at + ABREAST]
        n = sizes[own]
        table = np.zeros((n[0], len(own)), np.int64)
        for i, j in enumerate(own):
            table[: n[i], i] = pieces[j]
        yield own, table, np.searchsorted(-n, -np.arange(n[0]), "left")


def _products(model: Model, pieces: list[np.ndarray], first: np.ndarray) -> np.ndarray:
    """For each piece the matrix, up to a factor, that leads from the states before it to those at its end."""
    k = len(model.start)
    out = np.zeros((len(pieces), k, k))
    for own, table, going in _abreast(pieces):
        p = np.where(first[own][:, None, None], np.eye(k), model.step)
        for t in range(len(table)):
            n = going[t]
            if t:
                p[:n] = (p[:n].reshape(-1, k) @ model.step).reshape(-1, k, k)
            p[:n] *= model.emit[table[t, :n]][:, None, :]
            if t % 16 == 15:
                p[:n] /= p[:n].sum(axis=(1, 2), keepdims=True)
        out[own] = p / p.sum(axis=(1, 2), keepdims=True)
    return out


def lanes(model: Model, sequences: list[np.ndarray], block: int = BLOCK, *, later: bool = True) -> Lanes:
    """Nothing is lost at the borders of pieces: products of the pieces' matrices carry both recursions across them."""
    pieces = [s[at : at + block] for s in sequences for at in range(0, len(s), block)]
    many = np.array([-(-len(s) // block) for s in sequences], np.int64)
    of = np.repeat(np.arange(len(sequences)), many)
    begins = np.cumsum(many) - many
    first = np.zeros(len(pieces), bool)
    first[begins] = True
    before, after = np.tile(model.start, (len(pieces), 1)), np.ones((len(pieces), len(model.start)))
    long = np.flatnonzero(many[of] > 1)
    if len(long):
        matrix = dict(zip(long.tolist(), _products(model, [pieces[i] for i in long], first[long]), strict=True))
        for i in np.flatnonzero(many > 1):
            a, b = int(begins[i]), int(begins[i] + many[i])
            f = model.start
            for at in range(a, b - 1):
                f = f @ matrix[at]
                before[at + 1] = f = f / f.sum()
            g = after[b - 1]
            for at in range(b - 1, a, -1) if later else ():
                g = matrix[at] @ g
                after[at - 1] = g = g / g.sum()
    return Lanes(pieces, of, first, before, after)


def _entered(model: Model, x: Lanes, own: np.ndarray) -> np.ndarray:
    """The states' probabilities at a piece's first symbol, before it is seen."""
    return np.where(x.first[own][:, None], x.before[own], x.before[own] @ model.step)


def likelihood(model: Model, sequences: list[np.ndarray], block: int = BLOCK) -> np.ndarray:
    """log10 probability of each sequence of symbols, by the scaled forward recursion."""
    out, one, x = np.zeros(len(sequences)), np.ones(len(model.start)), lanes(model, sequences, block, later=False)
    for own, table, going in _abreast(x.pieces):
        log = np.zeros(len(own))
        a = _entered(model, x, own) * model.emit[table[0]]
        for t in range(len(table)):
            n = going[t]
            if t:
                a = (a[:n] @ model.step) * model.emit[table[t, :n]]
            scale = a @ one
            log[:n] += np.log10(scale)
            a /= scale[:, None]
        np.add.at(out, x.of[own], log)
    return out


def expected(model: Model, sequences: list[np.ndarray], block: int = BLOCK) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """Baum-Welch counts of whole sequences: states at their starts, steps between states, symbols by state; and the
    log10 likelihood. Steps are taken in single precision (they are scaled, so errors don't grow with a text's length) and
    summed up in double. Only a group of pieces is held at a time, however long a sequence is."""
    k, size = len(model.start), len(model.emit)
    starts, steps, emits, total = np.zeros(k), np.zeros((k, k)), np.zeros((size, k)), 0.0
    x, step, emit = lanes(model, sequences, block), model.step.astype(np.float32), model.emit.astype(np.float32)
    one, back = np.ones(k, np.float32), step.T.copy()
    for own, table, going in _abreast(x.pieces):
        span, width = table.shape
        alpha, scales = np.zeros((span, width, k), np.float32), np.ones((span, width, 1), np.float32)
        beta = x.after[own].astype(np.float32)
        a = _entered(model, x, own).astype(np.float32) * emit[table[0]]
        for t in range(span):
            n = going[t]
            if t:
                a = (a[:n] @ step) * emit[table[t, :n]]
            scales[t, :n, 0] = scale = a @ one
            a = a / scale[:, None]
            alpha[t, :n] = a
        total += float(np.log10(scales.astype(np.float64)).sum())
        ends = alpha[np.array([len(x.pieces[i]) for i in own]) - 1, np.arange(width)]
        beta /= (ends * beta).sum(axis=1, keepdims=True)
        for t in range(span - 1, -1, -1):
            n = going[t]
            if t + 1 < span:
                m = going[t + 1]
                e = emit[table[t + 1, :m]] * beta[:m] / scales[t + 1, :m]
                beta[:m] = e @ back
                steps += alpha[t, :m].T @ e
            alpha[t, :n] *= beta[:n]  # from here on the states' probabilities
        later = ~x.first[own]
        steps += x.before[own][later].T @ (emit[table[0]] * beta / scales[0])[later]
        starts += alpha[0][~later].sum(axis=0, dtype=np.float64)
        at = (table[:, :, None] * k + np.arange(k)).ravel()
        emits += np.bincount(at, alpha.ravel(), size * k).reshape(size, k)
    return starts, steps * model.step, emits, total


def estimate(starts: np.ndarray, steps: np.ndarray, emits: np.ndarray, share: np.ndarray) -> Model:
    emit = (emits + PRIOR * share[:, None]) / (emits.sum(axis=0) + PRIOR)
    k = len(starts)
    step = (steps + 1.0 + 10.0 * np.eye(k)) / (steps.sum(axis=1, keepdims=True) + k + 10.0)
    return Model((starts + 0.5) / (starts.sum() + 0.5 * k), step, emit)


def started(share: np.ndarray, states: int) -> Model:
    """Sticky states that emit what all texts hold, each with weights of its own so that rounds can tell them apart."""
    emit = share[:, None] * np.random.default_rng(7).gamma(1.0, 1.0, (len(share), states))
    return Model(np.full(states, 1 / states), np.full((states, states), 0.1 / states) + 0.9 * np.eye(states), emit / emit.sum(axis=0))


def train(rows: DataFrame, known: Vocabulary, *, states: int = STATES, rounds: int = ROUNDS) -> Model:
    """Rounds of Baum-Welch over all training texts, each whole, until the likelihood settles or `rounds` are done.

    Each task sends its counts by symbol, and sums come to the driver: a row for each symbol (SYMBOLS + CLASSES at
    most), one for the starts, one for each state's steps and one for the likelihood.
    """
    kind = "<u2" if len(known.share) < 65_536 else "<u4"
    own = rows.where("not held_out").select("symbols")
    model, before = started(known.share, states), None
    columns = [f"s{i}" for i in range(states)]
    size = len(known.share)
    for _ in range(rounds):
        shared = rows.sparkSession.sparkContext.broadcast(model)

        def run(batches: Iterator[dict[str, list]], shared=shared) -> Iterator[dict[str, list]]:
            total = np.zeros((2 + states + size, states))
            for x in batches:
                if x["symbols"]:
                    starts, steps, emits, log = expected(shared.value, [np.frombuffer(s, kind) for s in x["symbols"]])
                    total[0] += starts
                    total[1 : 1 + states] += steps
                    total[1 + states : -1] += emits
                    total[-1, 0] += log
            used = np.flatnonzero(total.any(axis=1))
            yield {"place": used} | {c: total[used, i] for i, c in enumerate(columns)}

        got = map_rows(own, run, "place long," + ",".join(f"{c} double" for c in columns))
        sums: pd.DataFrame = got.groupBy("place").agg(*[F.sum(c).alias(c) for c in columns]).toPandas()
        total = np.zeros((2 + states + size, states))
        total[sums["place"].to_numpy(np.int64)] = sums[columns].to_numpy()
        model = estimate(total[0], total[1 : 1 + states], total[1 + states : -1], known.share)
        shared.unpersist()
        if before is not None and total[-1, 0] - before < SETTLED * known.tokens:
            break
        before = total[-1, 0]
    return model


def score(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", states: int = STATES, rounds: int = ROUNDS, head: int = HEAD, symbols: int = SYMBOLS) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score (log10 probabilities of the whole text).

    Training texts are those in no held-out fold (null ids among them). A null or empty text is the end token alone.
    Rows that repeat count each, and each is returned; an empty table gives none; without training texts every token is
    unknown. Texts of any length are scored whole. Only the two named columns are read.
    """
    space = Workspace(docs.sparkSession, "hmm")
    base = id_text(docs, id_col, text_col)
    counts = space.save(token_counts(base), "counts")
    known = vocabulary(counts, head=head, symbols=symbols)
    rows = space.save(symbols_of(base, known), "rows")
    model = train(rows, known, states=states, rounds=rounds)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = "<u2" if len(known.share) < 65_536 else "<u4"
    n_all, v = known.tokens, known.distinct

    def run(batches: Iterator[dict[str, list]]) -> Iterator[dict[str, list]]:
        divisor = float(np.log10(n_all + 0.5 * (v + 1)))
        for x in batches:
            found = likelihood(shared.value, [np.frombuffer(s, kind) for s in x["symbols"]]) + np.array(x["class_log"])
            yield {c: x[c] for c in ("row", "doc_id", "held_out", "n_tokens", "head_known")} | {"base": np.array(x["head_log"]) - np.array(x["n_tokens"]) * divisor, "model": found}

    scored = map_rows(rows.drop("rest", "times"), run, "row long,doc_id long,held_out boolean,n_tokens long,head_known long,base double,model double")
    pairs = rows.where(F.size("rest") > 0).select("row", F.explode(F.arrays_zip("rest", "times")).alias("x")).select("row", F.col("x.rest").alias("token"), F.col("x.times").alias("times"))
    met = pairs.join(counts.select("token", "c"), "token", "left").withColumn("c", F.coalesce("c", F.lit(0)))
    rest = met.groupBy("row").agg(F.sum(F.col("times") * F.log10(F.col("c") + 0.5)).alias("log"), F.sum(F.when(F.col("c") > 0, F.col("times")).otherwise(0)).alias("known"))
    log = F.coalesce("log", F.lit(0.0))
    return scored.join(rest, "row", "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("head_known") + F.coalesce("known", F.lit(0))).alias("n_known"), F.lit(n_all).cast("long").alias("train_tokens"),
        (F.col("base") + log).alias("base_score"), (F.col("model") + log).alias("score"),
    )
