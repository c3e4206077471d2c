"""Language-model scores (operator 6): a hidden Markov model trained by Baum-Welch.

Tokens are runs of bytes other than ASCII white space, with A-Z in lower case, and an end after every text.

1. *Counts.*  Every training token is counted.  The ``HEAD`` most frequent words are symbols of their own; any other
   word is one of ``TAIL`` symbols, by its last three bytes and its length.  A word's probability given its symbol is
   (c + 0.1) / (C + 0.1 (V + 1)) with the symbol's C tokens and V words; words never seen share the rest.
2. *Start.*  The ``START`` most frequent words are grouped by the documents they share (counted over all training
   documents); each group is the start of a state.
3. *Baum-Welch.*  Each of ``ROUNDS`` rounds runs the scaled forward and backward recursions over all training texts;
   expected counts are summed within each task, then across partitions, and make the next parameters.  For training
   only, texts are cut into sequences of at most ``CUT`` tokens.
4. *Scores.*  The scaled forward recursion gives the exact likelihood of each whole text.  The pieces of a long text
   are taken as transfer matrices side by side and multiplied in order, which is the same recursion.

The driver holds the model: HEAD + TAIL + 1 symbols by ``STATES`` states, whatever the input.  The counts of all words
stay distributed; rare words meet them in a join by hash, summed per document.

Results for odd input: a null text is empty: one token, the end; a null ``doc_id`` is a training row; rows that come
twice are scored alike, and count twice in training; an empty table gives an empty result, and without training text
every probability comes from the smoothing; columns other than doc_id and text are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldlens.llm.common import Words, materialize, released_shuffles, signed, text_bytes, text_chunks

HEAD, TAIL, STATES = 1 << 15, 1 << 10, 8
START, ROUNDS, CUT = 256, 4, 512
GROUP_TOKENS = 1 << 19
ADD = 0.1
SMOOTH = 100.0
FLUSH = 1 << 20
END = HEAD + TAIL


# ---------------------------------------------------------------- counts and symbols

def _words(column: pa.Array) -> tuple[Words, np.ndarray]:
    """The words and the tail symbol of each."""
    words = Words(*text_bytes(column), fold=True)
    tail = np.zeros(len(words), dtype=np.uint64)
    for k in (3, 2, 1):
        at = words.end - k
        tail = tail << np.uint64(8) | np.where(at >= words.start, words.data[np.maximum(at, 0)], 0).astype(np.uint64)
    tail = tail * np.uint64(8) + np.minimum((words.end - words.start) >> 2, 7).astype(np.uint64)
    return words, ((tail * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - 10)).astype(np.int64)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[tuple[np.ndarray, ...]] = []

    def merged() -> tuple[np.ndarray, ...]:
        h, t, n = (np.concatenate(x) for x in zip(*held))
        h, lead, inverse = np.unique(h, return_index=True, return_inverse=True)
        return h, t[lead], np.bincount(inverse, n).astype(np.int64)

    def batch() -> pa.RecordBatch:
        h, t, n = merged()
        return pa.RecordBatch.from_arrays([pa.array(signed(h)), pa.array(t.astype(np.int32)), pa.array(n)], ["h", "tail", "c"])

    for chunk in text_chunks(batches):
        words, tail = _words(chunk.column("text"))
        held.append((words.code, tail, np.ones(len(words), dtype=np.int64)))
        if sum(len(x[0]) for x in held) > FLUSH:
            held = [merged()]
            if len(held[0][0]) > FLUSH // 2:
                yield batch()
                held = []
    if held:
        yield batch()


def _encode(head: np.ndarray):
    """The symbols of each text, without the end, as 16-bit numbers."""
    order = np.argsort(head)
    ranked = head[order]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in text_chunks(batches):
            words, symbol = _words(chunk.column("text"))
            symbol = symbol + HEAD
            if len(ranked):
                at = np.minimum(np.searchsorted(ranked, words.code), len(ranked) - 1)
                hit = ranked[at] == words.code
                symbol[hit] = order[at[hit]]
            raw = symbol.astype(np.uint16).tobytes()
            codes = [raw[2 * a: 2 * b] for a, b in zip(words.first[:-1].tolist(), words.first[1:].tolist())]
            out = chunk.drop_columns(["text"]).append_column("n_tokens", pa.array(np.diff(words.first) + 1, pa.int64()))
            yield out.append_column("codes", pa.array(codes, pa.binary()))

    return run


def _rare(head: np.ndarray):
    """(h, row, times and tail symbol) of the words of each text that are not in the head."""
    ranked = np.sort(head)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in text_chunks(batches):
            words, tail = _words(chunk.column("text"))
            rare = np.ones(len(words), dtype=bool)
            if len(ranked):
                rare = ranked[np.minimum(np.searchsorted(ranked, words.code), len(ranked) - 1)] != words.code
            h, doc, tail = words.code[rare], words.doc[rare], tail[rare]
            order = np.lexsort((h, doc))
            h, doc, tail = h[order], doc[order], tail[order]
            new = np.ones(len(h), dtype=bool)
            new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
            first = np.flatnonzero(new)
            times = np.diff(np.append(first, len(h)))
            yield pa.RecordBatch.from_arrays(
                [pa.array(signed(h[first])), pa.array(np.asarray(chunk.column("row"))[doc[first]]),
                 pa.array(times << 10 | tail[first])], ["h", "row", "times"])

    return run


# ---------------------------------------------------------------- recursions

def _sequences(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All symbols with an end after each text, and the offsets of the texts."""
    size = np.asarray(pc.binary_length(column), dtype=np.int64) // 2
    offsets = np.concatenate(([0], np.cumsum(size + 1)))
    flat = np.full(offsets[-1], END, dtype=np.int64)
    inner = np.ones(offsets[-1], dtype=bool)
    inner[offsets[1:] - 1] = False
    flat[inner] = np.frombuffer(b"".join(column.to_pylist()), dtype=np.uint16)
    return flat, offsets


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    yield from text_chunks(batches, "codes", 2 * GROUP_TOKENS)


def _pieces(offsets: np.ndarray, cut: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, length, text) of the pieces of at most ``cut`` symbols of each text, in order."""
    n = np.diff(offsets)
    parts = -(-n // cut)
    of = np.repeat(np.arange(len(n)), parts)
    shift = (np.arange(len(of)) - np.repeat(np.cumsum(parts) - parts, parts)) * cut
    return offsets[of] + shift, np.minimum(cut, n[of] - shift), of


def expected_counts(symbols: np.ndarray, start: np.ndarray, size: np.ndarray, first: np.ndarray, move: np.ndarray,
                    emit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """Expected counts of first states, moves and emissions of some sequences, and their log likelihood.

    Sequences are taken side by side, longest first, so that those still running are a prefix at every step.
    """
    order = np.argsort(-size, kind="stable")
    start, size = start[order], size[order]
    running = np.searchsorted(-size, -np.arange(size[0]), side="left")  # sequences longer than t
    states = len(first)
    at = np.concatenate(([0], np.cumsum(running)))
    seen = np.empty(at[-1], dtype=np.int64)
    alpha, scale = np.empty((at[-1], states)), np.empty(at[-1])
    before = None
    for t, n in enumerate(running):
        seen[at[t]: at[t + 1]] = x = symbols[start[:n] + t]
        a = (first[None, :] if before is None else before[:n] @ move) * emit[x]
        total = a.sum(axis=1)
        before = a / total[:, None]
        alpha[at[t]: at[t + 1]], scale[at[t]: at[t + 1]] = before, total
    moves = np.zeros((states, states))
    beta = np.ones((running[-1], states))
    gamma = alpha  # replaced from the end
    for t in range(len(running) - 1, 0, -1):
        n, m = running[t], running[t - 1]
        here = slice(at[t], at[t + 1])
        ahead = beta * emit[seen[here]] / scale[here][:, None]
        past = alpha[at[t - 1]: at[t - 1] + n]
        moves += move * (past.T @ ahead)
        gamma[here] *= beta
        beta = np.concatenate([ahead @ move.T, np.ones((m - n, states))]) if m > n else ahead @ move.T
    gamma[: at[1]] *= beta
    emitted = np.stack([np.bincount(seen, gamma[:, k], minlength=len(emit)) for k in range(states)], axis=1)
    return gamma[: at[1]].sum(axis=0), moves, emitted, float(np.log(scale).sum())


def log_likelihoods(symbols: np.ndarray, offsets: np.ndarray, first: np.ndarray, move: np.ndarray,
                    emit: np.ndarray, cut: int = CUT) -> np.ndarray:
    """Exact natural log likelihood of each text by the scaled forward recursion.

    The first piece of a text carries a row of state probabilities, each other piece a matrix (where it leads from
    each state); both run side by side and meet in order.
    """
    start, size, of = _pieces(offsets, cut)
    leading = np.ones(len(of), dtype=bool)
    leading[1:] = of[1:] != of[:-1]
    states = len(first)
    result, log = np.empty((len(of), states, states)), np.zeros(len(of))
    for lead in (True, False):
        own = np.flatnonzero(leading == lead)
        if not len(own):
            continue
        own = own[np.argsort(-size[own], kind="stable")]
        rows = 1 if lead else states
        a = np.zeros((len(own), rows, states))
        running = np.searchsorted(-size[own], -np.arange(size[own[0]]), side="left")
        for t, n in enumerate(running):
            e = emit[symbols[start[own[:n]] + t]][:, None, :]
            if t == 0:
                a = (np.broadcast_to(first, (n, 1, states)) if lead else np.broadcast_to(move, (n, states, states))) * e
            else:
                a[:n] = (a[:n].reshape(-1, states) @ move).reshape(n, rows, states) * e
            total = a[:n].sum(axis=(1, 2))
            a[:n] /= total[:, None, None]
            log[own[:n]] += np.log(total)
        result[own, :rows] = a
    total = np.bincount(of, log, minlength=len(offsets) - 1)
    place = np.arange(len(of)) - np.flatnonzero(leading)[np.cumsum(leading) - 1]
    state = result[leading, 0]
    for p in range(1, int(place.max(initial=0)) + 1):
        piece = np.flatnonzero(place == p)
        texts = of[piece]
        v = np.einsum("ni,nij->nj", state[texts], result[piece])
        norm = v.sum(axis=1)
        state[texts] = v / norm[:, None]
        total[texts] += np.log(norm)
    return total


# ---------------------------------------------------------------- training

def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """In how many texts two of the START first symbols occur together."""
    total = np.zeros((START, START), dtype=np.float64)
    for group in _groups(batches):
        symbols, offsets = _sequences(group.column("codes"))
        doc = np.repeat(np.arange(len(group)), np.diff(offsets))
        near = symbols < START
        x = np.zeros((len(group), START), dtype=np.float32)
        x[doc[near], symbols[near]] = 1
        total += x.T @ x
    yield pa.RecordBatch.from_arrays([pa.array(np.arange(START * START)), pa.array(total.ravel())], ["cell", "n"])


def word_groups(shared: np.ndarray, n: int) -> np.ndarray:
    """Spherical k-means of words by the words they share documents with, from the farthest words on."""
    size = np.sqrt(np.maximum(np.diag(shared), 1))
    x = shared / size[:, None] / size[None, :]
    x = x - x.mean(axis=0)
    x /= np.maximum(np.sqrt((x * x).sum(axis=1, keepdims=True)), 1e-12)
    chosen = [0]
    while len(chosen) < n:
        chosen.append(int(np.argmin((x @ x[chosen].T).max(axis=1))))
    centre = x[chosen]
    for _ in range(20):
        group = np.argmax(x @ centre.T, axis=1)
        for k in range(n):
            if (group == k).any():
                c = x[group == k].sum(axis=0)
                centre[k] = c / max(np.sqrt((c * c).sum()), 1e-12)
    return group


def _round(first: np.ndarray, move: np.ndarray, emit: np.ndarray):
    """Expected counts of a task: a row for each symbol, then one for each state's moves, one for the first states."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        states = len(first)
        total = np.zeros((len(emit) + states + 1, states))
        for group in _groups(batches):
            symbols, offsets = _sequences(group.column("codes"))
            start, size, _ = _pieces(offsets, CUT)
            if not len(start):
                continue
            begin, moves, emitted, _ = expected_counts(symbols, start, size, first, move, emit)
            total[: len(emit)] += emitted
            total[len(emit): -1] += moves
            total[-1] += begin
        at = np.flatnonzero(total.any(axis=1))
        yield pa.RecordBatch.from_arrays(
            [pa.array(at)] + [pa.array(np.ascontiguousarray(total[at, k])) for k in range(states)],
            ["line", *(f"s{k}" for k in range(states))])

    return run


def _collected(df: DataFrame) -> list:
    """Rows of a table of bounded size."""
    with released_shuffles(df.sparkSession):
        return df.collect()


def train(codes: DataFrame, unigram: np.ndarray, states: int = STATES, rounds: int = ROUNDS) -> tuple[np.ndarray, ...]:
    """(first, move, emit) from the symbol sequences of the training texts; ``unigram``: probability of each symbol."""
    shared = np.zeros(START * START)
    for cell, n in _collected(codes.select("codes").mapInArrow(_shared, "cell long, n double").groupBy("cell").agg(F.sum("n"))):
        shared[cell] = n
    group = word_groups(shared.reshape(START, START), states)
    emit = np.repeat(unigram[:, None], states, axis=1)
    emit[:START] *= np.where(group[:, None] == np.arange(states), 1.0, 0.02)
    emit /= emit.sum(axis=0)
    first = np.full(states, 1 / states)
    move = np.full((states, states), 0.1 / states) + 0.9 * np.eye(states)
    schema = "line long, " + ", ".join(f"s{k} double" for k in range(states))
    for _ in range(rounds):
        total = np.zeros((len(emit) + states + 1, states))
        sums = codes.select("codes").mapInArrow(_round(first, move, emit), schema)
        for row in _collected(sums.groupBy("line").agg(*[F.sum(f"s{k}") for k in range(states)])):
            total[row[0]] = row[1:]
        emit = total[: len(emit)] + SMOOTH * unigram[:, None]
        emit /= emit.sum(axis=0)
        move = total[len(emit): -1] + 1
        move /= move.sum(axis=1, keepdims=True)
        first = total[-1] + 1
        first /= first.sum()
    return first, move, emit


# ---------------------------------------------------------------- scores

def _score(first: np.ndarray, move: np.ndarray, emit: np.ndarray, base: np.ndarray):
    """Likelihood of the symbols, and base score and number of the tokens whose word is known from its symbol."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _groups(batches):
            symbols, offsets = _sequences(group.column("codes"))
            like = log_likelihoods(symbols, offsets, first, move, emit) / np.log(10)
            doc = np.repeat(np.arange(len(group)), np.diff(offsets))
            own = (symbols < HEAD) | (symbols == END)
            n = np.bincount(doc[own], minlength=len(group))
            known = base[END + 1] * np.bincount(doc[symbols == END], minlength=len(group))  # an end is known if trained
            out = group.drop_columns(["codes"])
            for name, values in (("like", like), ("head_base", np.bincount(doc[own], base[symbols[own]], minlength=len(group))),
                                 ("head_known", (n - 1 + known).astype(np.int64))):
                out = out.append_column(name, pa.array(values))
            yield out

    return run


def score(docs: DataFrame, folds: int = 10, held_out: int = 0, head: int = HEAD, states: int = STATES,
          rounds: int = ROUNDS) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every row of ``docs``."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % folds == held_out, F.lit(False))
    rows = docs.select("doc_id", out.alias("held_out"), F.xxhash64("doc_id", text).alias("row"), text.alias("text"))

    counts = materialize(rows.where("not held_out").select("text").mapInArrow(_count, "h long, tail int, c long")
                         .groupBy("h").agg(F.first("tail").alias("tail"), F.sum("c").alias("c")), "words")
    top = counts.orderBy(F.desc("c"), "h").limit(head).collect()
    of_head = np.array([r["h"] for r in top], dtype=np.int64).view(np.uint64)
    trained = counts.agg(F.count("*").alias("v"), F.sum("c").alias("n")).first()
    ends = rows.where("not held_out").count()
    n_all, v_all = (trained["n"] or 0) + ends, trained["v"] + (ends > 0)
    rare = counts.join(F.broadcast(docs.sparkSession.createDataFrame([(r["h"],) for r in top], "h long")), "h", "left_anti")
    rare = materialize(rare, "rare")
    tails = np.zeros((TAIL, 2))
    for t, c, v in rare.groupBy("tail").agg(F.sum("c"), F.count("*")).collect():  # at most TAIL rows
        tails[t] = c, v

    unigram = np.full(END + 1, ADD)
    unigram[: len(top)] += [r["c"] for r in top]
    unigram[len(top): HEAD] = 0  # symbols without a word
    unigram[HEAD:END] += tails[:, 0]
    unigram[END] += ends
    below = n_all + ADD * (v_all + 1)
    base = np.append(np.log10(np.maximum(unigram, ADD) / below), float(ends > 0))
    unigram /= unigram.sum()

    codes = materialize(rows.mapInArrow(_encode(of_head), "doc_id long, held_out boolean, row long, n_tokens long, codes binary"), "codes")
    model = train(codes.where("not held_out"), unigram, states, rounds)
    scored = materialize(codes.mapInArrow(_score(*model, base), "doc_id long, held_out boolean, row long, n_tokens long, "
                                                               "like double, head_base double, head_known long"), "scores")

    times, tail = F.shiftright("times", 10), F.col("times").bitwiseAND(F.lit(TAIL - 1)).cast("int")
    c = F.coalesce(F.col("c"), F.lit(0)) + F.lit(ADD)
    within = F.array(*[F.lit(float(x)) for x in tails[:, 0] + ADD * (tails[:, 1] + 1)])
    words = (rows.select("row", "text").mapInArrow(_rare(of_head), "h long, row long, times long")
             .join(rare.select("h", "c"), "h", "left")
             .select("row", (times * F.log10(c / F.lit(float(below)))).alias("base"),
                     (times * F.log10(c / F.get(within, tail))).alias("like"),
                     F.when(F.col("c").isNotNull(), times).otherwise(0).alias("known"))
             .groupBy("row").agg(F.sum("base").alias("rare_base"), F.sum("like").alias("rare_like"), F.sum("known").alias("rare_known")))
    copies = scored.groupBy("row").agg(F.count("*").alias("copies"))  # rows that come twice were summed twice
    each = materialize(words.join(copies, "row").select(
        "row", *[(F.col(k) / F.col("copies")).alias(k) for k in ("rare_base", "rare_like", "rare_known")]), "rare")
    zero = lambda k: F.coalesce(F.col(k), F.lit(0.0))
    return scored.join(each, "row", "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("head_known") + F.round(zero("rare_known")).cast("long")).alias("n_known"),
        F.lit(n_all).cast("long").alias("train_tokens"), (F.col("head_base") + zero("rare_base")).alias("base_score"),
        (F.col("like") + zero("rare_like")).alias("score"))


def lm_score_query(spark, sf_dir: str) -> DataFrame:
    return score(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
