"""A hidden Markov language model: Baum-Welch over partitions, exact likelihoods by forward recursion.

Tokens are the words of a text (ASCII letters lower-cased, split at ASCII white space) and one end.
A state emits a *symbol*: the end and every word with more than 1 / OWN of all training tokens, OWN at
most by that very rule, are symbols of their own; any other word's symbol is its class, its CRC-32 modulo
CLASSES, and the class emits the word by its training count: P(word | class) = (c + 1) / (n + v + 1) for the
n tokens and v distinct words that training saw in the class, so one part is left for words it never saw.
The parameters, (OWN + CLASSES) times STATES numbers at most, have a bounded size however large the
vocabulary is; the word counts cover all training texts and stay distributed.

* Counting: each task counts its words and hands out what it holds when that grows large.
* Words with more than 1 / FREQUENT of all training tokens, FREQUENT at most by that very rule, are
  broadcast. The others are counted per text and joined by word, where no key can be hot.
* Texts are encoded once, as 32-bit symbols, to a table in the shared folder.
* Start: the 64 most frequent symbols' co-occurrence in windows of WINDOW tokens; states begin as the
  neighbourhoods of those that differ most.
* ROUNDS of Baum-Welch: each task runs scaled forward and backward recursions over all its windows
  and emits expected counts by symbol, which are summed by symbol and smoothed by the symbols' own
  distribution. Training cuts texts into windows, whose first tokens have start probabilities of
  their own; scoring does not.
* Scoring: the scaled forward recursion over each whole text, all texts of a batch in step.

Defined results: a null or empty text is its end alone; a row without doc_id counts as the text "" for
the split and is returned with a null id; repeated rows are each counted and scored; without training
rows, counts are empty and the model is uniform. Other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import broadcast_value, doc_columns, materialize

STATES, CLASSES, OWN, FREQUENT, WINDOW, ROUNDS = 8, 1 << 16, 1 << 17, 1 << 19, 128, 4
#: Weight, in tokens, of the symbols' overall distribution in each state's emissions.
PRIOR = 2000.0
TOP = 64
#: The end as a token, symbol 0: no word holds a blank.
END = b" "
#: Distinct words that a counting task holds, windows and tokens that a scoring task works on at a time.
HELD, LANES, TOKENS = 300_000, 4096, 1 << 21


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 7 == 2


def count_words(docs: DataFrame) -> DataFrame:
    """token and c over the given texts, ends included."""

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())], names=["token", "n"])

        for batch in batches:
            for raw in batch.column(1).to_pylist():
                if raw:
                    counts.update(raw.lower().split())
                if len(counts) > HELD:
                    yield out()
                    counts = Counter()
            counts[END] += batch.num_rows
        yield out()

    return doc_columns(docs).mapInArrow(step, "token binary, n long").where("n > 0").groupBy("token").agg(F.sum("n").alias("c"))


_ENCODED = "doc_id long, held_out boolean, row long, n_tokens long, n_known long, log_count double, symbols binary, rare array<struct<token:binary,n:int>>"
_RARE = pa.list_(pa.struct([("token", pa.binary()), ("n", pa.int32())]))


def encode(docs: DataFrame, frequent) -> DataFrame:
    """Each text as symbols; counts of its frequent words are summed up, its other words listed. ``frequent``
    holds the frequent words, the end and those with symbols of their own first, their counts, and how many
    have symbols of their own."""

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        words, counts, own = frequent.value
        number = dict(zip(words, range(len(words))))
        symbol = np.array([i if i < own else own + zlib.crc32(w) % CLASSES for i, w in enumerate(words)] + [0], np.uint32)
        logs, seen = np.append(np.log10(counts + 1.0), 0.0), np.append(counts > 0, False)
        row = TaskContext.get().partitionId() << 40
        for batch in batches:
            n, known, log, symbols, rare = [], [], [], [], []
            for raw in batch.column(1).to_pylist():
                tokens = raw.lower().split() if raw else []
                tokens.append(END)
                ids = np.array([number.get(w, -1) for w in tokens], np.int64)
                other = np.flatnonzero(ids < 0).tolist()
                line = symbol[ids]
                if other:
                    line[other] = [own + zlib.crc32(tokens[i]) % CLASSES for i in other]
                n.append(len(tokens))
                known.append(int(seen[ids].sum()))
                log.append(float(logs[ids].sum()))
                symbols.append(line.astype("<u4").tobytes())
                rare.append([{"token": w, "n": k} for w, k in Counter(tokens[i] for i in other).items()])
            arrays = [batch.column(0), batch.column(2), pa.array(np.arange(row, row + len(n))), pa.array(n, pa.int64()), pa.array(known, pa.int64()), pa.array(log, pa.float64()), pa.array(symbols, pa.binary()), pa.array(rare, _RARE)]
            row += len(n)
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "held_out", "row", "n_tokens", "n_known", "log_count", "symbols", "rare"])

    return doc_columns(docs, held_out(docs["doc_id"]).alias("held_out")).mapInArrow(step, _ENCODED)


@dataclass
class Model:
    """start: first token of a text, of a later window; trans: state to state; emit: symbol by state."""

    start: np.ndarray
    trans: np.ndarray
    emit: np.ndarray


def _gather(batches: Iterator[pa.RecordBatch], tokens: int) -> Iterator[list[np.ndarray]]:
    """Symbol arrays of many texts at a time."""
    held, size = [], 0
    for batch in batches:
        for raw in batch.column(0).to_pylist():
            held.append(np.frombuffer(raw, "<u4"))
            size += len(held[-1])
            if size > tokens:
                yield held
                held, size = [], 0
    if held:
        yield held


def _windows(lines: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """All tokens in a row; start, length and is-first of each window."""
    sizes = np.array([len(x) for x in lines])
    flat = np.concatenate(lines).astype(np.int64)
    count = -(-sizes // WINDOW)
    first = np.cumsum(count) - count
    within = np.arange(count.sum()) - np.repeat(first, count)
    ends = np.repeat(np.cumsum(sizes), count)
    starts = np.repeat(np.cumsum(sizes) - sizes, count) + within * WINDOW
    return flat, starts, np.minimum(WINDOW, ends - starts), within == 0


def co_occurrence(encoded: DataFrame, top: list[int], symbols: int) -> np.ndarray:
    """How often two of the symbols in ``top`` meet in a window."""
    place = np.full(symbols, -1)
    place[top] = np.arange(len(top))
    size = len(top)

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((size, size))
        for lines in _gather(batches, TOKENS):
            flat, _, lengths, _ = _windows(lines)
            at, window = place[flat], np.repeat(np.arange(len(lengths)), lengths)
            here = at >= 0
            table = np.bincount(window[here] * size + at[here], minlength=len(lengths) * size).reshape(-1, size).astype(float)
            total += table.T @ table
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(size * size), pa.int32()), pa.array(total.ravel())], names=["pair", "n"])

    pairs = encoded.where("not held_out").select("symbols").mapInArrow(step, "pair int, n double").groupBy("pair").agg(F.sum("n").alias("n"))
    out = np.zeros(size * size)
    for r in pairs.collect():  # TOP * TOP rows
        out[r["pair"]] = r["n"]
    return out.reshape(size, size)


def initial(met: np.ndarray, top: list[int], overall: np.ndarray) -> Model:
    """States as the neighbourhoods of the symbols in ``top`` that differ most from one another."""
    rows = (met + 1e-3) / (met + 1e-3).sum(1, keepdims=True)
    shape = np.sqrt(rows)
    chosen = [0]
    while len(chosen) < STATES:
        distance = np.min([((shape - shape[c]) ** 2).sum(1) for c in chosen], axis=0)
        chosen.append(int(np.argmax(distance)) if distance.max() > 0 else len(chosen) % len(top))
    emit = np.repeat(overall[:, None], STATES, axis=1)
    share = overall[top].sum()
    emit[top] = 0.2 * emit[top] + 0.8 * share * rows[chosen].T
    trans = np.full((STATES, STATES), 0.1 / STATES) + 0.9 * np.eye(STATES)
    return Model(np.full((2, STATES), 1 / STATES), trans, emit / emit.sum(0))


def expected_counts(lines: list[np.ndarray], model: Model) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Expected starts, transitions and emissions over the windows of some texts."""
    emit, trans = model.emit.astype(np.float32), model.trans.astype(np.float32)
    starts_out, moves, out = np.zeros((2, STATES)), np.zeros((STATES, STATES)), np.zeros(emit.shape)
    flat, all_starts, all_lengths, all_first = _windows(lines)
    order = np.argsort(-all_lengths, kind="stable")
    for lo in range(0, len(order), LANES):
        own = order[lo : lo + LANES]
        starts, lengths, first = all_starts[own], all_lengths[own], all_first[own]
        active = len(own) - np.searchsorted(lengths[::-1], np.arange(lengths[0]), side="right")  # lanes longer than t
        seen, alphas, weights = [], [], []
        for t, n in enumerate(active):
            x = flat[starts[:n] + t]
            b = emit[x]
            a = (np.where(first[:n, None], model.start[0], model.start[1]).astype(np.float32) if t == 0 else alphas[-1][:n] @ trans) * b
            c = 1 / a.sum(1, keepdims=True)
            a *= c
            b *= c
            seen.append(x)
            alphas.append(a)
            weights.append(b)
        after, gammas = None, [None] * len(active)
        for t in range(len(active) - 1, -1, -1):
            beta = np.ones((active[t], STATES), np.float32)
            if after is not None:
                w = weights[t + 1]
                w *= after
                beta[: active[t + 1]] = w @ trans.T
                moves += alphas[t][: active[t + 1]].T @ w
            after = beta
            gammas[t] = alphas[t] * beta
        starts_out += np.stack([gammas[0][first].sum(0), gammas[0][~first].sum(0)])
        x, g = np.concatenate(seen), np.concatenate(gammas)
        for k in range(STATES):
            out[:, k] += np.bincount(x, weights=g[:, k], minlength=len(emit))
    return starts_out, moves * model.trans, out


def train_round(encoded: DataFrame, model: Model, overall: np.ndarray) -> Model:
    """One Baum-Welch step over all training windows. Sums come back by symbol: OWN + CLASSES + STATES + 2
    rows at most."""
    symbols = len(overall)
    handle = broadcast_value(encoded.sparkSession, model)

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for lines in _gather(batches, TOKENS):
            part = expected_counts(lines, handle.value)
            total = part if total is None else tuple(a + b for a, b in zip(total, part))
        if total is not None:
            rows = np.concatenate([total[2], total[1], total[0]])
            at = np.flatnonzero(rows.any(axis=1))
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), *(pa.array(rows[at, k]) for k in range(STATES))], names=["at", *(f"k{k}" for k in range(STATES))])

    schema = "at int, " + ", ".join(f"k{k} double" for k in range(STATES))
    sums = encoded.where("not held_out").select("symbols").mapInArrow(step, schema).groupBy("at").agg(*(F.sum(f"k{k}").alias(f"k{k}") for k in range(STATES)))
    rows = np.zeros((symbols + STATES + 2, STATES))
    for r in sums.toArrow().to_batches():
        rows[r.column(0).to_numpy()] = np.stack([r.column(k + 1).to_numpy() for k in range(STATES)], axis=1)
    handle.unpersist()
    emit = rows[:symbols] + PRIOR * overall[:, None]
    trans, start = rows[symbols : symbols + STATES] + 1, rows[symbols + STATES :] + 1
    return Model(start / start.sum(1, keepdims=True), trans / trans.sum(1, keepdims=True), emit / emit.sum(0))


def log_likelihoods(lines: list[np.ndarray], model: Model) -> np.ndarray:
    """log10 of each text's probability, by one scaled forward recursion over all texts in step."""
    sizes = np.array([len(x) for x in lines])
    order = np.argsort(-sizes, kind="stable")
    sizes = sizes[order]
    flat = np.concatenate([lines[i] for i in order])
    starts = np.cumsum(sizes) - sizes
    active = len(sizes) - np.searchsorted(sizes[::-1], np.arange(sizes[0]), side="right")
    total = np.zeros(len(sizes))
    a = None
    for t, n in enumerate(active.tolist()):
        b = model.emit[flat[starts[:n] + t]]
        b *= model.start[0] if a is None else a[:n] @ model.trans
        s = b.sum(1)
        b /= s[:, None]
        total[:n] += np.log(s)
        a = b
    out = np.zeros(len(sizes))
    out[order] = total / np.log(10)
    return out


def score_symbols(encoded: DataFrame, model: Model) -> DataFrame:
    """row and log10 of the symbol sequence's probability, words included up to their counts."""
    handle = broadcast_value(encoded.sparkSession, model)

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, lines, size = [], [], 0

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(log_likelihoods(lines, handle.value))], names=["row", "log_symbols"])

        for batch in batches:
            for row, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids.append(row)
                lines.append(np.frombuffer(raw, "<u4"))
                size += len(lines[-1])
                if size > TOKENS:
                    yield out()
                    ids, lines, size = [], [], 0
        if ids:
            yield out()

    return encoded.select("row", "symbols").mapInArrow(step, "row long, log_symbols double")


def score(docs: DataFrame, rounds: int = ROUNDS, frequent: int = FREQUENT, own: int = OWN) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every row. ``own``, no more than
    ``frequent``, and ``frequent`` bound the words with symbols of their own and those that are broadcast."""
    spark = docs.sparkSession
    counts = materialize(count_words(docs.where(~held_out(docs["doc_id"]))), "counts")
    n, v = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    is_own = (F.col("c") > n // own) | (F.col("token") == F.lit(END))
    known = counts.where((F.col("c") > n // frequent) | is_own).toArrow()  # ``frequent`` words and the end at most, as their counts sum to n at most
    ranked = sorted(zip(known.column(0).to_pylist(), known.column(1).to_pylist()), key=lambda w: (w[0] != END, -w[1], w[0]))
    if not ranked:
        ranked = [(END, 0)]
    words, seen = [w for w, _ in ranked], np.array([c for _, c in ranked])
    n_own = sum(w == END or c > n // own for w, c in ranked)
    encoded = materialize(encode(docs, broadcast_value(spark, (words, seen, n_own))), "symbols")

    symbols = n_own + CLASSES
    parts = np.ones(symbols)  # of a class: one part is left for words that training never saw
    parts[:n_own] = seen[:n_own] + 1
    for at, tokens, distinct in counts.where(~is_own).groupBy((F.crc32("token") % CLASSES).cast("int").alias("at")).agg(F.sum("c"), F.count("*")).collect():  # CLASSES rows at most
        parts[n_own + at] += tokens + distinct
    overall = parts / parts.sum()
    top = np.argsort(-parts, kind="stable")[:TOP].tolist()
    model = initial(co_occurrence(encoded, top, symbols), top, overall)
    for _ in range(rounds):
        model = train_round(encoded, model, overall)
    words_too = Model(model.start, model.trans, model.emit / parts[:, None])

    rare = encoded.select("row", F.explode("rare").alias("w")).select("row", "w.token", "w.n").join(counts, "token", "left")
    rare = rare.groupBy("row").agg(F.sum(F.col("n") * F.log10(F.coalesce("c", F.lit(0)) + 1.0)).alias("log_rare"), F.sum(F.when(F.col("c") > 0, F.col("n")).otherwise(0)).alias("known_rare"))
    out = encoded.drop("symbols", "rare").join(score_symbols(encoded, words_too), "row").join(rare, "row", "left")
    log_count = F.col("log_count") + F.coalesce("log_rare", F.lit(0.0))
    return out.select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("n_known") + F.coalesce("known_rare", F.lit(0))).cast("long").alias("n_known"),
        F.lit(int(n)).cast("long").alias("train_tokens"),
        (log_count - F.col("n_tokens") * float(np.log10(n + v + 1))).alias("base_score"),
        (log_count + F.col("log_symbols")).alias("score"),
    )
