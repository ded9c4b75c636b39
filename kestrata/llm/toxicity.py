"""Toxicity by a convolutional text classifier over hashed word embeddings.

A word is the sum of hashed embeddings of itself and of its first 4, 5 and 6
bytes, so that a stem is known under endings never seen.  Filters of widths 1,
2 and 3 run over the words, the maximum of each over the whole text feeds a
logistic output, and everything is trained in numpy by sparse Adagrad.  One in
``HELD_BACK`` of the training rows doesn't train but calibrates the score
(Platt) and sets a rejection threshold for each language; neither labels nor
lang, source or doc_id are inputs of a score.

Training uses every labelled row that isn't held out, as a whole text, one row
an id.  The rows are dealt to parts of bounded size.  The first part trains
alone; then, in each epoch, all parts go on from the same parameters, and what
they changed is averaged over the parts that changed it, slice by slice, off
the driver.  Calibration counts all rows kept back, by bins of their raw
score.  Scoring reads every whole text.

Defined results: null, empty and word-free texts get the score of no
evidence; without labels every score is 0; unlabelled languages and null use
the common threshold 0.3; repeated rows score alike; further columns are kept
by ``without_toxic``.
"""

from __future__ import annotations

import copy
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._sieve import may_join
from ._spark import cut, hinted
from ._text import U64, alnum_spans, chunks, fmix, hash_ranges, trimmed

PART_ROWS = 8_000  # that one task learns from
PART_BYTES = 32 << 20
BATCH_WORDS = 1 << 18
SLICES = 128  # of the embeddings, when parts are averaged
BIN = 1e-3  # of raw scores that are calibrated
BROADCAST_ROWS = 500_000
BUCKETS = 1 << 17
DIM = 8
FILTERS = 8
WIDTHS = (1, 2, 3)
STEMS = (4, 5, 6)
STEPS = 500  # of a batch, at least; a small sample is seen several times more
EPOCHS = (4, 15)
BATCH = 64
RATE = 0.15
HELD_BACK = 5  # one in so many training rows calibrates
COMMON = 0.3


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def features(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Embedding rows of every word (words x 4) and each document's first word, chunk by chunk."""
    for c in chunks(column):
        s, e, first = alnum_spans(c)
        h = c.prefix_hash(True)
        ids = np.empty((len(s), 1 + len(STEMS)), np.int32)
        for j, n in enumerate((None, *STEMS)):
            end = e if n is None else np.minimum(s + n, e)
            v = hash_ranges(h, s, end) + U64(j * 0x9E3779B97F4A7C15 % (1 << 64))
            ids[:, j] = (fmix(v) % U64(BUCKETS)).astype(np.int32)
        yield ids, first


@dataclass
class Model:
    table: np.ndarray = field(default_factory=lambda: np.zeros((BUCKETS, DIM), np.float32))
    taps: np.ndarray = field(default_factory=lambda: np.zeros((DIM, sum(WIDTHS) * FILTERS), np.float32))
    bias: np.ndarray = field(default_factory=lambda: np.zeros(len(WIDTHS) * FILTERS, np.float32))
    out: np.ndarray = field(default_factory=lambda: np.zeros(len(WIDTHS) * FILTERS, np.float32))
    shift: float = -4.0
    slope: float = 1.0
    offset: float = 0.0
    thresholds: dict[str, float] = field(default_factory=dict)
    trained: bool = False

    def pooled(self, ids: np.ndarray, first: np.ndarray, where: bool = False) -> tuple[np.ndarray, np.ndarray | None, np.ndarray | None]:
        """Pooled activations (documents x filters); with ``where`` also the word of each maximum, and the word vectors."""
        docs = len(first) - 1
        pool = np.zeros((docs, len(self.bias)), np.float32)
        filled = np.flatnonzero(first[1:] > first[:-1])
        if not len(filled):
            return pool, None, None
        x = self.table[ids[:, 0]]
        for j in range(1, ids.shape[1]):
            x += self.table[ids[:, j]]
        y = x @ self.taps
        z = np.empty((len(x), len(self.bias)), np.float32)
        tap = 0
        for k, w in enumerate(WIDTHS):
            part = z[:, k * FILTERS : (k + 1) * FILTERS]
            part[:] = y[:, tap * FILTERS : (tap + 1) * FILTERS]
            for j in range(1, w):
                step = y[j:, (tap + j) * FILTERS : (tap + j + 1) * FILTERS].copy()
                over = (first[1:][filled][:, None] - np.arange(1, j + 1)[None, :]).ravel()  # words whose tap lies behind their document
                over = over[(over >= 0) & (over < len(step))]
                step[over] = 0
                part[: len(x) - j] += step
            tap += w
        best = np.maximum.reduceat(z, first[:-1][filled], axis=0)
        pool[filled] = np.maximum(best + self.bias, 0)
        at = None
        if where:
            at = np.zeros((docs, len(self.bias)), np.int64)
            for d in filled:
                at[d] = first[d] + z[first[d] : first[d + 1]].argmax(axis=0)
        return pool, at, x

    def logit(self, ids: np.ndarray, first: np.ndarray) -> np.ndarray:
        return self.pooled(ids, first)[0] @ self.out + self.shift

    def scores(self, column: pa.Array) -> np.ndarray:
        parts = [self.logit(*f) for f in features(column)] if self.trained else []
        raw = np.concatenate(parts).astype(np.float64) if parts else np.full(len(column), -np.inf)
        return 1 / (1 + np.exp(-np.clip(self.slope * raw + self.offset, -50, 50))) if self.trained else np.zeros(len(column))


@dataclass
class State:
    """A model and the sums of squares that Adagrad divides by."""

    model: Model
    seen: list[np.ndarray]
    shift_seen: float = 1e-3


def _start(mean: float, seed: int) -> State:
    rng = np.random.default_rng(seed)
    m = Model(
        (rng.standard_normal((BUCKETS, DIM)) * 0.02).astype(np.float32),
        (rng.standard_normal((DIM, sum(WIDTHS) * FILTERS)) * 0.4).astype(np.float32),
        np.zeros(len(WIDTHS) * FILTERS, np.float32),
        (rng.standard_normal(len(WIDTHS) * FILTERS) * 0.3).astype(np.float32),
        trained=True,
    )
    m.shift = float(np.log((mean + 1e-3) / (1 - mean + 1e-3)))
    return State(m, [np.full(a.shape, 1e-3, np.float32) for a in (m.table, m.taps, m.bias, m.out)])


def _batches(order: np.ndarray, words: np.ndarray) -> Iterator[np.ndarray]:
    """Runs of ``order`` of ``BATCH`` documents, fewer where their words are very many."""
    lo = 0
    while lo < len(order):
        within = np.cumsum(words[order[lo : lo + BATCH]]) <= BATCH_WORDS
        hi = lo + max(1, int(within.sum()))
        yield order[lo:hi]
        lo = hi


def _fit(state: State, ids: list[np.ndarray], labels: np.ndarray, epochs: int, rng: np.random.Generator) -> None:
    """Train ``state`` in place."""
    m, seen = state.model, state.seen

    def step(i: int, a: np.ndarray, g: np.ndarray, rows=slice(None)) -> None:
        seen[i][rows] += g * g
        a[rows] -= RATE * g / np.sqrt(seen[i][rows])

    words = np.array([len(x) for x in ids])
    for _ in range(epochs):
        for pick in _batches(rng.permutation(len(labels)), words):
            some = [ids[i] for i in pick]
            first = np.concatenate([[0], np.cumsum([len(s) for s in some])])
            flat = np.concatenate(some)
            pool, at, x = m.pooled(flat, first, True)
            if at is None:
                continue
            p = 1 / (1 + np.exp(-(pool @ m.out + m.shift)))
            g = (p - labels[pick]).astype(np.float32) / len(pick)
            back = g[:, None] * m.out[None, :] * (pool > 0)
            step(3, m.out, pool.T @ g + 1e-4 * m.out)
            state.shift_seen += float(g.sum()) ** 2
            m.shift -= RATE * float(g.sum()) / np.sqrt(state.shift_seen)
            step(2, m.bias, back.sum(axis=0))
            taps, dx = np.zeros_like(m.taps), np.zeros_like(x)
            doc_end = first[1:]
            tap = 0
            for k, w in enumerate(WIDTHS):
                for f in range(FILTERS):
                    col = k * FILTERS + f
                    d = np.flatnonzero(back[:, col])
                    for j in range(w):
                        here = at[d, col] + j
                        ok = here < doc_end[d]
                        here, b = here[ok], back[d[ok], col]
                        c = (tap + j) * FILTERS + f
                        taps[:, c] += b @ x[here]
                        np.add.at(dx, here, b[:, None] * m.taps[:, c][None, :])
                tap += w
            step(1, m.taps, taps)
            touched = np.flatnonzero(np.abs(dx).sum(axis=1))
            rows, of = np.unique(flat[touched], return_inverse=True)
            gt = np.zeros((len(rows), DIM), np.float32)
            np.add.at(gt, of.ravel(), np.repeat(dx[touched], flat.shape[1], axis=0))
            step(0, m.table, gt, rows)


def _epochs(rows: int) -> int:
    return min(EPOCHS[1], max(EPOCHS[0], STEPS * BATCH // max(1, rows)))


def _flat(state: State) -> np.ndarray:
    """All but the embeddings, and what Adagrad divides them by."""
    m = state.model
    return np.concatenate([*[x.ravel() for x in (m.taps, m.bias, m.out, *state.seen[1:])], [m.shift, state.shift_seen]]).astype(np.float64)


def _changed(state: State, flat: np.ndarray, table: np.ndarray, seen: np.ndarray) -> None:
    """Set all parameters."""
    m, at = state.model, 0
    for x in (m.taps, m.bias, m.out, *state.seen[1:]):
        x[...] = flat[at : at + x.size].reshape(x.shape)
        at += x.size
    m.shift, state.shift_seen = float(flat[at]), float(flat[at + 1])
    m.table[...], state.seen[0][...] = table, seen


def _learnt(rows: DataFrame, state: State, epochs: int, seed: int, only: int | None = None) -> State:
    """``state`` after each part of ``rows`` (only part ``only``, if given) trained from it, averaged over the parts that changed a parameter."""
    shared = rows.sparkSession.sparkContext.broadcast(state)
    width = BUCKETS // SLICES

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        if only not in (None, part):
            return
        ids, y = [], []
        for b in batches:
            y.append(b.column("toxic").to_numpy().astype(np.float64))
            ids += [x[first[d] : first[d + 1]].copy() for x, first in features(b.column("text")) for d in range(len(first) - 1)]
        if not ids:
            return
        old, y = shared.value, np.concatenate(y)
        new = copy.deepcopy(old)
        # a small part sees its rows several times more
        _fit(new, ids, y, epochs if only is not None else min(EPOCHS[1], max(epochs, PART_ROWS // len(y))), np.random.default_rng([seed, part]))
        touched = np.flatnonzero((new.seen[0] != old.seen[0]).any(axis=1))
        change = np.concatenate([new.model.table[touched] - old.model.table[touched], new.seen[0][touched] - old.seen[0][touched]], axis=1)
        edge = np.searchsorted(touched, np.arange(0, BUCKETS + 1, width))
        out = [(-1, b"", (_flat(new) - _flat(old)).tobytes())]
        out += [(s, touched[i:j].astype(np.int32).tobytes(), change[i:j].tobytes()) for s, (i, j) in enumerate(zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True)) if j > i]
        yield pa.record_batch([pa.array([s for s, _, _ in out], pa.int32()), pa.array([part] * len(out), pa.int32()), pa.array([r for _, r, _ in out]), pa.array([c for _, _, c in out])], names=["slice", "part", "rows", "change"])

    def mean(t: pa.Table) -> pa.Table:
        t = t.sort_by([("part", "ascending")])  # sums of floats have an order
        slice_ = t.column("slice")[0].as_py()
        if slice_ < 0:
            at, total = b"", np.mean([np.frombuffer(c, np.float64) for c in t.column("change").to_pylist()], axis=0)
        else:
            total, n = np.zeros((width, 2 * DIM)), np.zeros(width)
            for r, c in zip(t.column("rows").to_pylist(), t.column("change").to_pylist(), strict=True):
                r = np.frombuffer(r, np.int32) - slice_ * width
                total[r] += np.frombuffer(c, np.float32).reshape(len(r), 2 * DIM)
                n[r] += 1
            some = np.flatnonzero(n)
            at, total = (some + slice_ * width).astype(np.int32).tobytes(), total[some] / n[some, None]
        return pa.table({"slice": pa.array([slice_], pa.int32()), "rows": [at], "change": [total.tobytes()]})

    columns = "slice int, part int, rows binary, change binary"
    found = rows.select("toxic", "text").mapInArrow(trimmed(run), columns).groupBy("slice").applyInArrow(mean, "slice int, rows binary, change binary")
    flat, table, seen = _flat(state), state.model.table.copy(), state.seen[0].copy()
    for r in found.collect():  # as large as the model, whatever the number of parts
        change = np.frombuffer(r.change, np.float64)
        if r["slice"] < 0:
            flat = flat + change
        else:
            at, change = np.frombuffer(r.rows, np.int32), change.reshape(-1, 2 * DIM)
            table[at] += change[:, :DIM].astype(np.float32)
            seen[at] += change[:, DIM:].astype(np.float32)
    _changed(state, flat, table, seen)
    shared.unpersist()
    return state


def _calibrate(m: Model, raw: np.ndarray, labels: np.ndarray, langs: list[str | None], count: np.ndarray) -> None:
    """Platt's slope and offset, so that 0.3 parts the classes best, and a threshold for each language; each entry stands for ``count`` rows."""
    positive, rows = (labels * count).sum(), count.sum()
    if 0 < positive < rows:
        t = np.where(labels == 1, (positive + 1) / (positive + 2), 1 / (rows - positive + 2))
        a, b = 1.0, 0.0
        for _ in range(200):
            p = 1 / (1 + np.exp(-np.clip(a * raw + b, -50, 50)))
            w = (p * (1 - p) + 1e-9) * count
            g = np.array([(count * (p - t) * raw).sum(), (count * (p - t)).sum()])
            hess = np.array([[(w * raw * raw).sum(), (w * raw).sum()], [(w * raw).sum(), w.sum()]]) + np.eye(2) * 1e-3
            d = np.linalg.solve(hess, g)
            a, b = a - np.clip(d[0], -1, 1), b - np.clip(d[1], -1, 1)
        m.slope, m.offset = max(float(a), 1e-3), float(b)
    p = 1 / (1 + np.exp(-np.clip(m.slope * raw + m.offset, -50, 50)))
    for lang in sorted({x for x in langs if x is not None}):
        own = np.array([x == lang for x in langs])
        y, s, n = labels[own], p[own], count[own]
        if (n * y).sum() < 10 or (n * (y == 0)).sum() < 10:
            continue
        best = max((2 * (n * ((s >= c) & (y == 1))).sum() / max(1, (n * (s >= c)).sum() + (n * y).sum()), -abs(c - COMMON), c) for c in np.arange(0.1, 0.91, 0.05))
        m.thresholds[lang] = float(best[2])


def _one_of_each_id(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From rows sorted by id, the first of each."""
    last = None
    for b in batches:
        if b.num_rows:
            i = b.column("doc_id").to_numpy()
            new = np.concatenate([[last is None or i[0] != last], i[1:] != i[:-1]])
            last = i[-1]
            yield b.filter(pa.array(new)).select(["toxic", "lang", "text", "back"])


def train(docs: DataFrame, labels: DataFrame, seed: int = 5) -> Model:
    """Fit on all labelled rows that are not held out."""
    known = labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    known = cut(known.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").cast("double").alias("toxic")))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "lang", "text")
    side = hinted(known, BROADCAST_ROWS)
    rows = (texts if side is not known else may_join(texts.filter("doc_id is not null"), known, ["doc_id"])).join(side, "doc_id")
    n, size = rows.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    # each id is in one part, in an order that doesn't depend on where its rows stand
    back = F.pmod(F.xxhash64(F.lit(seed + 1), "doc_id"), F.lit(HELD_BACK)) == 0
    parts = max(1, -(-n // PART_ROWS), -(-size // PART_BYTES))
    rows = rows.select("doc_id", "toxic", "lang", "text", back.alias("back")).repartition(parts, F.xxhash64(F.lit(seed), "doc_id"))
    rows = cut(rows.sortWithinPartitions("doc_id", "lang", "text").mapInArrow(_one_of_each_id, "toxic double, lang string, text string, back boolean"))
    found = {r.back: (r.n, r.y) for r in rows.groupBy("back").agg(F.count("*").alias("n"), F.sum("toxic").alias("y")).collect()}
    n, y = (sum(x) for x in zip((0, 0.0), *found.values(), strict=True))
    if not 0 < y < n:
        return Model()
    learn, kept = rows.filter("not back"), rows.filter("back")
    if 0 < found.get(False, (0, 0))[1] < found.get(False, (0, 0))[0]:
        n, y = found[False]
    else:
        learn, kept = rows, None
    state = _learnt(learn, _start(y / n, seed), _epochs(min(n, PART_ROWS)), seed, only=0)
    if rows.rdd.getNumPartitions() > 1:
        for i in range(_epochs(n)):
            state = _learnt(learn, state, 1, seed + 1 + i)
    m = state.model
    if kept is not None and True in found:

        def raw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                score = [shared.value.logit(*f) for f in features(b.column("text"))]
                if score:
                    yield pa.record_batch([b.column("toxic"), b.column("lang"), pa.array(np.rint(np.concatenate(score).astype(np.float64) / BIN).astype(np.int64))], names=["toxic", "lang", "bin"])

        shared = docs.sparkSession.sparkContext.broadcast(m)
        bins = kept.select("toxic", "lang", "text").mapInArrow(trimmed(raw), "toxic double, lang string, bin long").groupBy("toxic", "lang", "bin").count().toArrow()
        bins = bins.sort_by([("bin", "ascending"), ("lang", "ascending"), ("toxic", "ascending")])
        _calibrate(m, bins.column("bin").to_numpy() * BIN, bins.column("toxic").to_numpy(), bins.column("lang").to_pylist(), bins.column("count").to_numpy())
        shared.unpersist()
    return m


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """row (the input's columns in one struct, so that no name clashes), score and reject (score at or over the threshold of its language)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), "text", "lang")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            score = shared.value.scores(b.column("text"))
            bar = np.array([shared.value.thresholds.get(x, COMMON) for x in b.column("lang").to_pylist()])
            yield pa.record_batch([b.column("row"), pa.array(score, pa.float64()), pa.array(score >= bar)], names=["row", "score", "reject"])

    return packed.mapInArrow(trimmed(run), T.StructType([packed.schema["row"], T.StructField("score", T.DoubleType()), T.StructField("reject", T.BooleanType())]))


def toxicity_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted (score >= 0.3) and rejected (by the threshold of the language)."""
    model = train(docs, labels)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            score = shared.value.scores(b.column("text"))
            bar = np.array([shared.value.thresholds.get(x, COMMON) for x in b.column("lang").to_pylist()])
            yield pa.record_batch([b.column("doc_id"), pa.array(score, pa.float64()), pa.array(score >= bar)], names=["doc_id", "score", "rejected"])

    out = docs.select("doc_id", "text", "lang").mapInArrow(trimmed(run), T.StructType([docs.schema["doc_id"], T.StructField("score", T.DoubleType()), T.StructField("rejected", T.BooleanType())]))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= COMMON).cast("int").alias("predicted"), "rejected")


def without_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that the classifier doesn't reject, with the columns they came with."""
    return scored(docs, train(docs, labels)).filter(~F.col("reject")).select(*[F.col(f"row.`{c}`").alias(c) for c in docs.columns])
