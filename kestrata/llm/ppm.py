"""Language-model scores by prediction by partial matching over bytes.

Training counts every byte with the ``ORDER`` bytes before it, over all
training texts; each shorter context follows by summing.  The trie of contexts
is pretrained: a text's score is the log10 probability of its bytes and an end
symbol, where a symbol unseen in a context escapes to the next shorter one
(escape probability distinct / (total + distinct)) and the symbols of the
longer context are excluded from the shorter one's counts.  Below order 0 the
symbols not seen at all are equally likely.  Contexts that training never saw
are skipped at no cost, so the probabilities of all continuations sum to one.

Trie and vocabulary grow with the corpus, and no process holds them:

1. documents are dealt to parts of some ``PART_BYTES``; a part's distinct
   grams (a symbol with its context) and words go, packed, to slices: grams by
   the hash of the last ``LOW`` context symbols, words by their own;
2. a slice sums the training counts of all parts, which makes it a trie of the
   contexts of order ``LOW`` and more that end in its symbols;
3. a slice answers each part's grams with log probabilities (a gram's value is
   the same wherever it stands) and its words with counts;
4. a part's texts look their grams and words up among the part's answers.

Orders below ``LOW`` are broadcast: at most 257 ** LOW counts, however large the corpus.

Defined results: null and empty texts are the end symbol alone; repeated rows
count and score one by one; without training texts every symbol has
probability 1/257; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._spark import cut, small_batches
from ._text import U64, Chunk, chunks, fmix, trim, words

ORDER = 5
LOW = 3  # orders below this one are in every slice
END = 257  # bytes are 1..256; 0 stands before the text
SYMBOLS = 257
BITS = 9
PART_BYTES = 24 << 20
SLICE_BYTES = 32 << 20  # of text for each slice, up to MOST_SLICES
MOST_SLICES = 1024
HOLD = 2_000_000
END_WORD = np.uint64(0x5851F42D4C957F2D)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 7 == 2, F.lit(False))


def grams(c: Chunk) -> tuple[np.ndarray, np.ndarray]:
    """Each symbol with ORDER symbols before it in one key (the symbol lowest), ends included, and each document's first."""
    sizes = np.diff(c.at) + ORDER + 1
    at = np.concatenate([[0], np.cumsum(sizes)])
    s = np.zeros(at[-1], np.uint64)
    place = np.arange(len(c.buf)) + np.repeat(at[:-1] + ORDER - c.at[:-1], np.diff(c.at))
    s[place] = c.buf.astype(np.uint64) + U64(1)
    s[at[1:] - 1] = END
    key = s[ORDER:].copy()
    for j in range(1, ORDER + 1):
        key |= s[ORDER - j : len(s) - j] << U64(BITS * j)
    mine = np.ones(len(key), bool)
    over = (at[1:-1][:, None] - ORDER + np.arange(ORDER)[None, :]).ravel()  # keys that end in the padding of the next document
    mine[over] = False
    return key[mine], np.concatenate([[0], np.cumsum(np.diff(c.at) + 1)])


class Tally:
    """Counts of 64-bit keys, merged whenever enough new ones are held; a weight of 0 only names a key."""

    def __init__(self) -> None:
        self.keys, self.counts, self.held, self.n = np.zeros(0, np.uint64), np.zeros(0, np.int64), [], 0

    def add(self, keys: np.ndarray, weights: np.ndarray) -> None:
        self.held.append((keys, weights))
        self.n += len(keys)
        if self.n > HOLD:
            self.merge()

    def merge(self) -> None:
        held = [(self.keys, self.counts), *self.held]
        self.keys, self.counts = _sums(np.concatenate([k for k, _ in held]), np.concatenate([w for _, w in held]))
        self.held, self.n = [], 0


def packed(x: np.ndarray) -> bytes:
    """64-bit integers by bytes of equal weight, compressed; ``unpacked`` takes their number."""
    return pa.compress(np.ascontiguousarray(x.astype(np.uint64).view(np.uint8).reshape(-1, 8).T).tobytes(), codec="zstd", asbytes=True) if len(x) else b""


def unpacked(raw: bytes, n: int) -> np.ndarray:
    if not n:
        return np.zeros(0, np.uint64)
    planes = np.frombuffer(pa.decompress(raw, decompressed_size=8 * n, codec="zstd", asbytes=True), np.uint8)
    return np.ascontiguousarray(planes.reshape(8, n).T).view(np.uint64).ravel()


def _packed_keys(sorted_keys: np.ndarray) -> bytes:
    return packed(np.diff(sorted_keys, prepend=U64(0)))


def _unpacked_keys(raw: bytes, n: int) -> np.ndarray:
    return np.cumsum(unpacked(raw, n), dtype=np.uint64)


def _slice_of(kind: int, keys: np.ndarray, slices: int) -> np.ndarray:
    own = (keys >> U64(BITS)) & _mask(LOW) if kind == 0 else keys
    return (fmix(own + U64(kind)) % U64(slices)).astype(np.int32)


class HashTable:
    """Open addressing over 64-bit keys, two thirds full; ``get`` answers arrays of keys at once."""

    def __init__(self, keys: np.ndarray, values: np.ndarray) -> None:
        self.size = max(16, len(keys) + len(keys) // 2)
        self.keys = np.full(self.size, ~U64(0))
        self.values = np.zeros(self.size, values.dtype)
        todo, slot = np.arange(len(keys)), self._slot(keys)
        while len(todo):
            free = self.keys[slot] == ~U64(0)
            _, one = np.unique(slot[free], return_index=True)
            put = np.flatnonzero(free)[one]
            self.keys[slot[put]] = keys[todo[put]]
            self.values[slot[put]] = values[todo[put]]
            rest = np.ones(len(todo), bool)
            rest[put] = False
            todo, slot = todo[rest], (slot[rest] + 1) % self.size

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        h = (keys ^ (keys >> U64(29))) * U64(0x9E3779B97F4A7C15)
        return (((h >> U64(32)) * U64(self.size)) >> U64(32)).astype(np.int64)

    def get(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Values (0 where absent), and which keys are present."""
        slot = self._slot(keys)
        there = self.keys[slot]
        found = there == keys
        values = self.values[slot]
        todo = np.flatnonzero(~found & (there != ~U64(0)))
        slot = slot[todo]
        while len(todo):
            slot = (slot + 1) % self.size
            there = self.keys[slot]
            hit = there == keys[todo]
            found[todo[hit]] = True
            values[todo[hit]] = self.values[slot[hit]]
            more = ~hit & (there != ~U64(0))
            todo, slot = todo[more], slot[more]
        values[~found] = 0
        return values, found


def _sums(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys, kind="stable")
    keys, n = keys[order], n[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.add.reduceat(n, first) if len(first) else n


def _find(sorted_keys: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(sorted_keys):
        return np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
    at = np.minimum(np.searchsorted(sorted_keys, keys), len(sorted_keys) - 1)
    return at, sorted_keys[at] == keys


def _mask(order: int) -> np.uint64:
    return U64((1 << (BITS * order)) - 1)


class Trie:
    """Contexts of orders 0..ORDER, those of order LOW and more of one slice, as sorted arrays with log10 probabilities.

    Per order: gram keys (context and symbol) with the log probability where the
    context is the longest known one, and the log count; contexts with the log
    escape probability where longest, and, for the next shorter context after
    exclusion of this one's symbols, the log denominator and log escape.
    """

    def __init__(self, keys: np.ndarray, n: np.ndarray, low_keys: np.ndarray, low_n: np.ndarray) -> None:
        self.levels: list[dict[str, np.ndarray]] = []
        below = None
        for order in range(ORDER + 1):
            g, c = _sums((low_keys if order < LOW else keys) & _mask(order + 1), low_n if order < LOW else n)
            ctx, first = np.unique(g >> U64(BITS), return_index=True)
            of = np.repeat(np.arange(len(ctx)), np.diff(np.append(first, len(g))))
            total = np.add.reduceat(c, first) if len(first) else c
            distinct = np.diff(np.append(first, len(g)))
            level = {"grams": g, "count": np.log10(c), "top": np.log10(c) - np.log10((total + distinct)[of]), "ctx": ctx, "escape": np.log10(distinct) - np.log10(total + distinct), "total": total, "distinct": distinct, "raw": c}
            if below is not None and len(g):
                at, _ = _find(below["grams"], g & _mask(order))
                excluded = np.add.reduceat(below["raw"][at], first)
                parent, _ = _find(below["ctx"], ctx & _mask(order - 1))
                left_n, left_d = below["total"][parent] - excluded, below["distinct"][parent] - distinct
                some = left_d > 0
                level["low"] = np.log10(np.where(some, left_n + left_d, 1))
                level["low_escape"] = np.where(some, np.log10(np.where(some, left_d, 1)) - level["low"], 0.0)
            else:
                level["low"] = level["low_escape"] = np.zeros(len(ctx))
            self.levels.append(level)
            below = level
        self.unseen = -np.log10(SYMBOLS - int(self.levels[0]["distinct"][0])) if len(self.levels[0]["distinct"]) else -np.log10(SYMBOLS)
        self.table = HashTable(self.levels[-1]["grams"], self.levels[-1]["top"].astype(np.float32))
        for level in self.levels:
            for name in ("total", "distinct", "raw"):
                del level[name]
            for name in ("count", "top", "escape", "low", "low_escape"):
                level[name] = level[name].astype(np.float32)
        for name in ("grams", "count", "top"):  # the hash table has them
            self.levels[-1][name] = self.levels[-1][name][:0]

    def log10(self, keys: np.ndarray) -> np.ndarray:
        out, found = self.table.get(keys)
        out = out.astype(np.float64)
        todo = np.flatnonzero(~found)
        acc, child = np.zeros(len(todo)), np.full(len(todo), -1)
        for order in range(ORDER, -1, -1):
            if not len(todo):
                break
            level = self.levels[order]
            key = keys[todo] & _mask(order + 1)
            ctx, known = _find(level["ctx"], key >> U64(BITS))
            gram, hit = _find(level["grams"], key)
            lower = child >= 0
            above = self.levels[order + 1] if order < ORDER else level
            at = np.maximum(child, 0)
            low, low_escape = (above["low"][at], above["low_escape"][at]) if len(above["low"]) else (np.zeros(len(at)), np.zeros(len(at)))
            if len(level["ctx"]):
                gram = gram if len(level["grams"]) else gram[:0]
                count, top = (level["count"][gram], level["top"][gram]) if len(gram) else (0.0, 0.0)
                acc += np.where(hit, np.where(lower, count - low, top), np.where(lower, low_escape, np.where(known, level["escape"][ctx], 0.0)))
            done = hit
            out[todo[done]] = acc[done]
            child = np.where(known, ctx, child)[~done]
            todo, acc = todo[~done], acc[~done]
        out[todo] = acc + self.unseen
        return out


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.record_batch([pa.array(x, f.type) for x, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def _word_tokens(c: Chunk) -> tuple[np.ndarray, np.ndarray]:
    """Every document's words, then its end, and each document's first token (docs + 1 entries)."""
    h, word = words(c)
    at = word + np.arange(c.docs + 1)
    is_end = np.zeros(len(h) + c.docs, bool)
    is_end[at[1:] - 1] = True
    tokens = np.empty(len(is_end), np.uint64)
    tokens[is_end], tokens[~is_end] = END_WORD, h
    return tokens, at


_BLOB = pa.schema([("part", pa.int32()), ("kind", pa.int32()), ("slice", pa.int32()), ("m", pa.int32()), ("keys", pa.binary()), ("n", pa.binary())])


def _parts(slices: int):
    """From rows sorted by part: the part's distinct keys by kind (0 grams, 1 words) and slice, with their counts in training texts."""

    def blobs(part: int, tallies: tuple[Tally, Tally]) -> Iterator[pa.RecordBatch]:
        for kind, t in enumerate(tallies):
            t.merge()
            own = _slice_of(kind, t.keys, slices)
            order = np.argsort(own, kind="stable")
            edges = np.searchsorted(own[order], np.arange(slices + 1))
            rows = []
            for i in np.flatnonzero(np.diff(edges)).tolist():
                pick = order[edges[i] : edges[i + 1]]
                rows.append((part, kind, i, len(pick), _packed_keys(t.keys[pick]), packed(t.counts[pick])))
                if len(rows) == 64:
                    yield _batch(rows, _BLOB)
                    rows = []
            if rows:
                yield _batch(rows, _BLOB)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, tallies = None, None
        for b in batches:
            parts = b.column("part").to_numpy()
            for lo, hi in _runs(parts):
                if parts[lo] != part:
                    if tallies:
                        yield from blobs(part, tallies)
                    part, tallies = int(parts[lo]), (Tally(), Tally())
                own = b.slice(lo, hi - lo)
                learns = own.column("learns").to_numpy(zero_copy_only=False).astype(np.int64)
                for c in chunks(own.column("text")):
                    weight = learns[c.first : c.first + c.docs]
                    key, first = grams(c)
                    tallies[0].add(key, np.repeat(weight, np.diff(first)))
                    token, first = _word_tokens(c)
                    tallies[1].add(token, np.repeat(weight, np.diff(first)))
        if tallies:
            yield from blobs(part, tallies)
        trim()

    return run


def _runs(x: np.ndarray) -> list[tuple[int, int]]:
    """Starts and ends of runs of equal values."""
    if not len(x):
        return []
    edges = np.flatnonzero(np.diff(x)) + 1
    return list(zip([0, *edges.tolist()], [*edges.tolist(), len(x)], strict=True))


_MODEL = pa.schema([("kind", pa.int32()), ("slice", pa.int32()), ("m", pa.int32()), ("keys", pa.binary()), ("n", pa.binary()), ("total", pa.int64())])


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From blobs sorted by kind and slice: each slice's keys seen in training, and their counts over all parts."""

    def model(at: tuple[int, int], t: Tally) -> pa.RecordBatch:
        t.merge()
        seen = t.counts > 0
        return _batch([(*at, int(seen.sum()), _packed_keys(t.keys[seen]), packed(t.counts[seen]), int(t.counts.sum()))], _MODEL)

    at, tally = None, Tally()
    for b in batches:
        for r in b.to_pylist():
            if (r["kind"], r["slice"]) != at:
                if at:
                    yield model(at, tally)
                at, tally = (r["kind"], r["slice"]), Tally()
            tally.add(_unpacked_keys(r["keys"], r["m"]), unpacked(r["n"], r["m"]).astype(np.int64))
    if at:
        yield model(at, tally)


def _low_orders(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for r in b.to_pylist():
            k, n = _sums(_unpacked_keys(r["keys"], r["m"]) & _mask(LOW), unpacked(r["n"], r["m"]).astype(np.int64))
            yield pa.record_batch([pa.array(k.view(np.int64)), pa.array(n)], names=["key", "n"])


_ANSWER = pa.schema([("part", pa.int32()), ("kind", pa.int32()), ("m", pa.int32()), ("keys", pa.binary()), ("n", pa.binary())])


def _answers(shared):
    """From each slice's model and then its blobs: the blobs with log10 probabilities (grams) or counts (words) in place of their own counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        low, at, model = shared.value, None, None

        def opened(kind: int, keys: np.ndarray, n: np.ndarray):
            return Trie(keys, n.astype(np.int64), *low) if kind == 0 else HashTable(keys, n.astype(np.int64))

        none = np.zeros(0, np.uint64)
        for b in batches:
            for r in b.to_pylist():
                here = (r["kind"], r["slice"])
                if here != at:
                    at, model = here, None
                keys = _unpacked_keys(r["keys"], r["m"])
                if not r["ord"]:
                    model = opened(r["kind"], keys, unpacked(r["n"], r["m"]))
                    continue
                model = model or opened(r["kind"], none, none)
                out = model.log10(keys).astype(np.float32).tobytes() if r["kind"] == 0 else packed(model.get(keys)[0])
                yield _batch([(r["part"], r["kind"], r["m"], r["keys"], out)], _ANSWER)
        del model
        trim()

    return run


def _scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From each part's answers and then its texts: the texts' sums."""
    part, answers, tables = None, ([], []), None
    for b in batches:
        parts, texts = b.column("part").to_numpy(), b.column("ord").to_numpy()
        for lo, hi in _runs(parts.astype(np.int64) * 2 + texts):
            own = b.slice(lo, hi - lo)
            if parts[lo] != part:
                part, answers, tables = parts[lo], ([], []), None
            if not texts[lo]:
                for r in own.select(["kind", "m", "keys", "n"]).to_pylist():
                    value = np.frombuffer(r["n"], np.float32) if r["kind"] == 0 else unpacked(r["n"], r["m"]).astype(np.int64)
                    answers[r["kind"]].append((_unpacked_keys(r["keys"], r["m"]), value))
                continue
            if tables is None:
                tables = [HashTable(np.concatenate([k for k, _ in x]), np.concatenate([v for _, v in x])) for x in answers]
                answers = ([], [])
            out = []
            for c in chunks(own.column("text")):
                key, first = grams(c)
                token, at = _word_tokens(c)
                n = tables[1].get(token)[0]
                lp = tables[0].get(key)[0].astype(np.float64)
                out.append((np.diff(at), np.add.reduceat((n > 0).astype(np.int64), at[:-1]), np.add.reduceat(np.log10(n + 1.0), at[:-1]), np.add.reduceat(lp, first[:-1])))
            n, k, l, s = (np.concatenate(x) for x in zip(*out, strict=True))
            yield pa.record_batch([own.column("doc_id"), pa.array(n), pa.array(k), pa.array(l), pa.array(s)], names=["doc_id", "n_tokens", "n_known", "log_counts", "score"])
    del tables, answers
    trim()


def scores(docs: DataFrame, learns: Column, part_bytes: int = PART_BYTES, slice_bytes: int = SLICE_BYTES) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score and score of every document, learnt from the texts of the rows where ``learns`` holds."""
    spark = docs.sparkSession
    small_batches(spark)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(learns, F.lit(False)).alias("learns"), "text")
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts, slices = size // part_bytes + 1, min(MOST_SLICES, size // slice_bytes + 1)
    rows = rows.withColumn("part", F.pmod(F.xxhash64("doc_id", "text"), F.lit(parts)).cast("int"))
    blobs = cut(rows.drop("doc_id").repartition(parts, "part").sortWithinPartitions("part").mapInArrow(_parts(slices), "part int, kind int, slice int, m int, keys binary, n binary"))
    by_slice = blobs.repartition(2 * slices, "kind", "slice").sortWithinPartitions("kind", "slice")
    model = cut(by_slice.mapInArrow(_summed, "kind int, slice int, m int, keys binary, n binary, total long"))
    n, v = model.filter("kind = 1").agg(F.coalesce(F.sum("total"), F.lit(0)), F.coalesce(F.sum("m"), F.lit(0))).first()
    low = model.filter("kind = 0").mapInArrow(_low_orders, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).toArrow()
    shared = spark.sparkContext.broadcast((low.column("key").to_numpy().view(np.uint64), low.column("n").to_numpy()))
    first = model.select("kind", "slice", F.lit(0).alias("ord"), F.lit(0).alias("part"), "m", "keys", "n")
    asked = first.unionByName(blobs.select("kind", "slice", F.lit(1).alias("ord"), "part", "m", "keys", F.lit(None).cast("binary").alias("n")))
    asked = asked.repartition(2 * slices, "kind", "slice").sortWithinPartitions("kind", "slice", "ord")
    answers = asked.mapInArrow(_answers(shared), "part int, kind int, m int, keys binary, n binary")
    nothing = {c: F.lit(None).cast(t).alias(c) for c, t in (("kind", "int"), ("m", "int"), ("keys", "binary"), ("n", "binary"), ("doc_id", "long"), ("text", "string"))}
    met = answers.select("part", F.lit(0).alias("ord"), "kind", "m", "keys", "n", nothing["doc_id"], nothing["text"])
    met = met.unionByName(rows.select("part", F.lit(1).alias("ord"), *[nothing[c] for c in ("kind", "m", "keys", "n")], "doc_id", "text"))
    out = met.repartition(parts, "part").sortWithinPartitions("part", "ord").mapInArrow(_scored, "doc_id long, n_tokens long, n_known long, log_counts double, score double")
    base = F.col("log_counts") - F.col("n_tokens") * F.lit(float(np.log10(n + v + 1.0)))
    return out.select("doc_id", "n_tokens", "n_known", F.lit(int(n)).cast("long").alias("train_tokens"), base.alias("base_score"), "score")
