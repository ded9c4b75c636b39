"""Benchmark decontamination by an FM-index over each training shard.

A shard is one Arrow batch of documents.  Its words are named by the
benchmark's vocabulary; what no test phrase can touch is left out of the index
without loss: a phrase occurs only where each word and each neighbouring pair
is one of the benchmark's, so only runs of such pairs are kept, with a
separator between runs.  Every phrase (8 words, or a whole shorter item) is
sought backwards through the wavelet tree, its occurrences are located by the
sampled suffix positions, and overlapping ones merge into removal spans.

The benchmark is read in blocks of bounded bytes, one pass of the scan each.

Defined results: null and empty texts have no words; an item without words
never occurs; items with the same id count once and a null id is an empty
name; repeated rows are judged one by one; an empty benchmark marks nothing;
all columns of the input are kept.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._fm import FMIndex
from ._spark import small_batches
from ._text import alnum_spans, chunks, hash_ranges

WINDOW = 8
BLOCK_BYTES = 32 << 20

_SPANS = T.ArrayType(T.StructType([T.StructField(n, T.IntegerType()) for n in ("w0", "w1", "b0", "b1")]))
_ADDED = [T.StructField("words", T.LongType()), T.StructField("spans", _SPANS), T.StructField("items", T.ArrayType(T.StringType()))]
_SPANS_ARROW = pa.list_(pa.struct([(n, pa.int32()) for n in ("w0", "w1", "b0", "b1")]))


class Phrases:
    """One block of the benchmark: vocabulary, neighbouring pairs, distinct phrases by length, and the items of each."""

    def __init__(self, items: list[tuple[str, str]], window: int = WINDOW) -> None:
        hashes, names = [], []
        for c in chunks(pa.array([t for _, t in items], pa.string())):
            s, e, first = alnum_spans(c)
            h = hash_ranges(c.prefix_hash(True), s, e)
            for d in range(c.docs):
                if first[d] < first[d + 1]:
                    hashes.append(h[first[d] : first[d + 1]])
                    names.append(items[c.first + d][0])
        self.vocabulary = np.unique(np.concatenate(hashes)) if hashes else np.zeros(0, np.uint64)
        pairs, found = [np.zeros(0, np.int64)], {}
        for h, name in zip(hashes, names, strict=True):
            w = np.searchsorted(self.vocabulary, h)
            pairs.append(w[:-1] * len(self.vocabulary) + w[1:])
            for i in range(max(1, len(w) - window + 1)):
                found.setdefault(tuple(w[i : i + window].tolist()), set()).add(name)
        self.pairs = np.unique(np.concatenate(pairs))
        by_length: dict[int, list[tuple]] = {}
        for p in sorted(found):
            by_length.setdefault(len(p), []).append(p)
        self.phrases = {n: np.array(p) for n, p in by_length.items()}
        self.items = {n: [sorted(found[x]) for x in p] for n, p in by_length.items()}
        self.shortest = min(self.phrases, default=0)
        self.lone = np.unique(self.phrases[1][:, 0]) if 1 in self.phrases else np.zeros(0, np.int64)


def _member(x: np.ndarray, of: np.ndarray) -> np.ndarray:
    if not len(of):
        return np.zeros(len(x), bool)
    return of[np.minimum(np.searchsorted(of, x), len(of) - 1)] == x


def find(column: pa.Array, b: Phrases) -> tuple[np.ndarray, list[list[dict]], list[list[str]]]:
    """Words, removal spans (words and bytes, merged) and items of each text of a shard."""
    n_words, ids, doc, b0, b1, word0 = [], [], [], [], [], []
    for c in chunks(column):
        s, e, first = alnum_spans(c)
        h = hash_ranges(c.prefix_hash(True), s, e)
        n = np.diff(first)
        n_words.append(n)
        of = np.repeat(np.arange(c.docs), n)
        w = np.searchsorted(b.vocabulary, h)
        w[~_member(h, b.vocabulary)] = -1
        joined = np.zeros(len(w) + 1, bool)  # whether word i continues the pair from word i - 1
        if len(w) > 1:
            joined[1:-1] = (of[1:] == of[:-1]) & (w[1:] >= 0) & (w[:-1] >= 0) & _member(w[:-1] * len(b.vocabulary) + w[1:], b.pairs)
        starts = np.flatnonzero(~joined[:-1])
        length = np.diff(np.concatenate([starts, [len(w)]]))
        long = length >= max(2, b.shortest) if b.shortest else np.zeros(len(starts), bool)
        if len(b.lone):
            long |= _member(w[starts], b.lone)
        at = np.concatenate([np.arange(x, x + k) for x, k in zip(starts[long], length[long], strict=True)] or [np.zeros(0, np.int64)])
        if len(at):
            lead = np.repeat(starts[long], length[long]) == at
            ids.append(np.stack([w[at], lead]))
            doc.append(of[at] + c.first)
            word0.append(at - first[of[at]])
            b0.append(s[at] - c.at[of[at]])
            b1.append(e[at] - c.at[of[at]])
    total = np.concatenate(n_words) if n_words else np.zeros(0, np.int64)
    spans: list[list[dict]] = [[] for _ in total]
    items: list[set[str]] = [set() for _ in total]
    if ids:
        (w, lead), doc, word0, b0, b1 = np.concatenate(ids, axis=1), *(np.concatenate(x) for x in (doc, word0, b0, b1))
        # every run behind a separator: symbol 0; words from 1
        place = np.arange(len(w)) + np.cumsum(lead)
        text = np.zeros(len(w) + int(lead.sum()), np.int64)
        text[place] = w + 1
        back = np.full(len(text), -1)
        back[place] = np.arange(len(w))
        index = FMIndex(text)
        hits: dict[int, list[tuple[int, int]]] = {}
        for n, phrases in b.phrases.items():
            lo, hi = index.search(phrases + 1)
            some = np.flatnonzero(lo < hi)
            which = np.repeat(some, (hi - lo)[some])
            if not len(which):
                continue
            rows = np.concatenate([np.arange(lo[p], hi[p]) for p in some])
            at = back[index.locate(rows)]
            for p, x in zip(which.tolist(), at.tolist(), strict=True):
                items[doc[x]].update(b.items[n][p])
                hits.setdefault(int(doc[x]), []).append((x, x + n - 1))
        for d, found in hits.items():
            merged: list[list[int]] = []
            for x, y in sorted(found):
                if merged and x <= merged[-1][1] + 1 and word0[x] <= word0[merged[-1][1]] + 1:
                    merged[-1][1] = max(merged[-1][1], y)
                else:
                    merged.append([x, y])
            spans[d] = [{"w0": int(word0[x]), "w1": int(word0[y]) + 1, "b0": int(b0[x]), "b1": int(b1[y])} for x, y in merged]
    return total, spans, [sorted(x) for x in items]


def field(b: pa.RecordBatch, name: str) -> pa.Array:
    """A column of the input, all of which travel in the struct ``row``."""
    row = b.column("row")
    return row.flatten()[row.type.get_field_index(name)]


def _scan(shared, again: bool, then=iter):
    """A pass of one block of phrases; ``then`` goes on with its batches in the same worker."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from then(find_all(batches))

    def find_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        phrases = shared.value
        for b in batches:
            n, spans, items = find(field(b, "text"), phrases)
            if again:
                spans = [x + y for x, y in zip(b.column("spans").to_pylist(), spans, strict=True)]
                items = [sorted({*x, *y}) for x, y in zip(b.column("items").to_pylist(), items, strict=True)]
            yield pa.record_batch([b.column("row"), pa.array(n, pa.int64()), pa.array(spans, _SPANS_ARROW), pa.array(items, pa.list_(pa.string()))], names=["row", "words", "spans", "items"])

    return run


def located(docs: DataFrame, benchmark: DataFrame, then=iter, schema=None, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """row (the input's columns, so that no name clashes), words (their number), spans (removal spans by words and bytes) and items (occurring items).

    With ``then`` and its ``schema``, the last pass hands its batches on to that function.
    """
    spark = docs.sparkSession
    small_batches(spark)
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("id"), F.coalesce("text", F.lit("")).alias("text"))
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = -(-size // block_bytes) or 1
    out = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    plain = T.StructType([*out.schema.fields, *_ADDED])
    for i in range(blocks):
        rows = items.filter(F.pmod(F.xxhash64("id", "text"), F.lit(blocks)) == i).collect()
        shared = spark.sparkContext.broadcast(Phrases([(r.id, r.text) for r in rows], window))
        last = i == blocks - 1 and schema is not None
        out = out.mapInArrow(_scan(shared, i > 0, then), schema) if last else out.mapInArrow(_scan(shared, i > 0), plain)
    return out


def digest(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256 and contaminated (two items or more) of every document."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            hit = []
            for s in b.column("spans").to_pylist():
                words: set[int] = set()
                for x in s:
                    words.update(range(x["w0"], x["w1"]))
                hit.append(len(words))
            items = b.column("items").to_pylist()
            sha = [hashlib.sha256(",".join(x).encode()).hexdigest() for x in items]
            yield pa.record_batch([field(b, "doc_id"), b.column("words"), pa.array(hit, pa.int64()), pa.array([len(x) for x in items], pa.int64()), pa.array(sha), pa.array([len(x) >= 2 for x in items])], names=["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"])

    return located(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), benchmark, count, "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean")


def decontaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents without benchmark passages: those with two items or more go, from the others the spans are cut out."""
    names = docs.columns

    def excise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            b = b.filter(pa.array([len(x) < 2 for x in b.column("items").to_pylist()]))
            spans = b.column("spans").to_pylist()
            text = field(b, "text").to_pylist()
            for i in [i for i, s in enumerate(spans) if s]:
                raw, kept, at = text[i].encode(), [], 0
                for s in sorted((x["b0"], x["b1"]) for x in spans[i]):
                    kept.append(raw[at : max(at, s[0])])
                    at = max(at, s[1])
                text[i] = (b"".join(kept) + raw[at:]).decode()
            columns = [pa.array(text, pa.string()) if n == "text" else field(b, n) for n in names]
            if "n_chars" in names:
                old = field(b, "n_chars").to_pylist()
                columns[names.index("n_chars")] = pa.array([len(t) if s and n is not None else n for t, s, n in zip(text, spans, old, strict=True)], field(b, "n_chars").type)
            yield pa.record_batch(columns, names=names)

    return located(docs, benchmark, excise, docs.schema)
