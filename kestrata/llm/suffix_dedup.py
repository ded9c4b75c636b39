"""Removal of byte strings that occur more than once, by distributed suffix sorting with a difference cover.

Whether the ``length``-byte string at a start also starts elsewhere is read
off a suffix array: equal prefixes stand next to each other.  Sorting every
suffix of a corpus as one text would write many times its size, so the corpus
is first cut where equal strings are sure to meet.  In each string the gram
with the least hash is its anchor, which depends on the string's bytes only;
the starts that have one anchor at a distance of one cell of distances form a
context, keyed by the hash of a core of bytes that all strings of the cell
contain.  Equal strings have equal keys, hence:

* keys are counted first, combined before the shuffle; a key that occurs once
  has no repeated string, and its context goes no further;
* equal contexts (by a 128-bit digest of their bytes) repeat as a whole, and
  one of them stands for the rest;
* the distinct contexts of a key meet in one task, which sorts their suffixes
  (``_dc3``: sampled triples, recursion on names, merge) to ``length`` symbols
  and compares adjacent prefixes byte by byte.

A key whose distinct contexts outgrow ``group_bytes`` is halved: its cell of
distances becomes two, with longer cores and so with fewer contexts each, down
to cells of one distance, where a key is one string.

Defined results: null and empty texts have no bytes; texts shorter than
``length`` lose nothing; repeated rows repeat each other's strings; an empty
table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._dc3 import suffix_array
from ._sieve import BITS, bitmap, may_join, parted, taken
from ._spark import cut
from ._text import U64, Chunk, chunks, fmix, hash_ranges, powers, signed, _R_INV

GRAM = 32
BATCH_BYTES = 1 << 20
GROUP_BYTES = 2 << 20
_POS = np.uint64((1 << 30) - 1)


def _anchors(c: Chunk, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Anchor, first and last start, and prefix hash of every maximal run of starts with one anchor."""
    h = c.prefix_hash(False)
    n, none = len(c.buf), np.zeros(0, np.int64)
    sizes = np.diff(c.at)
    long = np.flatnonzero(sizes >= length)
    if not len(long):
        return none, none, none, h
    g = h[GRAM:] - h[:-GRAM]
    g *= powers(_R_INV, n)[: len(g)]
    g = fmix(g)
    w = length - GRAM + 1
    key = (g & ~_POS) | np.arange(len(g), dtype=np.uint64)
    pad = np.full(-len(key) % w + w, ~U64(0))
    rows = np.concatenate([key, pad]).reshape(-1, w)
    ahead = np.minimum.accumulate(rows, axis=1).ravel()
    behind = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    least = np.minimum(behind[: len(key)], ahead[w - 1 : w - 1 + len(key)])
    counts = sizes[long] - length + 1
    ends = np.cumsum(counts)
    starts = np.arange(ends[-1]) + np.repeat(c.at[long] - (ends - counts), counts)
    at = (least[starts] & _POS).astype(np.int64)
    new = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
    last = np.concatenate([new[1:], [len(at)]]) - 1
    return at[new], starts[new], starts[last], h


def _halved(p, a, b, d0, d1, *more):
    """Contexts (anchor p, starts a..b, distances d0 <= p - start < d1) with their cells of distances halved; cells of one distance stay."""
    mid = (d0 + d1) // 2
    out = [np.concatenate(x) for x in ((p, p), (np.maximum(a, p - mid + 1), np.maximum(a, p - d1 + 1)), (np.minimum(b, p - d0), np.minimum(b, p - mid)), (d0, mid), (mid, d1), *zip(more, more, strict=True))]
    some = out[1] <= out[2]
    return [x[some] for x in out]


def _keys(h: np.ndarray, p, d0, d1, length: int) -> np.ndarray:
    """Hashes of the cores, the bytes that all strings of a cell contain."""
    return fmix(hash_ranges(h, p - d0, p - d1 + 1 + length) + (d0 * 1024 + d1).astype(np.uint64))


def _cells(c: Chunk, length: int, level: int):
    """Contexts of cells halved ``level`` times: anchor, first and last start, least distance, the one after the greatest, and number; and the prefix hash."""
    p, lo, hi, h = _anchors(c, length)
    x = [p, lo, hi, np.zeros(len(p), np.int64), np.full(len(p), length - GRAM + 1), np.ones(len(p), np.int64)]
    for _ in range(level):
        x = _halved(*x)
    return x, h


def _places(length: int):
    """Key, the place of its leading bits in a bitmap, and number, of each distinct key of a chunk."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for c in chunks(b.column("text")):
                (p, _, _, d0, d1, _), h = _cells(c, length, 1)
                if len(p):
                    key, n = np.unique(_keys(h, p, d0, d1, length), return_counts=True)
                    yield pa.record_batch([pa.array(signed(key)), pa.array((key >> U64(64 - BITS)).astype(np.int64)), pa.array(n)], names=["key", "p", "n"])

    return run


def _named(c: Chunk, x: list[np.ndarray], key: np.ndarray, length: int) -> dict[str, np.ndarray]:
    """Rows of contexts: document, first and last start (within the chunk), key and name; ``n`` equal ones in a row, the last of which ends at start ``to``."""
    order = np.lexsort((x[1], x[3]))
    p, a, b, d0, _, n = (y[order] for y in x)
    key, raw = key[order], memoryview(c.buf)
    # where the strings lie about the anchor is part of the name
    digests = [hashlib.blake2b(raw[i : j + length], digest_size=16, person=struct.pack("<ii", q - i, j - i)).digest() for q, i, j in zip(p.tolist(), a.tolist(), b.tolist(), strict=True)]
    name = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
    # periodic text repeats one context from period to period: one row stands for such a run
    doc = np.searchsorted(c.at, a, "right") - 1
    new = np.ones(len(a), bool)
    new[1:] = (key[1:] != key[:-1]) | (name[1:] != name[:-1]).any(axis=1) | (doc[1:] != doc[:-1]) | (d0[1:] != d0[:-1]) | (a[1:] > b[:-1] + length)
    new = np.flatnonzero(new)
    last = np.append(new[1:], len(a)) - 1
    return {"doc": doc[new], "lo": a[new], "hi": b[new], "to": b[last], "n": np.add.reduceat(n, new) if len(new) else n, "key": key[new], "x": name[new, 0], "y": name[new, 1]}


_ROW = "key long, x long, y long, doc_id long, th long, lo int, hi int, to int, n int"
_NAMES = ["key", "x", "y", "doc_id", "th", "lo", "hi", "to", "n"]


def _row_batch(c: Chunk, r: dict[str, np.ndarray], ids: pa.Array, th: pa.Array) -> pa.RecordBatch:
    at, base = pa.array(r["doc"] + c.first), c.at[r["doc"]]
    return pa.record_batch([pa.array(signed(r["key"])), pa.array(r["x"]), pa.array(r["y"]), ids.take(at), th.take(at), *[pa.array((r[f] - base).astype(np.int32)) for f in ("lo", "hi", "to")], pa.array(r["n"].astype(np.int32))], names=_NAMES)


def _scan(length: int, shared):
    """The contexts whose key may occur more than once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for c in chunks(b.column("text")):
                x, h = _cells(c, length, 1)
                key = _keys(h, x[0], x[3], x[4], length)
                hit = taken(shared.value, (key >> U64(64 - BITS)).astype(np.int64))
                if hit.any():
                    yield _row_batch(c, _named(c, [y[hit] for y in x], key[hit], length), b.column("doc_id"), b.column("th"))

    return run


def _finer(length: int, level: int):
    """The halves of the wanted contexts of ``level``, each as often as its whole."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, wanted in enumerate(b.column("wanted").to_pylist()):
                own = b.slice(i, 1)
                for c in chunks(own.column("text")):
                    x, h = _cells(c, length, level)
                    key = signed(_keys(h, x[0], x[3], x[4], length)).tolist()
                    of = {(w["key"], w["lo"], w["hi"]): w["n"] for w in wanted}
                    x[5] = np.array([of.get(k, 0) for k in zip(key, x[1].tolist(), x[2].tolist(), strict=True)], np.int64)
                    some = x[5] > 0
                    y = _halved(*[z[some] for z in x])
                    if len(y[0]):
                        yield _row_batch(c, _named(c, y, _keys(h, y[0], y[3], y[4], length), length), own.column("doc_id"), own.column("th"))

    return run


def repeated_starts(texts: list[bytes], length: int) -> list[np.ndarray]:
    """For each text, the starts whose ``length``-byte string also starts elsewhere in the texts."""
    joined = np.frombuffer(b"\0".join(texts) + b"\0", np.uint8)
    sizes = np.array([len(t) for t in texts])
    at = np.concatenate([[0], np.cumsum(sizes + 1)])
    symbols = joined.astype(np.int64) + 2
    symbols[at[1:] - 1] = 1
    order = suffix_array(symbols, length)
    valid = np.zeros(len(joined), bool)
    for a, n in zip(at[:-1], sizes, strict=True):
        valid[a : a + max(0, n - length + 1)] = True
    order = order[valid[order]]
    h = Chunk(0, joined, np.array([0, len(joined)])).prefix_hash(False)
    prefix = hash_ranges(h, order, order + length)
    near = np.flatnonzero(prefix[1:] == prefix[:-1])
    found = np.zeros(len(joined), bool)
    span = np.arange(length)
    for i in range(0, len(near), 4096):
        x, y = order[near[i : i + 4096]], order[near[i : i + 4096] + 1]
        equal = (joined[x[:, None] + span] == joined[y[:, None] + span]).all(axis=1)
        found[x[equal]] = True
        found[y[equal]] = True
    return [np.flatnonzero(found[a : a + n]) for a, n in zip(at[:-1], sizes, strict=True)]


_SPAN = pa.schema([("doc_id", pa.int64()), ("th", pa.int64()), ("start", pa.int64()), ("stop", pa.int64())])


def _sorted_groups(length: int, batch_bytes: int):
    """Over contexts sorted by key: the spans of the repeated strings of those that occur once."""

    def settle(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
        if len(rows) < 2:
            return
        out = []
        for (_, doc, th, lo, n, _), starts in zip(rows, repeated_starts([r[5] for r in rows], length), strict=True):
            if n == 1 and len(starts):
                cuts = np.flatnonzero(np.diff(starts) > 1)
                first = starts[np.concatenate([[0], cuts + 1])]
                last = starts[np.concatenate([cuts, [len(starts) - 1]])]
                out += [(doc, th, lo + int(a), lo + int(b) + length) for a, b in zip(first, last, strict=True)]
        if out:
            yield pa.record_batch([pa.array(x, f.type) for x, f in zip(zip(*out, strict=True), _SPAN, strict=True)], schema=_SPAN)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: list[tuple] = []  # whole groups
        group: list[tuple] = []  # the group being read
        held, key = 0, None
        for b in batches:
            for r in zip(*[b.column(c).to_pylist() for c in ("key", "doc_id", "th", "lo", "n", "part")], strict=True):
                if r[0] != key:
                    done += group
                    held += sum(len(x[5]) for x in group)
                    group, key = [], r[0]
                    if held >= batch_bytes:
                        yield from settle(done)
                        done, held = [], 0
                group.append(r)
        yield from settle(done + group)

    return run


def _parts(length: int):
    """Cut the wanted contexts out of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for doc, th, wanted, text in zip(*[b.column(c).to_pylist() for c in ("doc_id", "th", "wanted")], b.column("text"), strict=True):
                raw = memoryview(text.as_buffer())
                rows += [(w["key"], doc, th, w["lo"], w["n"], bytes(raw[w["lo"] : w["hi"] + length])) for w in wanted]
                if sum(len(r[5]) for r in rows[-len(wanted) :]) > BATCH_BYTES or len(rows) > 5000:
                    yield _part_batch(rows)
                    rows = []
            if rows:
                yield _part_batch(rows)

    return run


_PART = pa.schema([("key", pa.int64()), ("doc_id", pa.int64()), ("th", pa.int64()), ("lo", pa.int32()), ("n", pa.int64()), ("part", pa.binary())])


def _part_batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.record_batch([pa.array(x, f.type) for x, f in zip(zip(*rows, strict=True), _PART, strict=True)], schema=_PART)


def _same_row(a: DataFrame, b: DataFrame):
    return (a["th"] == b["th"]) & a["doc_id"].eqNullSafe(b["doc_id"])


def _wanted(contexts: DataFrame) -> DataFrame:
    """named contexts -> doc_id, th and the list of those that represent them in that text."""
    rows = contexts.select("one.doc_id", "one.th", F.struct("key", "one.lo", "one.hi", "n").alias("w"))
    return cut(rows.groupBy("doc_id", "th").agg(F.collect_list("w").alias("wanted")))


def _asked(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    docs = may_join(docs, wanted, ["doc_id", "th"])
    return docs.join(wanted, _same_row(docs, wanted)).select(docs["doc_id"], docs["th"], "wanted", "text")


def repeated_spans(docs: DataFrame, length: int = 400, batch_bytes: int = BATCH_BYTES, group_bytes: int = GROUP_BYTES) -> DataFrame:
    """doc_id, th (hash of the text) and the repeated byte spans (start, stop) of the documents that have any."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("th"), "text").filter(F.octet_length("text") >= length)
    keys = docs.select("text").mapInArrow(_places(length), "key long, p long, n long").groupBy("key", "p").agg(F.sum("n").alias("n"))
    shared = docs.sparkSession.sparkContext.broadcast(bitmap(keys.filter("n > 1")))
    rows = cut(docs.mapInArrow(_scan(length, shared), _ROW))
    spans: DataFrame | None = None
    level = 1
    while True:
        named = cut(rows.groupBy("key", "x", "y").agg(F.sum("n").alias("n"), F.min(F.struct("doc_id", "th", "lo", "hi")).alias("one")))
        whole = rows.join(named.filter("n > 1").select("key", "x", "y"), ["key", "x", "y"]).select("doc_id", "th", F.col("lo").cast("long").alias("start"), (F.col("to") + length).cast("long").alias("stop"))
        size = F.sum(F.col("one.hi") - F.col("one.lo") + length)
        several = named.groupBy("key").agg(F.count("*").alias("m"), F.min("n").alias("least"), size.alias("size")).filter("m > 1 and least = 1")
        several = cut(several.select("key", (F.col("size") > (group_bytes if level < 10 else 1 << 62)).alias("large")))
        parts = _asked(docs, _wanted(named.join(several.filter("not large"), "key"))).mapInArrow(_parts(length), "key long, doc_id long, th long, lo int, n long, part binary")
        found = cut(parts.repartition("key").sortWithinPartitions("key").mapInArrow(_sorted_groups(length, batch_bytes), "doc_id long, th long, start long, stop long"))
        found = whole.unionByName(found)
        spans = found if spans is None else spans.unionByName(found)
        large = several.filter("large")
        if large.isEmpty():
            return spans
        rows = cut(_asked(docs, _wanted(named.join(large, "key"))).mapInArrow(_finer(length, level), _ROW))
        level += 1


def _removed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        out = []
        for doc, spans, text in zip(b.column("doc_id").to_pylist(), b.column("spans").to_pylist(), b.column("text"), strict=True):
            raw = memoryview(text.as_buffer()) if text.is_valid else memoryview(b"")
            runs: list[list[int]] = []
            for s in sorted((s["start"], s["stop"]) for s in spans or []):
                if runs and s[0] <= runs[-1][1]:
                    runs[-1][1] = max(runs[-1][1], s[1])
                else:
                    runs.append([*s])
            digest, at = hashlib.sha256(), 0
            for lo, hi in runs:
                digest.update(raw[at:lo])
                at = hi
            digest.update(raw[at:])
            out.append((doc, len(raw), sum(hi - lo for lo, hi in runs), len(runs), digest.hexdigest()))
        if out:
            d, n, r, k, s = zip(*out, strict=True)
            yield pa.record_batch([pa.array(d, pa.int64()), pa.array(n, pa.int64()), pa.array(r, pa.int64()), pa.array(k, pa.int64()), pa.array(s)], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def dedup_digest(docs: DataFrame, length: int = 400) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans (maximal runs) and kept_sha256 (the bytes that stay) of every document."""
    spans = cut(repeated_spans(docs, length).groupBy("doc_id", "th").agg(F.collect_list(F.struct("start", "stop")).alias("spans")))
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("th"), "text")
    may, rest = parted(docs, spans, ["doc_id", "th"])
    rows = may.join(spans, _same_row(may, spans), "left").select(may["doc_id"], "spans", "text")
    rows = rows.unionByName(rest.select("doc_id", F.lit(None).cast(spans.schema["spans"].dataType).alias("spans"), "text"))
    return rows.mapInArrow(_removed, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
