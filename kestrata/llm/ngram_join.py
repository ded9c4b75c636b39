"""Size-aware heavy-light similarity join of documents by word n-gram Jaccard.

Equal sets are one class first.  Distinct sets then meet by signatures that
every qualifying pair shares:

* light sets (size up to a boundary) enumerate their subsets of each size that
  an intersection with a qualifying partner can have;
* heavy sets are looked up in inverted lists.  A list holds the sets that agree
  on a segment of the shingle space.  With k shingles that may differ and
  k + 1 + spare segments, a qualifying pair agrees on more than ``spare`` of
  them.  A segment's strength is a matter of its content: none, frequent
  shingles only, then rare ones.  Each set leaves out the weakest, at most
  ``spare`` of them and all below one strength, so the strongest segment on
  which a pair agrees is used by both.  Lists of weak segments would be as long
  as a shared passage is frequent.  What counts as frequent comes from counts
  of all shingles in a fixed number of hashed bins; it moves work, never
  results.

The boundary is the size that makes the cost over the table's histogram of
small sizes least: signatures emitted, plus exact checks that only lists need.
Each list names its least set as the centre; candidate groups are the
components of those stars, and ``_verify`` decides every pair of a group
exactly.  In groups of more than one block, that is every pair that shares a
signature: a set goes only to blocks that hold such a partner, so chains of
lists don't cost the square of their length.  Sets just above the boundary's
partner range take part in both ways.

Defined results: null, empty and blank texts have empty sets and link with
nothing, not even with each other; a document with fewer words than a shingle
has its whole sequence as only shingle; repeated rows are classes like any
equal sets; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import ceil, comb, exp, sqrt

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._graph import connected_components
from ._sieve import may_join, parted
from ._spark import cut, hinted
from ._text import Seen, U64, chunks, fmix, shingle_sets, signed, trimmed
from ._verify import block_of, blocks_of, large_groups, links

LIGHT_MOST = 32  # the boundary is sought up to this size
CHECK_COST = 2.0  # of an exact check that a list may cause, in signatures
BROADCAST_ROWS = 500_000  # of ids, a few dozen bytes each, that may go to every task instead of shuffling all texts
GROWTH = 1.5  # of the size classes of heavy sets
BIN_BITS = 22  # of the hashed bins in which shingles are counted
BIN_SLICES = 64
SPARE = 0.25  # of the segments, beyond those that chance leaves empty, may be left out as weak
FREQUENT = 4.0  # standard deviations above the mean count of a bin


def overlap(s: int, t: int, num: int, den: int) -> int:
    """The least intersection of sets of sizes s and t with I * den >= num * (s + t - I)."""
    return -(-num * (s + t) // (num + den))


def partner_sizes(s: int, num: int, den: int) -> range:
    return range(-(-num * s // den), den * s // num + 1)


def subset_sizes(s: int, num: int, den: int) -> list[int]:
    return sorted({c for t in partner_sizes(s, num, den) if 0 < (c := overlap(s, t, num, den)) <= min(s, t)})


def size_class(s: int) -> int:
    i, top = 0, 8
    while s > top:
        i, top = i + 1, int(top * GROWTH)
    return i


def class_top(i: int) -> int:
    top = 8
    for _ in range(i):
        top = int(top * GROWTH)
    return top


def spare(i: int, num: int, den: int) -> int:
    """Weak segments that a set of class i may leave out: what chance leaves empty, with room."""
    n, bottom = int(2 * class_top(i) * (den - num) // (den + num)) + 1, class_top(i - 1) if i else 1
    room = 2.0
    for _ in range(4):
        mean = (n + room) * exp(-bottom / (n + room))
        room = min(n + 0.0, mean + 4 * sqrt(mean) + 2)
    return ceil(room + n * SPARE)


def segments(i: int, num: int, den: int) -> int:
    """Segments of size class i: the shingles in which two qualifying sets of the class may differ, one more, and the spare ones."""
    return int(2 * class_top(i) * (den - num) // (den + num)) + 1 + spare(i, num, den)


def classes_of(s: int, num: int, den: int) -> range:
    """Size classes in which a set of size s can meet a partner: where the larger of both may lie."""
    return range(size_class(s), size_class(den * s // num) + 1)


def boundary(histogram: dict[int, int], num: int, den: int) -> int:
    """The largest light size, by cost over the numbers of sets of each small size."""

    def light(s: int) -> float:
        return sum(comb(s, c) for c in subset_sizes(s, num, den))

    def heavy(s: int) -> float:
        return sum(segments(i, num, den) for i in classes_of(s, num, den)) * CHECK_COST

    best, least = 0, None
    for x in range(LIGHT_MOST + 1):
        cost = sum(n * ((light(s) if s <= x else 0) + (heavy(s) if s > x or den * s // num > x else 0)) for s, n in histogram.items())
        if least is None or cost < least:
            best, least = x, cost
    return best


def _set_hashes(v: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128 bits that name each set."""
    out = []
    for salt in (0x1B873593, 0xE6546B64):
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(fmix(v ^ U64(salt * 0x9E3779B97F4A7C15 % (1 << 64))))])
        out.append(fmix(total[at[1:]] - total[at[:-1]] + np.diff(at).astype(np.uint64)))
    return out[0], out[1]


def _signatures(v: np.ndarray, at: np.ndarray, x: int, num: int, den: int, frequent: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(document indexes, signatures) of the non-empty sets; sizes up to x enumerate, larger ones and their small partners use lists."""
    sizes = np.diff(at)
    for s in np.unique(sizes[(sizes > 0) & (sizes <= x)]).tolist():
        docs = np.flatnonzero(sizes == s)
        mixed = fmix(v[at[docs][:, None] + np.arange(s)[None, :]] ^ U64(0xA24BAED4963EE407))
        for c in subset_sizes(s, num, den):
            for pick in combinations(range(s), c):
                yield docs, fmix(mixed[:, pick].sum(axis=1, dtype=np.uint64) + U64(c))
    kinds = {s: classes_of(s, num, den) for s in np.unique(sizes[(sizes > 0) & (den * sizes // num > x)]).tolist()}
    rare = ~frequent[(v >> U64(64 - BIN_BITS)).astype(np.int64)]
    share, weight = fmix(v + U64(0x9FB21C651E98DF25)), fmix(v ^ U64(0xD6E8FEB86659FD93))
    for i in sorted({i for r in kinds.values() for i in r}):
        docs = np.flatnonzero(np.isin(sizes, [s for s, r in kinds.items() if i in r]))
        n = segments(i, num, den)
        of = np.repeat(np.arange(len(docs)), sizes[docs])
        pos = np.arange(len(of)) - np.repeat(np.cumsum(sizes[docs]) - sizes[docs], sizes[docs]) + np.repeat(at[docs], sizes[docs])
        sums = np.zeros(len(docs) * n, np.uint64)
        cell = (share[pos] % U64(n)).astype(np.int64) + of * n
        np.add.at(sums, cell, weight[pos])
        # the weakest segments: empty, then frequent shingles only, then few; each set leaves out at most the spare ones
        strength = np.bincount(cell, minlength=len(docs) * n) + np.bincount(cell[rare[pos]], minlength=len(docs) * n) * 1000
        strength = strength.reshape(len(docs), n)
        room = spare(i, num, den)
        use = (strength >= np.partition(strength, room, axis=1)[:, room : room + 1]).ravel()
        salt = np.arange(1, n + 1, dtype=np.uint64) * U64(0x9E3779B97F4A7C15) + U64(i * 0xC2B2AE3D27D4EB4F % (1 << 64))
        yield np.repeat(docs, n)[use], fmix((sums + np.tile(salt, len(docs)))[use])


def classes(docs: DataFrame, k: int) -> DataFrame:
    """doc_id, text_hash, n_shingles and the set's 128-bit name (hi, lo) of every row."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, hi, lo = [], [], []
            for c in chunks(b.column("text")):
                v, at = shingle_sets(c, k)
                x, y = _set_hashes(v, at)
                n.append(np.diff(at))
                hi.append(signed(x))
                lo.append(signed(y))
            if n:
                yield pa.record_batch([b.column("doc_id"), b.column("text_hash"), pa.array(np.concatenate(n)), pa.array(np.concatenate(hi)), pa.array(np.concatenate(lo))], names=["doc_id", "text_hash", "n_shingles", "hi", "lo"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), "text")
    return rows.mapInArrow(trimmed(scan), "doc_id long, text_hash long, n_shingles long, hi long, lo long")


def frequent_bins(docs: DataFrame, k: int) -> np.ndarray:
    """Which of the hashed bins hold frequent shingles, as packed bits, from the counts of every text; its size is fixed."""
    width = (1 << BIN_BITS) // BIN_SLICES

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << BIN_BITS, np.int64)
        for b in batches:
            for c in chunks(b.column("text")):
                v, _ = shingle_sets(c, k)
                np.add.at(total, (v >> U64(64 - BIN_BITS)).astype(np.int64), 1)
        if total.any():
            small = total.astype(np.uint16 if total.max() < 1 << 16 else np.int64)
            yield pa.record_batch([pa.array(np.arange(BIN_SLICES, dtype=np.int32)), pa.array([small.itemsize] * BIN_SLICES, pa.int32()), pa.array([part.tobytes() for part in small.reshape(BIN_SLICES, width)])], names=["slice", "width", "counts"])

    def add(t: pa.Table) -> pa.Table:
        total = np.zeros(width, np.int64)
        for w, c in zip(t.column("width").to_pylist(), t.column("counts").to_pylist(), strict=True):
            total += np.frombuffer(c, np.uint16 if w == 2 else np.int64)
        often = total > max(8.0, total.mean() + FREQUENT * sqrt(total.mean()))
        return pa.table([pa.array([t.column("slice")[0].as_py()], pa.int32()), pa.array([np.packbits(often).tobytes()])], names=["slice", "often"])

    counts = docs.select("text").mapInArrow(trimmed(count), "slice int, width int, counts binary").groupBy("slice").applyInArrow(add, "slice int, often binary")
    bits = np.zeros((BIN_SLICES, width // 8), np.uint8)
    for r in counts.collect():
        bits[r["slice"]] = np.frombuffer(r.often, np.uint8)
    return bits.ravel()


def candidate_groups(docs: DataFrame, k: int, num: int, den: int, x: int, shared: Broadcast) -> DataFrame:
    """(hi, grp): the sets, by the first half of their name, that share a list or subset with another, and their group.

    ``shared`` are the frequent bins.
    """

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent, seen = np.unpackbits(shared.value).astype(bool), Seen()
        for b in batches:
            for c in chunks(b.column("text")):
                v, at = shingle_sets(c, k)
                hi, _ = _set_hashes(v, at)
                one = np.sort(seen.first(hi))  # sets alike in a task count once
                hi, sizes = hi[one], np.diff(at)[one]
                v = v[np.repeat(at[one] - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())]
                at = np.concatenate([[0], np.cumsum(sizes)])
                found = list(_signatures(v, at, x, num, den, frequent))
                if found:
                    sig = np.concatenate([s for _, s in found])
                    of = hi[np.concatenate([d for d, _ in found])]
                    yield pa.record_batch([pa.array(signed(sig)), pa.array(signed(of))], names=["sig", "hi"])

    sig = docs.select("text").mapInArrow(trimmed(emit), "sig long, hi long")
    return star_groups(sig)


def _stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From (sig, hi) sorted, an edge from each list's first hi to every other; remembers one row."""
    last, centre = None, 0
    for b in batches:
        if not b.num_rows:
            continue
        sig, hi = b.column("sig").to_numpy(), b.column("hi").to_numpy()
        new = np.concatenate([[last is None or sig[0] != last], sig[1:] != sig[:-1]])
        begin = np.maximum.accumulate(np.where(new, np.arange(len(sig)), -1))
        of = np.where(begin < 0, centre, hi[np.maximum(begin, 0)])
        last, centre = sig[-1], of[-1]
        edge = np.unique(np.stack([of, hi])[:, of != hi], axis=1)
        if edge.shape[1]:
            yield pa.record_batch([pa.array(edge[0]), pa.array(edge[1])], names=["a", "b"])


def star_groups(members: DataFrame) -> DataFrame:
    """members (sig, hi) -> (hi, grp) of those that share a sig with another hi; groups are the components.

    One shuffle by list; a list is read in order and never held.
    """
    edges = members.repartition("sig").sortWithinPartitions("sig", "hi").mapInArrow(_stars, "a long, b long").distinct()
    return connected_components(edges).select(F.col("node").alias("hi"), F.col("component").alias("grp"))


def _partners(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From (sig, id, blk, blocks) sorted, the blocks that each id meets by each list; -1 is all, where a list has half of them or more."""
    held: list[pa.RecordBatch] = []

    def lists(rows: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(rows)
        sig, ids, blk, blocks = (t.column(x).to_numpy() for x in ("sig", "id", "blk", "blocks"))
        begin = np.flatnonzero(np.concatenate([[True], sig[1:] != sig[:-1]]))
        end = np.append(begin[1:], len(sig))
        several = end - begin > 1
        out = [np.zeros((2, 0), np.int64)]
        for lo, hi in zip(begin[several].tolist(), end[several].tolist(), strict=True):
            there, own = np.unique(blk[lo:hi]), np.unique(ids[lo:hi])
            if 2 * len(there) >= blocks[lo]:
                there = np.array([-1])
            out.append(np.stack([np.repeat(own, len(there)), np.tile(there, len(own))]))
        out = np.unique(np.concatenate(out, axis=1), axis=1)
        yield pa.record_batch([pa.array(out[0]), pa.array(out[1].astype(np.int32))], names=["id", "o"])

    for b in batches:
        if not b.num_rows:
            continue
        sig = b.column("sig").to_numpy()
        # the last list may go on in the next batch
        last = int(np.searchsorted(sig, sig[-1]))
        if held and (last or held[-1].column("sig")[0].as_py() != sig[0]):
            first = int(np.searchsorted(sig, sig[0], "right")) if held[-1].column("sig")[0].as_py() == sig[0] else 0
            yield from lists([*held, b.slice(0, first)])
            held, b, last = [], b.slice(first), last - first
        if last > 0:
            yield from lists([b.slice(0, last)])
        held.append(b.slice(max(last, 0)))
    if held:
        yield from lists(held)


def meeting_blocks(texts: DataFrame, k: int, num: int, den: int, x: int, shared: Broadcast) -> DataFrame:
    """texts (rep, hi, lo, blk, blocks, text) of sets of large groups -> id and meets, the blocks of sets that share a list or subset with it, null for all."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent = np.unpackbits(shared.value).astype(bool)
        for b in batches:
            for c in chunks(b.column("text")):
                v, at = shingle_sets(c, k)
                hi, lo = _set_hashes(v, at)
                part = b.slice(c.first, c.docs)
                named = (part.column("hi").to_numpy() == signed(hi)) & (part.column("lo").to_numpy() == signed(lo))
                for of, sig in _signatures(v, at, x, num, den, frequent):
                    rows = part.select(["rep", "blk", "blocks"]).take(pa.array(of[named[of]]))
                    yield pa.record_batch([pa.array(signed(sig[named[of]])), *rows.columns], names=["sig", "id", "blk", "blocks"])

    lists = texts.select("rep", "hi", "lo", "blk", "blocks", "text").mapInArrow(trimmed(emit), "sig long, id long, blk int, blocks int")
    met = lists.repartition("sig").sortWithinPartitions("sig", "id").mapInArrow(_partners, "id long, o int").groupBy("id").agg(F.collect_set("o").alias("meets"))
    return met.select("id", F.when(~F.array_contains("meets", -1), F.col("meets")).alias("meets"))


def _with(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """The texts (rep, text) that ``wanted`` has a row for; where that isn't broadcast, only they are shuffled."""
    side = hinted(wanted, BROADCAST_ROWS)
    return (docs if side is not wanted else may_join(docs, wanted, ["rep"])).join(side, "rep")


def tokens(docs: DataFrame, k: int, keep: list[str]) -> DataFrame:
    """The columns ``keep`` and the sorted shingle set, as longs, of each text that has the set named by (hi, lo)."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for c in chunks(b.column("text")):
                v, at = shingle_sets(c, k)
                part = b.slice(c.first, c.docs)
                hi, lo = _set_hashes(v, at)
                lists = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(np.ascontiguousarray(signed(v))))
                named = (part.column("hi").to_numpy() == signed(hi)) & (part.column("lo").to_numpy() == signed(lo))
                yield pa.record_batch([*[part.column(x) for x in keep], lists], names=[*keep, "tokens"]).filter(pa.array(named))

    kinds = ", ".join(f"{c} {docs.schema[c].dataType.simpleString()}" for c in keep)
    return docs.select(*keep, "hi", "lo", "text").mapInArrow(trimmed(scan), f"{kinds}, tokens array<long>")


def linked_components(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """doc_id, n_shingles, component_id (least doc_id reachable by links), n_links (rows linked directly) and text_hash of every row."""
    rows = cut(classes(docs, k))
    reps = rows.filter("n_shingles > 0").groupBy("hi", "lo").agg(F.min("doc_id").alias("rep"), F.count("*").alias("weight"), F.first("n_shingles").alias("n"))
    reps = cut(reps)
    histogram = {r.n: r["count"] for r in reps.filter(F.col("n") <= LIGHT_MOST).groupBy("n").count().collect()}
    x = boundary(histogram, num, den)
    shared = docs.sparkSession.sparkContext.broadcast(frequent_bins(docs, k))
    groups = candidate_groups(docs, k, num, den, x, shared)
    wanted = cut(reps.join(groups, "hi").filter("rep is not null").select("rep", "hi", "lo", "weight", "grp"))
    texts = docs.select(F.col("doc_id").cast("long").alias("rep"), "text")
    large = cut(wanted.join(large_groups(wanted), "grp").select("rep", "hi", "lo", blocks_of(F.col("__n")).alias("blocks")).withColumn("blk", block_of(F.col("rep"), F.col("blocks"))))
    meets = meeting_blocks(_with(texts, large), k, num, den, x, shared)
    asked = cut(wanted.join(meets.withColumnRenamed("id", "rep"), "rep", "left"))
    sets = tokens(_with(texts, asked), k, ["grp", "rep", "weight", "meets"]).withColumnRenamed("rep", "id")
    found = cut(links(sets, wanted, num, den))
    comp = connected_components(found.select("a", "b"))
    direct = found.filter("a = b").groupBy(F.col("a").alias("rep")).agg(F.sum("links").alias("__links"))
    by_rep = reps.join(comp.select(F.col("node").alias("rep"), "component"), "rep", "left").join(direct, "rep", "left")
    named = by_rep.select("hi", "lo", F.coalesce("component", "rep").alias("component"), (F.coalesce("__links", F.lit(0)) + F.col("weight") - 1).alias("n_links"))
    out = rows.join(named, ["hi", "lo"], "left")
    alone = F.col("n_shingles") == 0
    return out.select(
        "doc_id",
        "n_shingles",
        F.when(alone, F.col("doc_id")).otherwise(F.col("component")).alias("component_id"),
        F.when(alone, F.lit(0)).otherwise(F.col("n_links")).cast("long").alias("n_links"),
        "text_hash",
    )


def one_of_each(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """The documents with one of each group of near duplicates, that of the least doc_id, in the columns they came with.

    Of rows that repeat that document one stays; documents without words, and rows without an id, all stay.
    """
    rows = cut(linked_components(docs, k, num, den)).filter((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull())
    first = F.col("doc_id") == F.col("component_id")
    stays = rows.filter(first).groupBy("component_id").agg(F.min("text_hash").alias("__th"), F.count("*").alias("__copies"))
    # all but the only first document of a group is judged: it goes, or one of its copies stays
    key = (F.col("doc_id").alias("__id"), F.col("text_hash").alias("__h"))
    copies = rows.filter(first).join(stays.filter("__copies > 1"), "component_id").select(*key, (F.col("text_hash") == F.col("__th")).alias("__one"))
    judged = rows.filter(~first).select(*key, F.lit(False).alias("__one")).unionByName(copies)
    judged = cut(judged.groupBy("__id", "__h").agg(F.max("__one").alias("__one")))
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("doc_id").cast("long").alias("__id"), F.xxhash64("text").alias("__h"))
    side = hinted(judged, BROADCAST_ROWS)
    # with many judged, the others are told by a filter of fixed size and stay where they are
    some, rest = (packed, None) if side is not judged else parted(packed, judged, ["__id", "__h"])
    met = some.join(side, ["__id", "__h"], "left")
    once = met.filter("__one is null").select("row").unionByName(met.filter("__one").dropDuplicates(["__id", "__h"]).select("row"))
    if rest is not None:
        once = once.unionByName(rest.select("row"))
    return once.select(*[F.col(f"row.`{c}`").alias(c) for c in docs.columns])
