"""Substring dedup by MinHash banding of paragraphs.

A paragraph is a line; longer lines are cut further where a hash of three
words is least within ``REACH`` words on either side, so that a passage is cut
alike wherever it stands.  Lines and their pieces of ``MIN_WORDS`` words or
more are compared by their sets of word shingles: equal sets form classes,
classes meet in bands of MinHashes (tuned to a recall of ``RECALL`` at the
threshold), ``_verify`` decides exact Jaccard inside the groups that meet,
between sets of which another there has a size that allows the threshold; in
large groups, between those that share a rare shingle which every link has.

What goes, by place (doc_id, hash of the text, first byte):

1. of the lines of a component, all but the first;
2. of its pieces (and lines that are not cut) in the lines that stay, all but
   the first;
3. in the lines that stay, every run of ``PASSAGE`` words that stands in them
   at an earlier place, so that a longer repeat goes as a whole, word by word.

Runs are found through anchors: the least hash of ``GRAM`` words in a run is
the same wherever the run stands, so runs whose anchor stands once are done.
Removed spans that overlap are one.

Defined results: null, empty and blank texts have no paragraphs; shorter
paragraphs always stay; repeated rows repeat each other's paragraphs; rows
without an id come first; an empty table gives no rows; further columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._graph import connected_components
from ._sieve import may_join
from ._spark import cut, remove, written
from ._text import _R, _R_INV, U64, Chunk, Seen, chunks, fmix, hash_ranges, powers, shingles_of, signed, spans, trimmed
from ._verify import links, narrowed
from .ngram_join import _set_hashes

REACH = 10
MIN_WORDS = 8
PASSAGE = 24
GRAM = 8
ROWS_PER_BAND = 2
RECALL = 0.997
PACKED = 1 << 19  # band entries of a task that are dealt to buckets at once
BUCKET_ENTRIES = 1 << 21  # of a bucket that are sorted at once


def bands(threshold: float, recall: float = RECALL, rows: int = ROWS_PER_BAND) -> int:
    """The fewest bands that catch a pair at the threshold with probability ``recall``."""
    return int(np.ceil(np.log(1 - recall) / np.log(1 - threshold**rows)))


def _least(g: np.ndarray, w: int) -> np.ndarray:
    """The least of each ``w`` neighbouring values."""
    if len(g) < w:
        return g[:0]
    rows = np.concatenate([g, np.full(-len(g) % w + w, ~U64(0))]).reshape(-1, w)
    ahead = np.minimum.accumulate(rows, axis=1).ravel()
    behind = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[: len(g) - w + 1], ahead[w - 1 : len(g)])


def _least_around(g: np.ndarray, reach: int) -> np.ndarray:
    """Whether each value is the least of those at most ``reach`` away (the ends count as missing)."""
    out = np.zeros(len(g), bool)
    if len(g) > 2 * reach:
        out[reach : len(g) - reach] = g[reach : len(g) - reach] == _least(g, 2 * reach + 1)
    return out


def _hashes(h: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of the runs start:end of word hashes; equal runs give equal hashes."""
    p = np.zeros(len(h) + 1, np.uint64)
    np.cumsum(h * powers(_R, len(h))[: len(h)], out=p[1:])
    return fmix((p[end] - p[start]) * powers(_R_INV, len(h))[start] + (end - start).astype(np.uint64))


def _lines(c: Chunk):
    """Word hashes, first and last byte + 1 of each word, first word of each document, and first word of each line."""
    s, e, first = spans(c)
    h = hash_ranges(c.prefix_hash(True), s, e)
    begins = np.zeros(len(h), bool)
    if len(h):
        line = np.concatenate([[0], np.cumsum(c.buf == 10)])[s]
        begins[1:] = line[1:] != line[:-1]
        begins[first[:-1][first[:-1] < first[1:]]] = True
    return h, s, e, first, np.flatnonzero(begins)


def paragraphs(c: Chunk):
    """Word hashes, and by units, the pieces of all lines and then the lines that are cut: first word, last word + 1,
    document, kind (0 piece of a line, 1 line that is not cut, 2 line that is cut), first byte of the line, first and last byte + 1."""
    h, s, e, first, starts = _lines(c)
    n = len(h)
    if not n:
        z = np.zeros(0, np.int64)
        return h, z, z, z, z, z, z, z
    ends = np.append(starts[1:], n)
    length = ends - starts
    number = np.repeat(np.arange(len(starts)), length)
    place = np.arange(n) - starts[number]
    g = h.copy()
    g[1:] += h[:-1] * U64(0x9E3779B97F4A7C15)
    g[2:] += h[:-2] * U64(0xC2B2AE3D27D4EB4F)
    inside = (place >= REACH + 2) & (place < length[number] - REACH)
    begins = _least_around(fmix(g), REACH) & inside
    begins[starts] = True
    pieces = np.flatnonzero(begins)
    whole = np.bincount(number[pieces], minlength=len(starts)) == 1
    u0 = np.concatenate([pieces, starts[~whole]])
    u1 = np.concatenate([np.append(pieces[1:], n), ends[~whole]])
    kind = np.concatenate([whole[number[pieces]].astype(np.int64), np.full(int((~whole).sum()), 2)])
    doc = np.searchsorted(first, u0, "right") - 1
    at = c.at[doc]
    return h, u0, u1, doc, kind, s[starts[number[u0]]] - at, s[u0] - at, e[u1 - 1] - at


def _sets(c: Chunk, k: int):
    """Units long enough to compare: their sets, names, documents, kinds, whereabouts and names of long lines; pieces a document."""
    h, u0, u1, doc, kind, line, b0, b1 = paragraphs(c)
    n = np.bincount(doc[kind < 2], minlength=c.docs)
    long = np.flatnonzero(u1 - u0 >= MIN_WORDS)
    u0, u1 = u0[long], u1[long]
    pick = np.concatenate([h[i:j] for i, j in zip(u0.tolist(), u1.tolist(), strict=True)] or [h[:0]])
    v, offsets = shingles_of(pick, np.concatenate([[0], np.cumsum(u1 - u0)]), k)
    hi, lo = _set_hashes(v, offsets)
    name = np.where((kind[long] > 0) & (u1 - u0 >= PASSAGE), _hashes(h, u0, u1), U64(0))
    return v, offsets, hi, lo, doc[long], kind[long], line[long], b0[long], b1[long], name, n


def _units(docs: DataFrame, k: int) -> DataFrame:
    """One row a comparable unit, and one (kind -1) a document with the number of all its pieces in b0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for c in chunks(b.column("text")):
                _, offsets, hi, lo, doc, kind, line, b0, b1, name, n = _sets(c, k)
                every = np.concatenate([doc, np.arange(c.docs)])
                at = pa.array(every + c.first)
                zero = np.zeros(c.docs, np.int64)
                yield pa.record_batch(
                    [b.column("doc_id").take(at), b.column("th").take(at)]
                    + [pa.array(np.concatenate([signed(x), zero])) for x in (hi, lo, name)]
                    + [pa.array(np.concatenate(x).astype(np.int32)) for x in ((kind, zero - 1), (line, zero), (b0, n), (b1, zero), (np.diff(offsets), zero))],
                    names=["doc_id", "th", "hi", "lo", "name", "kind", "line", "b0", "b1", "size"],
                )

    return docs.mapInArrow(run, "doc_id long, th long, hi long, lo long, name long, kind int, line int, b0 int, b1 int, size int")


def _dealt(sig: np.ndarray, hi: np.ndarray, bits: int) -> pa.RecordBatch:
    """The entries in buckets by the first bits of sig, a row a bucket."""
    bucket = (sig >> U64(64 - bits)).astype(np.uint16 if bits <= 16 else np.uint32)
    by = np.argsort(bucket, kind="stable")
    some, at = np.unique(bucket[by], return_index=True)
    offsets = pa.py_buffer(np.append(at, len(by)).astype(np.int32) * 8)
    packed = [pa.Array.from_buffers(pa.binary(), len(some), [None, offsets, pa.py_buffer(np.ascontiguousarray(x[by]))]) for x in (sig, hi)]
    return pa.record_batch([pa.array(some.astype(np.int32)), *packed], names=["bucket", "sig", "hi"])


def _unpacked(column: pa.Array) -> np.ndarray:
    """The longs in a column of packed ones."""
    at = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(column.buffers()[2], np.uint8)[at[0] : at[-1]].copy().view(np.int64)


def _folded(sig: np.ndarray, hi: np.ndarray) -> tuple[pa.RecordBatch, np.ndarray, np.ndarray]:
    """Edges from the least hi of each sig to its others; each sig and that least hi."""
    by = np.argsort(sig)
    sig, hi = sig[by], hi[by]
    begin = np.flatnonzero(np.concatenate([[True], sig[1:] != sig[:-1]]))
    least = np.minimum.reduceat(hi, begin)
    of = np.repeat(least, np.diff(np.append(begin, len(sig))))
    a, b = of[of != hi], hi[of != hi]
    by = np.lexsort((b, a))
    a, b = a[by], b[by]
    new = np.ones(len(a), bool)
    new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    return pa.record_batch([pa.array(a[new]), pa.array(b[new])], names=["a", "b"]), sig[begin], least


def _bucket_stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From packed rows sorted by bucket, stars that connect the hi of each sig; holds a part of a bucket, and a row for each of its sigs."""
    last, held, n = None, [], 0

    def fold(parts: list) -> tuple[pa.RecordBatch, np.ndarray, np.ndarray]:
        return _folded(*(np.concatenate(x) for x in zip(*parts, strict=True)))

    for b in batches:
        bucket = b.column("bucket").to_numpy()
        begin = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]])).tolist() if len(bucket) else []
        for lo, end in zip(begin, [*begin[1:], len(bucket)], strict=True):
            if held and bucket[lo] != last:
                yield fold(held)[0]
                held, n = [], 0
            last = bucket[lo]
            part = b.slice(lo, end - lo)
            held.append((_unpacked(part.column("sig")), _unpacked(part.column("hi"))))
            n += len(held[-1][0])
            if n > BUCKET_ENTRIES:  # from here on the sigs so far are told by their least hi
                edges, sig, least = fold(held)
                yield edges
                held, n = [(sig, least)], 0
    if held:
        yield fold(held)[0]


def _band_groups(docs: DataFrame, k: int, n_bands: int) -> DataFrame:
    """(hi, grp) of the sets that share a band with another; groups are the components.

    Entries of bands are shuffled packed by bucket, a few rows for each task, and sorted as arrays.
    """
    bits = max(1, (4 * docs.rdd.getNumPartitions() - 1).bit_length())
    salts = [int(x) for x in fmix(np.arange(1, n_bands * ROWS_PER_BAND + 1, dtype=np.uint64))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, held, n = Seen(), [], 0
        for b in batches:
            for c in chunks(b.column("text")):
                v, offsets, hi, *_ = _sets(c, k)
                one = seen.first(hi)
                if not len(one):
                    continue
                hi = hi[one]
                sig = []
                for band in range(n_bands):
                    total = np.zeros(len(hi), np.uint64)
                    for r in range(ROWS_PER_BAND):
                        i = band * ROWS_PER_BAND + r
                        total += fmix(np.minimum.reduceat(fmix(v ^ U64(salts[i])), offsets[:-1])[one] + U64(i))
                    sig.append(fmix(total + U64(band)))
                held.append((np.concatenate(sig), np.tile(hi, n_bands)))
                n += len(held[-1][0])
                if n >= PACKED:
                    yield _dealt(*(np.concatenate(x) for x in zip(*held, strict=True)), bits)
                    held, n = [], 0
        if held:
            yield _dealt(*(np.concatenate(x) for x in zip(*held, strict=True)), bits)

    packed = docs.select("text").mapInArrow(trimmed(run), "bucket int, sig binary, hi binary")
    edges = packed.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(trimmed(_bucket_stars), "a long, b long").distinct()
    return connected_components(edges).select(F.col("node").alias("hi"), F.col("component").alias("grp"))


def _fitting(sets: DataFrame, num: int, den: int) -> DataFrame:
    """sets (hi, lo, size, grp and others) with no grp where none of the group has a size that allows the threshold.

    An intersection is no larger than the smaller set, and of all sizes of a
    group the next ones up and down are the likeliest to fit.
    """
    sizes = sets.filter("grp is not null").groupBy("grp", "size").agg(F.count("*").alias("m"), F.min("hi").alias("hi"), F.min("lo").alias("lo"))
    near = Window.partitionBy("grp").orderBy("size")
    below, above = F.lag("size").over(near), F.lead("size").over(near)
    sizes = sizes.withColumn("fits", F.coalesce(below * den >= F.col("size") * num, F.lit(False)) | F.coalesce(F.col("size") * den >= above * num, F.lit(False)))
    alone = sizes.filter("m = 1 and not fits").select("hi", "lo", F.lit(True).alias("alone"))
    return sets.join(alone, ["hi", "lo"], "left").withColumn("grp", F.when(F.col("alone").isNull(), F.col("grp"))).drop("alone", "size")


def _tokens(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            wanted = [{(w["hi"], w["lo"]): w["grp"] for w in x} for x in b.column("wanted").to_pylist()]
            for c in chunks(b.column("text")):
                v, offsets, hi, lo, doc, *_ = _sets(c, k)
                hi, lo = signed(hi).tolist(), signed(lo).tolist()
                found = {}
                for i, d in enumerate(doc.tolist()):
                    grp = wanted[c.first + d].get((hi[i], lo[i]))
                    if grp is not None:
                        found[hi[i]] = (grp, v[offsets[i] : offsets[i + 1]])
                if found:
                    lists = pa.array([signed(t) for _, t in found.values()], pa.list_(pa.int64()))
                    yield pa.record_batch([pa.array([g for g, _ in found.values()], pa.int64()), pa.array(list(found), pa.int64()), pa.array([1] * len(found), pa.int64()), lists], names=["grp", "id", "weight", "tokens"])

    return run


def _runs(c: Chunk):
    """The runs of ``PASSAGE`` words inside lines: word hashes and bytes of words, first word of each run, its line, the line's
    first and last word + 1, document, anchor; and the hash of ``GRAM`` words from each word on."""
    h, s, e, first, starts = _lines(c)
    n = len(h)
    ends = np.append(starts[1:], n)[: len(starts)]
    number = np.repeat(np.arange(len(starts)), ends - starts)
    at = np.arange(max(0, n - PASSAGE + 1))
    at = at[at + PASSAGE <= ends[number[at]]]
    w = np.arange(max(0, n - GRAM + 1))
    g = _hashes(h, w, w + GRAM)
    anchor = _least(g, PASSAGE - GRAM + 1)[at]
    return h, s, e, at, number[at], starts, ends, np.searchsorted(first, at, "right") - 1, anchor, g


def _anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """anchor, name of the line it stands in, and whether it stands there more than once; lines alike in a task count once."""
    seen = Seen()
    for b in batches:
        for c in chunks(b.column("text")):
            h, _, _, at, line, starts, ends, _, anchor, g = _runs(c)
            if not len(at):
                continue
            # a run's anchor may stand at several words of the run; a word is one where some run that holds it has it as anchor
            most = np.full(len(g) + PASSAGE - GRAM, ~U64(0))
            most[at + PASSAGE - GRAM] = ~anchor
            of = np.flatnonzero(~_least(most, PASSAGE - GRAM + 1)[: len(g)] == g)
            number = np.searchsorted(starts, of, "right") - 1
            by = np.lexsort((g[of], number))
            number, a = number[by], g[of][by]
            new = np.ones(len(a), bool)
            new[1:] = (a[1:] != a[:-1]) | (number[1:] != number[:-1])
            twice = np.diff(np.append(np.flatnonzero(new), len(a))) > 1
            number, a = number[new], a[new]
            name = _hashes(h, starts[number], ends[number])
            one = seen.first(fmix(name) + a)
            yield pa.record_batch([pa.array(signed(a[one])), pa.array(signed(name[one])), pa.array(twice[one])], names=["a", "name", "twice"])


def _met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From (a, name, twice) sorted, (a, name) of anchors that stand in several lines, or twice in one; some repeat."""
    last, lead = None, 0
    for b in batches:
        if not b.num_rows:
            continue
        a, name = b.column("a").to_numpy(), b.column("name").to_numpy()
        new = np.concatenate([[last is None or a[0] != last], a[1:] != a[:-1]])
        begin = np.maximum.accumulate(np.where(new, np.arange(len(a)), -1))
        of = np.where(begin < 0, lead, name[np.maximum(begin, 0)])
        last, lead = a[-1], of[-1]
        other, twice = name != of, b.column("twice").to_numpy(zero_copy_only=False)
        out = np.unique(np.stack([np.concatenate([a[other], a[other], a[twice]]), np.concatenate([name[other], of[other], name[twice]])]), axis=1)
        yield pa.record_batch([pa.array(out[0]), pa.array(out[1])], names=["a", "name"])


def _not_first(g: np.ndarray, *place: np.ndarray) -> np.ndarray:
    """Whether a row stands at another place than the least of its g."""
    by = np.lexsort((*place[::-1], g))
    first = np.ones(len(g), bool)
    first[1:] = g[by][1:] != g[by][:-1]
    least = np.empty(len(g), np.int64)
    least[by] = by[np.maximum.accumulate(np.where(first, np.arange(len(g)), 0))] if len(g) else 0
    return np.logical_or.reduce([x != x[least] for x in place])


def _overlapping(pick: np.ndarray, doc: np.ndarray, b0: np.ndarray, b1: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first and the last of each series of overlapping runs among the runs ``pick``, which ascend by document and place."""
    new = np.ones(len(pick), bool)
    new[1:] = (doc[pick[1:]] != doc[pick[:-1]]) | (b0[pick[1:]] >= b1[pick[:-1]])
    begin = np.flatnonzero(new)
    return pick[begin], pick[np.append(begin[1:], len(pick)) - 1] if len(pick) else pick


def _wanted_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Hash and whereabouts of every run of a line with an anchor that was asked for there.

    ``later`` tells those whose like stands at an earlier place in the same chunk; they go whatever else there is,
    so overlapping ones are one row, dealt anywhere by its key, while the others meet by their hash.
    """
    for b in batches:
        wanted = b.column("wanted")
        for c in chunks(b.column("text")):
            h, s, e, at, line, starts, _, doc, anchor, _ = _runs(c)
            part = wanted.slice(c.first, c.docs)
            n = pc.list_value_length(part).to_numpy(zero_copy_only=False)
            flat = part.flatten()
            key = lambda d, b0, a: fmix(d.astype(np.uint64) * U64(1 << 32) + b0.astype(np.uint64)) + fmix(a)
            asked = key(np.repeat(np.arange(c.docs), n), flat.field("b0").to_numpy(), flat.field("a").to_numpy().view(np.uint64))
            hit = np.isin(key(doc, s[starts[line]] - c.at[doc], anchor), asked)
            at, doc = at[hit], doc[hit]
            of = pa.array(doc + c.first)
            doc_id, th = b.column("doc_id").take(of), b.column("th").take(of)
            b0, b1 = s[at] - c.at[doc], e[at + PASSAGE - 1] - c.at[doc]
            g = _hashes(h, at, at + PASSAGE)
            later = _not_first(g, np.asarray(doc_id.is_valid()), doc_id.fill_null(0).to_numpy(), th.to_numpy(), b0)
            first, last = _overlapping(np.flatnonzero(later), doc, b0, b1)
            row = np.concatenate([np.flatnonzero(~later), first])
            end = np.concatenate([b1[~later], b1[last]])
            key_of = np.concatenate([g[~later], fmix(g[first] + fmix(first.astype(np.uint64)))])
            of = pa.array(row)
            columns = [pa.array(signed(key_of)), doc_id.take(of), th.take(of), pa.array(b0[row].astype(np.int32)), pa.array(end.astype(np.int32)), pa.array(np.arange(len(row)) >= len(row) - len(first))]
            yield pa.record_batch(columns, names=["g", "doc_id", "th", "b0", "b1", "later"])


def _later(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From runs sorted by hash and place, those that stand elsewhere than the first of their hash, and those known to."""
    last = None
    for b in batches:
        known = b.column("later")
        yield b.filter(known).select(["doc_id", "th", "b0", "b1"])
        b = b.filter(pc.invert(known))
        if not b.num_rows:
            continue
        g = b.column("g").to_numpy()
        new = np.ones(len(g), bool)
        new[1:] = g[1:] != g[:-1]
        new[0] = last is None or g[0] != last[0]
        begin = np.maximum.accumulate(np.where(new, np.arange(len(g)), -1))
        same = np.ones(len(g), bool)
        for i, name in enumerate(("doc_id", "th", "b0")):
            x = b.column(name)
            value, null = x.fill_null(0).to_numpy(), np.asarray(x.is_null())
            first, none = value[np.maximum(begin, 0)], null[np.maximum(begin, 0)]
            if last is not None:
                first, none = np.where(begin < 0, last[1][i][0], first), np.where(begin < 0, last[1][i][1], none)
            same &= (value == first) & (null == none)
            if not i:
                held = []
            held.append((first[-1], none[-1]))
        last = (g[-1], held)
        yield b.filter(pa.array(~same)).select(["doc_id", "th", "b0", "b1"])


def _with_wanted(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """The texts that ``wanted`` (doc_id, th, wanted) asks for; only those are shuffled."""
    docs = may_join(docs, wanted, ["doc_id", "th"])
    return docs.join(wanted, (docs["th"] == wanted["th"]) & docs["doc_id"].eqNullSafe(wanted["doc_id"])).select(docs["doc_id"], docs["th"], "wanted", "text")


def repeated_passages(docs: DataFrame, lines: DataFrame) -> DataFrame:
    """lines (name, doc_id, th, b0) that stay -> doc_id, th, b0, b1 of every run of ``PASSAGE`` words at another than its first place in them."""
    met = docs.select("text").mapInArrow(_anchors, "a long, name long, twice boolean").repartition("a").sortWithinPartitions("a", "name").mapInArrow(_met, "a long, name long")
    wanted = cut(met.join(lines, "name").groupBy("doc_id", "th").agg(F.collect_set(F.struct("b0", "a")).alias("wanted")))
    texts = _with_wanted(docs, wanted)
    runs = texts.mapInArrow(_wanted_runs, "g long, doc_id long, th long, b0 int, b1 int, later boolean")
    return runs.repartition("g").sortWithinPartitions("g", "doc_id", "th", "b0").mapInArrow(_later, "doc_id long, th long, b0 int, b1 int")


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of each text with their removed spans; overlapping ones are one."""
    for b in batches:
        out: list[list] = [[], [], [], [], []]
        columns = [b.column(x).to_pylist() for x in ("doc_id", "rows", "n_paragraphs", "spans", "kept")]
        for doc, rows, n, gone, kept in zip(*columns, strict=True):
            for i in range(rows):
                spans_: list[list[int]] = []
                # a repeated row has every paragraph of the first of its kind
                for x in sorted((y["b0"], y["b1"]) for y in (gone + kept if i else gone)):
                    if spans_ and x[0] < spans_[-1][1]:
                        spans_[-1][1] = max(spans_[-1][1], x[1])
                    else:
                        spans_.append(list(x))
                for column, value in zip(out, (doc, n, len(spans_), sum(y - x for x, y in spans_), ",".join(f"{x}:{y}" for x, y in spans_)), strict=True):
                    column.append(value)
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string())
        yield pa.record_batch([pa.array(x, t) for x, t in zip(out, kinds, strict=True)], names=["doc_id", "n_paragraphs", "n_removed", "removed_bytes", "removed"])


def repeated_paragraphs(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """doc_id, n_paragraphs, n_removed, removed_bytes and removed ("start:end" by bytes, comma-joined) of every document."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("th"), "text")
    units, _ = written(_units(docs, k))
    groups = cut(_band_groups(docs, k, bands(num / den)))
    here = F.struct("doc_id", "th", "b0")
    firsts = (F.min(here).alias("first"), F.min(F.when(F.col("kind") > 0, here)).alias("line"))
    size = F.max("size").alias("size")
    sets, path = written(units.filter("kind >= 0").groupBy("hi", "lo").agg(F.count("*").alias("n"), size, *firsts).join(groups, "hi", "left").filter("n > 1 or grp is not null"))
    sets = cut(_fitting(sets, num, den).filter("n > 1 or grp is not null"))
    remove(docs.sparkSession, path)
    wanted = cut(sets.filter("grp is not null").groupBy("first.doc_id", "first.th").agg(F.collect_list(F.struct("hi", "lo", "grp")).alias("wanted")))
    texts = _with_wanted(docs, wanted).select("wanted", "text")
    tokens, path = written(texts.mapInArrow(_tokens(k), "grp long, id long, weight long, tokens array<long>"))
    found = cut(links(*narrowed(tokens, sets.filter("grp is not null"), num, den), num, den).select("a", "b").filter("a != b"))
    remove(docs.sparkSession, path)
    component = connected_components(found).select(F.col("node").alias("hi"), "component")
    # a set that stands once and links with none decides nothing
    named = sets.join(component, "hi", "left").filter("n > 1 or component is not null").withColumn("component", F.coalesce("component", "hi"))
    stays = named.groupBy("component").agg(F.min("line").alias("stays"))
    named = cut(named.select("hi", "lo", "component").join(stays, "component").select("hi", "lo", "component", "stays"))
    # lines first; what is in lines that go decides nothing more
    hits = units.filter("kind >= 0").join(named, ["hi", "lo"]).drop("hi", "lo", "name", "size")
    gone = (F.col("kind") > 0) & ~here.eqNullSafe(F.col("stays"))
    hits = cut(hits.withColumn("dead", F.max(gone).over(Window.partitionBy("doc_id", "th", "line"))).drop("stays"))
    first = hits.filter("kind < 2 and not dead").groupBy("component").agg(F.min(here).alias("first"))
    hits = hits.join(first, "component", "left")
    gone = F.when(F.col("dead"), F.col("kind") > 0).otherwise((F.col("kind") < 2) & ~here.eqNullSafe(F.col("first")))
    span = F.struct("b0", "b1")
    none = F.lit(None).cast("struct<b0:int,b1:int>")
    hits = hits.select("doc_id", "th", F.lit(None).cast("int").alias("n"), F.when(gone, span).alias("span"), F.when(~gone & (F.col("kind") > 0), span).alias("kept"))
    lines = units.filter("kind > 0 and name != 0").join(named.select("hi", "lo", "stays"), ["hi", "lo"], "left")
    lines = lines.filter(F.col("stays").isNull() | here.eqNullSafe(F.col("stays"))).select("name", "doc_id", "th", "b0").distinct()
    # a table, so that the shuffles of texts and runs are gone when the last one is written
    passages, _ = written(repeated_passages(docs, lines))
    runs = passages.select("doc_id", "th", F.lit(None).cast("int").alias("n"), span.alias("span"), none.alias("kept"))
    every = units.filter("kind < 0").select("doc_id", "th", F.col("b0").alias("n"), none.alias("span"), none.alias("kept"))
    out = every.unionByName(hits).unionByName(runs).groupBy("doc_id", "th").agg(
        F.count("n").cast("int").alias("rows"),
        F.max("n").cast("long").alias("n_paragraphs"),
        F.collect_set("span").alias("spans"),
        F.collect_set("kept").alias("kept"),
    )
    return out.select("doc_id", "rows", "n_paragraphs", "spans", "kept").mapInArrow(_merged, "doc_id long, n_paragraphs long, n_removed long, removed_bytes long, removed string")
