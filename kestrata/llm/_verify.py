"""Exact Jaccard links inside groups of candidate sets, without emitting pairs.

Sets that may link share a group.  A group of up to ``MEMBERS`` is one task's
work; a larger one is dealt to blocks, and each pair of blocks is compared
where both meet, so that no task holds more than two blocks.  Where it is known
which blocks hold those that a set may link with (``meets``), it goes to no
others.  Where links are asked for and not their number, ``narrowed`` parts a
large group first by the rare tokens that sets which link must share.  A task
returns a spanning forest of the links it finds and each set's
number of links.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._spark import cut
from ._text import U64, fmix, trimmed

MEMBERS = 256
FEW = 24  # members of a group whose pairs are compared one by one, together with those of other groups
PAIR_TOKENS = 1 << 20
SALTS = 32
MOST_BROADCAST = 100_000  # large groups, two numbers each
COLUMNS = 1 << 14
CELL_BITS = 22  # of a token's cell: 8 MB of counters, whatever the number of tokens
SLICE_BITS = 16

_OUT = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("links", pa.int64())])


def intersections(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections of some hundred sets, by products of slices of their incidence matrix."""
    k = len(sets)
    row = np.repeat(np.arange(k), [len(s) for s in sets])
    token, column, df = np.unique(np.concatenate(sets) if k else np.zeros(0, np.int64), return_inverse=True, return_counts=True)
    shared = df > 1
    place = np.cumsum(shared) - 1
    keep = shared[column]
    row, column = row[keep], place[column[keep]]
    out = np.zeros((k, k), np.float32)
    by = np.argsort(column, kind="stable")
    row, column = row[by], column[by]
    for lo in range(0, int(shared.sum()), COLUMNS):
        i, j = np.searchsorted(column, (lo, lo + COLUMNS))
        used = min(COLUMNS, int(shared.sum()) - lo)
        m = np.zeros((k, used), np.float32)
        m[row[i:j], column[i:j] - lo] = 1
        out += m @ m.T
    out = out.astype(np.int64)
    out[np.arange(k), np.arange(k)] = [len(s) for s in sets]
    return out


def forest(linked: np.ndarray) -> list[tuple[int, int]]:
    """Edges of a spanning forest of a boolean adjacency matrix."""
    k = len(linked)
    todo, edges = np.ones(k, bool), []
    for root in range(k):
        if not todo[root]:
            continue
        todo[root], front = False, [root]
        while front:
            u = front.pop()
            for v in np.flatnonzero(linked[u] & todo):
                todo[v] = False
                edges.append((u, int(v)))
                front.append(int(v))
    return edges


def blocks_of(n: Column) -> Column:
    """Blocks of a group of n sets."""
    return F.ceil(n / F.lit(MEMBERS)).cast("int")


def block_of(id_: Column, blocks: Column) -> Column:
    return F.pmod(F.xxhash64(id_), blocks).cast("int")


def large_groups(groups: DataFrame) -> DataFrame:
    """grp and __n, the number of sets, of the groups that are dealt to blocks."""
    return groups.groupBy("grp").agg(F.count("*").alias("__n")).filter(F.col("__n") > MEMBERS)


def _sized(sets: DataFrame, groups: DataFrame) -> DataFrame:
    """sets with __n, the number of sets of their group where that is large."""
    # the few large groups meet their size by broadcast, or under SALTS keys, so that none is one task's work
    large = cut(large_groups(groups))
    if large.limit(MOST_BROADCAST + 1).count() <= MOST_BROADCAST:
        return sets.join(F.broadcast(large), "grp", "left")
    salted = sets.withColumn("__s", F.pmod(F.xxhash64(F.lit(3), "id"), F.lit(SALTS)).cast("int"))
    return salted.join(large.withColumn("__s", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))), ["grp", "__s"], "left").drop("__s")


def _cells(grp: np.ndarray, flat: np.ndarray) -> np.ndarray:
    return (fmix(fmix(grp.view(np.uint64)) + flat.view(np.uint64)) >> U64(64 - CELL_BITS)).astype(np.int64)


def _listed(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Tokens of the sets of a batch, the row of each, and the sizes."""
    column = b.column("tokens")
    at = column.offsets.to_numpy().astype(np.int64)
    size = np.diff(at)
    return column.values.to_numpy()[at[0] : at[-1]], np.repeat(np.arange(len(size)), size), size


def _counts(sets: DataFrame) -> np.ndarray:
    """For each cell of (grp, token), in how many sets it occurs: at least as often as any of its tokens, up to 65 535."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            flat, row, _ = _listed(b)
            cell, n = np.unique(_cells(b.column("grp").to_numpy()[row], flat), return_counts=True)
            yield pa.record_batch([pa.array(cell.astype(np.int32)), pa.array(n)], names=["cell", "n"])

    def pack(t: pa.Table) -> pa.Table:
        n = np.zeros(1 << SLICE_BITS, np.uint16)
        n[t.column("cell").to_numpy() & ((1 << SLICE_BITS) - 1)] = np.minimum(t.column("n").to_numpy(), 65535)
        return pa.table([pa.array([t.column("s")[0].as_py()], pa.int32()), pa.array([n.tobytes()])], names=["s", "n"])

    summed = sets.select("grp", "tokens").mapInArrow(run, "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n"))
    out = np.zeros((1 << (CELL_BITS - SLICE_BITS), 1 << SLICE_BITS), np.uint16)
    for r in summed.withColumn("s", F.shiftright("cell", SLICE_BITS)).groupBy("s").applyInArrow(pack, "s int, n binary").collect():  # 8 MB at most
        out[r.s] = np.frombuffer(r.n, np.uint16)
    return out.ravel()


def narrowed(sets: DataFrame, groups: DataFrame, numerator: int, denominator: int) -> tuple[DataFrame, DataFrame]:
    """sets and groups as ``links`` takes them, with each large group parted by tokens; the same links are found, some of them repeatedly.

    Sets that link have at least numerator / denominator of either in common.
    So, with the tokens of a group in one order, each has one of their common
    tokens among its first, as many as may differ and one more (prefix
    filtering).  The order is by how often a token occurs in the group, and
    tokens that occur once there are no one's in common.  Set repeats go alike.
    """
    sized = _sized(sets.select("grp", "id", "weight", "tokens"), groups)
    many = sized.filter("__n is not null").drop("__n")
    shared = sets.sparkSession.sparkContext.broadcast(_counts(many))

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            flat, row, size = _listed(b)
            grp = b.column("grp").to_numpy()
            n = shared.value[_cells(grp[row], flat)]
            by = np.lexsort((flat, n, row))
            place = np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)
            first = size - -(-size * numerator // denominator) + 1
            pick = by[(place < first[row]) & (n[by] > 1)]
            of = row[pick]
            key = fmix(fmix(grp[of].view(np.uint64)) + fmix(flat[pick].view(np.uint64)))
            for lo in range(0, len(of), b.num_rows or 1):  # no batch is longer than those that came
                part = b.take(pa.array(of[lo : lo + b.num_rows]))
                yield pa.record_batch([pa.array(key[lo : lo + b.num_rows].view(np.int64)), *[part.column(c) for c in ("id", "weight", "tokens")]], names=["grp", "id", "weight", "tokens"])

    parts = many.mapInArrow(trimmed(keyed), "grp long, id long, weight long, tokens array<long>")
    counted = many.mapInArrow(trimmed(keyed), "grp long, id long, weight long, tokens array<long>").select("grp")
    return sized.filter("__n is null").drop("__n").unionByName(parts), counted


def dealt(sets: DataFrame, groups: DataFrame) -> DataFrame:
    """A row for each pair of blocks (i, j) of its group that a set goes to: all that hold its own (blk), or those that its ``meets`` names."""
    sized = _sized(sets, groups)
    out = sized.withColumn("__k", F.coalesce(blocks_of(F.col("__n")), F.lit(1)))
    out = out.withColumn("__own", block_of(F.col("id"), F.col("__k")))
    others = F.sequence(F.lit(0), F.col("__k") - 1)
    out = out.withColumn("__o", F.explode(F.when(F.col("__k") > 1, F.coalesce("meets", others)).otherwise(others) if "meets" in sets.columns else others))
    return out.select("id", "weight", "tokens", F.col("__own").alias("blk"), "grp", F.least("__own", "__o").alias("i"), F.greatest("__own", "__o").alias("j"))


def links(sets: DataFrame, groups: DataFrame, numerator: int, denominator: int) -> DataFrame:
    """sets (grp, id, weight, tokens: sorted distinct longs; repeats of an id are alike) -> rows (a, b, links).

    ``groups`` has a row (grp) a set, from where that is known without its tokens.
    Sets may bring ``meets``: the blocks of those that they may link with, null for all.

    Rows with a != b are links with |intersection| * denominator >= numerator *
    |union|, enough of them to connect what links connect; rows with a = b
    carry parts of the number of a's links, each other set counted by weight.
    """
    rows = dealt(sets, groups)

    def whole_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """From rows sorted by group and block pair, many whole groups at once."""
        held: list[pa.RecordBatch] = []
        for b in batches:
            if not b.num_rows:
                continue
            # rows of the last group may go on in the next batch
            keys = [b.column(c).to_numpy() for c in ("grp", "i", "j")]
            last = b.num_rows - 1
            begin = int(np.flatnonzero(np.logical_or.reduce([k != k[last] for k in keys]))[-1]) + 1 if any((k != k[last]).any() for k in keys) else 0
            if held and [held[-1].column(c)[held[-1].num_rows - 1] for c in ("grp", "i", "j")] != [b.column(c)[0] for c in ("grp", "i", "j")]:
                yield from compared(held, numerator, denominator)
                held = []
            if begin:
                yield from compared([*held, b.slice(0, begin)], numerator, denominator)
                held = []
            held.append(b.slice(begin))
        if held:
            yield from compared(held, numerator, denominator)

    # without this, the join's partitioning by group would do, and a large group's blocks all stay in one task
    return rows.repartition("grp", "i", "j").sortWithinPartitions("grp", "i", "j", "id").mapInArrow(trimmed(whole_groups), "a long, b long, links long")


def compared(batches: list[pa.RecordBatch], num: int, den: int) -> Iterator[pa.RecordBatch]:
    """Links and numbers of links of whole groups, their rows sorted by group and id."""
    t = pa.Table.from_batches(batches)
    grp, i, j, ids = (t.column(c).to_numpy() for c in ("grp", "i", "j", "id"))
    new = np.ones(len(ids), bool)
    new[1:] = (grp[1:] != grp[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])
    one = new.copy()
    one[1:] |= ids[1:] != ids[:-1]  # repeated rows have one set
    t = t.filter(pa.array(one)).combine_chunks()
    ids, weight, blk, within = (t.column(c).to_numpy() for c in ("id", "weight", "blk", "i"))
    within = within == t.column("j").to_numpy()
    starts = np.flatnonzero(new[one])
    members = np.diff(np.append(starts, len(ids)))
    column = t.column("tokens").combine_chunks()
    column = pa.concat_arrays(column.chunks) if isinstance(column, pa.ChunkedArray) else column
    flat, at = column.values.to_numpy(), column.offsets.to_numpy().astype(np.int64)
    size = np.diff(at)
    u, v = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for m in np.unique(members[(members > 1) & (members <= FEW)]).tolist():
        x, y = np.triu_indices(m, 1)
        u.append((starts[members == m][:, None] + x).ravel())
        v.append((starts[members == m][:, None] + y).ravel())
    u, v = np.concatenate(u), np.concatenate(v)
    # an intersection is no larger than the smaller set
    may = (within[u] | (blk[u] != blk[v])) & (np.minimum(size[u], size[v]) * den >= num * np.maximum(size[u], size[v])) & (size[u] > 0)
    a, b = _linked_pairs(flat, at, size, u[may], v[may], num, den)
    n = np.zeros(len(ids), np.int64)
    np.add.at(n, a, weight[b])
    np.add.at(n, b, weight[a])
    found = [(ids[a], ids[b])]
    for s, m in zip(starts[members > FEW].tolist(), members[members > FEW].tolist(), strict=True):
        both = intersections([flat[at[k] : at[k + 1]] for k in range(s, s + m)])
        own = size[s : s + m]
        linked = both * den >= num * (own[:, None] + own[None, :] - both)
        linked &= (both > 0) & ~np.eye(m, dtype=bool)
        if not within[s]:
            linked &= blk[s : s + m, None] != blk[None, s : s + m]
        edges = np.array(forest(linked), np.int64).reshape(-1, 2) + s
        found.append((ids[edges[:, 0]], ids[edges[:, 1]]))
        n[s : s + m] += linked @ weight[s : s + m]
    some = n > 0
    x = np.concatenate([*[p for p, _ in found], ids[some]])
    y = np.concatenate([*[q for _, q in found], ids[some]])
    if len(x):
        yield pa.record_batch([pa.array(x), pa.array(y), pa.array(np.concatenate([np.zeros(len(x) - int(some.sum()), np.int64), n[some]]))], schema=_OUT)


def _linked_pairs(flat, at, size, u, v, num: int, den: int) -> tuple[np.ndarray, np.ndarray]:
    """Those of the pairs (u, v) of sets that link, by looking the tokens of u up among those of v."""
    if not len(u):
        return u, v
    distinct, dense = np.unique(flat.view(np.uint64), return_inverse=True)  # sets are sorted by unsigned value
    width = len(distinct)
    keys = np.repeat(np.arange(len(size)), size) * width + dense[at[0] : at[-1]]  # ascending: tokens are sorted within each set
    keep = []
    step = np.searchsorted(np.cumsum(size[u]), np.arange(PAIR_TOKENS, size[u].sum() + PAIR_TOKENS, PAIR_TOKENS), "right") + 1
    lo = 0
    for hi in np.unique(np.minimum(step, len(u))).tolist():
        p, q = u[lo:hi], v[lo:hi]
        if not len(p):
            continue
        n = size[p]
        first = np.cumsum(n) - n
        token = np.arange(n.sum()) - np.repeat(first, n) + np.repeat(at[p] - at[0], n)
        ask = np.repeat(q, n) * width + dense[at[0] + token]
        hit = keys[np.minimum(np.searchsorted(keys, ask), len(keys) - 1)] == ask
        both = np.add.reduceat(hit.astype(np.int64), first)
        keep.append(lo + np.flatnonzero((both > 0) & (both * den >= num * (size[p] + size[q] - both))))
        lo = hi
    keep = np.concatenate(keep)
    return u[keep], v[keep]
