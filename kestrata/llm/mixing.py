"""Mixing sources to target weights by fixed-length token blocks.

Each source's words, its documents in a seeded order, are one sequence cut
into blocks of ``BLOCK`` words.  A source's quota of slots is its target over
the mean words of its blocks.  Every output shard has equally many slots; a
multinomial draw decides how many of them each source fills, with the shares
of what the quotas still lack as probabilities (the stated correction: draws
beyond a quota are drawn anew, so the counts of all shards add up to the
quotas).  A source's slots are numbered through the shards; slot k takes block
perm((k mod blocks)) of pass k div blocks, where perm is a keyed pseudorandom
permutation of the source's block indexes, and slots meet blocks in a join by
(source, run of block indexes).

Defined results: a null source is a source of its own and comes last; a null,
empty or blank text has size 0 and is never taken; repeated rows are mixed one
by one; an empty table gives no rows; targets are 0 where all sizes are 0;
further columns are kept by ``mixed_documents`` and ignored by ``taken_words``.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._spark import WORD, cut, hinted, seeded, stratum

BLOCK = 32
OUT_SHARDS = 64
SLOTS_PER_ROW = 1 << 16
SLOTS_PER_TASK = 1 << 19
MOST_PASSES = 3
BUCKET_BLOCKS = 1024  # of a source that meet their slots in one group
ROWS_PER_BUCKET = 2000


def permuted(i: np.ndarray, n: int, key: int) -> np.ndarray:
    """A keyed bijection of 0..n-1: four Feistel rounds on the next even power of two, walked until inside."""
    half = max(1, (max(n - 1, 1).bit_length() + 1) // 2)
    mask = np.uint64((1 << half) - 1)
    out = i.astype(np.uint64)
    todo = np.arange(len(out))
    while len(todo):
        left, right = out[todo] >> np.uint64(half), out[todo] & mask
        for r in range(4):
            f = (right + np.uint64(key * 4 + r + 1)) * np.uint64(0x9E3779B97F4A7C15)
            f ^= f >> np.uint64(29)
            f *= np.uint64(0xBF58476D1CE4E5B9)
            left, right = right, left ^ ((f >> np.uint64(32)) & mask)
        out[todo] = (left << np.uint64(half)) | right
        todo = todo[out[todo] >= n]
    return out.astype(np.int64)


def targets(sizes: DataFrame) -> DataFrame:
    """stratum, source_size -> the same and target: weights 1, 2, 3, repeating, capped at three times the size.

    The sources that reach their cap are those first in cap / weight, so the
    repeated resharing has a closed form over running sums of that order.
    """
    every = Window.partitionBy()
    named = Window.orderBy(F.when(F.col("stratum") == "n", 1).otherwise(0), "stratum")
    t = (
        sizes.withColumn("w", (F.row_number().over(named) - 1) % 3 + 1)
        .withColumn("cap", (3 * F.col("source_size")).cast("long"))
        .withColumn("total", F.sum("source_size").over(every))
        .withColumn("weights", F.sum("w").over(every))
    )
    first = Window.orderBy(F.col("cap") / F.col("w"), "stratum").rowsBetween(Window.unboundedPreceding, -1)
    t = t.withColumn("cap_before", F.coalesce(F.sum("cap").over(first), F.lit(0))).withColumn("w_before", F.coalesce(F.sum("w").over(first), F.lit(0)))
    full = (F.col("total") - F.col("cap_before")) * F.col("w") > F.col("cap") * (F.col("weights") - F.col("w_before"))
    t = t.withColumn("full", full)
    t = t.withColumn("rest", F.col("total") - F.sum(F.when(F.col("full"), F.col("cap")).otherwise(0)).over(every))
    t = t.withColumn("rest_w", F.col("weights") - F.sum(F.when(F.col("full"), F.col("w")).otherwise(0)).over(every))
    share = (F.col("rest") * F.col("w")).cast("double") / F.col("rest_w").cast("double")
    return t.select("stratum", "source_size", F.when(F.col("full"), F.col("cap").cast("double")).otherwise(share).alias("target"))


def _placed(docs: DataFrame, seed: int, keep: list[str]) -> DataFrame:
    """Rows with size, stratum and start: the words of the source before the row's own."""
    total = docs.count()
    bits = min(24, max(8, math.ceil(math.log2(max(1, total / ROWS_PER_BUCKET)))))
    rows = docs.select(
        *keep,
        stratum(F.col("source")).alias("stratum"),
        seeded(seed, F.col("doc_id"), F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary"))).alias("__h"),
        F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        F.xxhash64("text").alias("__x"),
    ).withColumn("__b", F.shiftright("__h", 60 - bits))
    before = rows.groupBy("stratum", "__b").agg(F.sum("size").alias("__n"))
    before = before.withColumn("__before", F.sum("__n").over(Window.partitionBy("stratum").orderBy("__b")) - F.col("__n")).drop("__n")
    within = Window.partitionBy("stratum", "__b").orderBy("__h", "doc_id", "__x", "size").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("__sum", F.sum("size").over(within)).join(before, ["stratum", "__b"])
    return rows.withColumn("start", F.col("__before") + F.col("__sum") - F.col("size")).drop("__h", "__x", "__b", "__sum", "__before")


def shard_counts(quotas: np.ndarray, shards: int, seed: int) -> Iterator[np.ndarray]:
    """For each output shard, how many of its slots each source fills: a multinomial draw by what the quotas still lack."""
    left = quotas.astype(np.int64)
    for shard in range(shards):
        rng, counts = np.random.default_rng([seed, shard]), np.zeros(len(left), np.int64)
        todo = int(left.sum()) // (shards - shard)
        while todo:
            room = left - counts
            drawn = np.minimum(rng.multinomial(todo, room / room.sum()), room)
            counts += drawn
            todo -= int(drawn.sum())
        left = left - counts
        yield counts


def _slots(quotas: DataFrame, seed: int, shards: int) -> DataFrame:
    """stratum, out_shard, block, pass for every slot of the mix."""

    def dealt(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        every = [b for b in batches if len(b)]
        if not every:
            return
        q = pd.concat(every).sort_values("stratum")  # a row a source
        names, blocks, at = q.stratum.tolist(), q.blocks.tolist(), np.zeros(len(q), np.int64)
        for shard, counts in enumerate(shard_counts(q.slots.to_numpy(), shards, seed)):
            rows = [(names[i], shard, lo, min(int(at[i] + counts[i]), lo + SLOTS_PER_ROW), blocks[i]) for i in np.flatnonzero(counts).tolist() for lo in range(int(at[i]), int(at[i] + counts[i]), SLOTS_PER_ROW)]
            at += counts
            yield pd.DataFrame(rows, columns=["stratum", "out_shard", "lo", "hi", "blocks"]).astype({"out_shard": "int32"})

    def mapped(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for s, shard, lo, hi, n in b.itertuples(index=False):
                k = np.arange(lo, hi)
                yield pd.DataFrame({"stratum": s, "out_shard": np.int32(shard), "block": permuted(k % n, n, zlib.crc32(s.encode()) ^ seed), "pass": (k // n).astype("int32")})

    ranges = quotas.select("stratum", "slots", "blocks").coalesce(1).mapInPandas(dealt, "stratum string, out_shard int, lo long, hi long, blocks long")
    total = quotas.agg(F.sum("slots")).first()[0] or 0  # the ranges are tiny rows, so tasks are counted by the slots they spread to
    ranges = ranges.repartition(min(100_000, total // SLOTS_PER_TASK + 1), "stratum", "out_shard", "lo")
    return ranges.mapInPandas(mapped, "stratum string, out_shard int, block long, pass int")


def _mix(rows: DataFrame, seed: int, shards: int) -> tuple[DataFrame, DataFrame]:
    """Quotas by source, and the slots."""
    sizes = rows.groupBy("stratum").agg(F.sum("size").alias("source_size"))
    quotas = targets(sizes).withColumn("blocks", F.ceil(F.col("source_size") / BLOCK).cast("long"))
    slots = F.when(F.col("source_size") > 0, F.least(F.round(F.col("target") * F.col("blocks") / F.col("source_size")).cast("long"), MOST_PASSES * F.col("blocks")))
    quotas = cut(quotas.withColumn("slots", F.coalesce(slots, F.lit(0)).cast("long")))
    return quotas, _slots(quotas.filter("slots > 0"), seed, shards)


def _overlaps(docs: pa.Table, slots: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of the documents (by start) and slots of one run of blocks: slot, document, first word within the document, and words, for each two that meet."""
    start, size, block = (t.column(c).to_numpy() for t, c in ((docs, "start"), (docs, "size"), (slots, "block")))
    lo, hi = block * BLOCK, (block + 1) * BLOCK
    first, last = np.searchsorted(start + size, lo, "right"), np.searchsorted(start, hi, "left")
    n = last - first
    slot = np.repeat(np.arange(len(block)), n)
    doc = np.arange(len(slot)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first, n)
    a, b = np.maximum(start[doc], lo[slot]), np.minimum(start[doc] + size[doc], hi[slot])
    return slot, doc, a - start[doc], b - a


def _meet(rows: DataFrame, slots: DataFrame, emit, schema: str) -> DataFrame:
    """emit(documents by start, slots) over every (source, run of blocks); a document stands in each run that it has words in.

    A group has at most MOST_PASSES slots a block and the documents of BUCKET_BLOCKS * BLOCK words.
    """
    span = BLOCK * BUCKET_BLOCKS
    left = rows.filter("size > 0").withColumn("n_runs", F.expr(f"cast((start + size - 1) div {span} - start div {span} + 1 as int)"))
    left = left.withColumn("run", F.explode(F.sequence(F.expr(f"start div {span}"), F.expr(f"(start + size - 1) div {span}"))))
    right = slots.withColumn("run", F.expr(f"block div {BUCKET_BLOCKS}"))

    def met(docs: pa.Table, own: pa.Table) -> pa.Table:
        return emit(docs.sort_by([("start", "ascending")]).combine_chunks(), own)

    return left.groupBy("stratum", "run").cogroup(right.groupBy("stratum", "run")).applyInArrow(met, schema)


def _lists(of: np.ndarray, n: int, kind: pa.StructType, *columns: np.ndarray) -> pa.Array:
    """Lists of structs for rows 0..n-1, from columns whose rows belong to ``of`` (ascending)."""
    at = np.searchsorted(of, np.arange(n + 1))
    return pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.StructArray.from_arrays([pa.array(c).cast(f.type) for c, f in zip(columns, kind, strict=True)], fields=list(kind)))


_BY_SHARD = pa.struct([("shard", pa.int32()), ("words", pa.int64())])
_PART = pa.struct([("from", pa.int64()), ("words", pa.int64())])


def taken_words(docs: DataFrame, seed: int = 29, shards: int = OUT_SHARDS) -> DataFrame:
    """doc_id, size, source_size, target, taken, and by_shard (shard, words: what each output shard takes) of every document."""
    rows = cut(_placed(docs, seed, ["doc_id"]))
    quotas, slots = _mix(rows, seed, shards)

    def emit(docs: pa.Table, own: pa.Table) -> pa.Table:
        n = docs.num_rows
        slot, doc, _, words = _overlaps(docs, own)
        cell, at = np.unique(doc * shards + own.column("out_shard").to_numpy()[slot], return_inverse=True)
        sums = np.zeros(len(cell), np.int64)
        np.add.at(sums, at, words)
        lists = _lists(cell // shards, n, _BY_SHARD, cell % shards, sums)
        return docs.select(["doc_id", "stratum", "start", "size", "n_runs"]).append_column("by_shard", lists)

    met = _meet(rows, slots.select("stratum", "block", "out_shard"), emit, "doc_id long, stratum string, start long, size long, n_runs int, by_shard array<struct<shard:int,words:long>>")
    one = met.filter("n_runs = 1").select("doc_id", "stratum", "size", "by_shard")
    parts = met.filter("n_runs > 1").groupBy("doc_id", "stratum", "start", "size").agg(F.flatten(F.collect_list("by_shard")).alias("parts"))
    each = "transform(array_sort(array_distinct(transform(parts, p -> p.shard))), s -> struct(s as shard, aggregate(filter(parts, p -> p.shard = s), 0L, (n, p) -> n + p.words) as words))"
    several = parts.select("doc_id", "stratum", "size", F.expr(each).alias("by_shard"))
    none = rows.filter("size = 0").select("doc_id", "stratum", "size", F.expr("cast(array() as array<struct<shard:int,words:long>>)").alias("by_shard"))
    every = one.unionByName(several).unionByName(none).withColumn("taken", F.expr("aggregate(by_shard, 0L, (n, p) -> n + p.words)"))
    return every.join(hinted(quotas.select("stratum", "source_size", "target"), 100_000), "stratum").select("doc_id", "size", "source_size", "target", "taken", "by_shard")


def _joined(text: pd.Series, starts: pd.Series, counts: pd.Series) -> pd.Series:
    """The words of a text in the given ranges; each text is split once."""
    out = []
    for t, lo, n in zip(text, starts, counts, strict=True):
        w = t.encode().split() if t is not None else []
        out.append(b" ".join(x for i, k in zip(lo, n, strict=True) for x in w[i : i + k]).decode() if t is not None else None)
    return pd.Series(out)


def mixed_documents(docs: DataFrame, seed: int = 29, shards: int = OUT_SHARDS) -> DataFrame:
    """The mix as documents: for each pass that takes any of its blocks, a row with the words taken.

    Blocks of one document and pass are joined again in their order, whatever
    shards drew them, so a pass that takes all of a document returns its very text.
    """
    names = docs.columns
    rows = _placed_named(docs, seed)
    starts = cut(rows.select("stratum", "start", "size"))
    _, slots = _mix(starts, seed, shards)

    def emit(docs: pa.Table, own: pa.Table) -> pa.Table:
        slot, doc, first, words = _overlaps(docs, own)
        cell = doc * MOST_PASSES + own.column("pass").to_numpy()[slot]
        order = np.lexsort((first, cell))
        cell, first, words = cell[order], first[order], words[order]
        some, at = np.unique(cell, return_index=True)
        lists = _lists(np.repeat(np.arange(len(some)), np.diff(np.append(at, len(cell)))), len(some), _PART, first, words)
        out = docs.select(["stratum", "start", "n_runs"]).take(pa.array(some // MOST_PASSES))
        return out.append_column("pass", pa.array((some % MOST_PASSES).astype(np.int32))).append_column("parts", lists)

    met = _meet(starts, slots.select("stratum", "block", "pass"), emit, "stratum string, start long, n_runs int, pass int, parts array<struct<from:long,words:long>>")
    one = met.filter("n_runs = 1").select("stratum", "start", "pass", "parts")
    several = met.filter("n_runs > 1").groupBy("stratum", "start", "pass").agg(F.sort_array(F.flatten(F.collect_list("parts"))).alias("parts"))
    takes = one.unionByName(several).withColumn("got", F.expr("aggregate(parts, 0L, (n, p) -> n + p.words)"))
    out = rows.filter("size > 0").join(takes.hint("merge"), ["stratum", "start"])
    whole = F.col("got") == F.col("size")
    some = F.pandas_udf(_joined, "string")(F.when(~whole, F.col("row.text")), F.col("parts.from"), F.col("parts.words"))
    text = F.when(whole, F.col("row.text")).otherwise(some)
    out = out.withColumn("__text", text)
    length = {"n_chars": F.when(F.col("row.n_chars").isNotNull(), F.length("__text")).cast("long")} if "n_chars" in names else {}
    return out.select(*[F.col("__text").alias(c) if c == "text" else length[c].alias(c) if c in length else F.col(f"row.`{c}`").alias(c) for c in names])


def _placed_named(docs: DataFrame, seed: int) -> DataFrame:
    """As _placed, the input's columns in one struct so that no name clashes."""
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), "doc_id", "source", "text")
    return _placed(packed, seed, ["row", "doc_id"])
