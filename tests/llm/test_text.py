import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from kestrata.llm._dc3 import suffix_array
from kestrata.llm._fm import FMIndex
from kestrata.llm._spark import BATCH_ROWS, small_batches
from kestrata.llm._text import alnum_spans, chunks, shingle_sets, spans, trimmed, words
from kestrata.llm.mixing import permuted
from kestrata.llm.ppm import HashTable

from .brute import alnum, shingles
from .brute import words as plain_words

TEXTS = st.lists(st.none() | st.text("aB c\t\né.9", max_size=30), max_size=8)


@settings(max_examples=200, deadline=None)
@given(TEXTS)
def test_words_are_those_of_the_bytes(texts):
    for limit in (1, 20, 1 << 20):
        got, other, known = [], [], {}
        for c in chunks(pa.array(texts, pa.string()), limit):
            raw = c.buf.tobytes().lower()
            for how, out in ((spans, got), (alnum_spans, other)):
                s, e, first = how(c)
                out += [[raw[a:b] for a, b in zip(s[first[d] : first[d + 1]], e[first[d] : first[d + 1]], strict=True)] for d in range(c.docs)]
            h, first = words(c)
            flat = [w for d in got[len(got) - c.docs :] for w in d]
            for w, x in zip(flat, h.tolist(), strict=True):
                assert known.setdefault(w, x) == x
        assert got == [plain_words(t) for t in texts] and other == [alnum(t) for t in texts]
        assert len(set(known.values())) == len(known)


@settings(max_examples=100, deadline=None)
@given(TEXTS, st.integers(1, 4))
def test_shingle_sets(texts, k):
    sizes, names = [], {}
    for c in chunks(pa.array(texts, pa.string())):
        v, at = shingle_sets(c, k)
        for d in range(c.docs):
            own = v[at[d] : at[d + 1]].tolist()
            assert own == sorted(set(own))
            plain = shingles(plain_words(texts[c.first + d]), k)
            sizes.append(len(own) == len(plain))
            assert names.setdefault(frozenset(plain), own) == own
    assert all(sizes)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 3), max_size=60), st.integers(1, 20))
def test_suffix_arrays(text, depth):
    t = np.array(text, np.int64)
    assert suffix_array(t).tolist() == sorted(range(len(t)), key=lambda i: text[i:])
    prefixes = [tuple(text[i : i + depth]) for i in suffix_array(t, depth)]
    assert prefixes == sorted(prefixes) and sorted(suffix_array(t, depth).tolist()) == list(range(len(t)))


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 5), min_size=1, max_size=80), st.lists(st.integers(0, 6), min_size=1, max_size=4))
def test_fm_index_finds_every_occurrence(text, pattern):
    index = FMIndex(np.array(text))
    lo, hi = index.search(np.array([pattern]))
    found = sorted(index.locate(np.arange(lo[0], hi[0])).tolist()) if lo[0] < hi[0] else []
    assert found == [i for i in range(len(text) - len(pattern) + 1) if text[i : i + len(pattern)] == pattern]


def test_permutations_and_hash_tables():
    for n in (1, 2, 3, 7, 64, 1000):
        assert sorted(permuted(np.arange(n), n, 5).tolist()) == list(range(n))
    assert permuted(np.arange(1000), 1000, 5).tolist() != permuted(np.arange(1000), 1000, 6).tolist()
    keys = np.arange(5000, dtype=np.uint64) * np.uint64(7919)
    values, found = HashTable(keys, np.arange(5000, dtype=np.float32)).get(np.concatenate([keys, keys + np.uint64(1)]))
    assert found[:5000].all() and not found[5000:].any() and values[:5000].tolist() == list(range(5000)) and not values[5000:].any()


def test_session_settings_hold_where_none_are_set(spark):
    ours = ("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS)), ("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")
    session = spark.newSession()
    small_batches(session)
    assert all(session.conf.get(name) == value for name, value in ours)
    session.conf.set(ours[0][0], "77")
    small_batches(session)
    assert session.conf.get(ours[0][0]) == "77"


def test_arrow_batches_of_long_rows_are_bounded(spark):
    def sizes(batches):
        for b in batches:
            yield pa.record_batch([pa.array([b.nbytes])], names=["size"])

    session = spark.newSession()
    small_batches(session)
    rows = session.range(0, 200, 1, 1).select(F.repeat(F.lit("long row "), 20_000).alias("text"))
    found = [r[0] for r in rows.mapInArrow(sizes, "size long").collect()]
    assert sum(found) > 30 << 20 and max(found) < 6 << 20


def test_a_task_gives_freed_memory_back():
    def held():
        with open("/proc/self/statm") as f:
            return int(f.read().split()[1]) * 4096

    def work(batches):
        small = [np.ones(6000) for _ in range(4000)]  # below the size of arrays that are mapped on their own
        keep.append(np.ones(6000))  # a later one that stays
        yield from batches
        del small

    keep = []
    before = held()
    assert list(trimmed(work)(iter([1]))) == [1]
    assert held() - before < 60 << 20
